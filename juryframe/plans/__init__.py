"""plans of juryframe."""
