"""operators of juryframe."""
