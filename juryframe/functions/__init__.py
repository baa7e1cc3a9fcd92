"""functions of juryframe."""
