"""Structured Streaming forms of the journal and the tables they keep."""
