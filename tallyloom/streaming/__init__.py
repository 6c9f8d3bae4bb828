"""Structured Streaming forms of the run and gauge rollups."""
