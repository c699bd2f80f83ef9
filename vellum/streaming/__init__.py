"""Incremental (Structured Streaming) versions of the scheduled jobs."""
