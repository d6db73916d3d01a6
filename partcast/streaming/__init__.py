"""Incremental (Structured Streaming) versions of the daily demand roll-up."""
