"""Structured Streaming jobs over service logs."""
