"""Structured Streaming jobs (O1-O3)."""
