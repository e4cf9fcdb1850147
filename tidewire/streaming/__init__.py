"""Structured Streaming jobs and their keyed state."""
