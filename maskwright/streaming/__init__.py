"""Structured Streaming jobs built from the same column functions."""
