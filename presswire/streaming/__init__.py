"""Structured Streaming over feeds."""
