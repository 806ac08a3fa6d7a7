"""Structured Streaming over append-only logs: ratings, feedback, progress."""
