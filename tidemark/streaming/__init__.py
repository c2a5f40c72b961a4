"""Structured Streaming over the change stream."""
