"""Structured Streaming over the write feed."""
