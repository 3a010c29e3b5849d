"""Structured Streaming over the store and over command streams."""
