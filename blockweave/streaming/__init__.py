"""Structured Streaming over traffic events."""
