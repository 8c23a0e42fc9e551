"""Structured Streaming over run histories."""
