"""Structured Streaming twins of the time operators."""
