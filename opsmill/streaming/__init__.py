"""Structured Streaming versions of the continuously refreshed tables."""
