"""Structured Streaming versions of the daily operators."""
