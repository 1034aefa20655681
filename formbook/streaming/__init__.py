"""Structured Streaming versions of the scoring and as-of operators."""
