"""Streaming forms of the mergeable aggregates."""
