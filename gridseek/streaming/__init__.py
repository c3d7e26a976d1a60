"""Queries that arrive as a stream."""
