"""Linkage of records that arrive as a stream."""
