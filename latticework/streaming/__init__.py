"""Edges that arrive as a stream, merged into tables batch by batch."""

from .ingest import merge_degrees, stream_degrees

__all__ = ["merge_degrees", "stream_degrees"]
