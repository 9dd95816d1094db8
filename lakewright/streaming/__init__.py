"""Structured Streaming forms of landing and keyed merge."""

from lakewright.streaming.stream import land_stream, merge_stream, windowed_counts

__all__ = ["land_stream", "merge_stream", "windowed_counts"]
