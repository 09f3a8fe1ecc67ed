"""Fitted recipes on Structured Streaming."""

from plumbline.streaming.apply import apply_to_stream, write_prepared

__all__ = ["apply_to_stream", "write_prepared"]
