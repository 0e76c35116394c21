"""Streams of elements against a static synteny map."""

from .unique import stream_elements, stream_unique

__all__ = ["stream_elements", "stream_unique"]
