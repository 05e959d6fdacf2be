"""Streams: incremental indexing of arriving files, and sessions over event streams."""
