"""Deterministic identifiers as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column | str, length: int = 16, sep: str = ":") -> Column:
    """First `length` hex digits of the SHA-256 of the parts joined by `sep`."""
    return F.substring(F.sha2(F.concat_ws(sep, *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts]), 256), 1, length)


def file_id(path: Column | str) -> Column:
    return digest(path)


def symbol_id(file: Column | str, qualified: Column | str) -> Column:
    return digest(file, qualified)


def edge_id(rel: Column | str, source: Column | str, target: Column | str) -> Column:
    return digest(rel, source, target)


def chunk_id(file: Column | str, start: Column | str, end: Column | str) -> Column:
    return digest(file, start, end, length=32)


def qualified_name(path: Column, parent: Column, name: Column) -> Column:
    """path::Parent.name, or path::name without a parent."""
    return F.concat(path, F.lit("::"), F.coalesce(F.concat(parent, F.lit(".")), F.lit("")), name)


def point_id(chunk: Column) -> Column:
    """The integer of a chunk id's first 15 hex digits."""
    return F.conv(F.substring(chunk, 1, 15), 16, 10).cast("long")
