"""Texts of an Arrow batch as flat numpy arrays, and runs of equal keys over sorted batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters handled at once; numpy's temporaries are some tens of bytes for each.
SLICE_CHARS = 1 << 20


def text_slices(column: pa.Array, budget: int = SLICE_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for slices of about `budget` characters; one longer text is a slice of its own. Null reads as empty."""
    start, size, held = 0, 0, []
    for k, text in enumerate(column.to_pylist()):
        text = text or ""
        if held and size + len(text) > budget:
            yield start, held
            start, size, held = k, 0, []
        held.append(text)
        size += len(text) + 1
    if held:
        yield start, held


def code_points(texts: list[str], pad: str = " ") -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each between two pads, and the bounds of each text with its pads."""
    joined = pad + (pad + pad).join(texts) + pad
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 2
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lengths, out=bounds[1:])
    return points, bounds


def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A 32-bit finalizer over uint32 hashes; another salt gives another hash."""
    h = h ^ np.uint32(salt)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    h *= np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    return h


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer over uint64 hashes."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(points: np.ndarray, orders: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray]]:
    """(n, rolling uint32 hash of the n-gram that starts at each position); grams that run over a text's end are the caller's to drop."""
    top, h = max(orders), points.astype(np.uint32) * np.uint32(0x9E3779B1)
    if 1 in orders:
        yield 1, h
    for n in range(2, top + 1):
        if len(h) < 2:
            return
        h = h[:-1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        if n in orders:
            yield n, h


def gram_ends(bounds: np.ndarray, n: int) -> np.ndarray:
    """Positions at which an n-gram would leave its text."""
    ends = bounds[1:, None] - np.arange(1, n)[None, :]
    return ends[ends >= np.maximum(bounds[:-1], 0)[:, None]]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values over each text; values may be shorter than the last bound by the length of a gram."""
    starts = np.minimum(bounds[:-1], max(len(values) - 1, 0))
    return np.add.reduceat(values, starts) if len(values) else np.zeros(len(starts))


def sorted_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole runs of equal keys from batches sorted by them, several runs to a table; a run may span batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        starts, n, first = run_starts(batch, keys), batch.num_rows, 0
        if held and same_key(held[-1], batch, keys):
            first = int(starts[1]) if len(starts) > 1 else n
            held.append(batch.slice(0, first))
            if first == n:
                continue
        if held:
            yield pa.Table.from_batches(held)
        last = int(starts[-1])
        if last > first:
            yield pa.Table.from_batches([batch.slice(first, last - first)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def key_matrix(batch, keys: list[str]) -> list[np.ndarray]:
    return [np.asarray(batch.column(k).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(k).to_numpy()) for k in keys]


def run_starts(batch, keys: list[str]) -> np.ndarray:
    """First row of each run of equal keys."""
    n = batch.num_rows
    change = np.zeros(n, bool)
    change[0] = True
    for column in key_matrix(batch, keys):
        change[1:] |= column[1:] != column[:-1]
    return np.flatnonzero(change)


def same_key(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def list_matrix(column, width: int, dtype) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(dtype, copy=False)


def list_rows(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: places and values, as a matrix of doubles, of the lists of numbers that are neither null nor empty. A null number reads as NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    starts = np.cumsum(lengths) - lengths
    found = {}
    for width in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == width)
        found[width] = rows, (values.reshape(-1, width) if len(rows) * width == len(values) else values[starts[rows, None] + np.arange(width)])
    return found
