"""Members of hash buckets, split into blocks so that no task holds more than two blocks of a bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .arrays import mix64, run_starts, sorted_runs


def bucket_members(keys: DataFrame, block: int, more: list[str] = []) -> DataFrame:  # noqa: B006
    """uid, key, the columns `more`, lo, hi, block: members of buckets of two and more, once for every pair of blocks that they are compared in.

    keys has uid, key and `more`, all numbers; a bucket is a run of equal key and `more`. It is shuffled once, by key:
    20 bytes or so a row. A bucket of up to `block` members is one block, and costs no row more.
    """
    ship(keys.sparkSession)
    order = ["key", *more]
    names = ["uid", *order, "lo", "hi", "block"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, order):
            starts = run_starts(table, order)
            sizes = np.diff(np.append(starts, table.num_rows))
            columns = [np.asarray(table.column(c).to_numpy()) for c in ("uid", *order)]
            small = (sizes > 1) & (sizes <= block)
            at = np.flatnonzero(np.repeat(small, sizes))
            if len(at):
                zero = np.zeros(len(at), np.int32)
                yield pa.RecordBatch.from_arrays([*(pa.array(c[at]) for c in columns), *(pa.array(zero) for _ in range(3))], names=names)
            for k in np.flatnonzero(sizes > block).tolist():
                rows = slice(int(starts[k]), int(starts[k] + sizes[k]))
                blocks = -(-int(sizes[k]) // block)
                own = (mix64(columns[0][rows].view(np.uint64)) % np.uint64(blocks)).astype(np.int32)
                for other in range(blocks):
                    made = [*(pa.array(c[rows]) for c in columns), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own)]
                    yield pa.RecordBatch.from_arrays(made, names=names)

    kinds = ", ".join(f"{c} {keys.schema[c].dataType.simpleString()}" for c in ("uid", *order))
    return keys.repartition("key").sortWithinPartitions(*order, "uid").mapInArrow(run, f"{kinds}, lo int, hi int, block int")
