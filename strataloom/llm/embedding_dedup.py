"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, connected components.

Equal vectors of one label are set aside first and count as one vector with a weight. Only keys (a number for the
vector and a hash of label, table and signs) are shuffled for all vectors; the vectors themselves go only where a
bucket holds two or more.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .arrays import list_rows, mix64, run_starts, sorted_runs
from .buckets import bucket_members
from .components import connected_components
from .workspace import Workspace

#: The probability that a pair at the threshold shares no table.
MISS = 1e-4
#: Vectors of a bucket that are compared at once; a larger bucket is split in blocks of about so many and block pairs.
BLOCK = 1024
#: Bytes of gathered vectors that are verified at once.
GATHER = 32 << 20


def plan_tables(rows: int, least: float, miss: float = MISS) -> tuple[int, int]:
    """(tables, signs) for the most rows that one label has.

    Signs grow with the logarithm of the rows, so that unrelated vectors rarely meet at any size. Two vectors at
    cosine c differ in a sign with probability acos(c) / pi; there are as many tables as it takes for such a pair to
    share none with probability `miss`: 22 of 16 signs at 0.98 and up to 2,048 rows, 33 of 22 at 131,072.
    """
    signs = min(48, max(16, math.ceil(math.log2(max(rows, 1))) + 5))
    share = (1 - math.acos(min(least, 1.0)) / math.pi) ** signs
    return (max(1, math.ceil(math.log(miss) / math.log(1 - share))) if share < 1 else 1), signs


def hyperplanes(width: int, tables: int, signs: int, seed: int = 20) -> np.ndarray:
    """Fixed random directions, the same in every task."""
    return np.random.default_rng((seed, width)).standard_normal((width, tables * signs))


def usable(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: rows and values in double precision. Null, empty, zero and non-finite vectors are left out."""
    found = {}
    for width, (rows, x) in list_rows(column).items():
        good = np.isfinite(unit_rows(x)).all(axis=1)
        if good.any():
            found[width] = rows[good], np.ascontiguousarray(x[good])
    return found


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; not finite where a row is zero or not finite. Scaled by the largest component first, so that no square overflows or vanishes."""
    with np.errstate(all="ignore"):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def signatures(rows: DataFrame, tables: int, signs: int) -> DataFrame:
    """f1, f2 (fingerprint of the components), id, label, width, raw (the components' bytes), sig (one number a table) of the vectors that can link."""
    ship(rows.sparkSession)
    weights = (1 << np.arange(signs)).astype(np.int64)
    single = "float" in rows.schema["v"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for batch in batches:
            for width, (at, x) in usable(batch.column("v")).items():
                if width not in planes:
                    planes[width] = hyperplanes(width, tables, signs)
                bits = (unit_rows(x) @ planes[width] >= 0).reshape(len(at), tables, signs)
                sig = (bits * weights).sum(axis=2)
                raw = [r.tobytes() for r in (x.astype(np.float32) if single else x) + 0.0]  # -0.0 is 0.0
                prints = np.array([np.frombuffer(hashlib.blake2b(r, digest_size=16).digest(), np.int64) for r in raw])
                pick = pa.array(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(prints[:, 0].copy()), pa.array(prints[:, 1].copy()), batch.column("id").take(pick), batch.column("label").take(pick), pa.array(np.full(len(at), width, np.int32)), pa.array(raw, pa.binary()), pa.array([r.tobytes() for r in sig.astype(np.uint32 if signs <= 32 else np.uint64)], pa.binary())],
                    names=["f1", "f2", "id", "label", "width", "raw", "sig"],
                )

    kind = rows.schema["label"].dataType.simpleString()
    return rows.mapInArrow(run, f"f1 long, f2 long, id long, label {kind}, width int, raw binary, sig binary")


def bucket_links(unit: np.ndarray, sig: np.ndarray, weight: np.ndarray, table: int, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row, each counted as often as the partner's weight, and the row that stands for its links' component.

    A pair is counted in the first table that it shares, so no pair is counted twice over all tables. With `side`,
    only pairs of one row on each side count (blocks of a split bucket). Pairs stay in this function.
    """
    n = len(unit)
    links, root = np.zeros(n, np.int64), np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    step, gather = 256, max(1, GATHER // (16 * unit.shape[1]))
    for a in range(0, n, step):
        close = unit[a : a + step] @ unit[a:].T >= least - 1e-12
        every_i, every_j = np.nonzero(close)
        every_i, every_j = every_i + a, every_j + a
        keep = every_j > every_i
        if side is not None:
            keep &= side[every_i] != side[every_j]
        every_i, every_j = every_i[keep], every_j[keep]
        for g in range(0, len(every_i), gather):
            i, j = every_i[g : g + gather], every_j[g : g + gather]
            exact = np.einsum("ij,ij->i", unit[i], unit[j]) >= least
            if table:
                exact &= ~(sig[i, :table] == sig[j, :table]).any(axis=1)
            i, j = i[exact], j[exact]
            links += np.bincount(i, weights=weight[j], minlength=n).astype(np.int64) + np.bincount(j, weights=weight[i], minlength=n).astype(np.int64)
            for x, y in zip(i.tolist(), j.tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
    return links, np.array([find(x) for x in range(n)], np.int64)


def near_duplicates(rows: DataFrame, least: float = 0.98, tables: int | None = None, signs: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of `rows`.

    Only vectors of equal, non-null label (of whatever type) are compared; null, zero and non-finite vectors link with
    nothing and stand alone. Copies, equal in label and components, are told by a fingerprint and become one vector
    with a weight, so any number of copies costs what one costs. Every other vector has a key in each table; only
    buckets of two and more call for the vectors. A bucket above BLOCK vectors is split by a hash into blocks, and each
    pair of blocks is a task of its own, so no task holds more than two blocks. A task gives a vector's count of links
    and one edge to its component, never pairs. Ids are meant to be unique. Where an id repeats, its rows are vectors
    of their own, with a row each in the result: each counts its own links, and rows of one id share a component. A
    null id stands alone. Extra columns are ignored; empty tables give empty results.
    """
    spark = rows.sparkSession
    ws = Workspace(spark, "embedding-dedup")
    everyone = rows.select(F.col(id_column).cast("long").alias("id"), F.col(label_column).alias("label"), F.col(vector_column).alias("v"))
    base = everyone.filter("id is not null and label is not null and v is not null")
    if tables is None or signs is None:
        most = base.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        tables, signs = plan_tables(most, least)
    # each distinct vector once, with its number, the least of its ids and how many it stands for
    signed = signatures(base, tables, signs)
    same = ["f1", "f2", "label", "width"]
    members = ws.keep(signed.select("id", *same), "members")
    classes = signed.groupBy(*same).agg(F.count("*").alias("weight"), F.min("id").alias("least_id"), F.any_value("raw").alias("raw"), F.any_value("sig").alias("sig"))
    classes = ws.keep(classes.withColumn("uid", F.monotonically_increasing_id()), "classes")
    kind = np.uint32 if signs <= 32 else np.uint64
    number = np.dtype(np.float32 if "float" in rows.schema[vector_column].dataType.elementType.simpleString() else np.float64)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), kind).reshape(-1, tables).astype(np.uint64)
            salt = batch.column("salt").to_numpy().view(np.uint64)
            key = mix64(sig ^ mix64(salt[:, None] + np.arange(tables, dtype=np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("uid").to_numpy(), tables)), pa.array(key.ravel().view(np.int64)), pa.array(np.tile(np.arange(tables, dtype=np.int32), batch.num_rows))], names=["uid", "key", "t"])

    keys = classes.select("uid", "sig", F.xxhash64("label", "width").alias("salt")).mapInArrow(keyed, "uid long, key long, t int")
    tasks = bucket_members(keys, BLOCK, ["t"])
    full = tasks.join(classes.select("uid", "label", "width", "raw", "sig", "weight", "least_id"), "uid")
    order = ["key", "t", "label", "width", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_runs(batches, order):
            starts = [*run_starts(table, order).tolist(), table.num_rows]
            uid, least_id, t, lo, hi, block, width, weight = (table.column(c).to_numpy() for c in ("uid", "least_id", "t", "lo", "hi", "block", "width", "weight"))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(starts, starts[1:]):
                if b - a < 2:
                    continue
                unit = unit_rows(np.frombuffer(b"".join(table.column("raw").slice(a, b - a).to_pylist()), number).reshape(-1, int(width[a])).astype(np.float64))
                sig = np.frombuffer(b"".join(table.column("sig").slice(a, b - a).to_pylist()), kind).reshape(-1, tables)
                links, root = bucket_links(unit, sig, weight[a:b], int(t[a]), block[a:b] if lo[a] != hi[a] else None, least)
                linked = np.flatnonzero(links)
                if len(linked):
                    out.append((uid[a:b][linked], links[linked], least_id[a:b][linked], least_id[a:b][root[linked]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["uid", "links", "id", "root"])

    found = ws.keep(full.repartition("key", "lo", "hi").sortWithinPartitions(*order, "uid").mapInArrow(run, "uid long, links long, id long, root long"), "links")
    counted = found.groupBy("uid").agg(F.sum("links").alias("links"))
    # ids of copies hang on the least of them
    copies = members.join(classes.filter("weight > 1").select(*same, "least_id"), same).filter("id <> least_id").select("id", F.col("least_id").alias("root"))
    labels = connected_components(ws, found.select("id", "root").union(copies), "id", "root")
    # a row finds its class again by its own fingerprint; rows that cannot link have none
    told = members.join(classes.select(*same, "uid", "weight"), same).join(counted, "uid", "left").select("id", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    alone = outside(everyone)
    out = told.unionByName(alone).join(labels, "id", "left")
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"))


def outside(everyone: DataFrame) -> DataFrame:
    """id and n_links 0 of the rows whose vectors cannot link: those without id, label or vector, and those that `usable` leaves out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.ones(batch.num_rows, bool)
            for rows, _ in usable(batch.column("v")).values():
                out[rows] = False
            out |= batch.column("lacks").to_numpy(zero_copy_only=False)
            ids = batch.column("id").filter(pa.array(out))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.zeros(len(ids), np.int64))], names=["id", "n_links"])

    return everyone.select("id", "v", F.expr("id is null or label is null").alias("lacks")).mapInArrow(run, "id long, n_links long")


def op1_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


#: All pairs by label, and the least id that links reach, for tables small enough to be told so.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding])) AS norm
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, least(e.vec_id, coalesce(r.y, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(r.y, e.vec_id)) AS kept
FROM embeddings e LEFT JOIN least r ON r.x = e.vec_id LEFT JOIN counted c ON c.x = e.vec_id
"""
