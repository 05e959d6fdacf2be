"""Exact top-k by inner product with multi-resolution segment statistics.

Each vector is summed up, at every level, by the mean and the deviation of its segments. For one segment of m
components, <q, x> is at most m (mean_q mean_x + dev_q dev_x), by Cauchy and Schwarz; in terms of distances,
|q - x|^2 >= |q|^2 + |x|^2 - 2 sum of these, the usual segment lower bound. Levels go from one segment to segments of
one and two components; a candidate whose bound at some level lies below the query's k-th score so far is dropped. Of
what is left, the candidates with the best bounds are scored first, which raises the k-th score and drops most others;
the survivors get their exact integer scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .arrays import list_rows

#: Queries broadcast at once, and queries and candidate rows of one step: all bound memory whatever the table's size.
QUERY_BLOCK, QUERY_STEP, ROW_BLOCK = 8192, 512, 2048
#: Sums of products of whole numbers up to here are exact in doubles.
EXACT = float(1 << 53)


def whole_vectors(column: pa.Array, ids: pa.Array, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By width: ids and floor(scale * x) of the vectors that take part. Null and empty ones, and those that hold a null or are not finite once scaled, do not."""
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width, (rows, x) in list_rows(column).items():
        with np.errstate(over="ignore"):
            x = np.floor(x * scale)
        good = np.isfinite(x).all(axis=1) & ids.is_valid().to_numpy(zero_copy_only=False)[rows]
        if good.any():
            found[width] = ids.take(pa.array(rows[good])).to_numpy(zero_copy_only=False).astype(np.int64), x[good]
    return found


def levels(width: int) -> list[int]:
    """Segment counts, coarse to fine."""
    return sorted({n for n in (1, 4, 16, width // 2, 3 * width // 4) if 0 < n < width}) or [1]


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Scaled means and deviations side by side, so that a dot product of two rows is the bound. Segments differ by one component at most."""
    edges = np.arange(segments + 1) * x.shape[1] // segments
    sizes = np.diff(edges)
    with np.errstate(over="ignore", invalid="ignore"):
        mean = np.add.reduceat(x, edges[:-1], axis=1) / np.sqrt(sizes)
        rest = np.add.reduceat(x * x, edges[:-1], axis=1) - mean * mean
        return np.hstack([mean, np.sqrt(np.maximum(rest[:, sizes > 1], 0))])


def norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1))


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows. Doubles where they are exact, else whole numbers of any size, held within a long."""
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.einsum("ij,ij->i", q, x)
        size = np.einsum("ij,ij->i", np.abs(q), np.abs(x))
    large = np.flatnonzero(~(size < EXACT))
    if len(large):
        score = score.astype(object)
        for k in large.tolist():
            total = sum(int(a) * int(b) for a, b in zip(q[k].tolist(), x[k].tolist()))
            score[k] = max(-(1 << 63), min((1 << 63) - 1, total))
    return score


class TopK:
    """Running k best of each query, ties to the smaller id. `pairs` counts all pairs met, `exact` those that got an exact score."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, vectors, k
        self.levels = levels(vectors.shape[1])
        self.stats = [statistics(vectors, n) for n in self.levels]
        self.norm = norms(vectors)
        self.best: list[list[tuple]] = [[] for _ in ids]  # (-score, id), best first
        self.floor = np.full(len(ids), -np.inf)
        self.exact = self.pairs = 0

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        own = [statistics(x, n) for n in self.levels]
        norm = norms(x)
        for a in range(0, len(self.ids), QUERY_STEP):
            self._step(slice(a, a + QUERY_STEP), ids, x, own, norm)

    def _step(self, part: slice, ids: np.ndarray, x: np.ndarray, own: list[np.ndarray], norm: np.ndarray) -> None:
        alive = self.ids[part, None] != ids[None, :]
        self.pairs += int(alive.sum())
        slack = 1e-9 * self.norm[part, None] * norm[None, :] + 1e-6  # for the rounding of the bounds
        bound = None
        for q_stat, x_stat in zip(self.stats, own):
            with np.errstate(over="ignore", invalid="ignore"):
                bound = q_stat[part] @ x_stat.T + slack
            alive &= ~(bound < self.floor[part, None])  # a bound that is no number drops nothing
            if not alive.any():
                return
        # the best bounds first: their scores raise the floor before anything else is scored
        bound[~alive] = -np.inf
        first = min(2 * self.k, len(ids))
        at = np.argpartition(-bound, first - 1, axis=1)[:, :first]
        seeds = np.zeros_like(alive)
        np.put_along_axis(seeds, at, True, axis=1)
        self._score(part.start, np.nonzero(seeds & alive), ids, x)
        self._score(part.start, np.nonzero(alive & ~seeds & ~(bound < self.floor[part, None])), ids, x)

    def _score(self, start: int, pairs: tuple[np.ndarray, np.ndarray], ids: np.ndarray, x: np.ndarray) -> None:
        rows, at = pairs[0] + start, pairs[1]
        self.exact += len(rows)
        step = max(1, (1 << 22) // x.shape[1])  # pairs whose vectors are gathered at once
        score = [exact_scores(self.q[rows[a : a + step]], x[at[a : a + step]]) for a in range(0, len(rows), step)]
        if not score:
            return
        score = np.concatenate(score)
        cuts = np.flatnonzero(np.diff(rows)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(rows)]):
            r, found = rows[a], score[a:b]
            keep = np.flatnonzero(~(found.astype(np.float64) < self.floor[r]))
            best = sorted([*self.best[r], *((-int(v), i) for v, i in zip(found[keep].tolist(), ids[at[a:b][keep]].tolist()))])[: self.k]
            self.best[r] = best
            if len(best) == self.k:
                self.floor[r] = np.nextafter(float(-best[-1][0]), -np.inf) if abs(best[-1][0]) >= EXACT else -best[-1][0]

    def rows(self) -> pa.RecordBatch:
        found = [(q, i, -s) for q, best in zip(self.ids.tolist(), self.best) for s, i in best]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * 3, names=["query_id", "vec_id", "score"])


def top_k_exact(rows: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of highest integer inner product for each query.

    Vectors become floor(scale * x); those that are null or empty, hold null or non-finite components, overflow when
    scaled, or have a null id take no part. A query's own id is no candidate. Fewer rows than k give fewer; ties go to
    the smaller id; a repeated id is a candidate for each of its rows, and a query for the first of its vectors in their
    own order. Scores beyond a long are held at its ends. Vectors of another length than the query's are no candidates.
    Extra columns are ignored.

    Queries go over all rows in blocks of QUERY_BLOCK: each block is a broadcast of bounded size and one scan of the
    rows, without a shuffle of them; only k rows a query and task are shuffled. Blocks are by a hash of the id.
    """
    spark = ship(rows.sparkSession)
    base = rows.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v"))
    asked = queries.select(F.col(id_column).alias("id"), F.col(vector_column).alias("v")).filter("id is not null and v is not null")
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))
    found = None
    for b in range(blocks):
        part = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w, (ids, x) in whole_vectors(part["v"].combine_chunks(), part["id"].combine_chunks(), scale).items():
            order = np.lexsort((*x.T[::-1], ids))
            ids, first = np.unique(ids[order], return_index=True)
            by_width[w] = (ids, x[order][first])
        shared = spark.sparkContext.broadcast(by_width)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tops = {w: TopK(ids, q, k) for w, (ids, q) in shared.value.items()}
            for batch in batches:
                for start in range(0, batch.num_rows, ROW_BLOCK):
                    piece = batch.slice(start, ROW_BLOCK)
                    for w, (ids, x) in whole_vectors(piece.column("v"), piece.column("id"), scale).items():
                        if w in tops:
                            tops[w].add(ids, x)
            for top in tops.values():
                yield top.rows()

        part = base.mapInArrow(run, "query_id long, vec_id long, score long")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 10 best rows of embeddings for each vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k_exact(rows, rows.filter(F.col("vec_id") % 100 == 0))


ORACLE = """
WITH good AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
