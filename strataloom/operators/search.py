"""Vector search: filters, top-k, thresholds, reranking, rank fusion and hybrid expansion."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..session import ship


@dataclass(frozen=True)
class SearchQuery:
    """One search. `query` is embedded by the retriever; every filter is optional."""

    query: str = ""
    top_k: int = 10
    language: str | None = None
    chunk_types: tuple[str, ...] = ()
    path_prefix: str | None = None
    min_score: float = 0.0
    include_context: bool = False
    metadata_filters: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k must be between 1 and 100")
        if not 0 <= self.min_score <= 1:
            raise ValueError("min_score must be between 0 and 1")


def predicates(q: SearchQuery) -> list[Column]:
    """The query's filters as predicates on chunk columns, for Catalyst to push to the scan."""
    found = []
    if q.language:
        found.append(F.col("language") == q.language)
    if q.chunk_types:
        found.append(F.col("chunk_type").isin(*q.chunk_types))
    if q.path_prefix:
        found.append(F.col("path").startswith(q.path_prefix))
    found += [F.col("metadata")[k] == v for k, v in q.metadata_filters.items()]
    return found


def top_k(rows: DataFrame, query: list[float] | Column, k: int = 10, where: list[Column] | None = None, vector: str = "embedding", key: str = "chunk_id", metric: str = "cosine", scale: str = "raw") -> DataFrame:
    """The k rows of highest score with score and rank; ties go to the smaller key. Filters apply before scoring; the plan is a TakeOrderedAndProject, so only k rows a task leave it."""
    rows = reduce(lambda df, p: df.filter(p), where or [], rows)
    q = query if isinstance(query, Column) else vectors.literal(query)
    best = rows.withColumn("score", vectors.score(vectors.as_double(vector), q, metric, scale)).orderBy(F.desc("score"), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


#: Queries of a batch that go to the executors at once.
QUERY_BLOCK = 2048
#: Queries and rows whose scores a task holds at once.
TILE = 512, 1024


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): the k nearest rows by cosine of every query, itself left out; ties go to the smaller key.

    Queries go in blocks of bounded size, each with one scan of the rows and no shuffle of them: a task multiplies its
    batches by the block, tile by tile, and keeps k rows a query.
    """
    ship(rows.sparkSession)
    base = rows.select(F.col(key).cast("long").alias("id"), vectors.as_double(vector).alias("v")).filter("id is not null and v is not null")
    asked = queries.select(F.col(key).cast("long").alias("id"), vectors.as_double(vector).alias("v")).filter("id is not null and v is not null")
    blocks, found = max(1, -(-2 * asked.count() // QUERY_BLOCK)), None
    for b in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        shared = rows.sparkSession.sparkContext.broadcast((np.asarray(block["id"]), unit_rows(block["v"])))

        def run(batches, shared=shared):
            ids, q = shared.value
            best, who = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
            for batch in batches:
                for start in range(0, batch.num_rows, TILE[1]):
                    part = batch.slice(start, TILE[1])
                    near, x = np.asarray(part.column("id")), unit_rows(part.column("v"))
                    for a in range(0, len(ids), TILE[0]):
                        some = slice(a, a + TILE[0])
                        score = np.round(q[some] @ x.T, 12)
                        score[ids[some, None] == near[None, :]] = -np.inf
                        best[some], who[some] = kept(best[some], who[some], score, near)
            at = np.isfinite(best)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, k)[at.ravel()]), pa.array(who[at]), pa.array(best[at])], names=["query_id", "id", "score"])

        part = base.mapInArrow(run, "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumnRenamed("id", key)


def kept(best: np.ndarray, who: np.ndarray, score: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids a query after a tile of scores; only what may enter them is sorted, ties to the smaller id."""
    n, k = best.shape
    least = best[:, -1]
    if np.isneginf(least).any() and k < score.shape[1]:
        least = np.maximum(least, np.partition(np.nan_to_num(score, nan=-np.inf), -k, axis=1)[:, -k])
    at, j = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    if not len(at):
        return best, who
    row, value, name = np.concatenate([np.repeat(np.arange(n), k), at]), np.concatenate([best.ravel(), score[at, j]]), np.concatenate([who.ravel(), near[j]])
    order = np.lexsort((name, -value, row))
    first = np.searchsorted(row[order], np.arange(n))
    top = order[first[:, None] + np.arange(k)]
    return value[top], name[top]


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of length 1 of a column of equally long lists; null components are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.unique(np.asarray(pc.list_value_length(column)))
    if len(sizes) > 1:
        raise ValueError("vectors differ in length")
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), int(sizes[0]) if len(sizes) else 0)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length == 0, 1, length)


def above(hits: DataFrame, least: float) -> DataFrame:
    """The threshold after top-k: it may leave fewer than k rows."""
    return hits.filter(F.col("score") >= least) if least > 0 else hits


def by_score(hits: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    ranked = hits.orderBy(F.desc("score"), key).limit(k)
    return ranked.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))


def token_overlap(query: str, content: Column | str) -> Column:
    """Share of the query's distinct words that the content has; stands in for a cross-encoder where none is installed."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) > 0))
    wanted = split(F.lit(query))
    return F.size(F.array_intersect(wanted, split(F.col(content) if isinstance(content, str) else content))) / F.greatest(F.size(wanted), F.lit(1))


def rerank(hits: DataFrame, relevance: Column, k: int, key: str = "chunk_id") -> DataFrame:
    """The k hits of highest relevance, which becomes their score."""
    return by_score(hits.withColumn("score", relevance.cast("double")), k, key)


def two_stage(rows: DataFrame, query: list[float], q: SearchQuery, relevance: Column | None = None, **options) -> DataFrame:
    """Search with twice the rows where a reranker follows, then threshold, rerank or cut, and rank."""
    key = options.get("key", "chunk_id")
    hits = above(top_k(rows, query, q.top_k * (2 if relevance is not None else 1), predicates(q), **options), q.min_score)
    hits = rerank(hits, relevance, q.top_k, key) if relevance is not None else by_score(hits, q.top_k, key)
    if not q.include_context:
        hits = hits.withColumns({c: F.lit("") for c in ("context_before", "context_after") if c in hits.columns})
    return hits


def reciprocal_rank_fusion(lists: list[DataFrame], key: str = "chunk_id", constant: int = 60, k: int | None = None) -> DataFrame:
    """(key, score, rank) over any number of (key, rank) lists. Equal scores go to the earlier list, then the better rank in it."""
    union = reduce(DataFrame.unionByName, [df.select(key, "rank").withColumn("list_no", F.lit(i)) for i, df in enumerate(lists)])
    fused = union.groupBy(key).agg(F.sum(F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("score"), F.min(F.struct("list_no", "rank")).alias("first"))
    order = [F.desc(F.round("score", 12)), "first.list_no", "first.rank", key]
    best = fused.orderBy(*order).limit(k) if k else fused
    return best.withColumn("fused_rank", F.row_number().over(Window.orderBy(*order))).select(key, "score", F.col("fused_rank").alias("rank"))


def blend(vector_score: Column, centrality: Column, weight: float = 0.6) -> Column:
    return F.lit(weight) * vector_score + F.lit(1 - weight) * centrality


def related(seeds: DataFrame, relations: list[tuple[DataFrame, str, str, int | None]], node: str = "node", most: int = 3) -> DataFrame:
    """(node, rank): what the ranked seeds are related to and is no seed itself, in the order of the first seed.

    relations are (edges, own column, far column, cap) in falling priority: a seed gives the first `cap` of each (all
    where it is None), and `most` in all. seeds has node and rank, and is a top-k.
    """
    near = None
    for side, (rel, own, far, cap) in enumerate(relations):
        found = seeds.join(rel.select(F.col(own).alias(node), F.col(far).alias("near")).distinct(), node).select("rank", F.lit(side).alias("side"), F.lit(cap if cap else 1 << 30).alias("cap"), "near")
        near = found if near is None else near.union(found)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("rank", "side").orderBy("near"))).filter("n <= cap")
    fresh = near.join(seeds.select(F.col(node).alias("near")), "near", "left_anti")
    fresh = fresh.withColumn("m", F.row_number().over(Window.partitionBy("rank").orderBy("side", "n", "near"))).filter(F.col("m") <= most)
    first = fresh.groupBy("near").agg(F.min(F.struct("rank", "m")).alias("first"))
    return first.select(F.col("near").alias(node), F.row_number().over(Window.orderBy("first.rank", "first.m", "near")).alias("rank"))


def graph_expansion(seeds: DataFrame, calls: DataFrame, node: str = "node", per_side: int = 3, most: int = 3) -> DataFrame:
    """Callers, then callees, of ranked seeds; calls has src and tgt."""
    return related(seeds, [(calls, "tgt", "src", per_side), (calls, "src", "tgt", per_side)], node, most)


def symbols_of_chunks(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(chunk_id, rank, node): the first symbol of a ranked chunk's name whose file starts with the chunk's path."""
    found = chunks.select("chunk_id", "rank", "name", "path").join(symbols.select("name", F.col("id").alias("node"), "file_path", "start_line"), "name").filter(F.col("file_path").startswith(F.col("path")))
    return found.groupBy("chunk_id", "rank").agg(F.min_by("node", F.struct("file_path", "start_line")).alias("node"))


def chunks_of_symbols(nodes: DataFrame, symbols: DataFrame, chunks: DataFrame, query: list[float], per_symbol: int = 3, vector: str = "embedding") -> DataFrame:
    """(chunk_id, rank): the best chunks by cosine of ranked symbols' path and name, symbol by symbol."""
    own = nodes.select("node", F.col("rank").alias("symbol_rank")).join(symbols.select(F.col("id").alias("node"), F.col("file_path").alias("path"), "name"), "node")
    scored = chunks.join(own, ["path", "name"]).withColumn("score", vectors.score(vectors.as_double(vector), vectors.literal(query)))
    best = scored.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("score"), "chunk_id"))).filter(F.col("n") <= per_symbol)
    first = best.groupBy("chunk_id").agg(F.min(F.struct("symbol_rank", "n")).alias("first"))
    return first.select("chunk_id", F.row_number().over(Window.orderBy("first.symbol_rank", "first.n", "chunk_id")).alias("rank"))


def hybrid_chunks(chunks: DataFrame, symbols: DataFrame, edges: DataFrame, query: list[float], k: int = 10) -> DataFrame:
    """(chunk_id, score, rank): vector hits (twice k), chunks of what the first k are related to, and the fusion of both.

    Relations in falling priority: callers, callees, the class around, methods, bases. edges has rel_type, source_id
    and target_id.
    """
    hits = top_k(chunks, query, 2 * k)
    seeds = symbols_of_chunks(hits.filter(F.col("rank") <= k), symbols)
    seeds = seeds.groupBy("node").agg(F.min("rank").alias("rank"))
    of = lambda rel: edges.filter(F.col("rel_type") == rel)
    calls, contains, inherits = of("CALLS"), of("CONTAINS"), of("INHERITS_FROM")
    relations = [(calls, "target_id", "source_id", 3), (calls, "source_id", "target_id", 3), (contains, "target_id", "source_id", 1), (contains, "source_id", "target_id", 3), (inherits, "source_id", "target_id", None)]
    found = chunks_of_symbols(related(seeds, relations), symbols, chunks, query)
    return reciprocal_rank_fusion([hits.select("chunk_id", "rank"), found.join(hits.select("chunk_id"), "chunk_id", "left_anti")], k=k)


def hybrid(rows: DataFrame, query: list[float], calls: DataFrame, k: int = 10, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """Vector hits (twice k), their graph expansion, and the fusion of both."""
    hits = top_k(rows, query, 2 * k, vector=vector, key=key).select(F.col(key).alias("node"), "rank")
    expanded = graph_expansion(hits.filter(F.col("rank") <= k), calls)
    return reciprocal_rank_fusion([hits, expanded.join(hits.select("node"), "node", "left_anti")], "node", k=k)


class Retriever:
    """Search over a chunk table with an embedder, and a reranker if any: (query, DataFrame) to a relevance column."""

    def __init__(self, chunks: DataFrame, embed: Callable[[str], list[float]], relevance: Callable[[str], Column] | None = None):
        self.chunks, self.embed, self.relevance = chunks, embed, relevance

    def search(self, q: SearchQuery) -> DataFrame:
        return two_stage(self.chunks, self.embed(q.query), q, self.relevance(q.query) if self.relevance else None)

    def search_by_vector(self, vector: list[float], k: int = 10, where: list[Column] | None = None) -> DataFrame:
        return top_k(self.chunks, vector, k, where)
