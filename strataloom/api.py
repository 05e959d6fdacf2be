"""One object over scan, extraction, chunking, embedding, stores, search and graph queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .extract.run import extract, rows
from .functions import ids, text
from .operators import chunking, embed, render, search, traverse
from .operators.build import build_graph
from .operators.centrality import katz
from .sources import files as source_files
from .sources.settings import Settings, load
from .sources.store import GraphStore, VectorStore


class NotFound(LookupError):
    """A symbol or file that is asked for is not there."""


class Engine:
    """Index a directory, search it, and ask about its graph. `progress(message, done, total)` hears of each step."""

    def __init__(self, spark: SparkSession, home: str, settings: Settings | None = None, embedder: Callable | None = None, relevance: Callable | None = None, progress: Callable[[str, int, int], None] | None = None):
        self.spark, self.settings = spark, settings or load(spark=spark)
        self.vectors, self.graph = VectorStore(spark, f"{home}/vectors"), GraphStore(spark, f"{home}/graph")
        dimensions = self.settings.embedding.dimensions
        self.make_embedder = embedder or (lambda: embed.HashingEmbedder(dimensions))
        self.relevance, self.progress = relevance or search.token_overlap, progress or (lambda *_: None)

    # indexing

    def _chunks(self, files: DataFrame) -> DataFrame:
        s = self.settings.chunker
        if s.strategy == "token":
            rows_ = chunking.token_chunks(files, s.chunk_size, s.chunk_overlap, s.min_chunk_size, "content")
        elif s.strategy == "sliding_window":
            rows_ = chunking.sliding_windows(files, s.chunk_size, s.chunk_overlap, least_words=s.min_chunk_size, column="content")
        else:
            nodes = rows(extract(files), "nodes").drop("path", "language", "pos")
            rows_ = chunking.node_chunks(files, nodes, s.min_chunk_size, s.chunk_size, s.chunk_overlap)
        if "chunk_type" not in rows_.columns:
            rows_ = rows_.withColumns({"chunk_type": F.lit("snippet"), "name": F.lit(None).cast("string")})
        shaped = rows_.select("file_id", "path", "language", "chunk_type", "name", "chunk", "start_line", "end_line").join(files.select("file_id", "content", "metadata"), "file_id")
        shaped = chunking.with_context(shaped, self.settings.parser.context_lines, "content")
        shaped = shaped.select(ids.chunk_id("file_id", F.col("start_line"), F.col("end_line")).alias("chunk_id"), "file_id", "path", "language", "chunk_type", "name", F.col("chunk").alias("content"), text.token_count("chunk").alias("token_count"), "start_line", "end_line", "context_before", "context_after", "metadata")
        embedded = shaped.withColumn("_text", text.embedding_text(F.col("language"), F.col("chunk_type"), F.col("path"), F.col("name"), F.col("content")))
        made = embed.embed_column(embedded, "_text", self.make_embedder, batch=self.settings.embedding.batch_size).drop("_text")
        return made.withColumn("model", F.lit(self.settings.embedding.model))

    def index_directory(self, root: str, clear: bool = False, metadata: dict[str, str] | None = None) -> dict[str, int]:
        """Chunks of all source files under root; files that are unchanged since the last run are left alone."""
        if clear:
            self.vectors.clear()
        self.progress("scan", 0, 3)
        files = source_files.scan(self.spark, root, metadata, most_bytes=self.settings.parser.max_file_size_bytes, unknown=self.settings.parser.include_unknown).persist()
        known = self.vectors.read().select("path", F.col("metadata")["sha256"].alias("sha256")).distinct()
        fresh = source_files.changed(files, known).withColumn("metadata", F.map_concat(F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.create_map(F.lit("sha256"), F.col("sha256")))).persist()
        self.progress("chunk and embed", 1, 3)
        chunks = self._chunks(fresh).persist()
        old = self.vectors.read().join(fresh.select("file_id"), "file_id", "left_anti")
        n = chunks.count()
        self.vectors._replace(old.unionByName(chunks.dropDuplicates(["chunk_id"])))
        done = {"files": files.count(), "files_indexed": fresh.count(), "chunks": n}
        done["files_unchanged"] = done["files"] - done["files_indexed"]
        for df in (files, fresh, chunks):
            df.unpersist()
        self.progress("done", 3, 3)
        return done

    def index_file(self, root: str, path: str) -> int:
        """One file, whatever its size or name; its path stays relative, so that ids agree with directory runs."""
        one = source_files.read_file(self.spark, root, path)
        old = self.vectors.read().filter(F.col("path") != path)
        chunks = self._chunks(one).persist()
        n = chunks.count()
        self.vectors._replace(old.unionByName(chunks.dropDuplicates(["chunk_id"])))
        chunks.unpersist()
        return n

    def index_graph(self, root: str, clear: bool = False) -> dict[str, int]:
        if clear:
            self.graph.clear()
        built = build_graph(source_files.scan(self.spark, root))
        self.graph.upsert({k: built[k].select(*self.graph.read(k).columns) for k in ("files", "directories", "symbols", "edges")})
        processed, failed = built["files"].count(), built["failures"].count()
        return {"files": processed, "failed": failed, "symbols": self.graph.read("symbols").count(), "edges": self.graph.read("edges").count()}

    # search

    def search(self, query: search.SearchQuery, rerank: bool = False) -> DataFrame:
        maker = self.make_embedder()
        return search.Retriever(self.vectors.read(), lambda q: maker.embed_texts([q])[0], (lambda q: self.relevance(q, "content")) if rerank else None).search(query)

    def search_hybrid(self, query: str, k: int = 10) -> DataFrame:
        """Chunks by vector and by what the graph relates them to, with their fused score and rank."""
        vector = self.make_embedder().embed_texts([query])[0]
        chunks = self.vectors.read()
        found = search.hybrid_chunks(chunks, self.graph.read("symbols"), self.graph.read("edges"), vector, k)
        return chunks.drop("embedding").join(found, "chunk_id").orderBy("rank")

    def delete_file(self, path: str) -> int:
        return self.vectors.delete(F.col("path") == path)

    # graph

    def symbol(self, name_or_id: str) -> str:
        hit = self.graph.read("symbols").filter((F.col("id") == name_or_id) | (F.col("name") == name_or_id)).orderBy("file_path", "start_line").limit(1).collect()
        if not hit:
            raise NotFound(name_or_id)
        return hit[0]["id"]

    def find_symbols(self, name: str | None = None, file_path: str | None = None, decorator: str | None = None, kind: str | None = None) -> DataFrame:
        found = self.graph.read("symbols")
        if name is not None:
            found = found.filter(F.col("name") == name)
        if kind:
            found = found.filter(F.col("kind") == kind)
        if file_path:
            found = found.filter(F.col("file_path").startswith(file_path))
        return found.filter(F.exists("decorators", lambda d: d.startswith(decorator))) if decorator else found

    def symbols_in_file(self, file_id: str) -> DataFrame:
        return self.graph.read("symbols").filter(F.col("file_id") == file_id)

    def _edges(self, rel: str) -> DataFrame:
        return self.graph.read("edges").filter(F.col("rel_type") == rel).select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt"), F.col("confidence").alias("conf"))

    def _start(self, name_or_id: str) -> DataFrame:
        return self.spark.createDataFrame([(self.symbol(name_or_id),)], "id string")

    def callers(self, name_or_id: str, depth: int = 1) -> DataFrame:
        return self.graph.read("symbols").join(traverse.callers(self._edges("CALLS"), self._start(name_or_id), depth), "id")

    def callees(self, name_or_id: str, depth: int = 1) -> DataFrame:
        return self.graph.read("symbols").join(traverse.callees(self._edges("CALLS"), self._start(name_or_id), depth), "id")

    def call_path(self, source: str, target: str) -> list[str] | None:
        found = traverse.shortest_path(self._edges("CALLS"), self.symbol(source), self.symbol(target)).collect()
        return list(found[0]["path"]) if found else None

    def import_graph(self, file_id: str) -> DataFrame:
        paths = self.graph.read("files").select("id", "path")
        start = self.spark.createDataFrame([(file_id,)], "id string")
        closed = traverse.closure_edges(self._edges("IMPORTS"), start)
        named = closed.join(paths.withColumnsRenamed({"id": "src", "path": "from_path"}), "src").join(paths.withColumnsRenamed({"id": "tgt", "path": "to_path"}), "tgt")
        return named.groupBy("from_path").agg(F.array_sort(F.collect_set("to_path")).alias("imports"))

    def subclasses(self, name_or_id: str) -> DataFrame:
        return self.graph.read("symbols").join(traverse.hops(self._edges("INHERITS_FROM"), self._start(name_or_id), 1, reverse=True), "id")

    def superclasses(self, name_or_id: str) -> DataFrame:
        return self.graph.read("symbols").join(traverse.hops(self._edges("INHERITS_FROM"), self._start(name_or_id), 1), "id")

    def context(self, name_or_id: str) -> DataFrame:
        return traverse.symbol_context(self.graph.read("edges"), self.graph.read("symbols"), self.graph.read("files"), self.symbol(name_or_id))

    def context_text(self, name_or_id: str) -> str:
        return self.context(name_or_id).select(render.context_text().alias("t")).first()["t"]

    def impact(self, name_or_id: str, least: float = 0.0) -> dict[str, DataFrame]:
        return traverse.impact_set(self.graph.read("edges"), self.graph.read("symbols"), self.graph.read("files"), self.symbol(name_or_id), least)

    def centrality(self, **options) -> DataFrame:
        kinds = self.graph.read("edges").filter(F.col("rel_type").isin("CALLS", "INJECTS", "INHERITS_FROM"))
        return katz(self.graph.read("symbols").select("id"), kinds.select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt")), **options)
