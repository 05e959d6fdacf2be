"""Tables keyed by id with upsert, delete and versions, kept as Parquet folders."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by `order`; a row that wins a tie is one of the last."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter("_n = 1").drop("_n")


def upserted(old: DataFrame | None, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old with the rows of new instead of its own of the same key."""
    new = latest(new, key, order) if order else new.dropDuplicates([key])
    return new if old is None else old.join(new.select(key), key, "left_anti").unionByName(new)


class Table:
    """A keyed table at a path. A write makes a new version folder and then moves a pointer file to it, so that readers see whole versions."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, key
        self._pointer = f"{self.path}/_current"

    def _fs(self):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def version(self) -> str | None:
        fs = self._fs()
        if not fs.exists(self._at(self._pointer)):
            return None
        stream = fs.open(self._at(self._pointer))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def read(self) -> DataFrame:
        version = self.version()
        if version is None:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def _replace(self, rows: DataFrame) -> None:
        version = f"v-{uuid.uuid4().hex}"
        rows.select(*self.read().columns).write.parquet(f"{self.path}/{version}")
        fs, draft = self._fs(), self._at(f"{self._pointer}-{version}")
        stream = fs.create(draft, True)
        stream.write(bytearray(version.encode()))
        stream.close()
        old = self.version()
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._at(self.path).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(context.makeQualified(draft), context.makeQualified(self._at(self._pointer)), options)
        if old:
            fs.delete(self._at(f"{self.path}/{old}"), True)

    def upsert(self, rows: DataFrame, order: str | None = None) -> int:
        """Rows replace those of their key; returns how many rows came in."""
        n = rows.count()
        self._replace(upserted(self.read(), rows, self.key, order))
        return n

    def delete(self, condition) -> int:
        """Rows that satisfy the condition go; returns how many."""
        rows = self.read()
        n = rows.filter(condition).count()
        if n:
            self._replace(rows.filter(~F.coalesce(condition, F.lit(False))))
        return n

    def clear(self) -> None:
        self._replace(self.read().filter(F.lit(False)))


CHUNKS = "chunk_id string, file_id string, path string, language string, chunk_type string, name string, content string, token_count int, start_line int, end_line int, context_before string, context_after string, metadata map<string,string>, embedding array<float>, model string"


class VectorStore(Table):
    """Embedded chunks by chunk_id; content is stored apart from the text that was embedded."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark, path, CHUNKS, "chunk_id")

    def delete_by_file(self, file_id: str) -> int:
        return self.delete(F.col("file_id") == file_id)

    def stats(self) -> DataFrame:
        return index_stats(self.read())


def index_stats(chunks: DataFrame) -> DataFrame:
    """One row: total_files, total_chunks, total_tokens, and maps of chunks by language and by type."""
    counted = lambda c: chunks.groupBy(c).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    totals = chunks.agg(F.count_distinct("file_id").alias("total_files"), F.count("*").alias("total_chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"))
    return totals.join(F.broadcast(counted("language"))).join(F.broadcast(counted("chunk_type")))


GRAPH_TABLES = {
    "files": ("id string, path string, language string, sha256 string", "id"),
    "directories": ("id string, path string", "id"),
    "symbols": ("id string, name string, qualified_name string, kind string, file_id string, file_path string, start_line int, end_line int, parent_name string, decorators array<string>, seq long", "id"),
    "edges": ("id string, rel_type string, source_id string, target_id string, line int, confidence double, module_string string, imported_names array<string>, alias string, is_relative boolean, field_name string, field_type string, seq long", "id"),
}


class GraphStore:
    """Files, directories, symbols and edges by id; of edges that share an id the last one stays."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.tables = {n: Table(spark, f"{path.rstrip('/')}/{n}", schema, key) for n, (schema, key) in GRAPH_TABLES.items()}

    def read(self, name: str) -> DataFrame:
        return self.tables[name].read()

    def upsert(self, snapshot: dict[str, DataFrame]) -> None:
        for name, rows in snapshot.items():
            if name in self.tables:
                self.tables[name].upsert(rows, "seq" if "seq" in rows.columns else None)

    def delete_file(self, file_id: str) -> int:
        """A file, its symbols and all edges at either; returns the nodes that went."""
        gone = self.read("symbols").filter(F.col("file_id") == file_id).select("id").union(self.read("files").filter(F.col("id") == file_id).select("id"))
        ids = gone.persist()
        n = ids.count()
        edges = self.read("edges")
        left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
        self.tables["edges"]._replace(left)
        self.tables["symbols"].delete(F.col("file_id") == file_id)
        self.tables["files"].delete(F.col("id") == file_id)
        ids.unpersist()
        return n

    def clear(self) -> None:
        for t in self.tables.values():
            t.clear()

    def stats(self) -> DataFrame:
        return graph_stats({n: t.read() for n, t in self.tables.items()})

    def save_json(self, path: str) -> None:
        for name, t in self.tables.items():
            t.read().write.mode("overwrite").json(f"{path}/{name}")

    def load_json(self, path: str) -> None:
        self.upsert({n: self.spark.read.schema(schema).json(f"{path}/{n}") for n, (schema, _) in GRAPH_TABLES.items()})


def graph_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """One row: counts of the four tables, and maps of edges by type, symbols by kind and files by language."""
    totals = [tables[n].agg(F.count("*").alias(f"total_{n}")) for n in ("files", "symbols", "directories", "edges")]
    for name, column, alias in (("edges", "rel_type", "edges_by_type"), ("symbols", "kind", "symbols_by_kind"), ("files", "language", "files_by_language")):
        counts = tables[name].groupBy(column).agg(F.count("*").alias("n"))
        totals.append(counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(alias)))
    return reduce(lambda a, b: a.join(F.broadcast(b)), totals)
