"""Incremental indexing: a stream of file rows is chunked, embedded and upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import ids, text
from ..operators import chunking, embed
from ..sources.store import VectorStore

FILES = "path string, language string, content string"


def chunk_rows(files: DataFrame, size: int = 512, overlap: int = 64, dimensions: int = 256) -> DataFrame:
    """Embedded chunk rows of a files table, in the vector store's columns."""
    rows = files.withColumn("file_id", ids.file_id("path"))
    chunks = chunking.token_chunks(rows, size, overlap, column="content").withColumn("kind", F.lit("snippet"))
    name = F.lit(None).cast("string")
    shaped = chunks.select(
        ids.chunk_id("file_id", F.col("start_line"), F.col("end_line")).alias("chunk_id"), "file_id", "path", "language", F.col("kind").alias("chunk_type"), name.alias("name"), F.col("chunk").alias("content"), text.token_count("chunk").alias("token_count"),
        "start_line", "end_line", F.lit("").alias("context_before"), F.lit("").alias("context_after"), F.lit(None).cast("map<string,string>").alias("metadata"), text.embedding_text(F.col("language"), F.col("kind"), F.col("path"), name, F.col("chunk")).alias("embedded"),
    )
    return embed.embed_column(shaped, "embedded", lambda: embed.HashingEmbedder(dimensions)).withColumn("model", F.lit(f"hashing-{dimensions}")).drop("embedded")


def index_stream(spark: SparkSession, source: str, store: VectorStore, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows of Parquet files that arrive in `source` go to the store; a file's older chunks are replaced. Upserts are by id, so a batch that runs twice gives the same table."""
    stream = spark.readStream.schema(FILES).parquet(source)

    def write(batch: DataFrame, _: int) -> None:
        rows = chunk_rows(batch.dropDuplicates(["path"])).persist()
        try:
            kept = store.read().join(batch.select(ids.file_id("path").alias("file_id")).distinct(), "file_id", "left_anti")
            store._replace(kept.unionByName(rows))
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def session_stream(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each user over a stream (or a table) of events with a watermark for late rows."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
