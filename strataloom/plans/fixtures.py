"""Tables in the shape of code, made from the star-schema tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, tgt, conf: neighbouring lines of an order, of large quantity; nodes are parts."""
    by_order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(by_order).alias("tgt"), F.when(F.col("l_returnflag") == "N", 0.9).when(F.col("l_returnflag") == "A", 0.85).otherwise(0.5).alias("conf"), "l_quantity")
    return rows.filter("tgt is not null and tgt <> src and l_quantity >= 49").select("src", "tgt", "conf")


EDGES = """edges AS (SELECT src, tgt, conf FROM (
  SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS tgt,
         CASE l_returnflag WHEN 'N' THEN 0.90 WHEN 'A' THEN 0.85 ELSE 0.50 END AS conf, l_quantity AS q FROM lineitem)
  WHERE tgt IS NOT NULL AND tgt <> src AND q >= 49)"""

HUB = "hub AS (SELECT tgt AS id FROM edges GROUP BY tgt ORDER BY count(*) DESC, tgt LIMIT 1)"


def hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the node of most incoming edges."""
    return edges(spark, sf_dir).groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


def vector_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"])


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: id, name (with its size), file_id (the number of its brand), seq."""
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("name"), F.regexp_extract("p_brand", "#(.*)", 1).cast("long").alias("file_id"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("kind"))


SYMBOLS = "symbols AS (SELECT p_partkey AS id, p_name || ' ' || CAST(p_size AS VARCHAR) AS name, CAST(split_part(p_brand, '#', 2) AS BIGINT) AS file_id, p_partkey AS seq, p_type AS kind FROM part)"


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = symbols(spark, sf_dir).select("file_id").distinct()
    least = files.agg(F.min("file_id").alias("m"))
    f = F.col("file_id")
    made = files.join(F.broadcast(least)).select("file_id", F.explode(F.array((3 * f + 1) % 25 + F.col("m"), (7 * f + 2) % 25 + F.col("m"), (11 * f + 5) % 25 + F.col("m"))).alias("target"))
    return made.filter("target <> file_id").distinct()


IMPORTS = """imports AS (SELECT DISTINCT file_id, unnest([(3*file_id+1)%25+m, (7*file_id+2)%25+m, (11*file_id+5)%25+m]) AS target
  FROM (SELECT DISTINCT file_id FROM symbols), (SELECT min(file_id) AS m FROM symbols)),
links AS (SELECT file_id, target FROM imports WHERE target <> file_id)"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large lines as calls: call_id, file_id and caller_id of the line's part, and the callee's name."""
    own = symbols(spark, sf_dir)
    n = own.agg(F.count("*").alias("n"))
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity >= 45")
    lines = lines.join(F.broadcast(n)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", ((F.col("l_suppkey") * 37 + F.col("l_linenumber") * 11 + F.col("l_orderkey") * 5) % F.col("n")).alias("wanted"))
    lines = lines.join(own.select(F.col("id").alias("wanted"), F.col("name").alias("callee")), "wanted").join(own.select(F.col("id").alias("l_partkey"), "file_id"), "l_partkey")
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return lines.select(key.alias("call_id"), "file_id", F.col("l_partkey").alias("caller_id"), "callee")


CALLS = """calls AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS call_id, own.file_id, l_partkey AS caller_id, far.name AS callee
  FROM lineitem JOIN symbols own ON own.id = l_partkey
  JOIN symbols far ON far.id = (l_suppkey*37 + l_linenumber*11 + l_orderkey*5) % (SELECT count(*) FROM symbols) WHERE l_quantity >= 45)"""
