"""Katz centrality by power iteration over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settle


def katz(nodes: DataFrame, edges: DataFrame, most: int = 100, tolerance: float = 1e-6, beta: float = 1.0, alpha: float = 0.1) -> DataFrame:
    """(id, raw, katz, converged): beta plus alpha times the sum over incoming edges, parallel edges counted, scaled to 0..1.

    Stops once the summed change is below tolerance times the nodes, or after `most` rounds, with `converged` false.
    If all raw values are equal, all are 1.0. Edges are counted once into weights, so that a round shuffles one sum.
    """
    ids = settle(nodes.select("id").distinct())
    n = ids.count()
    weights = settle(edges.groupBy("src", "tgt").agg(F.count("*").cast("double").alias("w")).join(ids.withColumnRenamed("id", "src"), "src", "left_semi"))
    now, converged = ids.withColumn("raw", F.lit(0.0)), n == 0
    for _ in range(most if n else 0):
        inflow = weights.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("tgt").alias("id")).agg(F.sum(F.col("w") * F.col("raw")).alias("inflow"))
        after = settle(now.join(inflow, "id", "left").select("id", F.col("raw").alias("before"), (F.lit(beta) + F.lit(alpha) * F.coalesce("inflow", F.lit(0.0))).alias("raw")))
        change = after.agg(F.sum(F.abs(F.col("raw") - F.col("before")))).first()[0] if tolerance > 0 else None
        now = after.select("id", "raw")
        if change is not None and change < tolerance * n:
            converged = True
            break
    bounds = now.agg(F.min("raw").alias("low"), F.max("raw").alias("high"))
    span = F.col("high") - F.col("low")
    return now.join(F.broadcast(bounds)).select("id", "raw", F.when(span < 1e-10, 1.0).otherwise((F.col("raw") - F.col("low")) / span).alias("katz"), F.lit(converged).alias("converged"))
