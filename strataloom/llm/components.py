"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is linked to the least vertex around it."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a vertex, and the vertex, is linked to the least of them. Edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b")).filter("a <> b")


def connected_components(ws: Workspace, links: DataFrame, left: str, right: str, name: str = "components") -> DataFrame:
    """(id, component) for every id that some link holds; component is the least id that links reach.

    Nothing but two numbers a round comes to the driver. Each round is written to the shared folder. The minimum
    around a vertex is aggregated before the shuffle, and the join back is by vertex, which adaptive execution
    splits where one vertex is hot. Links to itself and links with a null end are ignored; an empty table gives an
    empty one.
    """
    edges = ws.keep(
        links.select(F.greatest(left, right).cast("long").alias("a"), F.least(left, right).cast("long").alias("b")).filter(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))).distinct(),
        f"{name}-0",
    )
    before, k = None, 0
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
        before, k = now, k + 1
        edges = ws.keep(_small_star(_large_star(edges).distinct()).distinct(), f"{name}-{k}")
        ws.drop(f"{name}-{k - 1}")
