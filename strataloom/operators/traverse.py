"""Traversal of edge tables (src, tgt, conf) by joins: k hops, shortest paths, closures, widest paths, impact."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..lineage import settle

#: Levels after which what was seen is written as one table, so that plans stay short however deep a search goes.
SETTLE_EVERY = 16


def hops(edges: DataFrame, start: DataFrame, depth: int | None, reverse: bool = False) -> DataFrame:
    """(id, depth) of what is reached from the start ids in at most `depth` steps, or in any number (None), the starts left out.

    Reverse follows edges from target to source. A level is one join, less what was seen before; up to three levels
    are one plan, more are cut by checkpoints.
    """
    here, there = ("tgt", "src") if reverse else ("src", "tgt")
    steps = edges.select(F.col(here).alias("at"), F.col(there).alias("id")).distinct()
    first = start.select(F.col(start.columns[0]).alias("id")).distinct()
    if depth is None or depth > 1:
        steps = settle(steps)  # planned and computed once, not once a level
    seen, level = first.withColumn("depth", F.lit(0)), first
    for d in count(1) if depth is None else range(1, depth + 1):
        level = steps.join(level.withColumnRenamed("id", "at"), "at").select("id").distinct().join(seen.select("id"), "id", "left_anti")
        if depth is None or depth > 3:
            level = settle(level)
            if level.isEmpty():
                break
        seen = seen.union(level.withColumn("depth", F.lit(d)))
        if d % SETTLE_EVERY == 0:
            seen = settle(seen)
    return seen.filter("depth > 0")


def callers(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    return hops(edges, start, depth, reverse=True)


def callees(edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    return hops(edges, start, depth)


def neighbours(edges: DataFrame, start: DataFrame, rel_type: str, outgoing: bool = True) -> DataFrame:
    """Ids one step away by edges of one type."""
    return hops(edges.filter(F.col("rel_type") == rel_type), start, 1, reverse=not outgoing).select("id")


def shortest_path(edges: DataFrame, source, target) -> DataFrame:
    """One row with `path`, an array of ids, or no row. Of equally short paths it is the least, id by id. A node reaches itself by [source]."""
    spark, steps = edges.sparkSession, settle(edges.select("src", "tgt").distinct())
    kind = dict(edges.dtypes)["src"]
    level = spark.range(1).select(F.lit(source).cast(kind).alias("id"), F.array(F.lit(source).cast(kind)).alias("path"))
    seen = level.select("id")
    for d in count(1):
        hit = level.filter(F.col("id") == target)
        if not hit.isEmpty():
            return hit.select("path")
        level = steps.join(level.withColumnRenamed("id", "src"), "src").select(F.col("tgt").alias("id"), F.concat("path", F.array("tgt")).alias("path"))
        level = settle(level.groupBy("id").agg(F.min("path").alias("path")).join(seen, "id", "left_anti"))
        if level.isEmpty():
            break
        seen = seen.union(level.select("id"))
        if d % SETTLE_EVERY == 0:
            seen = settle(seen)
    return level.filter(F.lit(False)).select("path")


def closure_edges(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(src, tgt) of all edges that leave the start or anything it reaches."""
    inside = start.select(F.col(start.columns[0]).alias("id")).union(hops(edges, start, None).select("id"))
    return edges.select("src", "tgt").distinct().join(inside.withColumnRenamed("id", "src"), "src", "left_semi")


def adjacency(edges: DataFrame) -> DataFrame:
    """(src, targets): sorted targets of each source."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_set("tgt")).alias("targets"))


def widest_paths(edges: DataFrame, start: DataFrame, least: float = 0.0, missing: float = 0.5) -> DataFrame:
    """(id, conf): for everything that reaches the start, the best confidence of a path, which is its weakest edge's.

    The fixpoint of max over paths of min over edges; edges below `least` are left out, a null confidence counts as
    `missing`, the start is no result.
    """
    rel = edges.select("src", "tgt", F.coalesce("conf", F.lit(missing)).alias("w")).filter(F.col("w") >= least)
    rel = settle(rel.groupBy("src", "tgt").agg(F.max("w").alias("w")))
    origin = start.select(F.col(start.columns[0]).alias("id"))
    best = settle(origin.withColumn("conf", F.lit(1.0)))
    changed = best
    while True:
        reached = rel.join(changed.select(F.col("id").alias("tgt"), "conf"), "tgt").select(F.col("src").alias("id"), F.least("conf", "w").alias("new")).groupBy("id").agg(F.max("new").alias("new"))
        merged = settle(best.join(reached, "id", "full").select("id", F.greatest("conf", "new").alias("conf"), (F.col("conf").isNull() | (F.col("new") > F.col("conf"))).alias("moved")))
        changed = merged.filter(F.coalesce("moved", F.lit(False)))
        best = merged.select("id", "conf")
        if changed.isEmpty():
            return best.join(origin, "id", "left_anti")


def confidence_breakdown(impact: DataFrame) -> DataFrame:
    return impact.agg(
        F.count_if(F.col("conf") >= 0.85).alias("certain"),
        F.count_if((F.col("conf") >= 0.5) & (F.col("conf") < 0.85)).alias("probable"),
        F.count_if(F.col("conf") < 0.5).alias("speculative"),
    )


def impact_set(edges: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: str, least: float = 0.0) -> dict[str, DataFrame]:
    """What a change of one symbol may touch: callers by confidence, direct callers, subclasses, importing and affected files, injectors, and the breakdown."""
    start = symbols.filter(F.col("id") == symbol_id).select("id")
    calls = edges.filter("rel_type = 'CALLS'").select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt"), F.col("confidence").alias("conf"))
    other = lambda rel: edges.filter(F.col("rel_type") == rel).select(F.col("source_id").alias("src"), F.col("target_id").alias("tgt"))
    reached = widest_paths(calls, start, least)
    direct = hops(calls.filter(F.coalesce("conf", F.lit(0.5)) >= least), start, 1, reverse=True).select("id")
    subclasses = hops(other("INHERITS_FROM"), start, 1, reverse=True).select("id")
    injectors = hops(other("INJECTS"), start, 1, reverse=True).select("id")
    own_file = symbols.join(start, "id", "left_semi").select("file_id")
    touched = reached.select("id").union(subclasses).distinct()
    return {
        "callers": reached,
        "direct_callers": direct,
        "subclasses": subclasses,
        "injectors": injectors,
        "importing_files": files.join(hops(other("IMPORTS"), own_file, 1, reverse=True).select("id"), "id", "left_semi"),
        "affected_files": files.join(symbols.join(touched, "id", "left_semi").select(F.col("file_id").alias("id")).distinct(), "id", "left_semi"),
        "breakdown": confidence_breakdown(reached),
    }


def symbol_context(edges: DataFrame, symbols: DataFrame, files: DataFrame, symbol_id: str) -> DataFrame:
    """One row: the symbol, its file, and sorted arrays of (name, kind, qualified_name) around it. Each side is aggregated before it is joined."""
    one = symbols.filter(F.col("id") == symbol_id)
    entry = F.struct("name", "kind", "qualified_name")

    def around(rel: str, reverse: bool, name: str) -> DataFrame:
        mine, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
        near = edges.filter((F.col("rel_type") == rel) & (F.col(mine) == symbol_id)).select(F.col(far).alias("id")).distinct()
        return symbols.join(near, "id", "left_semi").agg(F.array_sort(F.collect_list(entry)).alias(name))

    def around_file(reverse: bool, name: str) -> DataFrame:
        mine, far = ("target_id", "source_id") if reverse else ("source_id", "target_id")
        own = one.select(F.col("file_id").alias(mine))
        near = edges.filter("rel_type = 'IMPORTS'").join(own, mine, "left_semi").select(F.col(far).alias("id")).distinct()
        return files.join(near, "id", "left_semi").agg(F.array_sort(F.collect_list("path")).alias(name))

    row = one.join(files.select(F.col("id").alias("file_id"), F.col("language").alias("file_language")), "file_id", "left")
    for rel, reverse, name in (("CALLS", True, "callers"), ("CALLS", False, "callees"), ("CONTAINS", True, "parents"), ("CONTAINS", False, "methods"), ("INHERITS_FROM", False, "inherits_from"), ("INHERITS_FROM", True, "subclasses")):
        row = row.join(F.broadcast(around(rel, reverse, name)))  # one row, so no cross product
    return row.join(F.broadcast(around_file(False, "file_imports"))).join(F.broadcast(around_file(True, "imported_by"))).withColumn("parent_class", F.get("parents", F.lit(0))).drop("parents")
