"""Packing scored items into a token budget."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship


def candidates(items: DataFrame, budget: int, least: float = 0.0, order: Column | None = None) -> DataFrame:
    """id, score, cost of items that may be packed: score at least `least`, the first row of an id, cost within the budget."""
    kept = items.filter(F.col("score") >= least)
    first = Window.partitionBy("id").orderBy(order if order is not None else F.desc("score"))
    return kept.withColumn("_n", F.row_number().over(first)).filter((F.col("_n") == 1) & (F.col("cost") <= budget)).drop("_n")


def useful(items: DataFrame, budget: int, group: list[str], weight: Column) -> DataFrame:
    """items without those that no packing of the budget takes.

    Of items of one weight w, a greedy or a best packing takes a prefix by score, of budget / w at most. What is left
    of a group is thus bounded by the budget alone, however many rows it has.
    """
    order = Window.partitionBy(*group, "_w").orderBy(F.desc("score"), "id", "cost")
    ranked = items.withColumn("_w", weight).withColumn("_n", F.row_number().over(order))
    return ranked.filter((F.col("_w") <= budget) & (F.col("_n") * F.col("_w") <= budget)).drop("_w", "_n")


def greedy(items: DataFrame, budget: int, group: list[str] | None = None) -> DataFrame:
    """Items taken in the order of score per cost, skipping what does not fit; ties go to the smaller id.

    One aggregate over the sorted candidates of a group: what is left of the budget decides each next item, which no
    running sum can tell.
    """
    group = group or []
    line = F.array_sort(F.collect_list(F.struct((-F.col("score") / F.col("cost")).alias("density"), "id", "cost", "score")))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<id:bigint,cost:bigint,score:double>>").alias("taken"))

    def step(s: Column, x: Column) -> Column:
        item = F.struct(x["id"].cast("long").alias("id"), x["cost"].cast("long").alias("cost"), x["score"].cast("double").alias("score"))
        return F.when(x["cost"] <= s["left"], F.struct((s["left"] - x["cost"]).alias("left"), F.concat(s["taken"], F.array(item)).alias("taken"))).otherwise(s)

    fit = useful(items, budget, group, F.col("cost"))
    packed = fit.groupBy(*group).agg(line.alias("line")).select(*group, F.explode(F.aggregate("line", start, step)["taken"]).alias("x"))
    return packed.select(*group, "x.*")


def exact(items: DataFrame, budget: int, quantum: int = 64, group: list[str] | None = None) -> DataFrame:
    """The best total score of each group, with costs rounded up to quanta; items without a score are never taken."""
    ship(items.sparkSession)
    size, group = budget // quantum, group or []

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id").reset_index(drop=True)
        weight = np.ceil(pdf.cost.to_numpy() / quantum).astype(int)
        best, takes = np.zeros(size + 1), np.zeros((len(pdf), size + 1), bool)
        for i, (w, value) in enumerate(zip(weight, pdf.score.to_numpy())):
            if w > size or value <= 0:
                continue
            better = best.copy()
            better[w:] = np.maximum(best[w:], best[: size + 1 - w] + value)
            takes[i] = better > best
            best = better
        left, picked = size, []
        for i in range(len(pdf) - 1, -1, -1):
            if takes[i, left]:
                picked.append(i)
                left -= weight[i]
        return pdf.loc[sorted(picked)]

    rows = items.select(*group, F.col("id").cast("long").alias("id"), F.col("score").cast("double").alias("score"), F.col("cost").cast("long").alias("cost"))
    fit = useful(rows.filter("score > 0"), size, group, F.ceil(F.col("cost") / quantum))
    keyed = fit.groupBy(*group) if group else fit.withColumn("_all", F.lit(0)).groupBy("_all")
    out = keyed.applyInPandas(solve, (fit if group else fit.withColumn("_all", F.lit(0))).schema)
    return out.drop("_all")


def pack(items: DataFrame, budget: int = 8192, strategy: str = "greedy", quantum: int = 64, least: float = 0.0) -> DataFrame:
    """id, score, cost, position of what is packed, best score first."""
    fit = candidates(items, budget, least)
    chosen = greedy(fit, budget) if strategy == "greedy" else exact(fit, budget, quantum)
    return chosen.select("id", "score", "cost").withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def totals(packed: DataFrame, items: DataFrame, budget: int) -> DataFrame:
    """total_tokens, utilization, packed and dropped of one packing."""
    all_items = items.select("id").distinct().agg(F.count("*").alias("n"))
    used = packed.agg(F.coalesce(F.sum("cost"), F.lit(0)).cast("long").alias("total_tokens"), F.count("*").alias("packed"))
    return used.join(F.broadcast(all_items)).select("total_tokens", (F.col("total_tokens") / F.lit(budget)).alias("utilization"), "packed", (F.col("n") - F.col("packed")).alias("dropped"))
