"""Bounded samples of labelled rows, chosen by a hash of doc_id, and the split that keeps a fifth of the rows out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `per_class` rows of each class 0 and 1 that are not held out.

    The rows are those of the least hash, so they are the same on every run and spread over all sources. At most
    2 * per_class ids are broadcast; the documents are scanned once and not shuffled. A doc_id that repeats in
    either table may give several rows; the bound holds for the labels and again for what is collected.
    """
    chosen = None
    for value in (0, 1):
        part = labels.filter(~held_out() & (F.col(label) == value)).select("doc_id", F.col(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").limit(2 * per_class)
    table = rows.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    return table["text"].to_pylist(), table["y"].to_pylist()


def language_sample(docs: DataFrame, per_language: int) -> tuple[list[str], list[str]]:
    """Texts and languages of at most `per_language` rows of each language that are not held out.

    A first pass counts the languages (one row each comes back); a second keeps the rows whose hash falls under the
    share that each language needs. A language below the bound is taken whole.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return [], []
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 0.9 * per_language / n) if n > per_language else 1.0)])
    picked = usable.select("doc_id", "text", "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    table = picked.limit(per_language * len(counts)).toArrow().sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    return table["text"].to_pylist(), table["lang"].to_pylist()
