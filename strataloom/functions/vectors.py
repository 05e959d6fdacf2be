"""Vector arithmetic over array columns. Everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Sum of products over the shorter of the two lengths."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def normalized(v: Column) -> Column:
    """v at length 1; a zero vector as it is."""
    return F.when(norm(v) == 0, v).otherwise(F.transform(v, lambda x: x / norm(v)))


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def score(v: Column, query: Column, metric: str = "cosine", scale: str = "raw") -> Column:
    """Higher is nearer: cosine, dot or minus the Euclidean distance. `unit` maps cosine to 0..1."""
    if metric == "dot":
        raw = dot(v, query)
    elif metric == "euclidean":
        raw = -F.sqrt(squared_distance(v, query))
    elif metric == "cosine":
        length = norm(v) * norm(query)
        raw = F.when(length == 0, F.lit(0.0)).otherwise(dot(v, query) / length)
    else:
        raise ValueError(f"no metric {metric}")
    if scale == "unit":
        if metric != "cosine":
            raise ValueError("only cosine has a unit scale")
        return F.greatest(F.lit(0.0), (raw + 1) / 2)
    return raw
