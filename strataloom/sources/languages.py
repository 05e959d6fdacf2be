"""File extensions and the languages they mean; the registry is a small mutable dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_BY_LANGUAGE = {
    "c": "c h",
    "cpp": "cc cpp cxx hh hpp hxx",
    "go": "go",
    "java": "java",
    "javascript": "cjs js jsx mjs",
    "python": "py pyi pyw",
    "rust": "rs",
    "typescript": "cts mts ts tsx",
}


class Registry:
    def __init__(self):
        self.known = {f".{ext}": language for language, exts in _BY_LANGUAGE.items() for ext in exts.split()}

    def register(self, extension: str, language: str) -> None:
        """Add or override an extension; the dot may be left out."""
        extension = extension.lower()
        self.known[extension if extension.startswith(".") else f".{extension}"] = language

    def extensions(self) -> list[str]:
        return sorted(self.known)

    def languages(self) -> list[str]:
        return sorted(set(self.known.values()))

    def detect(self, path: Column | str) -> Column:
        path = F.col(path) if isinstance(path, str) else path
        pairs = F.create_map(*[F.lit(x) for kv in sorted(self.known.items()) for x in kv])
        return F.coalesce(pairs[F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))], F.lit("unknown"))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.known.items()), "extension string, language string")


REGISTRY = Registry()
