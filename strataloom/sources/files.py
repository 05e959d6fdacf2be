"""Source files as a table: recursive scan, ignore globs, size, language, binary and blank filters."""

from __future__ import annotations

import fnmatch
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..session import ship
from .languages import REGISTRY, Registry

#: Globs of what is not source, in alphabetical order.
IGNORED = ("*.bundle.js", "*.egg-info/**", "*.map", "*.min.js", "*.pyc", ".git/**", ".venv/**", "__pycache__/**", "build/**", "dist/**", "node_modules/**", "venv/**")


def _java(glob: str) -> str:
    """A glob as an anchored regular expression of Java; * crosses slashes."""
    return "^" + fnmatch.translate(glob).replace("(?s:", "(?s)").removesuffix(")\\Z").removesuffix(")\\z") + "$"


def ignored(path: Column | str, globs: tuple[str, ...] = IGNORED) -> Column:
    """True where a glob fits the whole path, or, less its trailing slashes and stars, one of its parts."""
    path = F.col(path) if isinstance(path, str) else path
    whole = "|".join(f"(?:{_java(g)})" for g in globs)
    part = "|".join(f"(?:{_java(g.rstrip('/*'))})" for g in globs if g.rstrip("/*"))
    return path.rlike(whole) | F.exists(F.split(path, "/"), lambda p: p.rlike(part))


def decoded(batches):
    """content as text with its encoding: UTF-8, else Latin-1; null for binary files (a zero byte in the first 8000)."""
    for batch in batches:
        texts, encodings = [], []
        for raw in batch.column("raw").to_pylist():
            if raw is None or b"\0" in raw[:8000]:
                texts.append(None)
                encodings.append(None)
                continue
            try:
                texts.append(raw.decode("utf-8"))
                encodings.append("utf-8")
            except UnicodeDecodeError:
                texts.append(raw.decode("latin-1"))
                encodings.append("latin-1")
        keep = [batch.column(c) for c in ("path", "size_bytes", "language")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(texts, pa.string()), pa.array(encodings, pa.string())], names=["path", "size_bytes", "language", "content", "encoding"])


def listed(spark: SparkSession, root: str, globs: tuple[str, ...] = IGNORED, most_bytes: int = 1 << 20, unknown: bool = False, registry: Registry = REGISTRY) -> DataFrame:
    """path (relative), size_bytes, language, raw of the files that pass all filters that need no content."""
    # names come back percent-encoded, and so must the root that is cut off them
    prefix = f"^(?:file:)?/*\\Q{quote(root.removeprefix('file:').strip('/'), safe='/~._-')}\\E/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.url_decode(F.regexp_replace(F.regexp_replace("path", prefix, ""), r"\+", "%2B"))
    rows = rows.select(path.alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw")).withColumn("language", registry.detect("path"))
    rows = rows.filter(~ignored("path", globs) & (F.col("size_bytes") <= most_bytes))
    return rows if unknown else rows.filter("language <> 'unknown'")


def count_files(spark: SparkSession, root: str, **options) -> int:
    """Files that pass the filters on path, size and language; their content is not read."""
    return listed(spark, root, **options).select("path").count()


def scan(spark: SparkSession, root: str, metadata: dict[str, str] | None = None, **options) -> DataFrame:
    """The source files table: file_id, path, language, encoding, content, size_bytes, sha256, repo_root, metadata.

    sha256 is that of the decoded text in UTF-8. file_id depends on the path alone, so that runs agree.
    """
    ship(spark)
    text = listed(spark, root, **options).mapInArrow(decoded, "path string, size_bytes long, language string, content string, encoding string")
    return finish(text.filter(F.col("content").rlike(r"\S")), root, metadata)


def finish(files: DataFrame, root: str | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else F.lit(None).cast("map<string,string>")
    return files.withColumns({"file_id": ids.file_id("path"), "sha256": F.sha2(F.encode("content", "UTF-8"), 256), "repo_root": F.lit(root), "metadata": pairs}).select("file_id", "path", "language", "encoding", "content", "size_bytes", "sha256", "repo_root", "metadata")


def read_file(spark: SparkSession, root: str, path: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """One file by its relative path, whatever its size, name or language."""
    rows = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/{path}").select(F.lit(path).alias("path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))
    ship(spark)
    text = rows.withColumn("language", REGISTRY.detect("path")).mapInArrow(decoded, "path string, size_bytes long, language string, content string, encoding string")
    return finish(text.filter(F.col("content").rlike(r"\S")), root, metadata)


def changed(files: DataFrame, before: DataFrame) -> DataFrame:
    """Files whose (path, sha256) was not there before: what an incremental run has to index."""
    return files.join(before.select("path", "sha256").distinct(), ["path", "sha256"], "left_anti")
