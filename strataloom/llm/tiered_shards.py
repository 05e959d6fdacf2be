"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable shards. A shard's tier is the logarithm of its size; once a tier holds
`fan_in` shards, runs of them are merged into one of up to the target size. Each append and each round of merges
writes new files only and then commits a new version of the manifest, by renaming a finished file to its final name;
readers see one version or the other. A merge is committed only onto a version that still holds all its inputs, so two
compactors never merge the same shard twice. Files stay until `vacuum` is called, which keeps all that the retained
versions name; files that no version names are left-overs of failed runs.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, unused

#: What `read` adds to the columns of the shards.
RESULT = ("shard_id", "tier", "version")


@dataclass(frozen=True)
class Shard:
    shard_id: int
    path: str
    n_rows: int
    n_bytes: int
    tier: int


class VersionTaken(RuntimeError):
    """Another writer committed the version first."""


class ShardStore:
    """A folder of shards with versioned manifests. One writer at a time wins a version; the others commit onto the next one."""

    def __init__(self, spark: SparkSession, root: str, small_bytes: int = 16 << 20, target_bytes: int = 256 << 20, fan_in: int = 4, merges_a_job: int = 64):
        self.spark, self.root = spark, root
        self.small_bytes, self.target_bytes, self.fan_in, self.merges_a_job = small_bytes, target_bytes, fan_in, merges_a_job
        self._jvm = spark._jvm
        self.fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{root}/manifest"))

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    # the manifest

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(self._path(f"{self.root}/manifest")) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, shards); the newest by default, (0, []) before the first commit. As long as the shards are many, not the rows."""
        known = self.versions()
        if version is None:
            if not known:
                return 0, []
            version = known[-1]
        stream = self.fs.open(self._path(f"{self.root}/manifest/v{version:08d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, [Shard(**x) for x in json.loads(text)]

    def commit(self, base: int, shards: list[Shard]) -> int:
        """Version base + 1 with these shards, if no one else has made it."""
        final = self._path(f"{self.root}/manifest/v{base + 1:08d}.json")
        draft = self._path(f"{self.root}/manifest/draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps([asdict(s) for s in shards]).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise VersionTaken(f"version {base + 1} was committed by another writer")
        return base + 1

    # shards

    def tier(self, n_bytes: int) -> int:
        return max(0, math.floor(math.log(max(n_bytes, 1) / self.small_bytes, self.fan_in) + 0.5))

    def _write(self, df: DataFrame, rows_a_file: int = 0) -> list[tuple[str, int, int]]:
        """(path, rows, bytes) of the files that df's partitions become; a partition without rows leaves none."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(folder)
        counted = self.spark.read.schema(df.schema).parquet(folder).groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("n_bytes")).agg(F.count("*").alias("n_rows"))
        return sorted((r["path"], r["n_rows"], r["n_bytes"]) for r in counted.collect())

    def land(self, table: DataFrame, rows_a_shard: int) -> list[tuple[str, int, int]]:
        """The table as small files of at most `rows_a_shard` rows, in its order and without a shuffle; not committed yet."""
        return self._write(table, rows_a_shard)

    def commit_change(self, change) -> int:
        """The version that `change(shards)` makes of the newest one's shards. A lost race is tried again on the version that won; change gives None to give up."""
        while True:
            base, shards = self.manifest()
            made = change(shards)
            if made is None:
                return base
            try:
                return self.commit(base, made)
            except VersionTaken:
                continue

    def _numbered(self, shards: list[Shard], files: list[tuple[str, int, int]]) -> list[Shard]:
        next_id = 1 + max((s.shard_id for s in shards), default=-1)
        return [Shard(next_id + k, p, n, b, self.tier(b)) for k, (p, n, b) in enumerate(files)]

    def append_files(self, files: list[tuple[str, int, int]]) -> int:
        """One arrival: files that are written become shards of a new version."""
        return self.commit_change(lambda shards: [*shards, *self._numbered(shards, files)])

    def append(self, arrival: DataFrame) -> int:
        """One arrival as small shards: a file a partition, no shuffle."""
        return self.append_files(self._write(arrival))

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Runs to merge: neighbours in age within a tier, at least two and together at most the target (fan_in shards in the tier at least)."""
        groups = []
        for tier in sorted({s.tier for s in shards}):
            own = sorted((s for s in shards if s.tier == tier and s.n_bytes < self.target_bytes // 2), key=lambda s: s.shard_id)
            if len(own) < self.fan_in:
                continue
            run, size = [], 0
            for s in own:
                if run and size + s.n_bytes > self.target_bytes:
                    groups.append(run)
                    run, size = [], 0
                run.append(s)
                size += s.n_bytes
            groups.append(run)
        return [g for g in groups if len(g) > 1]

    def compact(self, schema) -> int:
        """Rounds of merges until no tier is due. A merge is one task that streams its run into one file; merges of a round run side by side.

        A job's merges are committed together, onto the newest version if that still holds all their inputs; if another
        compactor took some of them, the files just made are dropped and the next round plans anew.
        """
        while True:
            version, shards = self.manifest()
            groups = self.plan(shards)[: self.merges_a_job]
            if not groups:
                return version
            parts = None
            for g in groups:
                part = self.spark.read.schema(schema).parquet(*[s.path for s in g]).coalesce(1)
                parts = part if parts is None else parts.union(part)
            files = self._write(parts)
            inputs = {s.shard_id: s for g in groups for s in g}
            if sum(n for _, n, _ in files) != sum(s.n_rows for s in inputs.values()):
                raise RuntimeError("a merge lost rows; nothing was committed")
            taken = []

            def merged(now: list[Shard]) -> list[Shard] | None:
                taken[:] = [i for i, s in inputs.items() if s not in now]
                return None if taken else [s for s in now if s.shard_id not in inputs] + self._numbered(now, files)

            self.commit_change(merged)
            if taken:
                for path, _, _ in files:
                    self.fs.delete(self._path(path), False)

    def vacuum(self, keep_versions: int = 10, older_than_s: float = 3600.0) -> int:
        """Forget all but the newest `keep_versions` versions, and delete the shards that only they name and that are `older_than_s` old; returns how many.

        Called by whoever runs the store, never by a merge: until then every version can be read. The age protects
        writers that have not committed yet, and readers that began on a version that has just been forgotten.
        """
        known = self.versions()
        kept, gone = known[-keep_versions:], known[:-keep_versions]
        named = {s.path for v in kept for s in self.manifest(v)[1]}
        due = {s.path for v in gone for s in self.manifest(v)[1]} - named
        oldest = time.time() * 1000 - older_than_s * 1000
        dropped = 0
        for path in sorted(due):
            p = self._path(path)
            if self.fs.exists(p) and self.fs.getFileStatus(p).getModificationTime() <= oldest:
                dropped += bool(self.fs.delete(p, False))
        # a version is forgotten once none of its own files is left
        for v in gone:
            if all(s.path in named or not self.fs.exists(self._path(s.path)) for s in self.manifest(v)[1]):
                self.fs.delete(self._path(f"{self.root}/manifest/v{v:08d}.json"), False)
        return dropped

    def read(self, schema, version: int | None = None) -> DataFrame:
        """Rows of one version, with their shard's id, tier and version. Columns of these names in the shards give way to them."""
        version, shards = self.manifest(version)
        kept = [F.col(f.name) for f in schema if f.name not in RESULT]
        if not shards:
            return self.spark.createDataFrame([], schema).select(*kept).withColumns({"shard_id": F.lit(0).cast("long"), "tier": F.lit(0), "version": F.lit(version)})
        path = unused("_path", schema.names)
        rows = self.spark.read.schema(schema).parquet(*[s.path for s in shards]).select(*kept, F.col("_metadata.file_path").alias(path))
        names = self.spark.createDataFrame([(s.path, s.shard_id, s.tier) for s in shards], f"`{path}` string, shard_id long, tier int")
        return rows.join(names, path).drop(path).withColumn("version", F.lit(version))


def table_bytes(table: DataFrame) -> int:
    """Bytes of the files behind the table; 0 where there are none."""
    jvm, total = table.sparkSession._jvm, 0
    conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for f in table.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(f)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def shard_documents(docs: DataFrame, root: str | None = None, least_arrivals: int = 12, side_by_side: int | None = None, **sizes) -> DataFrame:
    """All rows of docs after every arrival was appended and compacted, with shard_id, tier and version.

    The table lands as small files in its own order, each of about `small_bytes` and of a `least_arrivals`-th of the
    rows at most; each file is an arrival with a version of its own, however many there are. After every `fan_in`
    arrivals for each of the merges that run `side_by_side` (the session's parallelism by default), tiers that are due
    are merged. Every column and row is kept as it is, nulls, repeated rows and very long texts too; a shard is never
    split in a row. An empty table commits no shard and gives an empty result. Columns of docs named shard_id, tier or
    version stay in the shards; in the result the three new ones take their places. Files that merges replaced stay
    for readers of older versions until `vacuum`.
    """
    spark = docs.sparkSession
    store = ShardStore(spark, root or Workspace(spark, "shards").path("store"), **sizes)
    n = docs.count()
    files = store.land(docs, max(1, -(-n // max(least_arrivals, -(-table_bytes(docs) // store.small_bytes))))) if n else []
    step = store.fan_in * (side_by_side or spark.sparkContext.defaultParallelism)
    for k in range(0, len(files), step):
        for f in files[k : k + step]:
            store.append_files([f])
        store.compact(docs.schema)
    return store.read(docs.schema)


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    """The shard of every document once all arrivals are compacted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_documents(docs).select("doc_id", "n_chars", "shard_id", "tier", "version")
