"""Tables that cut lineage: Parquet in the folder that the cluster shares (spark.checkpoint.dir)."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="strataloom-shared-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


class Workspace:
    """Named tables of one run. A table that a later one replaces can be dropped at once."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return it as read back: its lineage ends at files that outlive any executor."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def extended(df: DataFrame, *fields: tuple[str, str | T.DataType]) -> T.StructType:
    """The schema of df with further fields; df.schema itself is cached and must stay as it is."""
    schema = T.StructType(list(df.schema.fields))
    for name, kind in fields:
        schema.add(name, kind)
    return schema


def unused(name: str, taken) -> str:
    """name, with as many underscores behind it as it takes to be none of `taken` (whatever the case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name
