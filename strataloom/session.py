"""Session construction and the one place that ships this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def local_session(app: str = "strataloom", cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the bench use; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Make the package importable on the executors; done once for each application.

    Nothing is sent where the package root is on PYTHONPATH already, as that is inherited by the workers.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(":"):
        return spark
    target = Path(tempfile.mkdtemp(prefix="strataloom-")) / "strataloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(ROOT.rglob("*.py")):
            z.write(p, p.relative_to(ROOT.parent))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)
    return spark
