"""A session for tests and the bench, and shipping the package to the executors of any session."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let the workers import this package: Spark hands a zip of it to every executor, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quillon-"), "quillon-package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def session(cores: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators are tested under."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("quillon")
        .config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
