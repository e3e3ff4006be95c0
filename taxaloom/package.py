"""Gives this package to the executors, for the few functions that run in Python there."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per Spark application."""
    sc = spark.sparkContext
    if getattr(sc, "_taxaloom_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-", dir="/tmp"), "taxaloom.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "taxaloom").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(archive)
    sc._taxaloom_shipped = True
