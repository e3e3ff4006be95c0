"""Tables in the folder that driver and executors share: lineage ends there, and a lost executor costs a task."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``, or in the context's checkpoint folder; where neither is set a temporary one, with a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
        if set_.isDefined():
            root = set_.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        else:
            root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str, compression: str | None = None) -> DataFrame:
    """Writes a table and reads it back."""
    path = f"{folder}/{name}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
