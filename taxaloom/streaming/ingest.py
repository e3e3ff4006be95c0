"""Resumable ingestion: files arrive in a folder, each batch is appended once, a restart goes on after the last."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def ingest(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, file_format: str = "parquet", transform: Callable[[DataFrame], DataFrame] | None = None, max_files: int = 1000) -> int:
    """Appends all new files of ``source`` to ``target`` (Parquet) and returns the number of batches.

    A batch is written to a folder of its number, so one that runs again after a failure replaces itself.
    """
    stream = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", max_files).load(source)

    done: set[int] = set()

    def append(batch: DataFrame, number: int) -> None:
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")
        done.add(number)

    query = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(done)
