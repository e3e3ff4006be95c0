"""Writers: tables, species-clustered tables, appended results and reused tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_transformed(df: DataFrame, path: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Applies a table function, writes its result and reads it back."""
    df.transform(transform).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def write_by_species(df: DataFrame, path: str, species: str, partitions: int | None = None, salt: int = 1) -> None:
    """One table clustered by species: a filter on species reads few row groups, and no species has a file of its own.

    Range partitions split by (species, salt), so that a species with very many records spreads.
    """
    keys = [F.col(species), (F.xxhash64(*[F.col(c) for c in df.columns]) % salt)] if salt > 1 else [F.col(species)]
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(species).write.mode("overwrite").parquet(path)


def deal(df: DataFrame, key: str) -> DataFrame:
    """Parts by the key, all of about the size that adaptive execution aims at, however many rows there are: a key of very many records gets several."""
    return df.hint("rebalance", key)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int, dealt: bool = False) -> DataFrame:
    """One table in ``buckets`` by the key, sorted by it, under ``path``; returned as read back.

    Grouping by the key, or joining on it with another table of as many buckets, needs no shuffle, however often it is done. A bucket is one task's:
    where one key holds a large share of the rows, :func:`write_by_species` with a salt is the better table.

    Rows are dealt out by the key first, so that a task sorts one part in memory, however large its share of the input was. ``dealt`` says that they
    have been (:func:`deal`): where columns are added or joined to narrow rows, deal the narrow ones.
    """
    rows = df if dealt else deal(df, key)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def reused(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Reads a table if it is there, else makes and writes it first. A table that is there and can't be read raises."""
    if not is_there(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def is_there(spark: SparkSession, path: str) -> bool:
    """A table whose write was finished."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)
