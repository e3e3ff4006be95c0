"""Windows, sets, filters and splits over rows of any table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.shared import shared_folder, stored

Keys = Sequence[str]


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def ordered(keys: Sequence[str | Column]) -> list[Column]:
    """Sort keys; a leading minus means descending."""
    return [k if isinstance(k, Column) else F.col(k[1:]).desc() if k.startswith("-") else F.col(k).asc() for k in keys]


def keep_first(df: DataFrame, keys: Keys, order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``, which should end in a unique key."""
    w = Window.partitionBy(*keys).orderBy(*ordered(order))
    return df.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def top_per_group(df: DataFrame, keys: Keys, order: Sequence[str | Column], n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*ordered(order))
    return df.withColumn("_row", F.row_number().over(w)).where(F.col("_row") <= n).drop("_row")


def number_in_group(df: DataFrame, keys: Keys, order: Sequence[str | Column], name: str) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*ordered(order))))


def running_total(df: DataFrame, keys: Keys, amount: Column, name: str, part_rows: int | None = None) -> DataFrame:
    """The sum of ``amount`` over all rows up to each, in the order of ``keys``, which are unique.

    Rows are dealt into ranges of the keys, as many as shuffles have partitions (or of about ``part_rows`` rows each), and written; each range is summed by
    itself, and the sums of the ranges before, one row for each, are added. So no task orders the whole table, and ``df`` is run once.
    """
    parts = max(1, -(-df.count() // part_rows)) if part_rows else int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumn("_amount", amount).repartitionByRange(parts, *[F.col(f"`{k}`") for k in keys]).withColumn("_part", F.spark_partition_id())
    placed = stored(dealt, shared_folder(df.sparkSession, "totals"), "placed")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum("_amount").alias("_sum")).select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = F.sum("_amount").over(Window.partitionBy("_part").orderBy(*[F.col(f"`{k}`") for k in keys]).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_within", within).join(F.broadcast(sums), "_part").withColumn(name, F.col("_before") + F.col("_within")).drop("_part", "_amount", "_within", "_before")


def group_ids(df: DataFrame, keys: Keys, name: str) -> DataFrame:
    """A number for each distinct key, in key order."""
    distinct = df.select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    ids = running_total(distinct, [f"_{k}" for k in keys], F.lit(1), name).withColumn(name, F.col(name).cast("int"))
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(ids[f"_{k}"]) for k in keys])
    return df.join(ids, same).drop(*[f"_{k}" for k in keys])


def with_group_aggregates(df: DataFrame, keys: Keys, **aggregates: Column) -> DataFrame:
    """Aggregates of its group on each row: a grouped table joined back, so a large group is combined early."""
    found = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(*[c.alias(n) for n, c in aggregates.items()])
    same = reduce(lambda a, b: a & b, [df[k].eqNullSafe(found[f"_{k}"]) for k in keys])
    return df.join(found, same, "left").drop(*[f"_{k}" for k in keys])


def local_peaks(df: DataFrame, keys: Keys, order: str, value: str, threshold: float) -> DataFrame:
    """Rows whose value exceeds both neighbours by more than the threshold."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    return near.where((F.col(value) - F.col("_a") > threshold) & (F.col(value) - F.col("_b") > threshold)).drop("_a", "_b")


def fill_down(df: DataFrame, keys: Keys, order: str, levels: Sequence[str]) -> DataFrame:
    """Carries each level's value to the rows below it, until a row sets a higher level."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = {}
    for k, level in enumerate(levels):
        # The last row that set this level or a higher one tells this level's value, null if it set a higher one alone.
        sets = reduce(lambda a, b: a | b, [F.col(h).isNotNull() for h in levels[: k + 1]])
        filled[level] = F.last(F.when(sets, F.struct(F.col(level).alias("v"))), ignorenulls=True).over(w)["v"]
    return df.withColumns(filled)


def seeded_order(seed: int, *keys: str) -> Column:
    """A repeatable shuffling key, the same in every engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def best_by_key(df: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The n different keys with the highest score, one row each, best first."""
    best = keep_first(df, [key], [F.col(score).desc(), F.col(key)])
    return best.orderBy(F.col(score).desc(), F.col(key)).limit(n)


def union_distinct(a: DataFrame, b: DataFrame, drop_null_rows: bool = False) -> DataFrame:
    out = a.unionByName(b).distinct()
    return out.dropna() if drop_null_rows else out


def ragged_union(*tables: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def union_audit(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in each table, merged, duplicates, rows with nulls among the distinct, and what b added."""
    rows = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    names = a.columns
    each = rows.groupBy(*names).agg(F.count("*").alias("_n"), F.count_if(F.col("_side") == 1).alias("_a"))
    incomplete = reduce(lambda x, y: x | y, [F.col(c).isNull() for c in names])
    return each.agg(
        F.coalesce(F.sum("_a"), F.lit(0)).alias("rows_a"),
        F.coalesce(F.sum(F.col("_n") - F.col("_a")), F.lit(0)).alias("rows_b"),
        F.count("*").alias("merged"),
        F.coalesce(F.sum("_n") - F.count("*"), F.lit(0)).alias("duplicates"),
        F.count_if(incomplete).alias("incomplete"),
        F.count_if(F.col("_a") == 0).alias("added"),
    )


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition holds, and all others (null included)."""
    flag = F.coalesce(condition, F.lit(False))
    return df.where(flag), df.where(~flag)


def any_symbol(columns: Keys, symbols: Sequence[str]) -> Column:
    return F.exists(F.array(*columns), lambda x: F.coalesce(x.isin(*symbols), F.lit(False)))


def all_symbols(columns: Keys, symbols: Sequence[str]) -> Column:
    return F.forall(F.array(*columns), lambda x: F.coalesce(x.isin(*symbols), F.lit(False)))


def mapped(c: Column, mapping: Mapping[str, str]) -> Column:
    """Looks a value up in a small fixed map; null if absent."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])[c]


def unpivot(df: DataFrame, ids: Keys, values: Keys, name: str = "variable", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)
