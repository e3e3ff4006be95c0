"""Exact quantiles of groups of any size, by counting.

Groups of few rows are put in order as they are. In a large one values are counted in buckets, first by their power of two and then by equal widths; the bucket that holds a wanted rank is counted again in finer
buckets, until it has few rows. Only those rows are put in order. No task sees all values of a group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.shared import shared_folder, stored

#: Buckets of a group in each round, and rows of a bucket that are put in order by one task.
BUCKETS, ORDERED_ROWS = 1024, 100_000


def _bucket(buckets: int, first: bool) -> Column:
    """In the first round one bucket for each sign and power of two, so that no later one spans more than a factor of two; then equal widths between _lo
    and _hi."""
    if first:
        power = F.floor(F.log2(F.abs("_v"))).cast("long") + 1100
        return F.when(F.col("_v") == 0, 0).when(F.col("_v") < 0, -power).otherwise(power).cast("long")
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    return F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.floor(share * buckets), F.lit(buckets - 1))).cast("long")


def group_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float], buckets: int = BUCKETS, ordered_rows: int = ORDERED_ROWS, max_rounds: int = 60) -> DataFrame:
    """keys and, for each column c, ``c_quantiles``: an array of the quantiles at the probabilities, interpolated between neighbours.

    Nulls and NaN don't count; a column without values in a group has null. ``df`` is read once to count, once for groups of up to
    ``ordered_rows`` and some times more if there are larger ones, so a costly one should be stored first. Null keys are a group. Without keys there
    is one group, and one row, whatever the table holds.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, named, strict=True)], *[F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)).alias(f"_v{i}") for i, c in enumerate(columns)])
    large = rows.groupBy(*named).agg(F.count("*").alias("_n")).where(F.col("_n") > ordered_rows).select(*[F.col(n).alias(f"{n}l") for n in named], "_n")
    folder = shared_folder(df.sparkSession, "quantiles")
    large = stored(large, folder, "large")
    final = [F.percentile(f"_v{i}", F.array(*[F.lit(float(p)) for p in probabilities])).alias(f"{c}_quantiles") for i, c in enumerate(columns)]
    if not large.take(1):
        return rows.groupBy(*named).agg(*final).withColumnsRenamed(dict(zip(named, keys, strict=True)))
    same = reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"{n}l")) for n in named], F.lit(True))
    held = rows.join(F.broadcast(large), same, "left_semi") if not keys else rows.join(large, same, "left_semi")
    found = _refined(held, named, [f"_v{i}" for i in range(len(columns))], probabilities, buckets, ordered_rows, max_rounds, folder)
    found = found.withColumnsRenamed({f"_v{i}_quantiles": f"{c}_quantiles" for i, c in enumerate(columns)})
    if keys:
        found = found.unionByName(rows.join(large, same, "left_anti").groupBy(*named).agg(*final))
    return found.withColumnsRenamed(dict(zip(named, keys, strict=True)))


def _refined(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probabilities: Sequence[float], buckets: int, ordered_rows: int, max_rounds: int, folder: str) -> DataFrame:
    """The same for large groups."""
    spark = df.sparkSession
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("one"))
    long = df.select(key.alias("_g"), F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for i, c in enumerate(columns)])).alias("_x"))
    long = long.select("_g", F.col("_x.c").alias("_c"), F.col("_x.v").alias("_v")).where("_v is not null and not isnan(_v)")
    ranges = stored(long.groupBy("_g", "_c").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n")), folder, "ranges")
    asked = F.array(*[F.struct(F.lit(i).alias("q"), F.lit(float(p)).alias("p")) for i, p in enumerate(probabilities)])
    ranks = ranges.select("_g", "_c", "_n", F.explode(asked).alias("a")).withColumn("_at", (F.col("_n") - 1) * F.col("a.p"))
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor("_at").alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil("_at").alias("rank"))))
    ranks = stored(ranks.select("_g", "_c", F.col("a.q").alias("_q"), (F.col("_at") - F.floor("_at")).alias("_share"), ends.alias("e")).select("_g", "_c", "_q", "_share", F.col("e.end").alias("_end"), F.col("e.rank").cast("long").alias("_rank")), folder, "ranks")
    # Nodes: stretches of values with the ranks before them; _node numbers the stretch within its group by its bounds.
    nodes = ranges.select("_g", "_c", "_lo", "_hi", F.lit(0).cast("long").alias("_before"), "_n")
    wanted = ranks.select("_g", "_c", "_rank").distinct()
    for k in range(max_rounds):
        most = nodes.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0
        if most <= ordered_rows:
            break
        inside = _inside(long, nodes)
        counted = inside.withColumn("_b", _bucket(buckets, k == 0)).groupBy("_g", "_c", "_before", "_b").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.count("*").alias("_n"))
        prior = F.sum("_n").over(Window.partitionBy("_g", "_c", "_before").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        placed = counted.select("_g", "_c", "_lo", "_hi", (F.col("_before") + F.coalesce(prior, F.lit(0))).alias("_before"), "_n")
        own = wanted.select(F.col("_g").alias("_g2"), F.col("_c").alias("_c2"), "_rank")
        holds = F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_c") == F.col("_c2")) & (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_n"))
        nodes = stored(placed.join(own, holds, "left_semi"), folder, f"nodes-{k}")
    else:
        raise RuntimeError(f"buckets hold too many rows after {max_rounds} rounds")
    each = _inside(long, nodes).groupBy("_g", "_c", "_before", "_v").agg(F.count("*").alias("_m"))
    upto = F.sum("_m").over(Window.partitionBy("_g", "_c", "_before").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    values = each.select("_g", "_c", "_v", (F.col("_before") + upto - F.col("_m")).alias("_from"), (F.col("_before") + upto).alias("_to"))
    right = ranks.withColumnsRenamed({"_g": "_g2", "_c": "_c2"})
    met = values.join(right, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_c") == F.col("_c2")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    low, high = F.max(F.when(F.col("_end") == 0, F.col("_v"))), F.max(F.when(F.col("_end") == 1, F.col("_v")))
    found = met.groupBy("_g", "_c", "_q").agg((low + (high - low) * F.max("_share")).alias("_v"))
    lists = [F.array(*[F.max(F.when((F.col("_c") == i) & (F.col("_q") == q), F.col("_v"))) for q in range(len(probabilities))]).alias(f"_list{i}") for i in range(len(columns))]
    out = found.groupBy("_g").agg(*lists)
    groups = df.select(key.alias("_all")).distinct() if keys else spark.range(1).select(F.struct(F.lit(0).alias("one")).alias("_all"))
    out = groups.join(out, F.col("_all").eqNullSafe(F.col("_g")), "left")
    own_list = [F.when(F.col(f"_list{i}")[0].isNotNull(), F.col(f"_list{i}")).alias(f"{c}_quantiles") for i, c in enumerate(columns)]
    return out.select(*[F.col(f"_all.k{i}").alias(k) for i, k in enumerate(keys)], *own_list)


def _inside(long: DataFrame, nodes: DataFrame) -> DataFrame:
    """Values with the stretch that they lie in: a group has a few stretches, which never overlap."""
    own = nodes.select(F.col("_g").alias("_g2"), F.col("_c").alias("_c2"), "_lo", "_hi", "_before")
    return long.join(own, F.col("_g").eqNullSafe(F.col("_g2")) & (F.col("_c") == F.col("_c2")) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).drop("_g2", "_c2")


def group_medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys and ``c_median`` for each column."""
    out = group_quantiles(df, keys, columns, [0.5])
    return out.select(*[F.col(f"`{k}`") for k in keys], *[F.col(f"{c}_quantiles")[0].alias(f"{c}_median") for c in columns])
