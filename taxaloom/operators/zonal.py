"""Counts, shares and summaries by cell, sub-region and taxon."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.operators.quantiles import group_medians
from taxaloom.operators.rows import with_group_aggregates
from taxaloom.shared import shared_folder, stored

Keys = Sequence[str]


def mode_per_column(df: DataFrame, key: str, columns: Keys) -> DataFrame:
    """The most frequent value of each column by key, blank for none; ties take the smallest value."""
    # Sums of sparse one-column rows stay one shuffle per grain: (key, column, value), then (key).
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x"))
    counts = long.where("x.v is not null").groupBy(key, "x.c", "x.v").agg(F.count("*").alias("n"))
    best = counts.groupBy(key, "c").agg(F.min(F.struct((-F.col("n")).alias("n"), "v")).alias("m"))
    wide = best.groupBy(key).agg(*[F.max(F.when(F.col("c") == c, F.col("m.v"))).alias(c) for c in columns])
    return df.select(key).distinct().join(wide, key, "left").select(key, *[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def absolute_centre(column: str, method: str) -> Column:
    return {"median": F.median, "mean": F.avg}[method](F.abs(F.col(column)))


def in_region_share(occurrences: DataFrame, inside: Column, name: str) -> DataFrame:
    n, own = F.count("*"), F.count_if(inside)
    return occurrences.groupBy(name).agg(n.alias("records"), own.alias("in_region"), (own / n).alias("share"), (own > 0).alias("present"))


def cell_richness(cells: DataFrame, keys: Keys, value: str = "inclusion") -> DataFrame:
    """Sum of inclusion; null only where all are null."""
    return cells.groupBy(*keys).agg(F.sum(value).alias("richness"))


def richness_by_group(cells: DataFrame, cell: str, group: str) -> DataFrame:
    """Richness of each cell by group and in all, in one pass."""
    out = cells.rollup(cell, group).agg(F.sum("inclusion").alias("richness"), F.grouping(group).alias("_all"))
    return out.where(F.col(cell).isNotNull()).select(cell, F.when(F.col("_all") == 1, "all").otherwise(F.col(group)).alias(group), "richness")


def area_of_occupancy(cells: DataFrame, regions: DataFrame, species: str = "species") -> DataFrame:
    """Cells that hold each species (any inclusion above 0), in all and by sub-region, with shares of all cells."""
    held = cells.groupBy(species, "cell").agg(F.max((F.coalesce(F.col("inclusion"), F.lit(0)) > 0).cast("int")).alias("has"))
    total = held.groupBy(species).agg(F.sum("has").alias("tpaoo"), F.count("*").alias("_n"))
    part = held.join(regions.select("cell", "sub_region", "country"), "cell").groupBy(species, "sub_region", "country").agg(F.sum("has").alias("paoo"), F.count("*").alias("_m"))
    return part.join(total, species).select(species, "sub_region", "country", "tpaoo", (F.col("tpaoo") / F.col("_n")).alias("prop_tpaoo"), "paoo", (F.col("paoo") / F.col("_m")).alias("prop_paoo"))


def suitability_statistics(cells: DataFrame, regions: DataFrame, species: str = "species") -> DataFrame:
    """Least, mean, median and greatest suitability in all and by sub-region; sub-regions without any go."""
    three = lambda p: [F.min("suitability").alias(f"{p}min"), F.avg("suitability").alias(f"{p}mean"), F.max("suitability").alias(f"{p}max")]

    def with_median(rows: DataFrame, keys: Sequence[str], p: str) -> DataFrame:
        middle = group_medians(rows, keys, ["suitability"]).withColumnRenamed("suitability_median", f"{p}median")
        return rows.groupBy(*keys).agg(*three(p)).join(middle, list(keys))

    folder = shared_folder(cells.sparkSession, "suitability")
    own = stored(cells.select(species, "cell", "suitability"), folder, "cells")
    placed = stored(own.join(regions.select("cell", "sub_region"), "cell"), folder, "placed")
    part = with_median(placed, [species, "sub_region"], "region_").where("region_max > 0")
    return part.join(with_median(own, [species], "total_"), species)


def taxon_richness(rows: DataFrame, taxon: str, region: Keys, name: str = "clean_name", value: str = "paoo") -> DataFrame:
    """Distinct species with occupancy by taxon and region, by region, and their ratio."""
    present = rows.where(F.col(value) > 0)
    own = present.groupBy(*region, taxon).agg(F.countDistinct(name).alias("taxon_richness"))
    if not region:
        return own.crossJoin(F.broadcast(present.agg(F.countDistinct(name).alias("total_richness")))).withColumn("relative_richness", F.col("taxon_richness") / F.col("total_richness"))
    total = present.groupBy(*region).agg(F.countDistinct(name).alias("total_richness"))
    return own.join(total, list(region)).withColumn("relative_richness", F.col("taxon_richness") / F.col("total_richness"))


def share_by_group(richness: DataFrame, group: Column, region: str) -> DataFrame:
    out = richness.withColumn("group", group)
    return with_group_aggregates(out, ["group", region], group_share=F.sum("relative_richness"))


def detection_rate(stats: DataFrame, few: Column) -> DataFrame:
    """Included over all but those with too few records, in percent; reliable above 80."""
    n, small = F.count("*"), F.count_if(few)
    rate = 100 * F.count_if(~F.col("excluded")) / (n - small)
    return stats.agg(n.alias("total"), small.alias("too_few"), F.count_if(~F.col("excluded")).alias("included"), rate.alias("rate"), (rate > 80).alias("reliable"))


def exclusion_profile(stats: DataFrame, dataset: str, source: str, reason: str) -> DataFrame:
    """Counts and shares by reason for each dataset, and for each source in it."""
    sets = stats.groupingSets([[F.col(dataset), F.col(reason)], [F.col(dataset), F.col(source), F.col(reason)]], dataset, source, reason).agg(F.count("*").alias("n"), F.grouping(source).alias("_all"))
    out = sets.select(dataset, F.when(F.col("_all") == 1, "all").otherwise(F.col(source).cast("string")).alias(source), reason, "n")
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(dataset, source)))


def log_binned(df: DataFrame, value: str, width: float, groups: Keys) -> DataFrame:
    """Share of rows by bins of the decimal logarithm, within each group and in all of its rows."""
    bins = df.where(F.col(value) > 0).withColumn("bin", F.floor(F.log10(value) / F.lit(width)).cast("long"))
    counts = bins.groupBy(*groups, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*groups)))


#: Scales of a frequency: how a value is taken to the scale and which values have a place on it.
SCALES = {"identity": (lambda c: c, lambda c: F.lit(True)), "log10": (F.log10, lambda c: c > 0), "log": (F.log, lambda c: c > 0), "sqrt": (F.sqrt, lambda c: c >= 0)}


def frequency_grains(df: DataFrame, value: str, widths: Mapping[str, float], levels: Sequence[str]) -> DataFrame:
    """Frequency polygons over all rows and within each level of a hierarchy (country, then sub-region), on several scales at once.

    ``widths`` maps a scale to its bin width. Rows are counted once by scale, lowest level and bin; the grains add these counts up. Returns scale, grain (``all`` or the
    level's name), the levels (null above the grain), bin, n, share within the grain's group, and ``middle``: the bin's middle as a value. Null and infinite values and such without a place on the scale are left
    out; null levels are a group.
    """
    v = F.col(value).cast("double")
    usable = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    placed = F.array(*[F.when(SCALES[s][1](v), F.struct(F.lit(s).alias("scale"), F.floor(SCALES[s][0](v) / F.lit(w)).cast("long").alias("bin"))) for s, w in widths.items()])
    lowest = usable.select(*levels, F.explode(F.filter(placed, lambda x: x.isNotNull())).alias("x")).groupBy("x.scale", *levels, "x.bin").agg(F.count("*").alias("n"))
    kinds = dict(df.dtypes)
    out = None
    for k in range(len(levels) + 1):
        own = lowest.groupBy("scale", *levels[:k], "bin").agg(F.sum("n").alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy("scale", *levels[:k]))
        gone = [F.lit(None).cast(kinds[c]).alias(c) for c in levels[k:]]
        one = own.select("scale", F.lit(levels[k - 1] if k else "all").alias("grain"), *levels[:k], *gone, "bin", "n", share.alias("share"))
        out = one if out is None else out.unionByName(one)
    width = F.element_at(F.create_map(*[F.lit(x) for s, w in widths.items() for x in (s, float(w))]), F.col("scale"))
    at = (F.col("bin") + 0.5) * width
    middle = F.when(F.col("scale") == "log10", F.pow(F.lit(10.0), at)).when(F.col("scale") == "log", F.exp(at)).when(F.col("scale") == "sqrt", at * at).otherwise(at)
    return out.withColumn("middle", middle)


def mean_response(df: DataFrame, region: str, response: str, logit: bool = False) -> DataFrame:
    """Mean response by region, clamped to 0..1; optionally its logit with a guard at both ends."""
    out = df.where(F.col(response).isNotNull()).groupBy(region).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg(response))).alias("response"))
    if logit:
        p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("response")))
        out = out.withColumn("response", F.log(p / (1 - p)))
    return out.orderBy("response", region)


def connections(flows: DataFrame, species: str, origin: str, destination: str, attributes: Keys) -> DataFrame:
    """Different links of a species from origin to destination, each of weight 1; blank ends go."""
    ends = [F.nullif(F.trim(F.col(c)), F.lit("")).isNotNull() for c in (origin, destination)]
    return flows.where(ends[0] & ends[1]).select(species, origin, destination, *attributes).distinct().withColumn("connections", F.lit(1))
