"""Cleaning, splitting and merging of checklists and occurrence records."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom.operators.joins import backbone_match, containment_join
from taxaloom.operators.rows import blank_to_null, keep_first

# Records that count as evidence, and abbreviations of ranks below species.
EVIDENCE = ("HUMAN_OBSERVATION", "PRESERVED_SPECIMEN")
RANK_PREFIX = {"SUBSPECIES": "subsp.", "VARIETY": "var.", "FORM": "f."}
FIRST_YEAR = 1970


def _usable(max_uncertainty: float) -> Column:
    return F.col("basis").isin(*EVIDENCE) & F.col("has_coordinate") & ~F.col("has_issue") & (F.col("status") == "PRESENT") & (F.col("year") >= FIRST_YEAR) & (F.col("uncertainty") <= max_uncertainty)


def quality_filter(occurrences: DataFrame, keys: DataFrame, max_uncertainty: float, box: tuple[float, float, float, float]) -> DataFrame:
    """Usable records of the wanted taxa inside a box (west, east, south, north)."""
    inside = F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3])
    return occurrences.where(_usable(max_uncertainty) & inside).join(keys, "taxon_key", "left_semi")


def species_list(occurrences: DataFrame, name: str, max_uncertainty: float = 4700) -> DataFrame:
    return occurrences.where(_usable(max_uncertainty)).select(name).distinct()


def rank_filter(df: DataFrame, ranks: DataFrame, rank: str, name: str) -> DataFrame:
    """Rows of the listed ranks with a name."""
    return df.where(blank_to_null(F.col(name)).isNotNull()).join(ranks, rank, "left_semi")


def exclusion_reason(excluded: str, observations: str, overlap: str, dimensions: int) -> Column:
    few = F.log(F.col(observations)) <= dimensions
    return F.when(~F.col(excluded) & (F.col(overlap) > 0), "Included").when(few, "Too Few Observations").when(F.col(overlap) == 0, "No Hypervolume Overlap").otherwise("Other")


def prefixed_name(name: str, rank: str, epithet: str) -> Column:
    prefix = reduce(lambda c, x: c.when(F.col(rank) == x[0], x[1]), RANK_PREFIX.items(), F.when(F.lit(False), ""))
    return F.concat_ws(" ", name, prefix, F.when(prefix.isNotNull(), F.col(epithet)))


def name_with_author(name: str, author: str) -> Column:
    return F.concat_ws(" ", name, blank_to_null(F.col(author)))


def clean_split(matches: DataFrame, name: str, found: str, distance: str, limit: int) -> DataFrame:
    """``outcome``: a name whose match differs by ``limit`` edits or more is a mismatch, with all its rows."""
    bad = F.coalesce((F.col(distance) >= limit) & (F.col(found) != F.col(name)), F.lit(False))
    names = matches.where(bad).select(F.col(name).alias("_n")).distinct().withColumn("_bad", F.lit(True))
    return matches.join(names, matches[name] == names["_n"], "left").withColumn("outcome", F.when(F.col("_bad"), "mismatch").otherwise("clean")).drop("_n", "_bad")


def drop_lower_taxa(keys: DataFrame, species: str, is_species: Column) -> DataFrame:
    """Keys below species go where their species is listed itself."""
    listed = keys.where(is_species).select(species).distinct()
    return keys.where(is_species).unionByName(keys.where(~is_species).join(listed, species, "left_anti"))


def tag_groups(df: DataFrame, groups: DataFrame, order: str) -> DataFrame:
    """Plant group by order; unknown without an order, others for an unlisted one. ``groups``: order, group."""
    out = df.join(groups.select(F.col("order").alias("_o"), F.col("group").alias("_g")), F.col(order) == F.col("_o"), "left")
    return out.withColumn("group", F.when(blank_to_null(F.col(order)).isNull(), "unknowns").otherwise(F.coalesce("_g", F.lit("others")))).drop("_o", "_g")


def result_problems(results: DataFrame, expected: DataFrame, name: str) -> DataFrame:
    """Number of names that weren't expected, and of included rows without overlap."""
    strange = results.select(name).distinct().join(expected, name, "left_anti").agg(F.count("*").alias("n")).select(F.lit("unexpected").alias("problem"), "n")
    empty = results.where("not excluded and overlap = 0").agg(F.count("*").alias("n")).select(F.lit("included without overlap").alias("problem"), "n")
    return strange.unionByName(empty)


def merge_corrections(base: DataFrame, edits: DataFrame, sources: DataFrame, name: str, source: str) -> DataFrame:
    """Adds manually corrected names to their sources; blank, null and removed ones don't count."""
    good = edits.withColumn(name, blank_to_null(F.col(name))).where(F.col(name).isNotNull() & (F.lower(name) != "removed"))
    return base.unionByName(good.join(sources, source, "left_semi").select(*base.columns))


def review_queue(problems: Mapping[str, DataFrame], name: str, row_id: str) -> DataFrame:
    """One row per problem name with its origin, and blank columns for a person's answer."""
    parts = [df.select(F.col(name).alias("name"), F.col(row_id).alias("id"), F.lit(origin).alias("origin")) for origin, df in problems.items()]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = every.groupBy("name").agg(F.min("id").alias("id"), F.min(F.struct("origin", "id")).alias("_m"))
    return one.select("name", "id", "_m.origin", F.lit(None).cast("string").alias("accepted_name"), F.lit(None).cast("string").alias("comment"))


def loss_accounting(matches: DataFrame, source: str, name: str, found: str) -> DataFrame:
    """Per source: rows in, matched, clean, mismatch, na, duplicates and lost, in one pass."""
    same = F.col(found) == F.col(name)
    n, na = F.count("*"), F.count_if(F.col(found).isNull())
    return matches.groupBy(source).agg(n.alias("n_in"), F.count(found).alias("matched"), F.count_if(same).alias("clean"), F.count_if(~same).alias("mismatch"), na.alias("na"), (n - F.countDistinct(name)).alias("duplicates"), F.greatest(F.lit(0), n - F.count(found) - na).alias("lost"))


def standardize(checklist: DataFrame, keyed: DataFrame, backbone: DataFrame) -> DataFrame:
    """Accepted names of a checklist: verbatim names once, keyed, synonyms resolved; how many names each has."""
    names = keep_first(checklist, ["verbatim_name"], ["id"]).select("verbatim_name")
    hit = backbone_match(names, keyed, "verbatim_name", "name", ["accepted_key"]).where("matched")
    accepted = backbone.select(F.col("usage_key").alias("accepted_key"), F.col("name").alias("accepted_name"))
    return hit.join(accepted, "accepted_key").groupBy("accepted_name", F.col("accepted_key").alias("species_key")).agg(F.count("*").alias("names"))


def underlying_taxa(included: DataFrame, known: DataFrame, analysed: DataFrame, name: str, known_name: str) -> DataFrame:
    """Known names that hold an included species' name (its subspecies, varieties and forms), and whether the species itself is among
    those analysed. Species without one are absent."""
    found = containment_join(included.select(name), known.select(known_name).where(F.col(known_name).isNotNull()).distinct().withColumn("_id", F.col(known_name)), name, known_name, "_id").drop("_id")
    own = analysed.select(F.col(name).alias("_a")).where("_a is not null").distinct()
    return found.join(own, F.col(name) == F.col("_a"), "left").select(name, known_name, F.col("_a").isNotNull().alias("analysed"))
