"""The driver tables in the roles of the screening tables, in Spark and in DuckDB's SQL.

lineitem with part plays the occurrences (species: brand for niches, part key elsewhere), part the checklists and the
backbone, nation and region the sub-regions and countries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.sources import writers

#: Relations by name, as DuckDB common table expressions.
CTE = {
    "occ": """occ as (select concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) as obs_id,
      p_brand as clean_name, p_name as scientific_name, p_type as "order", l_partkey as taxon_key, l_suppkey as dataset_key, l_orderkey as order_key,
      case l_returnflag when 'A' then 'ABSENT' else 'PRESENT' end as status,
      case when l_linestatus = 'O' then 'HUMAN_OBSERVATION' when l_linenumber % 2 = 0 then 'PRESERVED_SPECIMEN' else 'FOSSIL_SPECIMEN' end as basis,
      l_linenumber <> 7 as has_coordinate, l_tax > 0.07 as has_issue, year(l_shipdate) as "year", l_quantity * 100 as uncertainty,
      ((l_orderkey * 7919 + l_linenumber * 104729) % 36000) / 100.0 - 180 as lon, ((l_partkey * 6271 + l_suppkey * 3571 + l_linenumber * 977) % 18000) / 100.0 - 90 as lat,
      l_quantity as bio1, l_extendedprice as bio2, l_discount as bio3, l_tax as bio4
      from lineitem join part on l_partkey = p_partkey)""",
    "chk": """chk as (select p_partkey as id, p_name as verbatim_name, p_brand as authorship, 'list' || (p_size % 3) as source_dataset,
      case when p_size % 2 = 0 then 'present' else 'absent' end as presence, p_type as "order", p_size as size from part)""",
    "known": "known as (select verbatim_name, authorship, id from chk where id % 3 = 0)",
    "cand": "cand as (select verbatim_name, authorship, id from chk where id % 3 <> 0)",
    "backbone": """backbone as (select p_partkey as usage_key, p_name as name, p_type as rank, p_brand as family,
      min(p_partkey) over (partition by p_name) as accepted_key from part)""",
    "paoo": """paoo as (select p_name as clean_name, p_type as "order", p_brand as family, s_nationkey as region_id, n_name as sub_region, r_name as country,
      sum(l_quantity) as paoo, count(*) as records
      from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
      where l_returnflag <> 'R' or l_tax > 0.04 group by all)""",
    "cells": """cells as (select l_partkey as species, l_orderkey % 500 as cell, case when l_discount > 0.03 then 1.0 end as inclusion, l_discount * 10 as suitability, p_type as "order",
      obs from (select l_partkey, l_orderkey, l_discount, p_type, concat_ws('|', l_orderkey, l_linenumber, l_suppkey) as obs from lineitem join part on l_partkey = p_partkey))""",
    "region_cells": """region_cells as (select c.cell, n_nationkey as region_id, n_name as sub_region, r_name as country from (select distinct l_orderkey % 500 as cell from lineitem) c
      join nation on n_nationkey = c.cell % 23 join region on n_regionkey = r_regionkey)""",
    "stats": """stats as (select p_brand as clean_name, p_type as "order", p_size % 4 as source, count(*) as observations, p_size % 4 = 0 as excluded,
      case when p_size % 4 = 0 then 0.0 else (p_size % 10) / 10.0 end as overlap, min(p_retailprice) as volume from part group by all)""",
}


#: A record's id, from its line.
OBS_ID = "concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint))"


def sql(*relations: str, body: str) -> str:
    """A query over some of the relations; ``known`` and ``cand`` need ``chk``."""
    return f"with {', '.join(CTE[r] for r in relations)} {body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def occ(spark: SparkSession, sf: str, dealt: bool = False, lines: DataFrame | None = None, more: tuple[str, ...] = ()) -> DataFrame:
    """``lines``: lineitem, if it is not to be read whole, with columns ``more`` to keep. ``dealt``: for :func:`taxaloom.sources.writers.write_bucketed` by taxon_key, the records are dealt out before their ids and other columns are made.

    After the join: dealt before it, a sort-merge join would take the parts as its own and could no longer split a large key.
    """
    rows = (table(spark, sf, "lineitem") if lines is None else lines).join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    if dealt:
        rows = writers.deal(rows, "l_partkey")
    return rows.selectExpr(
        f"{OBS_ID} as obs_id",
        "p_brand as clean_name", "p_name as scientific_name", "p_type as `order`", "l_partkey as taxon_key", "l_suppkey as dataset_key", "l_orderkey as order_key",
        "case l_returnflag when 'A' then 'ABSENT' else 'PRESENT' end as status",
        "case when l_linestatus = 'O' then 'HUMAN_OBSERVATION' when l_linenumber % 2 = 0 then 'PRESERVED_SPECIMEN' else 'FOSSIL_SPECIMEN' end as basis",
        "l_linenumber <> 7 as has_coordinate", "l_tax > 0.07D as has_issue", "year(l_shipdate) as year", "l_quantity * 100 as uncertainty",
        "((l_orderkey * 7919 + l_linenumber * 104729) % 36000) / 100.0D - 180 as lon", "((l_partkey * 6271 + l_suppkey * 3571 + l_linenumber * 977) % 18000) / 100.0D - 90 as lat",
        "l_quantity as bio1", "l_extendedprice as bio2", "l_discount as bio3", "l_tax as bio4", *more,
    )


def chk(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey as id", "p_name as verbatim_name", "p_brand as authorship", "concat('list', p_size % 3) as source_dataset",
        "case when p_size % 2 = 0 then 'present' else 'absent' end as presence", "p_type as `order`", "p_size as size",
    )


def known(spark: SparkSession, sf: str) -> DataFrame:
    return chk(spark, sf).where("id % 3 = 0").select("verbatim_name", "authorship", "id")


def cand(spark: SparkSession, sf: str) -> DataFrame:
    return chk(spark, sf).where("id % 3 <> 0").select("verbatim_name", "authorship", "id")


def backbone(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").selectExpr("p_partkey as usage_key", "p_name as name", "p_type as rank", "p_brand as family")
    return part.join(part.groupBy("name").agg(F.min("usage_key").alias("accepted_key")), "name").select("usage_key", "name", "rank", "family", "accepted_key")


def located(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem with part, supplier, nation and region."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def paoo(spark: SparkSession, sf: str) -> DataFrame:
    rows = located(spark, sf).where("l_returnflag <> 'R' or l_tax > 0.04D")
    keys = {"clean_name": "p_name", "order": "p_type", "family": "p_brand", "region_id": "s_nationkey", "sub_region": "n_name", "country": "r_name"}
    return rows.groupBy(*[F.col(c).alias(n) for n, c in keys.items()]).agg(F.sum("l_quantity").alias("paoo"), F.count("*").alias("records"))


def cells(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr("l_partkey as species", "l_orderkey % 500 as cell", "case when l_discount > 0.03D then 1.0D end as inclusion", "l_discount * 10 as suitability", "p_type as `order`", "concat_ws('|', l_orderkey, l_linenumber, l_suppkey) as obs")


def region_cells(spark: SparkSession, sf: str) -> DataFrame:
    cell = table(spark, sf, "lineitem").selectExpr("l_orderkey % 500 as cell").distinct()
    rows = cell.join(table(spark, sf, "nation"), F.col("n_nationkey") == F.col("cell") % 23).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.selectExpr("cell", "n_nationkey as region_id", "n_name as sub_region", "r_name as country")


def stats(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").selectExpr("p_brand as clean_name", "p_type as `order`", "p_size % 4 as source", "p_size % 4 = 0 as excluded", "case when p_size % 4 = 0 then 0.0D else (p_size % 10) / 10.0D end as overlap", "p_retailprice")
    return part.groupBy("clean_name", "order", "source", "excluded", "overlap").agg(F.count("*").alias("observations"), F.min("p_retailprice").alias("volume"))
