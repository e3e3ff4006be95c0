"""Declared schemas, and the check that a table has one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Columns of the exchanged tables.
CHECKLIST = "verbatimName string, verbatimNameAuthorship string, interimName string, interimNameAuthorship string, sourceDataset string, presence string"
BACKBONE = "taxonID string, scientificName string, scientificNameAuthorship string, taxonRank string, nomenclaturalStatus string, taxonomicStatus string"
NICHE_STATS = "species string, observations long, excluded boolean, jaccard double, sorensen double, frac_volume_species double, frac_volume_region double, realized_niche double, overlap_region double, included_overlap double"


def columns_of(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.split()) for c in schema.split(", ")]


def assert_columns(df: DataFrame, schema: str) -> DataFrame:
    """The table itself, if it has the schema's columns; names and types are told otherwise."""
    have, want = dict(df.dtypes), {n: {"long": "bigint", "integer": "int"}.get(t, t) for n, t in columns_of(schema)}
    wrong = [f"{n}: {have.get(n)} instead of {t}" for n, t in want.items() if have.get(n) != t]
    if wrong or set(have) - set(want):
        raise ValueError(f"columns differ: {wrong}, not expected: {sorted(set(have) - set(want))}")
    return df


def with_missing(df: DataFrame, schema: str) -> DataFrame:
    """Adds the schema's missing columns as nulls."""
    return df.withColumns({n: F.lit(None).cast(t) for n, t in columns_of(schema) if n not in df.columns})
