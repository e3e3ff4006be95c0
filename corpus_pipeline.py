"""A training corpus from ``documents`` in five stages, each over all that the one before kept.

Defined cases: the first stage takes out null and blank texts, as they have no language; a later stage, called alone, keeps
them. A null id stays a row of its own, is never a near duplicate and keeps its null; rows that share an id stay or go together in
the third stage and are judged by their own texts in the others; an empty table gives an empty table of the same
columns (the last stage: no pieces); other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.llm import decontamination, language_id, line_dedup, near_duplicates, packing, queries
from taxaloom.llm.common import shared_dir, stored


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells; without a letter, a text or a clear language they go. If no row
    has a language to learn from, no language is told and all go."""
    return language_id.keep_known(docs, queries.language_model(docs))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of a source's documents go; every document stays, with its new length (null for
    a null text)."""
    out = line_dedup.drop_frequent_lines(docs, queries.MAX_RATIO, host_col="source")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays; rows of one id stay or go together, null ids and texts
    without words stay."""
    dropped = near_duplicates.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(dropped, docs["doc_id"] == dropped["dropped_id"], "left_anti")


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go; null texts have none."""
    return decontamination.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents left, with their places in sequences of 2048 tokens; a null text is a separator alone."""
    return packing.pack(docs, queries.tokenizer())


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_duplicate_stage),
    ("decontamination", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express string kernels, banded alignment and packing; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result but the last is written to the shared folder and read again."""
    folder = shared_dir(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder, name)
    return STAGES[-1][1](spark, docs, sf_dir)
