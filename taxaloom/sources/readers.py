"""Readers: delimited occurrences and checklists, headerless matrices, folders of match results, the backbone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaloom.operators.rows import keep_first


def read_occurrences(spark: SparkSession, path: str, schema: T.StructType | str, separator: str = "\t") -> DataFrame:
    """Delimited records with a header; unused columns are pruned by Catalyst."""
    return spark.read.schema(schema).option("header", True).option("sep", separator).option("encoding", "UTF-8").csv(path)


def read_checklist(spark: SparkSession, path: str, column: str, source: str, presence: str = "present") -> DataFrame:
    """A list with a header: verbatimName, interimName (the working copy), sourceDataset, presence."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    name = F.col(f"`{column}`")
    author = F.col("scientificNameAuthorship") if "scientificNameAuthorship" in raw.columns else F.lit(None).cast("string")
    return raw.select(name.alias("verbatimName"), author.alias("verbatimNameAuthorship"), name.alias("interimName"), author.alias("interimNameAuthorship"), F.lit(source).alias("sourceDataset"), F.lit(presence).alias("presence"))


def wide_checklist(df: DataFrame, name: str, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Selected columns, one row for each name, the name as verbatimName."""
    return keep_first(df.where(F.col(name).isNotNull()), [name], order).select(F.col(name).alias("verbatimName"), *columns)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of one text file with numbers from 1, by the places of the file's splits.

    A split is told by its first byte, not by the task that read it. The lines before each come from a prefix sum over the
    splits' sizes, a row for each split; no line passes through a single task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    sizes = lines.groupBy("_start").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.join(sizes.select("_start", "_first", before.alias("_before")), "_start").select((F.col("_id") - F.col("_first") + F.col("_before") + 1).alias("line"), "value")


def read_matrix(lines: DataFrame, header_line: int, separator: str = ",", skip: str = r"(?i)^\s*(total|sum)\b") -> DataFrame:
    """A table whose header stands in a data row: preamble and total rows go."""
    head = lines.where(F.col("line") == header_line).first()
    names = [x.strip() for x in head["value"].split(separator)]
    body = lines.where((F.col("line") > header_line) & ~F.col("value").rlike(skip))
    cells = F.split("value", separator, -1)
    return body.select("line", *[F.nullif(F.trim(F.get(cells, F.lit(i))), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_folders(spark: SparkSession, root: str, column: str, pattern: str = "*.csv") -> DataFrame:
    """Every matching file below a folder, each row named by its file's two parent folders; one row per source and name;
    names of one word (genera) go."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).csv(root)
    parts = F.split(F.col("_metadata.file_path"), "/")
    out = raw.select(F.concat_ws("_", F.element_at(parts, -3), F.element_at(parts, -2)).alias("source"), F.trim(F.col(column)).alias("name"))
    return out.where(F.size(F.split("name", r"\s+")) > 1).distinct()


def read_backbone(spark: SparkSession, path: str) -> DataFrame:
    """Six columns of a tab-separated backbone without its synonyms."""
    names = ["taxonID", "scientificName", "scientificNameAuthorship", "taxonRank", "nomenclaturalStatus", "taxonomicStatus"]
    raw = spark.read.option("header", True).option("sep", "\t").csv(path)
    return raw.select(*names).where(F.lower(F.coalesce("taxonomicStatus", F.lit(""))) != "synonym")


def clade_orders(spark: SparkSession, orders: dict[str, Sequence[str]]) -> DataFrame:
    """Accepted orders of each plant group in their published sequence: order, group, position."""
    rows = [(o, g, i) for g, own in orders.items() for i, o in enumerate(own)]
    return spark.createDataFrame(rows, "order string, group string, position int")


def rows_and_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.countDistinct(column).alias("distinct"))


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"))
