"""Grids of different resolution, extent and projection, and values moved from one to another.

Cells of a grid are numbered row by row from its north-west corner. A target cell's centre is taken back to longitude and latitude, and finds
its source cells by arithmetic; values then join on the source cell, whatever the number of layers.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from taxaloom.functions.projections import INVERSES


@dataclass(frozen=True)
class Grid:
    """``west`` and ``north`` are the corner; in metres with a ``projection``, else in degrees. ``around``: the last column's neighbour is the first."""

    west: float
    north: float
    resolution: float
    columns: int
    rows: int
    projection: str | None = None
    around: bool = False

    @staticmethod
    def globe(resolution: float) -> Grid:
        return Grid(-180.0, 90.0, float(resolution), round(360 / resolution), round(180 / resolution), around=True)

    @property
    def cells(self) -> int:
        return self.columns * self.rows

    def centres(self, spark: SparkSession) -> DataFrame:
        """cell, x, y of every cell, and lon and lat."""
        row, column = F.floor(F.col("id") / self.columns), F.col("id") % self.columns
        out = spark.range(self.cells).select(F.col("id").alias("cell"), (self.west + (column + 0.5) * self.resolution).alias("x"), (self.north - (row + 0.5) * self.resolution).alias("y"))
        lon, lat = INVERSES[self.projection](F.col("x"), F.col("y")) if self.projection else (F.col("x"), F.col("y"))
        return out.withColumns({"lon": lon, "lat": lat})

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Column and row of a place, as fractions: whole numbers are borders of cells."""
        return (x - self.west) / self.resolution, (self.north - y) / self.resolution

    def cell(self, column: Column, row: Column) -> Column:
        """Number of the cell; null outside the grid."""
        own = F.pmod(column, F.lit(self.columns)) if self.around else column
        return F.when((row >= 0) & (row < self.rows) & (own >= 0) & (own < self.columns), row * self.columns + own).cast("long")


def source_cells(spark: SparkSession, source: Grid, target: Grid, method: str) -> DataFrame:
    """cell (of the target), source_cell and weight: the cell that holds the centre (``near``), or the four whose centres are around
    it, weighted by their nearness (``bilinear``). Places outside the source have no row."""
    x, y = source.place(F.col("lon"), F.col("lat"))
    centres = target.centres(spark).where("lon is not null and lat is not null")
    if method == "near":
        near = centres.select("cell", source.cell(F.floor(x), F.floor(y)).alias("source_cell"), F.lit(1.0).alias("weight"))
        return near.where("source_cell is not null")
    if method != "bilinear":
        raise ValueError(f"no method {method!r}")
    left, top = F.floor(x - 0.5), F.floor(y - 0.5)
    right, down = x - 0.5 - left, y - 0.5 - top
    corners = [F.struct(source.cell(left + i, top + j).alias("source_cell"), ((right if i else 1 - right) * (down if j else 1 - down)).alias("weight")) for i in (0, 1) for j in (0, 1)]
    return centres.select("cell", F.explode(F.array(*corners)).alias("c")).select("cell", "c.*").where("source_cell is not null and weight > 0")


def resample(layers: DataFrame, source: Grid, target: Grid, method: str, keys: Sequence[str] = (), value: str = "value", ceiling: bool = False) -> DataFrame:
    """Values on the target grid by key: keys, cell and the value. Source cells without a value, or with null, are left out and the
    weights of the others made whole; a target cell with none has no row. ``ceiling`` makes shares whole presences."""
    own = layers.where(F.col(value).isNotNull()).select(*keys, F.col("cell").alias("source_cell"), F.col(value).cast("double").alias("_v"))
    met = own.join(source_cells(layers.sparkSession, source, target, method), "source_cell")
    if method == "near":
        out = met.select(*keys, "cell", F.col("_v").alias(value))
    else:
        out = met.groupBy(*keys, "cell").agg((F.sum(F.col("_v") * F.col("weight")) / F.sum("weight")).alias(value))
    return out.withColumn(value, F.ceil(value).cast("double")) if ceiling else out


def crop(layers: DataFrame, grid: Grid, west: float, east: float, south: float, north: float) -> DataFrame:
    """Rows whose cell's centre lies in the extent."""
    row, column = F.floor(F.col("cell") / grid.columns), F.col("cell") % grid.columns
    x, y = grid.west + (column + 0.5) * grid.resolution, grid.north - (row + 0.5) * grid.resolution
    return layers.where(x.between(west, east) & y.between(south, north))
