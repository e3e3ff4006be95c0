"""Connected components of a link table, by rounds of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import stored


def connected_components(links: DataFrame, folder: str, name: str, max_rounds: int = 60) -> DataFrame:
    """node, component: the smallest node that each linked node reaches.

    ``links`` has two long columns a and b. Each round hangs every node's larger neighbours and the node itself on
    the smallest node around it (a star), first for larger neighbours and then for smaller ones, until
    all links are stars around their smallest node. Minima are combined before the shuffle; the table of links
    doesn't grow, and each round's is written to the shared folder.
    """
    edges = stored(_clean(links), folder, f"{name}-0")
    for k in range(1, max_rounds + 1):
        large = _star(edges, folder, f"{name}-{k}-large", larger=True)
        edges = stored(_star(large, folder, f"{name}-{k}-small", larger=False), folder, f"{name}-{k}")
        # Done when every node hangs on one centre and no centre hangs on another.
        hung = edges.groupBy(F.col("a").alias("c")).agg(F.count("*").alias("n"))
        if not hung.where("n > 1").take(1) and not edges.join(hung, F.col("b") == F.col("c"), "left_semi").take(1):
            centres = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(centres.withColumn("component", F.col("node")))
    raise RuntimeError(f"links are no stars after {max_rounds} rounds")


def _clean(links: DataFrame) -> DataFrame:
    return links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _star(edges: DataFrame, folder: str, name: str, larger: bool) -> DataFrame:
    """One star operation over links (a > b)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges
    # A table of its own: Spark can then split the rows of a centre that has very many.
    centre = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), folder, name)
    hung = both.join(centre, "a")
    if larger:
        found = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(centre.select("a", F.col("m").alias("b")))
    return _clean(found)
