"""Subtree totals of forests by parallel tree contraction, in rounds of joins.

Each round contracts the maximal unary chains (compress: pointer jumping finds the node below the chain and the sum on the way) and
then takes out all leaves, whose sums go to their parents (rake). A forest of n nodes is down to its roots after about log n
rounds, whatever its shape: a path goes in the first, a tree whose every node branches loses half of its nodes in each.
Then the rounds are expanded backwards: a chain's node has the total of the node below its chain and the sum on the
way. Nodes that are left shrink from round to round, and so do the tables that are joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import stored


def subtree_totals(nodes: DataFrame, values: Sequence[str], folder: str, max_rounds: int = 200) -> DataFrame:
    """``id`` and, for each of the values, its sum over the node and all below it.

    ``nodes`` has ``id`` (unique, of any type that can be ordered), ``parent`` (null for a root) and the values (long,
    null counts as 0). Every parent must be a node; a cycle raises; an empty table gives an empty one. Sums to one parent are
    combined before the shuffle, so a node may have any number of children.
    """
    kind = nodes.schema["id"].dataType
    active = stored(nodes.select("id", F.col("parent").cast(kind).alias("parent"), *[F.coalesce(v, F.lit(0)).cast("long").alias(v) for v in values]), folder, "active-0")
    removed, before = [], None
    for k in range(1, max_rounds + 1):
        left = active.where("parent is not null").count()
        if not left:
            break
        if left == before:
            raise ValueError("some nodes are below no root")
        before = left
        counted = stored(_counted(active), folder, f"counted-{k}")
        chains = _chains(counted.where("n = 1 and parent is not null").select("id", "parent", F.col("child").alias("below"), *values), values, folder, k)
        rest = counted.where("n <> 1 or parent is null").select("id", "parent", *values, "n")
        sums = []
        if chains is not None:
            # The top of a chain, whose parent isn't in it, gives its sum to the parent and its place to the node below.
            tops = chains.join(chains.select(F.col("id").alias("_c")), F.col("parent") == F.col("_c"), "left_anti").select(F.col("below").alias("_e"), F.col("parent").alias("_p"), *[F.col(v).alias(f"_{v}") for v in values])
            tops = stored(tops, folder, f"tops-{k}")
            rest = stored(rest.join(tops.select("_e", "_p"), F.col("id") == F.col("_e"), "left").select("id", F.coalesce("_p", "parent").alias("parent"), *values, "n"), folder, f"rest-{k}")
            sums.append(tops.select(F.col("_p").alias("_t"), *[F.col(f"_{v}") for v in values]))
        leaves = rest.where("n = 0 and parent is not null")
        sums.append(leaves.select(F.col("parent").alias("_t"), *[F.col(v).alias(f"_{v}") for v in values]))
        given = sums[0] if len(sums) == 1 else sums[0].unionByName(sums[1])
        given = given.groupBy("_t").agg(*[F.sum(f"_{v}").alias(f"_{v}") for v in values])
        inner = rest.where("n > 0 or parent is null").join(given, F.col("id") == F.col("_t"), "left")
        active = stored(inner.select("id", "parent", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]), folder, f"active-{k}")
        removed.append((leaves.select("id", *values), chains))
    else:
        raise RuntimeError(f"nodes are left after {max_rounds} rounds")
    known = active.select("id", *values)
    for k, (leaves, chains) in reversed(list(enumerate(removed, 1))):
        known = known.unionByName(leaves)
        if chains is not None:
            below = known.select(F.col("id").alias("_e"), *[F.col(v).alias(f"_{v}") for v in values])
            grown = chains.join(below, F.col("below") == F.col("_e")).select("id", *[(F.col(v) + F.col(f"_{v}")).alias(v) for v in values])
            known = known.unionByName(stored(grown, folder, f"grown-{k}"))
    return known


def _counted(active: DataFrame) -> DataFrame:
    """Each node with the number of its children and, where that is one, the child."""
    own = active.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("_n"), F.min("id").alias("child"))
    return active.join(own, F.col("id") == F.col("_p"), "left").select(*active.columns, F.coalesce("_n", F.lit(0)).alias("n"), "child")


def _chains(chains: DataFrame, values: Sequence[str], folder: str, k: int) -> DataFrame | None:
    """Nodes of unary chains with the node ``below`` their chain and the sums from them down to it; None if there are none.

    Each step doubles the way that a node looks down; nodes that see the end wait in tables of their own.
    """
    open_ = stored(chains, folder, f"chain-{k}-0")
    if not open_.take(1):
        return None
    done, step = None, 0
    while True:
        step += 1
        seen = open_ if done is None else open_.unionByName(done)
        ahead = seen.select(F.col("id").alias("_i"), F.col("below").alias("_b"), *[F.col(v).alias(f"_{v}") for v in values])
        moved = open_.join(ahead, F.col("below") == F.col("_i"), "left")
        hit = F.col("_i").isNotNull()
        moved = stored(moved.select("id", "parent", F.coalesce("_b", "below").alias("below"), *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values], hit.alias("_open")), folder, f"chain-{k}-{step}")
        ended = moved.where("not _open").drop("_open")
        done = ended if done is None else done.unionByName(ended)
        open_ = moved.where("_open").drop("_open")
        if not open_.take(1):
            return done
        if step > 40:
            raise ValueError("a chain leads back to itself")
