"""Connected components of a graph given as an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanledger.operators.support import Shelf

MOST_ROUNDS = 60


def _hung_on_least(edges: DataFrame, at: str, to: str) -> DataFrame:
    """Every edge (at, to) with m, the least id among ``at`` and all its ``to``."""
    least = edges.groupBy(at).agg(F.min(to).alias("m")).select(F.col(at).alias("k"), F.least(at, "m").alias("m"))
    return edges.join(least, edges[at] == least["k"]).drop("k")


def components(edges: DataFrame, shelf: Shelf, name: str = "edges") -> DataFrame:
    """(id, root) for each id in the edges (a, b): root is the least id of its component.

    A large star hangs the greater neighbours of a node on its least neighbour, a small star the lesser
    ones. Both are one grouped minimum and one join, so a hub is pre-aggregated and its join can be split.
    Two rounds with equal edge sums mean that all trees are flat. No edges give no rows.
    """
    now = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                    .distinct(), f"{name}-0")
    before = None
    for i in range(1, MOST_ROUNDS):
        both = now.union(now.select("v", "u"))
        large = _hung_on_least(both, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _hung_on_least(large.where("u > v").distinct(), "u", "v")
        flat = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            small.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        now = shelf.put(flat, f"{name}-{i}")
        shelf.drop(f"{name}-{i - 1}")
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == before:
            return now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(
                now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        before = sign
    raise RuntimeError("the components did not settle")
