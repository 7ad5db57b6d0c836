"""Connected components of a large edge table by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obscast.llm.shared import Scratch


def _min_neighbour(edges: DataFrame) -> DataFrame:
    """(u, v, m): every edge in both directions with the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(least, "u")


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of every node of the edges (a, b), component the least node reachable.

    Large stars hang each node's larger neighbours on the least one, small stars its smaller
    ones; a logarithmic number of rounds ends in one star per component. Each round's edges
    are written to the shared folder. Null ends and loops are left out; no edges, no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = edges.toDF("a", "b").where("a <> b")
    edges = scratch.cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if now == state or now[0] == 0:
            break
        state = now
        stars = _min_neighbour(edges).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        stars = stars.where("a <> b").distinct()
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        small = stars.join(least, "a")
        moved = small.select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m"))
        edges = scratch.cut(moved.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        edges.select("b", "b").distinct()
    )
