"""Connected components by alternating large-star and small-star steps.

Each step is a min-aggregation (with map-side combine) and an equi-join; both
sides of the join are tables, so a hub's edges are split by adaptive execution
and no neighbourhood is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.scratch import Scratch


def _star(edges: DataFrame, scratch: Scratch, name: str, large: bool) -> DataFrame:
    """One step over edges (u > v); the result has the same orientation."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges
    low = scratch.save(near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-low")
    joined = near.join(low, "u")
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return scratch.save(moved.filter("u <> v").distinct(), name, like=edges)


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex of an undirected edge list (a, b): component is its least reachable id.

    Loops and repeated edges are allowed; edges with a null end are ignored; no
    edges give no rows.  Raises RuntimeError rather than return unfinished
    components, which max_rounds (logarithmic in practice) leaves ample room for.
    """
    now = scratch.save(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
        .distinct(),
        f"{name}-0",
    )
    for k in range(1, max_rounds + 1):
        wide = _star(now, scratch, f"{name}-{k}l", large=True)
        new = _star(wide, scratch, f"{name}-{k}s", large=False)
        scratch.drop(f"{name}-{k}l", f"{name}-{k}l-low", f"{name}-{k}s-low", f"{name}-{k - 1}s" if k > 1 else f"{name}-0")
        now = new
        # done when no end of an edge that leads down leads down itself, and none leads down twice
        below = now.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("root")).union(now.select("v", F.lit(0), F.lit(1)))
        ends = below.groupBy("id").agg(F.sum("down").alias("down"), F.max("root").alias("root"))
        if ends.filter("down > 1 OR (down = 1 AND root = 1)").isEmpty():
            roots = now.select(F.col("v").alias("id")).distinct()
            return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots.select("id", F.col("id").alias("component")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
