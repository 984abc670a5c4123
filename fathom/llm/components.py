"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a group-by (a minimum per node, combined before the shuffle) and an
equi-join, so a node with very many neighbours is split like any skewed join
key. Steps are written to the shared folder; the driver sees two numbers each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every greater neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    low = _least(down)
    tied = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, steps: int = 60) -> DataFrame:
    """(node, root) for every node of the edges (u, v) other than roots themselves; root: the component's least node.

    Null ends and loops are no edges. Raises if it has not converged after that many steps (they halve long chains, so 60 is far off).
    """
    now = written(_small(edges.select("u", "v").where("u is not null and v is not null and u <> v")), "edges")
    seen = None
    for _ in range(steps):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
        after = written(_small(_large(now)), "edges")
        forget(now)
        now = after
    raise RuntimeError(f"no components after {steps} steps")
