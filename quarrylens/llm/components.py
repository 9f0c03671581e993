"""Connected components of an edge table by alternating star contractions.

Each round is two aggregations over the edges and their joins; the number of rounds grows
with the logarithm of the longest chain. Edges are cut from their lineage every round with a
reliable checkpoint, and only two numbers reach the driver. What has at most ``FINISH`` edges is
finished by union-find in one task: a round writes files for every partition however few its edges
are, so the rounds of a small table cost more disk than its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.llm.common import saved
from quarrylens.operators.components import union_find

# Edges that one task finishes: two numbers each.
FINISH = 500_000


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Point the larger (or the smaller) neighbours of each node at its least neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    near = both.join(least, "u")
    if larger:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        below = near.where("v <= u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = below.union(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the least node it reaches."""
    now = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )
    state = None
    while True:
        found = now.agg(
            F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")
        ).first()
        if found["n"] <= FINISH:
            last = now.coalesce(1).mapInArrow(union_find, "node long, component long")
            return last.withColumnRenamed("component", "root")
        if (found["n"], found["h"]) == state:
            break
        state = (found["n"], found["h"])
        now = saved(_stars(_stars(now, larger=True), larger=False))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots).distinct()
