"""Connected components by contraction.

While there are many edges, every node hooks onto the neighbour (or itself) that comes first in
a random order drawn anew each round, and edges between what is left are formed again; the
number of nodes falls by a constant factor a round, chains included. What has at most
``FINISH`` edges is finished by union-find in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.session import cut_lineage

# Edges that one task finishes: two numbers each.
FINISH = 500_000


def union_find(batches):
    """(node, component) of the edges of one task; a component is named by its least node."""
    import pyarrow as pa

    parent: dict[int, int] = {}

    def root(node: int) -> int:
        while (above := parent.setdefault(node, node)) != node:
            parent[node] = parent[above]
            node = above
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array([root(n) for n in nodes], pa.int64())], names=["node", "component"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a long, b long); a component is named by one of
    its nodes."""
    edges = cut_lineage(edges.select("a", "b").distinct())
    steps = []
    while edges.count() > FINISH:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = F.xxhash64(F.lit(len(steps)), "b")
        both = both.unionByName(both.select("a", F.col("a").alias("b")))
        step = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.struct(draw, "b")).alias("component")))
        steps.append(step)

        def hooked(frame: DataFrame, side: str, step: DataFrame = step) -> DataFrame:
            to = step.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
            return frame.join(to, F.col(side) == F.col("__n")).withColumn(side, F.col("__c")).drop("__n", "__c")

        left = hooked(hooked(edges, "a"), "b").filter("a <> b")
        edges = cut_lineage(left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    steps.append(edges.coalesce(1).mapInArrow(union_find, "node long, component long"))
    found = steps[0]
    for step in steps[1:]:
        to = step.select(F.col("node").alias("__n"), F.col("component").alias("__c"))
        found = found.join(to, F.col("component") == F.col("__n"), "left").select(
            "node", F.coalesce("__c", "component").alias("component"))
    return found
