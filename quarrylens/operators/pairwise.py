"""Mann-Whitney counts for all pairs of groups at once.

U of two groups sums, over the values of one, how many rows of the other lie below (ties by
half). With the counts of rows per value and group as a matrix, one product of the matrix with
its own running sum gives U for every pair. Values are cut into ranges of about ``CELLS`` cells;
a range's product tells the pairs of rows inside the range, and the same product over the
ranges' totals tells those in different ranges. Group names, counts and pairs stay in Spark.

A task holds one range of two blocks of ``GROUP_BLOCK`` groups, and a matrix of one number per pair of these.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.operators.ordered import Key, Ordered
from quarrylens.operators.quantiles import with_below

CELLS = 200_000
GROUP_BLOCK = 1_000
# Numbers in a dense piece of the matrix.
_DENSE = 4_000_000
_SUMS = "a long, b long, u double, x double"


def _sums(frame, p: int, q: int, ties: bool):
    """(a, b, u, x) of all pairs of groups out of (value, gid, count); x is what joint ties add
    to the sum of t**3 - t."""
    import pandas as pd

    gids, g = np.unique(frame["gid"].to_numpy(), return_inverse=True)
    v = np.unique(frame["value"].to_numpy(), return_inverse=True)[1]
    order = np.argsort(v, kind="stable")
    v, g, c = v[order], g[order], frame["count"].to_numpy()[order].astype(float)
    n, step = len(gids), max(1, _DENSE // max(1, len(gids)))
    u, x, below = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
    for first in range(0, int(v[-1]) + 1 if len(v) else 0, step):
        i, j = np.searchsorted(v, [first, first + step])
        piece = np.zeros((min(step, int(v[-1]) + 1 - first), n))
        piece[v[i:j] - first, g[i:j]] = c[i:j]
        run = np.cumsum(piece, axis=0)
        u += piece.T @ (below + run - (piece / 2 if ties else piece))
        if ties:
            square = piece * piece
            joint = square.T @ piece
            x += 3 * (joint + joint.T)
        below = below + run[-1]
    first, second = np.triu_indices(n, 1)
    block = gids // GROUP_BLOCK
    keep = (block[first] == p) & (block[second] == q)
    if ties:  # all pairs are listed by the product over the ranges
        keep &= (u[first, second] != 0) | (x[first, second] != 0)
    first, second = first[keep], second[keep]
    return pd.DataFrame({"a": gids[first], "b": gids[second], "u": u[first, second], "x": x[first, second]})


def pair_sums(cells: DataFrame, groups: int) -> DataFrame:
    """(a, b, u, x) for every pair of groups a < b out of (value, gid, count), gid from 0."""
    values = with_below(cells.groupBy("value").agg(F.count(F.lit(1)).alias("count")), [])
    ranges = values.select(F.col("value").alias("__v"), F.floor(F.col("below") / CELLS).alias("range"))
    ranged = cells.join(ranges, F.col("value") == F.col("__v")).drop("__v")
    blocks = -(-groups // GROUP_BLOCK)

    def per_blocks(frame: DataFrame) -> DataFrame:
        own, other = F.floor(F.col("gid") / GROUP_BLOCK).cast("int"), F.col("other")
        spread = frame.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return spread.withColumns({"p": F.least(own, other), "q": F.greatest(own, other)}).drop("other")

    def inside(key, frame):
        return _sums(frame, int(key[1]), int(key[2]), True)

    def between(key, frame):
        return _sums(frame, int(key[0]), int(key[1]), False)

    totals = ranged.groupBy("range", "gid").agg(F.sum("count").alias("count"))
    near = per_blocks(ranged).groupBy("range", "p", "q").applyInPandas(inside, _SUMS)
    far = per_blocks(totals.withColumnRenamed("range", "value")).groupBy("p", "q").applyInPandas(between, _SUMS)
    return near.unionByName(far).groupBy("a", "b").agg(F.sum("u").alias("u"), F.sum("x").alias("x"))


def numbered(groups: DataFrame) -> DataFrame:
    """Groups with ``gid``, their number in the order of their names from 0."""
    named = Ordered(groups, [], [Key("group")], tiebreak=False).number("gid").df
    return named.withColumn("gid", F.col("gid") - 1)
