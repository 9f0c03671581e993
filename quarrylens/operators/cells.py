"""Contingency counts of many pairs of columns, and rank sums of groups, from one pass each.

Pairs are counted batch by batch on dictionary codes, so what leaves the scan is a count per pair
of values, not a row per pair of columns. Rank sums of numeric columns over the groups of
categorical ones send a cell once per numeric column to the task of its value range, where the
ranks for all categorical columns are taken; ``ranks`` describes the ranges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.operators import ranks
from quarrylens.operators.quantiles import with_below
from quarrylens.session import cut_lineage

_RANK_SUMS = "k int, range long, c int, group string, n long, rs double, ties double"


def named(parts: DataFrame, number: str, name: str, names: list[str]) -> DataFrame:
    """Column ``name`` in place of ``number``, an index into ``names``."""
    return parts.withColumn(name, F.element_at(F.array(*map(F.lit, names)), F.col(number) + 1)).drop(number)


def pair_cells(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(column_a, column_b, row_value, column_value, count) of the complete rows of every pair."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    numbers = [(at[a], at[b]) for a, b in pairs]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            coded = [c.dictionary_encode() for c in batch.columns]
            codes = [c.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for c in coded]
            for a, b in numbers:
                width = max(1, len(coded[b].dictionary))
                both = (codes[a] >= 0) & (codes[b] >= 0)
                found, count = np.unique(codes[a][both] * width + codes[b][both], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(found), a, np.int32)), pa.array(np.full(len(found), b, np.int32)),
                        coded[a].dictionary.take(pa.array(found // width)), coded[b].dictionary.take(pa.array(found % width)),
                        pa.array(count.astype(np.int64)),
                    ],
                    names=["a", "b", "row_value", "column_value", "part"],
                )

    texts = df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
    parts = texts.mapInArrow(run, "a int, b int, row_value string, column_value string, part long")
    counts = parts.groupBy("a", "b", "row_value", "column_value").agg(F.sum("part").alias("count"))
    return named(named(counts, "a", "column_a", columns), "b", "column_b", columns).select(
        "column_a", "column_b", "row_value", "column_value", "count")


def group_moments(df: DataFrame, numbers: list[str], cats: list[str]) -> DataFrame:
    """(numeric, categorical, group, n, mean, var, min, max) of every number column over the groups
    of every categorical one: a row counts once per categorical column, for all numbers at once."""
    groups = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("string").alias("group")) for i, c in enumerate(cats)])
    values = [F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(numbers)]
    long = df.select(*values, F.inline(groups)).filter("`group` is not null")

    def facts(i: int):
        v = F.col(f"v{i}")
        return F.struct(F.lit(numbers[i]).alias("numeric"), F.count(v).alias("n"), F.avg(v).alias("mean"),
                        F.var_samp(v).alias("var"), F.min(v).alias("min"), F.max(v).alias("max"))

    per_group = long.groupBy("c", "group").agg(F.array(*[facts(i) for i in range(len(numbers))]).alias("f"))
    out = per_group.select("c", "group", F.inline("f")).filter("n > 0")
    return named(out, "c", "categorical", cats).select("numeric", "categorical", "group", "n", "mean", "var", "min", "max")


def rank_sums(df: DataFrame, numbers: list[str], cats: list[str], moments: DataFrame, least: int) -> DataFrame:
    """(numeric, categorical, group, n, rs, ties): rows, sum of mid-ranks and tie terms of the groups
    with at least ``least`` values, ranked among the rows of these groups."""
    small = moments.filter(F.col("n") < least)
    rows = df.select(*[F.col(n).cast("double").alias(f"v{i}") for i, n in enumerate(numbers)],
                     *[F.col(c).cast("string").alias(f"g{j}") for j, c in enumerate(cats)])
    out_of = {r["categorical"] for r in small.select("categorical").distinct().collect()}
    groups = {}
    for j, c in enumerate(cats):
        if c in out_of:
            side = small.filter(F.col("categorical") == c).groupBy(F.col("group").alias(f"__g{j}")).agg(
                F.collect_set("numeric").alias(f"__out{j}"))
            rows = rows.join(side, F.col(f"g{j}") == F.col(f"__g{j}"), "left")
        groups[j] = c in out_of
    rows = cut_lineage(rows)

    def group_for(j: int, name: str):
        if not groups[j]:
            return F.col(f"g{j}")
        return F.when(~F.coalesce(F.array_contains(f"__out{j}", name), F.lit(False)), F.col(f"g{j}"))

    cells = F.array(*[
        F.struct(F.lit(i).alias("k"), F.col(f"v{i}").alias("value"),
                 F.array(*[group_for(j, n) for j in range(len(cats))]).alias("groups")) for i, n in enumerate(numbers)])
    long = rows.select(F.inline(cells)).filter("value is not null")
    size = ranks.range_size(rows)
    placed = ranks.placed_values(long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("count")), size)
    met = long.join(placed, (F.col("k") == F.col("__k")) & (F.col("value") == F.col("__v")))
    met = met.select("k", "place", "groups", ranks._range(F.col("place"), size).alias("range"))

    def inside(key, frame):
        import pandas as pd

        place = frame["place"].to_numpy()
        order = np.argsort(place, kind="stable")
        place = place[order]
        table = np.array([list(g) for g in frame["groups"]], dtype=object).reshape(len(frame), -1)[order]
        found = []
        for c in range(table.shape[1]):
            code, names = pd.factorize(table[:, c])
            has = code >= 0
            if not has.any():
                continue
            which, count = np.unique(place[has], return_inverse=True, return_counts=True)[1:]
            mid = (np.cumsum(count) - (count - 1) / 2)[which]
            t = count[which].astype(float)
            n = np.bincount(code[has])
            found.append(pd.DataFrame({
                "k": int(key[0]), "range": int(key[1]), "c": c, "group": names, "n": n,
                "rs": np.bincount(code[has], mid), "ties": np.bincount(code[has], t * t - 1)}))
        return pd.concat(found) if found else pd.DataFrame(columns=[f.split()[0] for f in _RANK_SUMS.split(", ")])

    many = met.filter(F.col("place").bitwiseAND(F.lit(1)) == 0).groupBy("k", "range").applyInPandas(inside, _RANK_SUMS)
    # A range of one value: every row has the middle rank of the rows there.
    alone = met.filter(F.col("place").bitwiseAND(F.lit(1)) == 1).select("k", "range", F.posexplode("groups").alias("c", "group"))
    alone = alone.filter("`group` is not null").groupBy("k", "range", "c", "group").agg(F.count(F.lit(1)).alias("n"))
    t = F.sum("n").over(Window.partitionBy("k", "range", "c")).cast("double")
    alone = alone.select("k", "range", "c", "group", "n", (F.col("n") * (t + 1) / 2).alias("rs"), (F.col("n") * (t * t - 1)).alias("ties"))
    parts = cut_lineage(many.unionByName(alone))
    below = Window.partitionBy("tk", "tc").orderBy("tr").rowsBetween(Window.unboundedPreceding, -1)
    held = parts.groupBy(F.col("k").alias("tk"), F.col("c").alias("tc"), F.col("range").alias("tr")).agg(F.sum("n").alias("held"))
    held = held.withColumn("skipped", F.coalesce(F.sum("held").over(below), F.lit(0)))
    same = (F.col("k") == F.col("tk")) & (F.col("c") == F.col("tc")) & (F.col("range") == F.col("tr"))
    sums = parts.join(held, same).groupBy("k", "c", "group").agg(
        F.sum("n").cast("double").alias("n"), F.sum(F.col("rs") + F.col("skipped") * F.col("n")).alias("rs"),
        F.sum("ties").alias("ties"))
    return named(named(sums, "k", "numeric", numbers), "c", "categorical", cats)
