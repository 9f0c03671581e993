"""Exact quantiles. ``percentile`` keeps one group's distinct values in one buffer, so it
serves groups of bounded size; larger groups are ranked on their value counts instead."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require
from quarrylens.operators.ordered import Key, Ordered, attach_totals, fits_one_task
from quarrylens.session import cut_lineage

INTERPOLATIONS = ("linear", "lower", "higher", "midpoint", "nearest")
COUNTS = "_value_counts"
BELOW = "below"


def value_counts(df: DataFrame, columns: list[str], keys=(), as_type: str = "double") -> DataFrame:
    """Long (keys, column, value, count); combines map-side, so repeated values are cheap."""
    keys = list(keys)
    known = None if keys else _known(df, as_type, columns)
    if known is not None:
        return known.select("column", "value", "count")
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast(as_type).alias("value")) for c in columns
    ]))
    long = df.select(*keys, pairs.alias("__p")).select(*keys, "__p.column", "__p.value")
    return long.filter(F.col("value").isNotNull()).groupBy(*keys, "column", "value").agg(
        F.count(F.lit(1)).alias("count")
    )


def _known(df: DataFrame, kind: str, columns: list[str]) -> DataFrame | None:
    names, counts = getattr(df, COUNTS, {}).get(kind, ((), None))
    if counts is None or len(set(columns)) < len(columns) or not set(columns) <= set(names):
        return None
    return counts if set(columns) == set(names) else counts.filter(F.col("column").isin(*columns))


def with_counts(df: DataFrame, kind: str, columns: list[str], counts: DataFrame) -> DataFrame:
    """``df`` with value counts that are known of it, by type of the values or as ``BELOW``."""
    out = df.select("*")
    setattr(out, COUNTS, {**getattr(df, COUNTS, {}), kind: (tuple(columns), counts)})
    return out


def counted_once(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the ordered counts of ``columns`` computed at once and written to the shared folder, for
    reports whose sections each read them: ordering them is most of such a section's work."""
    if not columns or _known(df, BELOW, columns) is not None:
        return df
    counts = cut_lineage(cumulative_counts(df, columns))
    return with_counts(with_counts(df, BELOW, columns, counts), "double", columns, counts)


def cumulative_counts(df: DataFrame, columns: list[str], keys=()) -> DataFrame:
    """value_counts plus ``below`` (rows with a smaller value) within (keys, column)."""
    known = None if keys else _known(df, BELOW, columns)
    if known is not None:
        return known
    counts = value_counts(df, columns, keys)
    if keys or _known(df, "double", columns) is None:
        # Sizes, ranges and rows are three readings; the cells are counted for the first only.
        counts = cut_lineage(counts)
    return with_below(counts, [*keys, "column"])


def with_below(counts: DataFrame, keys: list[str]) -> DataFrame:
    out = Ordered(counts, keys, [Key("value")]).running(__cum=("sum", F.col("count"))).df
    return out.withColumn("below", F.col("__cum") - F.col("count")).drop("__cum")


# Cells that one task gathers into rows.
TASK_CELLS = 2_000_000
# A value of more than this share of a column's cells goes to the cells, not they to it.
FREQUENT = 1_000


def rows_of_cells(cells: DataFrame, values: DataFrame, rows: int, columns: int, found: str) -> DataFrame:
    """(row, f0, f1, ...) of the cells (row, k, value), none null: column k's value is replaced by the
    column ``found`` out of ``values`` (k, value, count, found).

    Cells of one value would meet it in one task, which grows with the table where a column has few
    values. Values of more than a ``FREQUENT``-th of the rows (and of ``TASK_CELLS`` / 10) are at most
    that many a column; they are looked up where the cells lie, whose keys then spread them."""
    often = F.col("count") > max(rows // FREQUENT, TASK_CELLS // 10)
    names = [F.col("k").alias("__k"), F.col("value").alias("__v")]
    frequent = values.filter(often).select(*names, F.col(found).alias("__often"))
    seldom = values.filter(~often).select(*names, F.col(found).alias("__seldom"))
    tasks = max(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows * columns // TASK_CELLS))
    known = cells.join(F.broadcast(frequent), (F.col("k") == F.col("__k")) & (F.col("value") == F.col("__v")), "left").drop("__k", "__v")
    done = F.col("__often").isNotNull()
    known = known.withColumns({
        "__m": F.when(done, -1 - F.col("k")).otherwise(F.col("k")),
        "__n": F.when(done, F.col("row").cast("double")).otherwise(F.col("value"))})
    met = known.join(seldom, (F.col("__m") == F.col("__k")) & (F.col("__n") == F.col("__v")), "left").select(
        "row", "k", F.coalesce("__often", "__seldom").alias(found))
    # Rows are dealt first: counted per task before that, they would only be held twice.
    return met.repartition(tasks, "row").groupBy("row").agg(
        *[F.max(F.when(F.col("k") == i, F.col(found))).alias(f"f{i}") for i in range(columns)])


def quantiles_of_counts(cum: DataFrame, keys: list[str], probabilities, interpolation: str = "linear") -> DataFrame:
    """(keys, n, q) from value counts with ``below``: find the values at the two ranks
    around each position. Every step is a map-side combined aggregate."""
    qs = [float(q) for q in probabilities]
    rows = attach_totals(cum, keys, few=keys == ["column"], __n=F.sum("count"))
    picks = []
    for i, q in enumerate(qs):
        pos = (F.col("__n") - 1) * F.lit(q)
        low, high = F.floor(pos), F.ceil(pos)
        if interpolation == "nearest":
            low = high = F.bround(pos)
        elif interpolation == "lower":
            high = low
        elif interpolation == "higher":
            low = high
        for side, at in (("l", low), ("h", high)):
            inside = (F.col("below") <= at) & (at < F.col("below") + F.col("count"))
            picks.append(F.max(F.when(inside, F.col("value"))).alias(f"__{side}{i}"))
    aggs = [F.max("__n").alias("n"), *picks]
    picked = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    values = []
    for i, q in enumerate(qs):
        pos = (F.col("n") - 1) * F.lit(q)
        weight = F.lit(0.5) if interpolation == "midpoint" else pos - F.floor(pos)
        a, b = F.col(f"__l{i}"), F.col(f"__h{i}")
        values.append(a + (b - a) * weight)
    return picked.select(*keys, "n", F.array(*values).alias("q"))


def exact_quantiles(df: DataFrame, columns: list[str], probabilities, keys=(),
                    interpolation: str = "linear", bounded: bool | None = None) -> DataFrame:
    """One row per key with, for each column, an array of quantiles in request order."""
    require(interpolation in INTERPOLATIONS, "INVALID_INTERPOLATION")
    keys, qs = list(keys), [float(q) for q in probabilities]
    if interpolation == "linear":
        if bounded is None:
            bounded = fits_one_task(df, keys)
        if bounded:
            aggs = [
                F.percentile(F.col(c).cast("double"), F.array(*[F.lit(q) for q in qs])).alias(c) for c in columns
            ]
            return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    found = quantiles_of_counts(cumulative_counts(df, columns, keys), [*keys, "column"], qs, interpolation)
    wide = [F.max(F.when(F.col("column") == c, F.col("q"))).alias(c) for c in columns]
    return found.groupBy(*keys).agg(*wide) if keys else found.agg(*wide)


def quantile_row(df: DataFrame, columns: list[str], probabilities, interpolation: str = "linear") -> dict:
    """Driver-side {column: [quantiles]} - a few numbers, used as literals in later plans."""
    row = exact_quantiles(df, columns, probabilities, interpolation=interpolation).first()
    missing = [None] * len(list(probabilities))
    return {c: (list(row[c]) if row and row[c] is not None else missing) for c in columns}


def linspace(low: float, high: float, bins: int) -> list[float]:
    step = (high - low) / bins
    edges = [low + step * i for i in range(bins)] + [high]
    return [e for e in edges if not math.isnan(e)]
