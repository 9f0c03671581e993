"""Rank correlations for all pairs of columns out of one table of ranks.

Every cell is replaced once by the place of its value in its column, so rows times columns are
moved, not rows times pairs. Places are cut into ranges of at least ``RANGE`` rows. A row is sent
once per column, with its places in all columns, to the task of that column's range, and the task
works for all pairs of the column; ranges of one value alone, however many rows have it, need
no task. What lies between ranges is told by the counts of rows per pair of ranges, which are
formed map-side.

Kendall counts discordant pairs of rows (x, y) in three parts: those in one range of x (inside
the task of that range), those in different ranges of x but one of y (inside the task of y's
range) and those apart in both (from the counts). Spearman ranks the complete rows of each pair:
a cell's rank is its rank inside its range plus what the ranges below hold.

A task holds fewer than two times the greater of ``RANGE`` and a ``RANGES``-th of all rows; the
counts of a pair are at most (2 * RANGES) squared.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.operators.quantiles import rows_of_cells, with_below
from quarrylens.session import cut_lineage

RANGE = 50_000
RANGES = 1_000
_BLOCK = 32


def column_places(df: DataFrame, columns: list[str]) -> tuple[DataFrame, int]:
    """(row, places array<long>) and the size of a range. A place is twice the number of cells
    below, plus one where the value fills a range of its own; null cells stay null."""
    cells = F.array(*[F.struct(F.lit(i).alias("k"), F.col(c).cast("double").alias("value")) for i, c in enumerate(columns)])
    numbered = cut_lineage(df.select(F.monotonically_increasing_id().alias("row"), cells.alias("cells")))
    rows = numbered.count()
    size = max(RANGE, -(-rows // RANGES))
    long = numbered.select("row", F.inline("cells")).filter("value is not null")
    placed = _value_places(long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("count")), size)
    wide = rows_of_cells(long, placed, rows, len(columns), "place")
    return cut_lineage(wide.select("row", F.array(*[f"f{i}" for i in range(len(columns))]).alias("places"))), size


def range_size(rows: DataFrame) -> int:
    return max(RANGE, -(-rows.count() // RANGES))


def _value_places(counts: DataFrame, size: int) -> DataFrame:
    place = F.col("below") * 2 + F.when(F.col("count") >= size, 1).otherwise(0)
    return with_below(counts, ["k"]).withColumn("place", place)


def placed_values(counts: DataFrame, size: int) -> DataFrame:
    """(__k, __v, place) of the value counts (k, value, count)."""
    return _value_places(counts, size).select(F.col("k").alias("__k"), F.col("value").alias("__v"), "place")


def _range(place, size: int):
    """Number of the range of a place: even, or odd for a value alone. Columns and arrays."""
    if isinstance(place, Column):
        return (F.floor(F.shiftright(place, 1) / size) * 2 + place.bitwiseAND(F.lit(1))).cast("long")
    return (place >> 1) // size * 2 + (place & 1)


def _sent(places: DataFrame, size: int, width: int) -> DataFrame:
    """(k, range, row, places): a row once per column whose range is not of one value alone."""
    per = F.array(*[F.struct(F.lit(k).alias("k"), F.col("places")[k].alias("place")) for k in range(width)])
    sent = places.select("row", "places", F.inline(per)).filter(F.col("place").bitwiseAND(F.lit(1)) == 0)
    return sent.select("k", _range(F.col("place"), size).alias("range"), "row", "places")


def _matrix(frame) -> np.ndarray:
    return np.array([[-1 if v is None or v != v else int(v) for v in p] for p in frame["places"]], np.int64)


def inversions(first: np.ndarray, second: np.ndarray) -> int:
    """Pairs with first[i] < first[j] and second[i] > second[j]."""
    y = second[np.lexsort((second, first))]
    y = np.unique(y, return_inverse=True)[1].astype(np.int64)
    n = len(y)
    width = n + 1
    pad = -n % _BLOCK
    blocks = np.concatenate([y, np.full(pad, width)]).reshape(-1, _BLOCK)
    found = 0
    for i in range(_BLOCK - 1):
        found += int((blocks[:, i : i + 1] > blocks[:, i + 1 :]).sum())
    at, size = np.arange(n), _BLOCK
    y = np.sort(blocks, axis=1).reshape(-1)[:n]  # the padding is greater than all and stays last
    while size < n:
        block = at // (2 * size)
        on_left = at // size % 2 == 0
        keys = block * (width + 1) + y
        left, right = keys[on_left], keys[~on_left]
        left_before = np.searchsorted(at[on_left], block[~on_left] * 2 * size)
        held = np.minimum(size, n - block[~on_left] * 2 * size)
        not_above = np.searchsorted(left, right, side="right") - left_before
        found += int((held - not_above).sum())
        y = np.sort(keys) - block * (width + 1)
        size *= 2
    return found


def _tie_sums(*keys: np.ndarray) -> tuple[int, float, float]:
    """Sums of t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5) over groups of equal keys."""
    if not len(keys[0]):
        return 0, 0.0, 0.0
    t = np.unique(np.stack(keys), axis=1, return_counts=True)[1] if len(keys) > 1 else np.unique(keys[0], return_counts=True)[1]
    return _sums_of(t)


def _sums_of(t: np.ndarray) -> tuple[int, float, float]:
    v = t.astype(float)
    return int((t * (t - 1) // 2).sum()), float((v * (v - 1) * (v - 2)).sum()), float((v * (v - 1) * (2 * v + 5)).sum())


_PARTS = ("a int, b int, n long, dis long, t_x long, z_x double, u_x double, t_y long, z_y double, u_y double, t_xy long")


def _table(rows):
    import pandas as pd

    names = [f.split()[0] for f in _PARTS.split(", ")]
    kinds = {"int": "int32", "long": "int64", "double": "float64"}
    return pd.DataFrame(rows, columns=names).astype({f.split()[0]: kinds[f.split()[1]] for f in _PARTS.split(", ")})


def kendall_parts(places: DataFrame, size: int, width: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, n, dis, ties) per pair of column numbers."""
    wanted = set(pairs)

    def inside(key, frame):
        c, rows, codes = int(key[0]), [], _matrix(frame)
        for o in range(width):
            if (min(c, o), max(c, o)) not in wanted or c == o:
                continue
            own = codes[codes[:, o] >= 0]
            x, y = own[:, c], own[:, o]
            ties = _tie_sums(x)
            if c < o:
                rows.append((c, o, 0, inversions(x, y), *ties, 0, 0.0, 0.0, _tie_sums(x, y)[0]))
            else:
                alone = (y & 1) == 1
                joint = _tie_sums(x[alone], y[alone])[0]
                rows.append((o, c, 0, inversions(_range(y, size), x), 0, 0.0, 0.0, *ties, joint))
        return _table(rows)

    def between(key, frame):
        rx, x = np.unique(frame["ra"].to_numpy(), return_inverse=True)
        ry, y = np.unique(frame["rb"].to_numpy(), return_inverse=True)
        grid = np.zeros((len(rx), len(ry)), np.int64)
        grid[x, y] = frame["count"].to_numpy()
        # Rows in a lower range of x and a higher one of y, for every cell.
        above = np.cumsum(grid[:, ::-1], axis=1)[:, ::-1] - grid
        lower = np.cumsum(above, axis=0) - above
        tx, ty = _sums_of(grid[rx % 2 == 1].sum(axis=1)), _sums_of(grid[:, ry % 2 == 1].sum(axis=0))
        joint = _sums_of(grid[np.ix_(rx % 2 == 1, ry % 2 == 1)])[0]
        return _table([(int(key[0]), int(key[1]), int(grid.sum()), int((grid * lower).sum()), *tx, *ty, joint)])

    sent = _sent(places, size, width).groupBy("k", "range").applyInPandas(inside, _PARTS)
    cells = range_counts(places, size, pairs).groupBy("a", "b").applyInPandas(between, _PARTS)
    names = [f.split()[0] for f in _PARTS.split(", ")][2:]
    return sent.unionByName(cells).groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in names])


def range_counts(places: DataFrame, size: int, pairs: list[tuple[int, int]]) -> DataFrame:
    """(a, b, ra, rb, count): complete rows per pair of columns and of ranges. Batches are counted
    on their own before anything is moved."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists = batch.column(0)
            if not batch.num_rows:
                continue
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            flat = np.where(np.isnan(flat), -1, flat).astype(np.int64) if flat.dtype.kind == "f" else flat
            codes = flat.reshape(batch.num_rows, -1)
            ranges = _range(codes, size)
            for a, b in pairs:
                both = (codes[:, a] >= 0) & (codes[:, b] >= 0)
                cells, count = np.unique(ranges[both][:, [a, b]], axis=0, return_counts=True)
                m = len(count)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(m, a, np.int32)), pa.array(np.full(m, b, np.int32)), pa.array(cells[:, 0]),
                        pa.array(cells[:, 1]), pa.array(count.astype(np.int64)),
                    ],
                    names=["a", "b", "ra", "rb", "part"],
                )

    filled = places.select(F.transform("places", lambda p: F.coalesce(p, F.lit(-1).cast("long"))).alias("places"))
    counted = filled.mapInArrow(run, "a int, b int, ra long, rb long, part long")
    return counted.groupBy("a", "b", "ra", "rb").agg(F.sum("part").alias("count"))


def complete_ranks(places: DataFrame, size: int, width: int) -> DataFrame:
    """(row, ranks): ranks[k][o] is the mid-rank of the row's cell in column k among the rows that
    have a value in column o as well; null where either is missing."""
    per = F.array(*[F.struct(F.lit(k).alias("k"), F.col("places")[k].alias("place")) for k in range(width)])
    long = places.select("row", "places", F.inline(per)).filter("place is not null")
    ranged = long.withColumn("range", _range(F.col("place"), size))
    held = F.array(*[F.count(F.col("places")[o]) for o in range(width)])
    table = ranged.groupBy("k", "range").agg(held.alias("held"))
    below = Window.partitionBy("k").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    # At most 2 * RANGES rows a column, each with one number per column.
    table = table.select("k", "range", "held", F.array(*[
        F.coalesce(F.sum(F.col("held")[o]).over(below), F.lit(0)) for o in range(width)]).alias("skipped"))
    table = cut_lineage(table.withColumnsRenamed({"k": "tk", "range": "tr"}))

    def inside(key, frame):
        import pandas as pd

        c, codes = int(key[0]), _matrix(frame)
        order = np.argsort(codes[:, c], kind="stable")
        own = codes[order]
        value, start, count = np.unique(own[:, c], return_index=True, return_counts=True)
        which = np.repeat(np.arange(len(value)), count)
        has = (own >= 0).astype(np.int64)
        total = np.concatenate([np.zeros((1, width), np.int64), np.cumsum(has, axis=0)])
        low, high = total[start][which], total[start + count][which]
        ranks = np.where(has == 1, (low + high + 1) / 2, np.nan)
        out = pd.DataFrame({"row": frame["row"].to_numpy()[order], "k": c, "range": int(key[1])})
        out["inner"] = [[None if v != v else v for v in r] for r in ranks.tolist()]
        return out

    many = _sent(places, size, width).groupBy("k", "range").applyInPandas(
        inside, "row long, k int, range long, inner array<double>")
    alone = ranged.filter(F.col("place").bitwiseAND(F.lit(1)) == 1).select("row", "k", "range", "places")
    at = lambda t: (F.col("k") == F.col("tk")) & (F.col("range") == F.col("tr"))
    ranks_many = many.join(table, at(table)).select("row", "k", F.zip_with("inner", "skipped", lambda r, s: r + s).alias("r"))
    mid = F.zip_with("held", "skipped", lambda h, s: (h + 1) / 2 + s)
    ranks_alone = alone.join(table, at(table)).select(
        "row", "k", F.zip_with(mid, "places", lambda r, p: F.when(p.isNotNull(), r)).alias("r"))
    every = ranks_many.unionByName(ranks_alone)
    return every.groupBy("row").agg(F.array(*[
        F.max(F.when(F.col("k") == k, F.col("r"))) for k in range(width)]).alias("ranks"))


def numbered_pairs(pairs: list[tuple[str, str]]) -> tuple[list[str], list[tuple[int, int]], dict]:
    """(columns, pairs of their numbers in rising order, numbers -> the pair as it was named)."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(columns)}
    named = {tuple(sorted((at[a], at[b]))): (a, b) for a, b in pairs}
    return columns, list(named), named
