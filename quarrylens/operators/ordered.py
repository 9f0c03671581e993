"""Order-dependent computation that never needs one task to hold a whole group.

A plain ``Window.partitionBy(k).orderBy(o)`` sends every row of ``k`` to one task, so
one key with a third of the table (or no key at all) does not scale. ``Ordered`` looks
at the largest group first. When it is small, windows are used as they are. When it is
not, rows are range-partitioned by (keys, order), windows run inside each range, and
what must cross a range boundary is carried over from a summary with one row per range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quarrylens.errors import require
from quarrylens.ids import ROW_ID
from quarrylens.session import cut_lineage, max_group_rows

CHUNK = "__chunk"
_LOCAL = "__local_rn"
SIZES = "_group_sizes"


@dataclass(frozen=True)
class Key:
    """One ordering column: name, direction and null placement."""

    column: str
    ascending: bool = True
    nulls: str = "last"

    def expr(self, reverse: bool = False) -> Column:
        c = F.col(self.column)
        ascending = self.ascending != reverse
        first = (self.nulls == "first") != reverse
        if ascending:
            return c.asc_nulls_first() if first else c.asc_nulls_last()
        return c.desc_nulls_first() if first else c.desc_nulls_last()


def order_keys(order_by, nulls: str = "last", default_ascending: bool = True) -> list[Key]:
    """Accept ``"c"``, ``{"column": "c", "direction": "desc"}``, ``{"column": "c", "ascending":
    False}`` or ``Key``."""
    keys = []
    for item in order_by or []:
        if isinstance(item, Key):
            keys.append(item)
            continue
        spec = {"column": item} if isinstance(item, str) else dict(item)
        unknown = set(spec) - {"column", "direction", "ascending", "nulls"}
        require(not unknown, "UNKNOWN_PARAMETER",
                parameters=sorted(unknown))
        direction = spec.get("direction")
        require(direction in (None, "asc", "desc"), "INVALID_SORT_DIRECTION",
                direction=direction)
        ascending = direction == "asc" if direction else bool(spec.get("ascending", default_ascending))
        keys.append(Key(spec["column"], ascending, spec.get("nulls") or nulls))
    return keys


def group_sizes(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, largest group) from one map-side combined aggregate."""
    if not keys:
        n = df.count()
        return n, n
    row = (
        df.groupBy(*keys).count()
        .agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.max("count"), F.lit(0)).alias("m"))
        .first()
    )
    return int(row["n"]), int(row["m"])


def with_sizes(df: DataFrame, sizes: dict) -> DataFrame:
    """``df`` with the group sizes that are known of it (its rows must not have changed)."""
    setattr(df, SIZES, sizes)
    return df


def same_rows(df: DataFrame, before: DataFrame) -> DataFrame:
    """``df`` derived from ``before`` by adding or dropping columns only."""
    return with_sizes(df, getattr(before, SIZES, {}))


def fits_one_task(df: DataFrame, keys: list[str]) -> bool:
    return group_sizes(df, keys)[1] <= max_group_rows(df.sparkSession)


class Ordered:
    def __init__(self, df: DataFrame, keys, order: list[Key], tiebreak: bool = True):
        self.keys = list(keys or [])
        self.by = list(order)
        self.order = list(order)
        if tiebreak and ROW_ID in df.columns and ROW_ID not in [k.column for k in order]:
            self.order.append(Key(ROW_ID))
        limit = max_group_rows(df.sparkSession)
        # A chain of operators over the same keys counts its groups once.
        self._sizes = dict(getattr(df, SIZES, {}))
        known = tuple(self.keys)
        if known not in self._sizes:
            self._sizes[known] = group_sizes(df, self.keys)
        rows, largest = self._sizes[known]
        self.chunked = largest > limit
        if self.chunked:
            ranges = max(2, -(-rows // limit), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
            df = cut_lineage(
                df.repartitionByRange(ranges, *[F.col(k) for k in self.keys], *[k.expr() for k in self.order])
                .withColumn(CHUNK, F.spark_partition_id())
            )
        self._df = df
        self.limit = limit

    @property
    def df(self) -> DataFrame:
        return with_sizes(self._df.drop(CHUNK), self._sizes)

    def _window(self, reverse: bool):
        parts = self.keys + ([CHUNK] if self.chunked else [])
        w = Window.partitionBy(*parts) if parts else Window.partitionBy(F.lit(0))
        return w.orderBy(*[k.expr(reverse) for k in self.order])

    def running(self, reverse: bool = False, /, **specs) -> "Ordered":
        """Add running columns, each ``name=(kind, Column)``.

        sum, count, max, min and last (non-null) include the current row; ``prev`` is
        the value of the row before.
        """
        w = self._window(reverse)
        frame = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        fn = {
            "sum": lambda c: F.sum(c).over(frame),
            "count": lambda c: F.count(c).over(frame),
            "max": lambda c: F.max(c).over(frame),
            "min": lambda c: F.min(c).over(frame),
            "last": lambda c: F.last(c, ignorenulls=True).over(frame),
            "prev": lambda c: F.lag(c, 1).over(w),
        }
        if not self.chunked:
            self._df = self._df.withColumns({n: fn[k](c) for n, (k, c) in specs.items()})
            return self

        inputs = {f"__in_{n}": c for n, (_, c) in specs.items()}
        given = self._df.withColumns(inputs)
        local = given.withColumns(
            {_LOCAL: F.row_number().over(w), **{n: fn[k](F.col(f"__in_{n}")) for n, (k, _) in specs.items()}}
        )
        whole = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
        exact = all(k in whole and (k != "sum" or isinstance(given.schema[f"__in_{n}"].dataType, T.IntegralType))
                    for n, (k, _) in specs.items())
        if exact:
            # What a range ends with is its total, in any order; the rows need not be sorted for it.
            ends = [whole[k](f"__in_{n}").alias(f"__end_{n}") for n, (k, _) in specs.items()]
        else:
            ends = []
            for n, (k, _) in specs.items():
                source = f"__in_{n}" if k == "prev" else n
                ends.append(F.max_by(F.struct(source), _LOCAL)[source].alias(f"__end_{n}"))
        summary = (given if exact else local).groupBy(*self.keys, CHUNK).agg(*ends)
        chunk_order = F.col(CHUNK).desc() if reverse else F.col(CHUNK).asc()
        cw = (Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))).orderBy(chunk_order)
        before = cw.rowsBetween(Window.unboundedPreceding, -1)
        combine = {
            "sum": lambda c: F.sum(c).over(before),
            "count": lambda c: F.sum(c).over(before),
            "max": lambda c: F.max(c).over(before),
            "min": lambda c: F.min(c).over(before),
            "last": lambda c: F.last(c, ignorenulls=True).over(before),
            "prev": lambda c: F.lag(c, 1).over(cw),
        }
        # Ranges are contiguous, so at most one group enters a range from outside:
        # the carry has fewer rows than there are ranges and may be broadcast.
        carry = summary.withColumn("__seen", F.count(F.lit(1)).over(before)).withColumns(
            {f"__carry_{n}": combine[k](F.col(f"__end_{n}")) for n, (k, _) in specs.items()}
        ).filter("__seen > 0").select(
            *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(self.keys)],
            F.col(CHUNK).alias("__k_chunk"), *[f"__carry_{n}" for n in specs],
        )
        cond = local[CHUNK] == carry["__k_chunk"]
        for i, k in enumerate(self.keys):
            cond = cond & local[k].eqNullSafe(carry[f"__k_{i}"])
        joined = local.join(F.broadcast(carry), cond, "left")
        merged = {}
        for n, (k, _) in specs.items():
            here, past = F.col(n), F.col(f"__carry_{n}")
            if k in ("sum", "count"):
                merged[n] = F.coalesce(here + past, here, past)
            elif k == "max":
                merged[n] = F.greatest(here, past)
            elif k == "min":
                merged[n] = F.least(here, past)
            elif k == "last":
                merged[n] = F.coalesce(here, past)
            else:
                merged[n] = F.when(F.col(_LOCAL) == 1, past).otherwise(here)
        keep = [c for c in local.columns if not c.startswith("__in_") and c != _LOCAL]
        self._df = joined.withColumns(merged).select(*keep)
        return self

    def framed(self, before: int, after: int, /, **exprs) -> "Ordered":
        """Add columns over the frame of ``before`` preceding and ``after`` following rows.

        ``exprs`` maps a name to a function from a bounded frame to a Column. In the
        range-partitioned form rows are numbered and cut into blocks, each block borrowing
        the few rows its frames reach into; blocks spread over all tasks.
        """
        if not self.chunked:
            w = self._window(False)
            frame = w.rowsBetween(-before, after)
            self._df = self._df.withColumns({n: f(frame, w) for n, f in exprs.items()})
            return self
        self.running(__rn=("count", F.lit(1)))
        size = max(self.limit, 4 * (before + after), 2)
        pos = F.col("__rn") - 1
        own = F.floor(pos / size).cast("long")
        targets = F.array_compact(F.array(
            own,
            F.when(pos >= (own + 1) * size - before, own + 1),
            F.when((pos < own * size + after) & (own > 0), own - 1),
        ))
        blocks = self._df.withColumn("__own", own).withColumn("__block", F.explode(targets))
        w = Window.partitionBy(*self.keys, "__block").orderBy("__rn")
        frame = w.rowsBetween(-before, after)
        out = blocks.withColumns({n: f(frame, w) for n, f in exprs.items()})
        self._df = out.filter(F.col("__own") == F.col("__block")).drop("__own", "__block", "__rn")
        return self

    def number(self, name: str = "__rn") -> "Ordered":
        return self.running(**{name: ("count", F.lit(1))})

    def ranks(self, name: str, method: str) -> "Ordered":
        """rank, dense_rank, row_number or percent_rank; ties share the order columns."""
        if method == "row_number":
            return self.number(name)
        if not self.chunked:
            base = Window.partitionBy(*self.keys) if self.keys else Window.partitionBy(F.lit(0))
            w = base.orderBy(*[k.expr() for k in self.by])
            fn = {"rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank}[method]
            self._df = self._df.withColumn(name, fn().over(w))
            return self
        tie = F.struct(*[F.col(k.column) for k in self.by])
        self.running(__pos=("count", F.lit(1)), __prev=("prev", tie))
        self._df = self._df.withColumn("__new", ~tie.eqNullSafe(F.col("__prev")) | (F.col("__pos") == 1))
        if method == "dense_rank":
            self.running(**{name: ("sum", F.col("__new").cast("long"))})
        else:
            self.running(**{name: ("max", F.when(F.col("__new"), F.col("__pos")))})
        self._df = self._df.drop("__pos", "__prev", "__new")
        if method == "percent_rank":
            joined = attach_totals(self._df, self.keys, __n=F.count(F.lit(1)))
            self._df = joined.withColumn(
                name, F.when(F.col("__n") <= 1, 0.0).otherwise((F.col(name) - 1) / (F.col("__n") - 1))
            ).drop("__n")
        return self


def attach_totals(df: DataFrame, keys: list[str], /, few: bool = False, **aggregates) -> DataFrame:
    """Whole-group aggregates on every row, by aggregate-and-join. With ``few`` groups (names of
    columns) the totals go to the rows, which would meet by group in as few tasks otherwise.

    Unlike a window over ``keys`` this combines map-side and lets the join split a hot
    key, because the aggregated side has one row per key.
    """
    names = list(aggregates)
    if not keys:
        totals = df.agg(F.struct(*[a.alias(n) for n, a in aggregates.items()]).alias("__t"))
        boxed = df.withColumn("__t", totals.scalar())
        return boxed.select(*df.columns, *[F.col("__t")[n].alias(n) for n in names])
    totals = df.groupBy(*[F.col(k).alias(f"__t_{i}") for i, k in enumerate(keys)]).agg(
        *[a.alias(n) for n, a in aggregates.items()]
    )
    cond = F.lit(True)
    for i, k in enumerate(keys):
        cond = cond & df[k].eqNullSafe(totals[f"__t_{i}"])
    if few:
        totals = F.broadcast(totals)
    return df.join(totals, cond, "left").select(df["*"], *[totals[n] for n in names])
