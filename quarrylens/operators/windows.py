"""Ranking, running totals, lag/lead and rolling windows, safe for hot or absent groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require, require_columns
from quarrylens.ids import kind
from quarrylens.operators.ordered import Ordered, attach_totals, order_keys, same_rows

ROLLING = {"sum", "avg", "min", "max", "count", "median", "std"}


def _setup(df: DataFrame, spec: dict, default_name: str, seen: set, ascending: bool):
    name = str(spec.get("output_column") or default_name).strip()
    require(bool(name), "OUTPUT_COLUMN_REQUIRED")
    require(name not in seen, "DUPLICATE_OUTPUT_COLUMN", column=name)
    seen.add(name)
    require(name not in df.columns or bool(spec.get("replace")), "OUTPUT_COLUMN_EXISTS", column=name)
    parts = list(spec.get("partition_by") or [])
    require(len(parts) == len(set(parts)), "DUPLICATE_PARTITION_COLUMN")
    require(bool(spec.get("order_by")), "ORDER_BY_REQUIRED")
    nulls = spec.get("nulls", "last")
    require(nulls in ("first", "last"), "INVALID_NULL_PLACEMENT")
    order = order_keys(spec["order_by"], nulls, ascending)
    names = [k.column for k in order]
    require(len(names) == len(set(names)), "DUPLICATE_ORDER_COLUMN")
    require_columns(df, parts + names, "UNKNOWN_ORDER_OR_PARTITION_COLUMN")
    return name, parts, order


def _source(df: DataFrame, spec: dict, numeric: bool) -> str:
    column = spec.get("source_column")
    require_columns(df, [column], "UNKNOWN_SOURCE_COLUMN")
    require(not numeric or kind(df, column) == "numeric", "INCOMPATIBLE_COLUMN_TYPE", column=column)
    return column


def _operations(operations) -> list[dict]:
    require(bool(operations), "OPERATIONS_REQUIRED")
    return operations


def apply_ranking(df: DataFrame, operations: list[dict]) -> DataFrame:
    """Order columns are descending unless told otherwise."""
    seen: set = set()
    for spec in _operations(operations):
        method = spec.get("method", "rank")
        require(method in ("rank", "dense_rank", "row_number", "percent_rank"), "INVALID_METHOD")
        name, parts, order = _setup(df, spec, "rank", seen, ascending=False)
        df = Ordered(same_rows(df.drop(name), df), parts, order).ranks(name, method).df
    return df


def apply_running_totals(df: DataFrame, operations: list[dict]) -> DataFrame:
    seen: set = set()
    for spec in _operations(operations):
        source = _source(df, spec, True)
        name, parts, order = _setup(df, spec, f"{source}_running_total", seen, ascending=True)
        policy = spec.get("null_policy", "skip")
        require(policy in ("skip", "zero", "propagate"), "INVALID_NULL_POLICY")
        value = F.col(source).cast("double")
        specs = {"__run": ("sum", F.coalesce(value, F.lit(0.0)))}
        if policy == "propagate":
            specs["__nulls"] = ("count", F.when(value.isNull(), 1))
        df = Ordered(df, parts, order).running(**specs).df
        total = F.col("__run")
        if policy == "skip":
            total = F.when(F.col(source).isNotNull(), total)
        elif policy == "propagate":
            total = F.when(F.col("__nulls") == 0, total)
        df = same_rows(df.withColumn(name, total).drop(*specs), df)
    return df


def running_final_totals(df: DataFrame, spec: dict) -> DataFrame:
    """Each partition's closing total under the null policy."""
    parts, c = list(spec.get("partition_by") or []), F.col(spec["source_column"]).cast("double")
    total = F.sum(F.coalesce(c, F.lit(0.0)))
    if spec.get("null_policy", "skip") == "propagate":
        total = F.when(F.count_if(c.isNull()) == 0, total)
    return df.groupBy(*parts).agg(total.alias("final_total")) if parts else df.agg(total.alias("final_total"))


def apply_lag_lead(df: DataFrame, operations: list[dict]) -> DataFrame:
    """``default`` replaces every null result, not only those past the edge."""
    seen: set = set()
    for spec in _operations(operations):
        source = _source(df, spec, False)
        direction, offset = spec.get("direction", "lag"), spec.get("offset", 1)
        require(direction in ("lag", "lead"), "INVALID_DIRECTION")
        require(isinstance(offset, int) and offset >= 1, "INVALID_OFFSET")
        name, parts, order = _setup(df, spec, f"{source}_{direction}_{offset}", seen, ascending=True)
        shift = F.lag if direction == "lag" else F.lead
        before, after = (offset, 0) if direction == "lag" else (0, offset)
        df = Ordered(df, parts, order).framed(
            before, after, **{name: lambda frame, w: shift(source, offset).over(w)}).df
        if "default" in spec:
            df = same_rows(df.withColumn(name, F.coalesce(F.col(name), F.lit(spec["default"]))), df)
    return df


def apply_rolling_windows(df: DataFrame, operations: list[dict]) -> DataFrame:
    """Last N rows. ``min_periods`` counts values, for ``count`` it counts rows."""
    seen: set = set()
    for spec in _operations(operations):
        source = _source(df, spec, True)
        fn, size = spec.get("function", "avg"), spec.get("window")
        require(fn in ROLLING, "INVALID_FUNCTION", function=fn)
        require(isinstance(size, int) and size >= 1, "INVALID_WINDOW")
        least = spec.get("min_periods")
        least = size if least is None else least
        require(isinstance(least, int) and 1 <= least <= size, "INVALID_MIN_PERIODS")
        ddof = spec.get("ddof", 1)
        require(isinstance(ddof, int) and ddof >= 0, "INVALID_DDOF")
        name, parts, order = _setup(df, spec, f"{source}_rolling_{fn}_{size}", seen, ascending=True)
        c = F.col(source).cast("double")

        def build(frame, _, fn=fn, c=c, least=least, ddof=ddof):
            n = F.count(c).over(frame)
            value = {
                "sum": lambda: F.sum(c).over(frame), "avg": lambda: F.avg(c).over(frame),
                "min": lambda: F.min(c).over(frame), "max": lambda: F.max(c).over(frame),
                "count": lambda: n.cast("double"),
                "median": lambda: F.percentile(c, F.lit(0.5)).over(frame),
                "std": lambda: F.when(n > ddof, F.stddev_pop(c).over(frame) * F.sqrt(n / (n - F.lit(ddof)))),
            }[fn]()
            guard = F.count(F.lit(1)).over(frame) if fn == "count" else n
            return F.when(guard >= least, value)

        df = Ordered(df, parts, order).framed(size - 1, 0, **{name: build}).df
    return df


def cumulative_share(df: DataFrame, value: str, order_by, name: str = "cumulative_share", keys=()) -> DataFrame:
    """Running sum over the total, in the given order."""
    out = Ordered(df, list(keys), order_keys(order_by)).running(__cum=("sum", F.col(value).cast("double"))).df
    out = attach_totals(out, list(keys), __all=F.sum(F.col(value).cast("double")))
    return out.withColumn(name, F.try_divide(F.col("__cum"), F.col("__all"))).drop("__cum", "__all")


def share_of_total(df: DataFrame, value: str, keys=(), name: str = "share") -> DataFrame:
    out = attach_totals(df, list(keys), __all=F.sum(F.col(value).cast("double")))
    return out.withColumn(name, F.coalesce(F.try_divide(F.col(value), F.col("__all")), F.lit(0.0))).drop("__all")
