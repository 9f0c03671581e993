"""The seven grouped measures shared by KPIs, charts and business summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require
from quarrylens.operators.ordered import fits_one_task
from quarrylens.operators.quantiles import exact_quantiles

AGGREGATIONS = {"sum", "mean", "median", "min", "max", "count", "nunique"}


def measure(df: DataFrame, keys: list, specs: list[tuple[str, str, Column]]) -> DataFrame:
    """Aggregate ``(alias, aggregation, value)`` per key; keys are names or aliased Columns.

    Everything except a median combines map-side. Medians use one buffer per group only
    where groups are small enough and are ranked on value counts elsewhere.
    """
    for _, fn, _ in specs:
        require(fn in AGGREGATIONS, "INVALID_AGGREGATION", aggregation=fn)
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    work = df.select(*named, *[v.alias(f"__v{i}") for i, (_, _, v) in enumerate(specs)])
    names = work.columns[:len(named)]
    build = {
        "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct,
        "median": F.median,
    }
    medians = [i for i, s in enumerate(specs) if s[1] == "median"]
    inline = not medians or fits_one_task(work, names)
    aggs = [build[fn](F.col(f"__v{i}")).alias(alias) for i, (alias, fn, _) in enumerate(specs)
            if inline or fn != "median"]
    if inline:
        return work.groupBy(*names).agg(*aggs) if names else work.agg(*aggs)
    base = work.groupBy(*names).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
    mids = exact_quantiles(work, [f"__v{i}" for i in medians], [0.5], names, bounded=False).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)],
        *[F.col(f"__v{i}")[0].alias(specs[i][0]) for i in medians])
    cond = reduce(lambda a, b: a & b, [base[k].eqNullSafe(mids[f"__k{i}"]) for i, k in enumerate(names)], F.lit(True))
    return base.join(mids, cond, "left").select(*names, *[a for a, _, _ in specs])
