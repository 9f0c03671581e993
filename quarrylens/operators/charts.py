"""The aggregated rows behind each chart. Drawing is left to the reader of the frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require, require_columns
from quarrylens.functions.dates import parse_timestamp
from quarrylens.ids import ROW_ID, data_columns, kind, numeric_columns
from quarrylens.operators import stats as S
from quarrylens.operators.aggregate import pivot_dataframe, top_categories
from quarrylens.operators.measures import measure
from quarrylens.operators.ordered import Key, Ordered, attach_totals
from quarrylens.operators.quantiles import exact_quantiles, linspace, quantile_row

MISSING = "(missing)"


def _percent(df: DataFrame, keys: list[str]) -> DataFrame:
    total = attach_totals(df, keys, __t=F.sum("value"))
    zero = None if keys else 0.0
    share = F.when(F.col("__t") != 0, F.col("value") / F.col("__t") * 100).otherwise(F.lit(zero).cast("double"))
    return total.withColumn("value", share).drop("__t")


def build_bar_chart(df: DataFrame, category_column: str, value_column=None, series_column=None,
                    aggregation: str = "sum", top_n: int | None = None, sort_by: str = "value",
                    descending: bool = True, normalize_percent: bool = False,
                    include_missing_category: bool = False) -> DataFrame:
    require(top_n is None or top_n >= 1, "INVALID_TOP_N")
    require(value_column is not None or aggregation in ("count", "nunique"), "VALUE_COLUMN_REQUIRED")
    keys = [category_column] + ([series_column] if series_column else [])
    require_columns(df, keys + ([value_column] if value_column else []))
    if include_missing_category:
        df = df.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit(MISSING)) for k in keys})
    else:
        df = df.dropna(subset=keys)
    if value_column:
        df = df.filter(F.col(value_column).isNotNull())
    v = F.col(value_column) if value_column else (F.lit(1) if aggregation == "count" else F.col(category_column))
    out = measure(df, keys, [("value", aggregation, v)])
    if normalize_percent:
        out = _percent(out, [category_column] if series_column else [])
    order = F.col("value") if sort_by == "value" else F.col(category_column)
    order = order.desc() if descending else order.asc()
    if series_column:
        if top_n is not None:
            rank = F.sum("value")
            lead = out.groupBy(F.col(category_column).alias("__c")).agg(rank.alias("__r"))
            lead = lead.orderBy(F.col("__r").desc() if descending else F.col("__r").asc(), "__c").limit(top_n)
            out = out.join(lead.select("__c"), F.col(category_column).eqNullSafe(F.col("__c")), "left_semi")
        return out
    out = out.orderBy(order, F.col(category_column))
    return out.limit(top_n) if top_n is not None else out


# Resampling frequencies and the truncation unit of each.
FREQUENCIES = {"D": "day", "W": "week", "MS": "month", "M": "month", "QS": "quarter", "Q": "quarter", "YS": "year",
               "Y": "year", "H": "hour"}
_STEP = {"day": "interval 1 day", "week": "interval 7 days", "month": "interval 1 month",
         "quarter": "interval 3 months", "year": "interval 1 year", "hour": "interval 1 hour"}


def _timeline(df: DataFrame, x: str, series: str | None, unit: str, fill: bool) -> DataFrame:
    """Period starts between first and last value of each series; one row per period."""
    keys = [series] if series else []
    g = df.groupBy(*keys, F.date_trunc(unit, F.col(x)).alias(x)).agg(F.sum("value").alias("value"))
    ends = [F.min(x).alias("a"), F.max(x).alias("b")]
    spans = g.groupBy(*keys).agg(*ends) if keys else g.agg(*ends)
    # Both sides come from g, so each gets names of its own before they meet.
    full = spans.select(*[F.col(k).alias("__series") for k in keys],
                        F.explode(F.sequence("a", "b", F.expr(_STEP[unit]))).alias("__x"))
    seen = g.select(*[F.col(k).alias("__seen_series") for k in keys], F.col(x).alias("__seen_x"), "value")
    cond = F.col("__x") == F.col("__seen_x")
    if series:
        cond = cond & F.col("__series").eqNullSafe(F.col("__seen_series"))
    value = F.coalesce(F.col("value"), F.lit(0.0)) if fill else F.col("value")
    return full.join(seen, cond, "left").select(
        F.col("__x").alias(x), *[F.col("__series").alias(k) for k in keys], value.alias("value"))


def build_line_chart(df: DataFrame, x_column: str, y_column: str, series_column=None, aggregation: str = "sum",
                     parse_datetime: bool = False, frequency: str | None = None, fill_missing_intervals: bool = False,
                     cumulative: bool = False, rolling_window: int | None = None,
                     normalize_percent: bool = False) -> DataFrame:
    """Also the area chart, which adds ``normalize_percent`` per x."""
    keys = [x_column] + ([series_column] if series_column else [])
    require_columns(df, keys + [y_column])
    require(not frequency or parse_datetime, "DATETIME_REQUIRED")
    require(not frequency or frequency in FREQUENCIES, "INVALID_FREQUENCY")
    require(rolling_window is None or rolling_window >= 1, "INVALID_ROLLING_WINDOW")
    if parse_datetime:
        typed = F.col(x_column).cast("timestamp") if kind(df, x_column) == "datetime" else parse_timestamp(F.col(x_column))
        df = df.withColumn(x_column, typed)
    df = df.dropna(subset=keys)
    if aggregation != "count":
        df = df.filter(F.col(y_column).isNotNull())
    out = measure(df, keys, [("value", aggregation, F.col(y_column))])
    if frequency:
        out = _timeline(out, x_column, series_column, FREQUENCIES[frequency], fill_missing_intervals)
    group = [series_column] if series_column else []
    if cumulative:
        out = Ordered(out, group, [Key(x_column)]).running(__c=("sum", F.col("value"))).df.withColumn(
            "value", F.col("__c")).drop("__c")
    if rolling_window:
        out = Ordered(out, group, [Key(x_column)]).framed(
            rolling_window - 1, 0, __m=lambda frame, w: F.avg("value").over(frame)).df.withColumn(
            "value", F.col("__m")).drop("__m")
    if normalize_percent:
        out = _percent(out, [x_column] if series_column else [])
    return out


def build_area_chart(df: DataFrame, x_column: str, y_column: str, **options) -> DataFrame:
    return build_line_chart(df, x_column, y_column, **options)


def build_pie_donut(df: DataFrame, category_column: str, value_column=None, aggregation: str = "count",
                    top_n: int | None = None, group_other: bool = True, min_share: float = 0.0,
                    include_missing_category: bool = False) -> DataFrame:
    require(aggregation in ("count", "sum", "mean"), "INVALID_AGGREGATION")
    require(0 <= min_share < 1, "INVALID_MIN_SHARE")
    c = F.col(category_column)
    if include_missing_category:
        df = df.withColumn(category_column, F.coalesce(c.cast("string"), F.lit(MISSING)))
    else:
        df = df.filter(c.isNotNull())
    if value_column:
        df = df.filter(F.col(value_column).isNotNull())
    g = measure(df, [category_column], [("value", aggregation, F.col(value_column) if value_column else F.lit(1))])
    if top_n is not None:
        g = top_categories(g, category_column, "value", top_n, group_other=group_other).drop("share")
    g = attach_totals(g, [], __t=F.sum("value"))
    share = F.col("value") / F.col("__t")
    if min_share > 0:
        small = share < min_share
        if group_other:
            name = F.when(small, F.lit("Other")).otherwise(c.cast("string"))
            g = g.groupBy(name.alias(category_column)).agg(F.sum("value").alias("value"))
        else:
            g = g.filter(~small).drop("__t")
        g = attach_totals(g, [], __t=F.sum("value"))
    return g.select(category_column, F.col("value").cast("double").alias("value"),
                    (F.col("value") / F.col("__t")).alias("share"))


def build_histogram(df: DataFrame, value_column: str, group_column=None, bins: int = 20, density: bool = False,
                    cumulative: bool = False, lower_quantile=None, upper_quantile=None) -> DataFrame:
    """(group, bin, lower, upper, value) over edges shared by all groups."""
    require(1 <= bins <= 500, "INVALID_BINS")
    keys = [group_column] if group_column else []
    v = F.col(value_column).cast("double")
    work = df.dropna(subset=[value_column, *keys]).select(*keys, v.alias("__v"))
    asked = [q for q in (lower_quantile, upper_quantile) if q is not None]
    if asked:
        found = quantile_row(work, ["__v"], asked)["__v"]
        if lower_quantile is not None:
            work = work.filter(F.col("__v") >= F.lit(found[0]))
        if upper_quantile is not None:
            work = work.filter(F.col("__v") <= F.lit(found[-1]))
    low, high = work.agg(F.min("__v"), F.max("__v")).first()
    require(low is not None, "NO_DATA")
    if low == high:
        low, high = low - 0.5, high + 0.5
    cuts = linspace(low, high, bins)
    counted = work.groupBy(*keys, S.histogram_bin(F.col("__v"), cuts).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    each = [F.struct(F.lit(i).alias("bin"), F.lit(cuts[i]).alias("lower"), F.lit(cuts[i + 1]).alias("upper"))
            for i in range(bins)]
    groups = work.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    frame = groups.select(*[F.col(k).alias(f"__{k}") for k in keys], F.inline(F.array(*each)))
    cond = frame["bin"] == counted["bin"]
    for k in keys:
        cond = cond & (frame[f"__{k}"] == counted[k])
    out = frame.join(counted, cond, "left").select(
        *[F.col(f"__{k}").alias("group") for k in keys], frame["bin"], "lower", "upper",
        F.coalesce(F.col("n"), F.lit(0)).cast("double").alias("value"))
    g = ["group"] if keys else []
    if density:
        out = attach_totals(out, g, __t=F.sum("value")).withColumn(
            "value", F.col("value") / F.col("__t") / (F.col("upper") - F.col("lower"))).drop("__t")
    if cumulative:
        out = Ordered(out, g, [Key("bin")]).running(__c=("sum", F.col("value"))).df.withColumn(
            "value", F.col("__c")).drop("__c")
    return out


def build_scatter_bubble(df: DataFrame, x_column: str, y_column: str, size_column=None, group_column=None,
                         max_points: int | None = None) -> DataFrame:
    """The plotted points: all complete rows, bubble sizes scaled to 30..300. ``max_points`` is
    the caller's own bound: the first so many rows."""
    cols = [c for c in (x_column, y_column, size_column, group_column) if c]
    require_columns(df, cols)
    work = df.dropna(subset=cols)
    if max_points is not None:
        work = (work.orderBy(ROW_ID) if ROW_ID in df.columns else work).limit(max_points)
    work = work.select(*cols)
    if size_column:
        raw = F.abs(F.col(size_column).cast("double"))
        work = attach_totals(work, [], __a=F.min(raw), __b=F.max(raw))
        scaled = 30 + 270 * F.try_divide(raw - F.col("__a"), F.col("__b") - F.col("__a"))
        work = work.withColumn("bubble_size", F.coalesce(scaled, F.lit(80.0))).drop("__a", "__b")
    return work


def scatter_statistics(df: DataFrame, x_column: str, y_column: str) -> DataFrame:
    """Pearson with p and the fitted line over all complete rows."""
    from quarrylens.operators.eda import analyze_numeric_relationships
    return analyze_numeric_relationships(df, [x_column, y_column], rank_methods=False)


def build_box_violin(df: DataFrame, value_column: str, group_column=None, max_groups: int | None = None) -> DataFrame:
    v = F.col(value_column).cast("double")
    keys = [group_column] if group_column else []
    work = df.dropna(subset=[value_column, *keys]).select(*keys, v.alias("value"))
    if keys:
        if max_groups is not None:
            levels = work.select(*keys).distinct().limit(max_groups + 1).count()
            require(levels <= max_groups, "TOO_MANY_GROUPS",
                    groups=levels)
        work = work.withColumnRenamed(group_column, "group")
    else:
        work = work.withColumn("group", F.lit(value_column))
    q = exact_quantiles(work, ["value"], [0.25, 0.5, 0.75], ["group"]).select(
        F.col("group").alias("__g"), F.col("value").alias("__q"))
    iqr = F.col("__q")[2] - F.col("__q")[0]
    low, high = F.col("__q")[0] - 1.5 * iqr, F.col("__q")[2] + 1.5 * iqr
    joined = work.join(q, F.col("group").eqNullSafe(F.col("__g")))
    x = F.col("value")
    out = joined.groupBy("group").agg(
        F.count(x).alias("count"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.max("__q").alias("__q"), F.count_if((x < low) | (x > high)).alias("outlier_count"))
    return out.select("group", "count", "mean", F.col("__q")[1].alias("median"), F.col("__q")[0].alias("q1"),
                      F.col("__q")[2].alias("q3"), iqr.alias("iqr"), low.alias("lower_fence"),
                      high.alias("upper_fence"), "min", "max", "outlier_count")


def build_heatmap(df: DataFrame, mode: str = "correlation", columns=None, method: str = "pearson", row_column=None,
                  column_column=None, value_column=None, aggregation: str = "mean",
                  min_observations: int = 3) -> DataFrame:
    require(mode in ("correlation", "metric"), "INVALID_MODE")
    if mode == "correlation":
        columns = columns or numeric_columns(df)
        return S.correlation_matrix(S.analyze_correlations(df, columns, method, max(2, min_observations)), columns)
    fn = {"mean": "avg", "nunique": "distinct"}.get(aggregation, aggregation)
    return pivot_dataframe(df.dropna(subset=[row_column, column_column]), [row_column], [column_column],
                           [{"function": fn, "column": value_column, "alias": "value"}])


def build_business_chart(df: DataFrame, chart_type: str, category_column: str, value_column: str,
                         comparison_column=None, line_column=None, aggregation: str = "sum",
                         order_column: str | None = None, start_value: float = 0.0) -> DataFrame:
    """pareto, variance, funnel, waterfall or combo.

    Funnel and waterfall run in the order of ``order_column`` (its minimum per category),
    or of the first row of each category.
    """
    require(chart_type in ("pareto", "variance", "funnel", "waterfall", "combo"), "INVALID_CHART_TYPE")
    require_columns(df, [c for c in (category_column, value_column, comparison_column, line_column, order_column) if c])
    specs = [("value", aggregation, F.col(value_column))]
    if chart_type == "variance":
        require(bool(comparison_column), "COMPARISON_REQUIRED")
        specs.append(("comparison", aggregation, F.col(comparison_column)))
    if chart_type == "combo":
        require(bool(line_column), "LINE_REQUIRED")
        specs.append(("line", "mean", F.col(line_column)))
    if chart_type in ("funnel", "waterfall"):
        position = order_column or ROW_ID
        require_columns(df, [position])
        specs.append(("position", "min", F.col(position)))
    g = measure(df.filter(F.col(category_column).isNotNull()), [category_column], specs)
    if chart_type == "combo":
        return g
    if chart_type == "variance":
        gap = F.col("value") - F.col("comparison")
        return g.withColumns({"variance": gap, "variance_pct": F.try_divide(gap * 100.0, F.abs("comparison"))})
    if chart_type == "pareto":
        o = Ordered(g, [], [Key("value", ascending=False), Key(category_column)])
        o.running(cumulative_value=("sum", F.col("value")))
        t = attach_totals(o.df, [], __t=F.sum("value"))
        return t.withColumn("cumulative_pct", F.try_divide(F.col("cumulative_value") * 100.0, F.col("__t"))).drop("__t")
    o = Ordered(g, [], [Key("position"), Key(category_column)])
    if chart_type == "funnel":
        first = F.when(F.col("__rn") == 1, F.col("value"))
        o.number("__rn").running(__first=("last", first), __prev=("prev", F.col("value")))
        return o.df.withColumns({
            "conversion_from_start_pct": F.try_divide(F.col("value") * 100.0, F.col("__first")),
            "conversion_from_previous_pct": F.when(F.col("__rn") == 1, 100.0).otherwise(
                F.try_divide(F.col("value") * 100.0, F.col("__prev"))),
        }).drop("__rn", "__first", "__prev")
    o.running(__end=("sum", F.col("value").cast("double")))
    return o.df.withColumns({"start": F.lit(float(start_value)) + F.col("__end") - F.col("value"),
                             "end": F.lit(float(start_value)) + F.col("__end")}).drop("__end")


def column_roles(df: DataFrame) -> dict[str, list[str]]:
    """numeric by schema, datetime by schema or when four fifths of the text parses."""
    numbers = numeric_columns(df)
    times = [c for c in data_columns(df) if kind(df, c) == "datetime"]
    texts = [c for c in data_columns(df) if kind(df, c) == "string"]
    if texts:
        row = df.agg(*[F.count(c).alias(f"n_{c}") for c in texts],
                     *[F.avg(F.when(F.col(c).isNotNull(), parse_timestamp(F.col(c)).isNotNull().cast("double")))
                       .alias(f"r_{c}") for c in texts]).first()
        times += [c for c in texts if row[f"n_{c}"] >= 2 and (row[f"r_{c}"] or 0) >= 0.8]
    return {"numeric": numbers, "datetime": times,
            "categorical": [c for c in data_columns(df) if c not in numbers and c not in times]}


# Fixed values: (chart, score) per intent.
_SCORES = {
    "trend": [("line", 0.98), ("area", 0.82)], "distribution": [("histogram", 0.98), ("box", 0.78)],
    "group_distribution": [("box", 0.99), ("histogram", 0.68)], "comparison": [("bar", 0.99)],
    "correlation": [("heatmap", 0.99), ("scatter", 0.65)],
}


def recommend_charts(df: DataFrame, intent: str = "auto", x_column=None, y_column=None, category_column=None,
                     group_column=None, business_chart_type: str = "pareto", max_recommendations: int = 5) -> DataFrame:
    roles = column_roles(df)
    nums, cats, times = roles["numeric"], roles["categorical"], roles["datetime"]
    y = y_column or (nums[0] if nums else None)
    cat = category_column or (cats[0] if cats else None)
    time = times[0] if times else None
    group = group_column or cat
    needs = {"trend": (x_column or time) and y, "distribution": y, "group_distribution": y and group, "comparison": cat,
             "correlation": len(nums) >= 2, "relationship": len(nums) >= 2 or (x_column and y_column),
             "composition": cat, "business": cat and y, "auto": True}
    require(intent in needs, "INVALID_INTENT")
    require(bool(needs[intent]), "INSUFFICIENT_COLUMNS")
    picks: list[tuple[str, float, str | None, str | None]] = []
    if intent == "business":
        picks.append((business_chart_type, 0.99, cat, y))
    elif intent == "relationship":
        picks.append(("scatter", 0.99, x_column or nums[0], y_column or nums[1]))
        if len(nums) >= 3:
            picks.append(("heatmap", 0.67, None, None))
    elif intent == "composition":
        few = df.select(cat).filter(F.col(cat).isNotNull()).distinct().limit(9).count() <= 8
        picks += [("donut", 0.96, cat, y), ("bar", 0.82, cat, y)] if few else [("bar", 0.98, cat, y)]
    elif intent == "auto":
        if time and nums:
            picks.append(("line", 0.95, time, y))
        if x_column in nums and y_column in nums:
            picks.append(("scatter", 0.94, x_column, y_column))
        if category_column and y_column in nums:
            picks.append(("bar", 0.92, category_column, y_column))
        if group_column and y_column in nums:
            picks.append(("box", 0.88, group_column, y_column))
        if len(nums) >= 3:
            picks.append(("heatmap", 0.82, None, None))
        if nums:
            picks.append(("histogram", 0.72, None, y))
        if cats and not picks:
            picks.append(("bar", 0.9, cat, None))
    else:
        first = {"trend": x_column or time, "group_distribution": group, "comparison": cat}.get(intent)
        picks += [(chart, score, first, y) for chart, score in _SCORES[intent]]
    rows = [F.struct(F.lit(c).alias("chart"), F.lit(s).alias("score"), F.lit(a).cast("string").alias("dimension"),
                     F.lit(b).cast("string").alias("measure")) for c, s, a, b in dict.fromkeys(picks)]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows))).orderBy(F.desc("score")).limit(max_recommendations)
