"""Descriptive statistics, correlation, distribution, intervals, effect sizes and tests.

Spark reduces rows to sufficient statistics (moments, rank sums, contingency cells); the
test statistic and its p-value are Columns over that small result, so the same code
serves one test or one per group.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import EngineError, require, require_columns
from quarrylens.functions import tails as P
from quarrylens.ids import kind, numeric_columns
from quarrylens.operators import ranks as R
from quarrylens.operators.aggregate import contingency_table
from quarrylens.operators.ordered import Key, Ordered, attach_totals
from quarrylens.operators.quantiles import (
    INTERPOLATIONS, counted_once, cumulative_counts, exact_quantiles, linspace, quantile_row, quantiles_of_counts, rows_of_cells, with_below,
)


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def _numeric(df: DataFrame, columns=None, least: int = 1) -> list[str]:
    columns = numeric_columns(df) if columns is None else require_columns(df, columns)
    require(len(columns) >= least, "NO_NUMERIC_COLUMNS" if least == 1 else "INSUFFICIENT_NUMERIC_COLUMNS")
    bad = [c for c in columns if kind(df, c) != "numeric"]
    require(not bad, "INCOMPATIBLE_COLUMN_TYPE", columns=bad)
    return columns


def adjusted_skew(g1: Column, n: Column) -> Column:
    return F.when(n >= 3, F.coalesce(F.when(F.isnan(g1), 0.0).otherwise(g1), F.lit(0.0))
                  * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def adjusted_kurtosis(g2: Column, n: Column) -> Column:
    clean = F.coalesce(F.when(F.isnan(g2), None).otherwise(g2), F.lit(None).cast("double"))
    return F.when(n >= 4, F.coalesce((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * clean + 6.0), F.lit(0.0)))


def moments(df: DataFrame, columns: list[str], ddof: int = 1) -> DataFrame:
    """Long (column, n, null_count, mean, ... skewness, kurtosis) from one pass without shuffle of rows."""
    parts = []
    for c in columns:
        v, n = _d(c), F.count(c).cast("double")
        var = (F.var_samp if ddof == 1 else F.var_pop)(v)
        parts.append(F.struct(
            F.lit(c).alias("column"), F.count(c).alias("count"), F.count_if(F.col(c).isNull()).alias("null_count"),
            F.count(F.lit(1)).alias("rows"), F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.sum(v).alias("sum"), F.when(n > ddof, var).alias("variance"), F.var_pop(v).alias("var_pop"),
            F.skewness(v).alias("g1"), F.kurtosis(v).alias("g2"),
            adjusted_skew(F.skewness(v), n).alias("skewness"), adjusted_kurtosis(F.kurtosis(v), n).alias("kurtosis"),
            F.count_if(v > 0).alias("positive_count"), F.count_if(v < 0).alias("negative_count"),
            F.count_if(v == 0).alias("zero_count"),
        ))
    # Forty columns per aggregate keep the generated code inside the JIT limits.
    frames = [df.agg(F.array(*parts[i:i + 40]).alias("a")).select(F.inline("a")) for i in range(0, len(parts), 40)]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _count_facts(cum: DataFrame, probabilities) -> DataFrame:
    """unique_count, mode (most frequent, then smallest) and quantiles out of value counts."""
    facts = cum.groupBy("column").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.max_by("value", F.struct(F.col("count"), (-F.col("value")).alias("s"))).alias("mode"))
    found = quantiles_of_counts(cum, ["column"], probabilities).select(F.col("column").alias("qc"), "q")
    return facts.join(found, F.col("column") == F.col("qc")).drop("qc").withColumnRenamed("column", "vc")


def analyze_descriptive_statistics(df: DataFrame, columns=None, ddof: int = 1) -> DataFrame:
    require(ddof in (0, 1), "INVALID_DDOF")
    columns = _numeric(df, columns)
    facts = _count_facts(cumulative_counts(df, columns), [0.5])
    t = moments(df, columns, ddof).join(facts, F.col("column") == F.col("vc"), "left")
    sd = F.sqrt("variance")
    return t.select(
        "column", "count", "null_count",
        F.round(F.coalesce(F.try_divide(F.col("null_count") * 100.0, F.col("rows")), F.lit(0.0)), 6)
        .alias("null_rate_pct"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"), "mean", F.col("q")[0].alias("median"), "mode",
        "min", "max", (F.col("max") - F.col("min")).alias("range"), "sum", "variance", sd.alias("std_dev"),
        F.when(F.col("mean") != 0, sd / F.col("mean")).alias("coefficient_of_variation"), "skewness", "kurtosis",
    )


def analyze_percentiles(df: DataFrame, columns=None, quantiles=None, interpolation: str = "linear") -> DataFrame:
    """Fixed marks plus one ``q_<p>`` column per requested quantile."""
    require(interpolation in INTERPOLATIONS, "INVALID_INTERPOLATION")
    columns = _numeric(df, columns)
    qs = [0, 0.25, 0.5, 0.75, 1] if quantiles is None else list(quantiles)
    require(bool(qs) and all(isinstance(q, (int, float)) and 0 <= q <= 1 for q in qs), "INVALID_QUANTILE")
    require(len(qs) == len({float(q) for q in qs}), "DUPLICATE_QUANTILE")
    marks = [0.25, 0.5, 0.75, 0.1, 0.9]
    row = exact_quantiles(df, columns, [*marks, *qs], interpolation=interpolation)
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("q")) for c in columns])
    long = row.select(F.inline(items))
    q = F.col("q")
    iqr = q[2] - q[0]
    return long.select(
        "column", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3"), iqr.alias("iqr"),
        (q[0] - 1.5 * iqr).alias("lower_fence"), (q[2] + 1.5 * iqr).alias("upper_fence"), q[3].alias("p10"),
        q[4].alias("p90"), (q[4] - q[3]).alias("p90_p10_spread"),
        *[q[len(marks) + i].alias(f"q_{float(v):g}") for i, v in enumerate(qs)],
    )


# ---------------------------------------------------------------- association of number columns

def _pairs(columns: list[str]) -> list[tuple[str, str]]:
    return list(combinations(columns, 2))


_PAIR = ["column_a", "column_b"]


def _column_ranks(df: DataFrame, columns: list[str], rows: int) -> DataFrame:
    """The rows of ``df`` with each column's values replaced by their mid-ranks: one long table
    of cells meets one table of ranked values, however many pairs are formed of it later."""
    cells = F.array(*[F.struct(F.lit(i).alias("k"), _d(c).alias("value")) for i, c in enumerate(columns)])
    # The row number lives inside this one plan only; it is taken before rows turn into cells.
    numbered = df.select(F.monotonically_increasing_id().alias("row"), cells.alias("cells"))
    long = numbered.select("row", F.inline("cells"))
    counts = long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("count"))
    ranks = with_below(counts, ["k"]).withColumn("rank", F.col("below") + (F.col("count") + 1) / 2)
    wide = rows_of_cells(long, ranks, rows, len(columns), "rank")
    return wide.select(*[F.col(f"f{i}").alias(c) for i, c in enumerate(columns)])


def spearman_pairs(df: DataFrame, pairs) -> DataFrame:
    """Pearson correlation of mid-ranks. Columns without nulls are ranked once for all their
    pairs; a pair with a null somewhere is ranked anew after its incomplete rows are dropped."""
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    gaps = df.agg(*[F.count_if(_d(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("rows")).first()
    full = {c for i, c in enumerate(columns) if not gaps[i]}
    whole = [p for p in pairs if set(p) <= full]
    rest = [p for p in pairs if not set(p) <= full]
    frames = []
    if whole:
        used = [c for c in columns if any(c in p for p in whole)]

        def build(a: Column, b: Column) -> list[Column]:
            spread = F.stddev_pop(a) * F.stddev_pop(b)
            return [F.count(a).alias("n"), F.try_divide(F.covar_pop(a, b), spread).alias("correlation")]

        frames.append(_pair_aggregate(_column_ranks(df, used, gaps["rows"]), whole, build))
    if rest:
        frames.append(_spearman_with_gaps(df, rest))
    return reduce(lambda a, b: a.unionByName(b), frames)


def _named(parts: DataFrame, named: dict) -> DataFrame:
    """Column names in place of column numbers a and b."""
    table = F.create_map(*[x for (a, b), names in named.items() for x in (F.lit(f"{a},{b}"), F.array(*map(F.lit, names)))])
    names = table[F.concat_ws(",", "a", "b")]
    return parts.withColumns({"column_a": names[0], "column_b": names[1]}).drop("a", "b")


def _spearman_with_gaps(df: DataFrame, pairs) -> DataFrame:
    columns, numbers, named = R.numbered_pairs(pairs)
    places, size = R.column_places(df, columns)
    ranks = R.complete_ranks(places, size, len(columns))
    frames = []
    for i in range(0, len(numbers), 60):
        parts = []
        for a, b in numbers[i:i + 60]:
            x, y = F.col("ranks")[a][b], F.col("ranks")[b][a]
            spread = F.stddev_pop(_both(x, y, x)) * F.stddev_pop(_both(x, y, y))
            parts.append(F.struct(*[F.lit(c).alias(n) for c, n in zip(named[a, b], _PAIR)],
                                  F.count(_both(x, y, x)).alias("n"),
                                  F.try_divide(F.covar_pop(x, y), spread).alias("correlation")))
        frames.append(ranks.agg(F.array(*parts).alias("s")).select(F.inline("s")))
    return reduce(lambda a, b: a.unionByName(b), frames)


def kendall_pairs(df: DataFrame, pairs) -> DataFrame:
    """Exact tau-b over the complete rows of every pair; see ``ranks`` for how pairs are counted."""
    columns, numbers, named = R.numbered_pairs(pairs)
    places, size = R.column_places(df, columns)
    out = _named(R.kendall_parts(places, size, len(columns), numbers), named)
    n = F.col("n").cast("double")
    total = n * (n - 1) / 2
    diff = total - F.col("t_x") - F.col("t_y") + F.col("t_xy") - 2 * F.col("dis")
    m = n * (n - 1)
    var = (m * (2 * n + 5) - F.col("u_x") - F.col("u_y")) / 18 + F.try_divide(
        2.0 * F.col("t_x") * F.col("t_y"), m) + F.coalesce(
        F.try_divide(F.col("z_x") * F.col("z_y"), 9 * m * (n - 2)), F.lit(0.0))
    return out.select(
        *_PAIR, "n", F.try_divide(diff, F.sqrt(total - F.col("t_x")) * F.sqrt(total - F.col("t_y"))).alias("correlation"),
        P.z_p(F.try_divide(diff, F.sqrt(F.when(var > 0, var)))).alias("p_value"))


def _pair_aggregate(df: DataFrame, pairs, build) -> DataFrame:
    """All pairs in wide aggregates of 60, returned long."""
    frames = []
    for i in range(0, len(pairs), 60):
        parts = [
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), *build(_d(a), _d(b)))
            for a, b in pairs[i:i + 60]
        ]
        frames.append(df.agg(F.array(*parts).alias("s")).select(F.inline("s")))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), value)


def analyze_correlations(df: DataFrame, columns=None, method: str = "pearson", min_periods: int = 2) -> DataFrame:
    """Long (column_a, column_b, correlation, absolute_correlation, pairwise_count)."""
    require(method in ("pearson", "spearman", "kendall"), "INVALID_METHOD")
    require(isinstance(min_periods, int) and min_periods >= 2, "INVALID_MIN_PERIODS")
    pairs = _pairs(_numeric(df, columns, 2))
    if method == "pearson":
        def build(a, b):
            x, y = _both(a, b, a), _both(a, b, b)
            flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
            return [F.when(~flat, F.corr(a, b)).alias("correlation"), F.count(x).alias("n")]
        out = _pair_aggregate(df, pairs, build)
    else:
        out = (spearman_pairs if method == "spearman" else kendall_pairs)(df, pairs)
    value = F.when(F.col("n") >= min_periods, F.when(F.isnan("correlation"), None).otherwise(F.col("correlation")))
    return out.select("column_a", "column_b", value.alias("correlation"),
                      F.abs(value).alias("absolute_correlation"), F.col("n").alias("pairwise_count"))


def strongest_pairs(correlations: DataFrame, top: int | None = None, sign: str = "any") -> DataFrame:
    c = F.col("correlation")
    t = correlations.filter(c.isNotNull())

    def cut(ordered: DataFrame) -> DataFrame:
        return ordered if top is None else ordered.limit(top)

    if sign == "positive":
        return cut(t.filter(c > 0).orderBy(F.desc("correlation")))
    if sign == "negative":
        return cut(t.filter(c < 0).orderBy(F.asc("correlation")))
    return cut(t.orderBy(F.desc("absolute_correlation"), "column_a", "column_b"))


def correlation_matrix(correlations: DataFrame, columns: list[str]) -> DataFrame:
    """Square form: one row per column, its own cell 1."""
    both = correlations.select("column_a", "column_b", "correlation").unionByName(
        correlations.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation"))
    wide = [F.when(F.col("column_a") == c, 1.0).otherwise(
        F.max(F.when(F.col("column_b") == c, F.col("correlation")))).alias(c) for c in columns]
    return both.groupBy("column_a").agg(*wide)


def analyze_covariance(df: DataFrame, columns=None, ddof: int = 1) -> DataFrame:
    require(ddof in (0, 1), "INVALID_DDOF")
    columns = _numeric(df, columns, 2)
    pairs = [(a, a) for a in columns] + _pairs(columns)

    def build(a, b):
        n = F.count(_both(a, b, a))
        cov = (F.covar_samp if ddof == 1 else F.covar_pop)(a, b)
        return [F.when(n > ddof, cov).alias("covariance"), n.alias("observations")]

    return _pair_aggregate(df, pairs, build)


# ---------------------------------------------------------------- distribution and normality

def histogram(df: DataFrame, columns: list[str], bins: int = 10) -> DataFrame:
    """Equal-width counts (column, bin, lower, upper, count); the last bin is closed."""
    require(isinstance(bins, int) and 1 <= bins <= 200, "INVALID_HISTOGRAM_BINS")
    row = df.agg(*[F.min(_d(c)).alias(f"a_{c}") for c in columns], *[F.max(_d(c)).alias(f"b_{c}")
                                                                    for c in columns]).first()
    marks, edges = [], []
    for c in columns:
        low, high = row[f"a_{c}"], row[f"b_{c}"]
        if low is None:
            continue
        if low == high:
            low, high = low - 0.5, high + 0.5
        cuts = linspace(low, high, bins)
        marks.append(F.struct(F.lit(c).alias("column"), histogram_bin(_d(c), cuts).alias("bin")))
        edges += [F.struct(F.lit(c).alias("column"), F.lit(i).alias("bin"), F.lit(cuts[i]).alias("lower"),
                           F.lit(cuts[i + 1]).alias("upper")) for i in range(bins)]
    frame = df.sparkSession.range(1).select(F.inline(F.array(*edges)))
    counts = df.select(F.explode(F.array(*marks)).alias("m")).select("m.*").filter("bin is not null").groupBy(
        "column", "bin").agg(F.count(F.lit(1)).alias("count"))
    return frame.join(counts, ["column", "bin"], "left").fillna({"count": 0})


def histogram_bin(v: Column, cuts: list[float]) -> Column:
    """Bin number by the rule of an evenly spaced histogram, corrected at the edges."""
    bins, low, high = len(cuts) - 1, cuts[0], cuts[-1]
    at = F.least(F.floor((v - F.lit(low)) / F.lit((high - low)) * bins).cast("int"), F.lit(bins - 1))
    array = F.array(*[F.lit(x) for x in cuts])
    start, end = F.element_at(array, at + 1), F.element_at(array, at + 2)
    fixed = F.when(v < start, at - 1).when((v >= end) & (at < bins - 1), at + 1).otherwise(at)
    return F.when((v >= F.lit(low)) & (v <= F.lit(high)), fixed)


def shape_label(skew: Column) -> Column:
    return (F.when(skew.isNull(), "unknown").when(skew >= 1, "strong_right_skew")
            .when(skew >= 0.5, "moderate_right_skew").when(skew <= -1, "strong_left_skew")
            .when(skew <= -0.5, "moderate_left_skew").otherwise("approximately_symmetric"))


def tail_label(kurt: Column) -> Column:
    return (F.when(kurt.isNull(), "unknown").when(kurt > 1, "heavy_tailed").when(kurt < -1, "light_tailed")
            .otherwise("moderate_tails"))


def analyze_distributions(df: DataFrame, columns=None, quantiles=None) -> DataFrame:
    columns = _numeric(df, columns)
    qs = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99] if quantiles is None else list(quantiles)
    require(bool(qs) and all(0 <= q <= 1 for q in qs), "INVALID_QUANTILES")
    cum = cumulative_counts(df, columns)
    facts = _count_facts(cum, [0.25, 0.5, 0.75, *qs])
    q = F.col("q")
    iqr = q[2] - q[0]
    low, high = q[0] - 1.5 * iqr, q[2] + 1.5 * iqr
    side = facts.select(F.col("vc").alias("oc"), low.alias("lo"), high.alias("hi"))
    outliers = cum.join(F.broadcast(side), F.col("column") == F.col("oc")).groupBy("oc").agg(
        F.coalesce(F.sum(F.when((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi")), F.col("count"))),
                   F.lit(0)).alias("iqr_outlier_count"))
    t = moments(df, columns).join(facts, F.col("column") == F.col("vc"), "left").join(
        outliers, F.col("column") == F.col("oc"), "left")
    return t.select(
        "column", "count", "null_count", "mean", q[1].alias("median"), F.sqrt("variance").alias("std_dev"), "min",
        "max", (F.col("max") - F.col("min")).alias("range"), "skewness", "kurtosis",
        shape_label(F.col("skewness")).alias("shape"), tail_label(F.col("kurtosis")).alias("tails"),
        q[0].alias("q1"), q[2].alias("q3"), iqr.alias("iqr"), low.alias("lower_iqr_fence"),
        high.alias("upper_iqr_fence"), F.coalesce("iqr_outlier_count", F.lit(0)).alias("iqr_outlier_count"),
        "positive_count", "negative_count", "zero_count",
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.round(F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("count")), F.lit(0.0)), 6)
        .alias("unique_ratio"),
        *[q[3 + i].alias(f"q_{float(v):g}") for i, v in enumerate(qs)],
    )


def _dagostino(n: Column, g1: Column, b2: Column) -> Column:
    """K-squared: normalised skewness and kurtosis, squared and added."""
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    delta = 1 / F.sqrt(F.log(w2) / 2)
    ratio = y / F.sqrt(2 / (w2 - 1))
    z1 = delta * F.log(ratio + F.sqrt(ratio * ratio + 1))
    mean = 3 * (n - 1) / (n + 1)
    var = 24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    x = (b2 - mean) / F.sqrt(var)
    root = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / root * (2 / root + F.sqrt(1 + 4 / (root * root)))
    inner = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    cube = F.signum(inner) * F.pow(F.abs(inner), 1 / 3)
    z2 = (1 - 2 / (9 * a) - cube) / F.sqrt(2 / (9 * a))
    return z1 * z1 + z2 * z2


# Anderson-Darling critical values for the normal case and their levels in percent.
AD_LEVELS = [15.0, 10.0, 5.0, 2.5, 1.0]
AD_CRITICAL = [0.576, 0.656, 0.787, 0.918, 1.092]


def analyze_normality(df: DataFrame, columns=None, alpha: float = 0.05) -> DataFrame:
    require(0 < alpha < 1, "INVALID_ALPHA")
    columns = _numeric(df, columns)
    m = moments(df, columns)
    stats = m.select(F.col("column").alias("mc"), "mean", F.sqrt("variance").alias("sd"))
    cum = cumulative_counts(df, columns).join(stats, F.col("column") == F.col("mc"))
    cum = attach_totals(cum, ["column"], few=True, __n=F.sum("count"))
    z = (F.col("value") - F.col("mean")) / F.col("sd")
    lo, hi, n = F.col("below").cast("double"), (F.col("below") + F.col("count")).cast("double"), F.col("__n")
    # Sum of (2i-1) over a run of equal values is a difference of squares, from either end.
    weight_low = hi * hi - lo * lo
    weight_high = (n - lo) * (n - lo) - (n - hi) * (n - hi)
    terms = cum.withColumns({"__cdf": P.normal_cdf(z), "__sf": P.normal_sf(z)}).withColumn(
        "__t", weight_low * F.log("__cdf") + weight_high * F.log("__sf"))
    ad = terms.groupBy("column").agg((-F.max("__n") - F.sum("__t") / F.max("__n")).alias("ad")).withColumnRenamed(
        "column", "ac")
    t = m.join(ad, F.col("column") == F.col("ac"), "left")
    n = F.col("count").cast("double")
    varies = F.col("var_pop") > 0
    jb = F.when(varies & (n >= 2), n / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4))
    k2 = F.when(varies & (n >= 8), _dagostino(n, F.col("g1"), F.col("g2") + 3))
    near = min(range(5), key=lambda i: abs(AD_LEVELS[i] - alpha * 100))
    crit = F.lit(AD_CRITICAL[near]) / (1 + 4 / n - 25 / (n * n))
    t = t.select(
        "column", F.col("count").alias("sample_size"), "null_count", (~varies).alias("constant"),
        k2.alias("dagostino_statistic"), P.chi2_sf(k2, 2).alias("dagostino_p_value"),
        jb.alias("jarque_bera_statistic"), P.chi2_sf(jb, 2).alias("jarque_bera_p_value"),
        F.when(varies & (n >= 3), F.col("ad")).alias("anderson_darling_statistic"),
        F.when(varies & (n >= 3), F.round(crit, 3)).alias("anderson_darling_critical_value"),
        F.lit(AD_LEVELS[near]).alias("anderson_darling_level_pct"),
    )
    reject = [F.col("dagostino_p_value") < alpha, F.col("jarque_bera_p_value") < alpha,
              F.col("anderson_darling_statistic") > F.col("anderson_darling_critical_value")]
    no = sum((F.coalesce(r, F.lit(False)).cast("int") for r in reject), F.lit(0))
    yes = sum((F.coalesce(~r, F.lit(False)).cast("int") for r in reject), F.lit(0))
    return t.withColumn("consensus", (
        F.when(no + yes == 0, "insufficient_evidence").when(no > yes, "evidence_against_normality")
        .when(yes > no, "no_strong_evidence_against_normality").otherwise("mixed_evidence")))


# ---------------------------------------------------------------- samples and group moments

def as_samples(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as samples: long (group, value) without nulls."""
    columns = _numeric(df, columns)
    items = F.array(*[F.struct(F.lit(c).alias("group"), _d(c).alias("value")) for c in columns])
    return df.select(F.inline(items)).filter("value is not null")


def grouped_samples(df: DataFrame, value_column: str, group_column: str) -> DataFrame:
    require_columns(df, [value_column, group_column])
    require(kind(df, value_column) == "numeric", "INCOMPATIBLE_COLUMN_TYPE")
    return df.select(F.col(group_column).cast("string").alias("group"), _d(value_column).alias("value")).dropna()


def group_moments(samples: DataFrame, keys=()) -> DataFrame:
    v = F.col("value")
    return samples.groupBy(*keys, "group").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.var_samp(v).alias("var"), F.min(v).alias("min"),
        F.max(v).alias("max"))


def _agg(df: DataFrame, keys, *aggs) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def anova_from(groups: DataFrame, keys=()) -> DataFrame:
    """F, eta squared and omega squared out of group sizes, means and variances."""
    keys = list(keys)
    n, m, v = F.col("n"), F.col("mean"), F.col("var")
    t = attach_totals(groups, keys, __gm=F.sum(n * m) / F.sum(n))
    t = _agg(t, keys, F.count(F.lit(1)).alias("k"), F.sum(n).alias("total_n"), F.max("__gm").alias("grand_mean"),
             F.sum(n * (m - F.col("__gm")) ** 2).alias("ss_between"),
             F.sum(F.when(n > 1, (n - 1) * v).otherwise(0.0)).alias("ss_within"))
    dfb, dfw = (F.col("k") - 1).cast("double"), (F.col("total_n") - F.col("k")).cast("double")
    ssb, ssw = F.col("ss_between"), F.col("ss_within")
    msw = F.try_divide(ssw, F.when(dfw > 0, dfw))
    f = F.try_divide(F.try_divide(ssb, dfb), msw)
    return t.select(
        *keys, "k", "total_n", "grand_mean", "ss_between", "ss_within", dfb.alias("df_between"),
        dfw.alias("df_within"), f.alias("f_statistic"), P.f_sf(f, dfb, dfw).alias("p_value"),
        F.try_divide(ssb, ssb + ssw).alias("eta_squared"),
        F.greatest(F.lit(0.0), F.try_divide(ssb - dfb * msw, ssb + ssw + msw)).alias("omega_squared"),
    )


def welch_anova_from(groups: DataFrame, keys=()) -> DataFrame:
    keys = list(keys)
    w = F.col("n") / F.when(F.col("var") > 0, F.col("var"))
    t = attach_totals(groups.withColumn("__w", w), keys, __ws=F.sum("__w"), __wm=F.sum(F.col("__w") * F.col("mean")),
                      __bad=F.count_if(F.col("__w").isNull()))
    center = F.col("__wm") / F.col("__ws")
    share = 1 - F.col("__w") / F.col("__ws")
    t = _agg(t, keys, F.count(F.lit(1)).cast("double").alias("k"), F.max("__bad").alias("bad"),
             F.sum(F.col("__w") * (F.col("mean") - center) ** 2).alias("num"),
             F.sum(share * share / (F.col("n") - 1)).alias("term"))
    k, term = F.col("k"), F.col("term")
    f = F.when(F.col("bad") == 0, F.col("num") / (k - 1) / (1 + 2 * (k - 2) / (k * k - 1) * term))
    df2 = F.when(F.col("bad") == 0, F.try_divide(k * k - 1, 3 * term))
    return t.select(*keys, f.alias("welch_f"), (k - 1).alias("welch_df1"), df2.alias("welch_df2"),
                    P.f_sf(f, k - 1, df2).alias("welch_p_value"))


def levene_from(samples: DataFrame, keys=()) -> DataFrame:
    """Brown-Forsythe: one-way ANOVA of distances from the group median."""
    keys = list(keys)
    ids = [*keys, "group"]
    mid = exact_quantiles(samples, ["value"], [0.5], ids).select(
        *[F.col(c).alias(f"__m{i}") for i, c in enumerate(ids)], F.col("value")[0].alias("__mid"))
    cond = F.lit(True)
    for i, c in enumerate(ids):
        cond = cond & samples[c].eqNullSafe(mid[f"__m{i}"])
    dist = samples.join(mid, cond).select(*[samples[c] for c in ids],
                                          F.abs(samples["value"] - mid["__mid"]).alias("value"))
    return anova_from(group_moments(dist, keys), keys).select(
        *keys, F.col("f_statistic").alias("levene_statistic"), F.col("p_value").alias("levene_p_value"))


def eta_label(eta: Column) -> Column:
    return P.magnitude(eta, 0.01, 0.06, 0.14)


def analyze_anova(df: DataFrame, value_column=None, group_column=None, sample_columns=None,
                  alpha: float = 0.05) -> DataFrame:
    s = as_samples(df, sample_columns) if sample_columns else grouped_samples(df, value_column, group_column)
    g = group_moments(s)
    out = anova_from(g)
    extra = [welch_anova_from(g), levene_from(s)]
    for e in extra:
        out = _beside(out, e)
    return out.withColumns({"reject_null": F.col("p_value") < alpha, "effect_magnitude": eta_label(F.col("eta_squared"))})


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """Put two one-row results next to each other as a scalar subquery."""
    box = other.select(F.struct("*").alias("__b")).scalar()
    names = other.columns
    return one.withColumn("__b", box).select(*one.columns, *[F.col("__b")[c].alias(c) for c in names])


# ---------------------------------------------------------------- intervals and effect sizes

def _wilson(successes: Column, n: Column, z: Column):
    p = successes / n
    denom = 1 + z * z / n
    center = (p + z * z / (2 * n)) / denom
    half = z / denom * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return p, F.greatest(F.lit(0.0), center - half), F.least(F.lit(1.0), center + half)


def _two_moments(df: DataFrame, a: str, b: str) -> DataFrame:
    x, y = _d(a), _d(b)
    return df.agg(
        F.count(x).cast("double").alias("n_a"), F.avg(x).alias("mean_a"), F.var_samp(x).alias("var_a"),
        F.count(y).cast("double").alias("n_b"), F.avg(y).alias("mean_b"), F.var_samp(y).alias("var_b"))


def _welch(t: DataFrame):
    ea, eb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    df = (ea + eb) ** 2 / (ea * ea / (F.col("n_a") - 1) + eb * eb / (F.col("n_b") - 1))
    return F.sqrt(ea + eb), df


def calculate_confidence_interval(df: DataFrame, interval_type: str, column=None, column_b=None,
                                  confidence_level: float = 0.95, population_std=None, success_value=True) -> DataFrame:
    require(0 < confidence_level < 1, "INVALID_CONFIDENCE_LEVEL")
    require_columns(df, [c for c in (column, column_b) if c])
    upper = F.lit(1 - (1 - confidence_level) / 2)
    z = P.normal_quantile(upper)

    def spread(t, est, se, df_col, *keep):
        crit = P.t_quantile(upper, df_col) if df_col is not None else z
        t = t.withColumns({"estimate": est, "standard_error": se})
        t = t.withColumn("critical_value", crit)
        deg = df_col if df_col is not None else F.lit(None).cast("double")
        e, w = F.col("estimate"), F.col("critical_value") * F.col("standard_error")
        return t.select(F.lit(interval_type).alias("interval_type"), "estimate", (e - w).alias("lower"),
                        (e + w).alias("upper"), "standard_error", "critical_value",
                        deg.alias("degrees_of_freedom"), *keep)

    if interval_type in ("mean_t", "mean_z", "paired_mean_difference"):
        v = _d(column) - _d(column_b) if interval_type == "paired_mean_difference" else _d(column)
        t = df.agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("m"), F.var_samp(v).alias("var"))
        if interval_type == "mean_z":
            require(population_std is not None and population_std > 0, "POPULATION_STD_REQUIRED")
            return spread(t, F.col("m"), F.lit(float(population_std)) / F.sqrt("n"), None, "n")
        return spread(t, F.col("m"), F.sqrt(F.col("var") / F.col("n")), F.col("n") - 1, "n")
    if interval_type == "difference_means_welch":
        t = _two_moments(df, column, column_b)
        se, deg = _welch(t)
        return spread(t, F.col("mean_a") - F.col("mean_b"), se, deg, "n_a", "n_b")
    if interval_type == "proportion":
        hit = F.col(column) == F.lit(success_value)
        t = df.agg(F.count(column).cast("double").alias("n"), F.count_if(hit).cast("double").alias("successes"))
        p, low, high = _wilson(F.col("successes"), F.col("n"), z)
        return t.select(F.lit(interval_type).alias("interval_type"), p.alias("estimate"), low.alias("lower"),
                        high.alias("upper"), "successes", "n")
    require(interval_type == "difference_proportions", "INVALID_INTERVAL_TYPE")
    t = df.agg(*[x for s, c in (("a", column), ("b", column_b)) for x in (
        F.count(c).cast("double").alias(f"n_{s}"),
        F.count_if(F.col(c) == F.lit(success_value)).cast("double").alias(f"s_{s}"))])
    p1, l1, u1 = _wilson(F.col("s_a"), F.col("n_a"), z)
    p2, l2, u2 = _wilson(F.col("s_b"), F.col("n_b"), z)
    est = p1 - p2
    return t.select(
        F.lit(interval_type).alias("interval_type"), est.alias("estimate"),
        F.greatest(F.lit(-1.0), est - F.sqrt((p1 - l1) ** 2 + (u2 - p2) ** 2)).alias("lower"),
        F.least(F.lit(1.0), est + F.sqrt((u1 - p1) ** 2 + (p2 - l2) ** 2)).alias("upper"),
        p1.alias("proportion_a"), p2.alias("proportion_b"), "n_a", "n_b")


def pooled_sd() -> Column:
    return F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b"))
                  / (F.col("n_a") + F.col("n_b") - 2))


def calculate_effect_size(df: DataFrame, effect_type: str, column: str, column_b: str,
                          success_value=True) -> DataFrame:
    require_columns(df, [column, column_b])
    head = F.lit(effect_type).alias("effect_type")
    if effect_type in ("cohens_d", "hedges_g", "glass_delta"):
        t = _two_moments(df, column, column_b)
        gap = F.col("mean_a") - F.col("mean_b")
        if effect_type == "glass_delta":
            value = F.try_divide(gap, F.sqrt("var_b"))
        else:
            value = F.try_divide(gap, pooled_sd())
            if effect_type == "hedges_g":
                value = value * (1 - 3 / (4 * (F.col("n_a") + F.col("n_b") - 2) - 1))
        return t.select(head, value.alias("value"), P.magnitude(value).alias("magnitude"),
                        F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"))
    if effect_type == "paired_dz":
        v = _d(column) - _d(column_b)
        t = df.agg(F.count(v).alias("n_a"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"))
        value = F.try_divide(F.col("m"), F.col("sd"))
        return t.select(head, value.alias("value"), P.magnitude(value).alias("magnitude"), "n_a",
                        F.col("n_a").alias("n_b"))
    if effect_type == "cohens_h":
        t = df.agg(*[x for s, c in (("a", column), ("b", column_b)) for x in (
            F.count(c).alias(f"n_{s}"), F.avg((F.col(c) == F.lit(success_value)).cast("double")).alias(f"p_{s}"))])
        value = 2 * F.asin(F.sqrt("p_a")) - 2 * F.asin(F.sqrt("p_b"))
        return t.select(head, value.alias("value"), P.magnitude(value).alias("magnitude"), "n_a", "n_b")
    require(effect_type == "cramers_v", "INVALID_EFFECT_TYPE")
    t = chi_square_test(df, column, column_b)
    return t.select(head, F.col("cramers_v").alias("value"),
                    P.magnitude(F.col("cramers_v"), 0.1, 0.3, 0.5).alias("magnitude"),
                    F.col("n").alias("n_a"), F.col("n").alias("n_b"))


# ---------------------------------------------------------------- t tests

def _alternative(alternative: str) -> None:
    require(alternative in ("two-sided", "less", "greater"), "INVALID_ALTERNATIVE")


def _t_result(t: DataFrame, diff: Column, se: Column, deg: Column, alternative: str, alpha: float,
              confidence: float, **extra) -> DataFrame:
    _alternative(alternative)
    t = t.withColumns({"mean_difference": diff, "standard_error": se, "degrees_of_freedom": deg.cast("double"), **extra})
    t = t.withColumn("t_statistic", F.try_divide(F.col("mean_difference"), F.col("standard_error")))
    tail = 1 - (1 - confidence) / 2 if alternative == "two-sided" else confidence
    t = t.withColumns({
        "p_value": P.t_p(F.col("t_statistic"), F.col("degrees_of_freedom"), alternative),
        "__crit": P.t_quantile(F.lit(tail), F.col("degrees_of_freedom")),
    })
    w = F.col("__crit") * F.col("standard_error")
    none = F.lit(None).cast("double")
    return t.withColumns({
        "reject_null": F.col("p_value") < alpha,
        "ci_lower": none if alternative == "less" else F.col("mean_difference") - w,
        "ci_upper": none if alternative == "greater" else F.col("mean_difference") + w,
    }).drop("__crit")


def one_sample_t_test(df: DataFrame, column: str, population_mean: float = 0.0, alternative: str = "two-sided",
                      alpha: float = 0.05, confidence_level: float = 0.95) -> DataFrame:
    _numeric(df, [column])
    v = _d(column)
    t = df.agg(F.count(v).cast("double").alias("n"), F.avg(v).alias("sample_mean"), F.stddev_samp(v).alias("sample_std"))
    diff = F.col("sample_mean") - F.lit(float(population_mean))
    out = _t_result(t, diff, F.col("sample_std") / F.sqrt("n"), F.col("n") - 1, alternative, alpha, confidence_level)
    d = F.try_divide(F.col("mean_difference"), F.col("sample_std"))
    return out.withColumns({"cohens_d": d, "effect_magnitude": P.magnitude(d)})


def independent_t_test(df: DataFrame, sample_mode: str = "columns", column_a=None, column_b=None, value_column=None,
                       group_column=None, group_a=None, group_b=None, equal_var: bool = False,
                       alternative: str = "two-sided", alpha: float = 0.05,
                       confidence_level: float = 0.95) -> DataFrame:
    require(sample_mode in ("columns", "grouped"), "INVALID_SAMPLE_MODE")
    if sample_mode == "columns":
        _numeric(df, [column_a, column_b])
        s, a, b = as_samples(df, [column_a, column_b]), column_a, column_b
    else:
        require(group_a != group_b, "GROUPS_MUST_DIFFER")
        a, b = str(group_a), str(group_b)
        s = grouped_samples(df, value_column, group_column).filter(F.col("group").isin(a, b))
    g = group_moments(s)

    def pick(name, side):
        return F.max(F.when(F.col("group") == side, F.col(name))).cast("double")

    t = g.agg(*[pick(x, y).alias(f"{x}_{z}") for y, z in ((a, "a"), (b, "b")) for x in ("n", "mean", "var")])
    psd = pooled_sd()
    if equal_var:
        deg = F.col("n_a") + F.col("n_b") - 2
        se = psd * F.sqrt(1 / F.col("n_a") + 1 / F.col("n_b"))
    else:
        se, deg = _welch(t)
    d = F.try_divide(F.col("mean_a") - F.col("mean_b"), psd)
    n = F.col("n_a") + F.col("n_b")
    out = _t_result(t, F.col("mean_a") - F.col("mean_b"), se, deg, alternative, alpha, confidence_level,
                    cohens_d=d, hedges_g=d * (1 - 3 / (4 * n - 9)), effect_magnitude=P.magnitude(d))
    return _beside(out, levene_from(s))


def paired_t_test(df: DataFrame, column_a: str, column_b: str, alternative: str = "two-sided", alpha: float = 0.05,
                  confidence_level: float = 0.95) -> DataFrame:
    require(column_a != column_b, "SAME_COLUMN")
    require_columns(df, [column_a, column_b])
    a, b = _d(column_a), _d(column_b)
    v = a - b
    t = df.agg(F.count(v).cast("double").alias("n"), F.avg(_both(a, b, a)).alias("mean_a"),
               F.avg(_both(a, b, b)).alias("mean_b"), F.avg(v).alias("m"), F.stddev_samp(v).alias("sd"))
    out = _t_result(t, F.col("m"), F.col("sd") / F.sqrt("n"), F.col("n") - 1, alternative, alpha, confidence_level)
    flat, m = F.col("standard_error") == 0, F.col("mean_difference")
    sided = {"two-sided": F.lit(0.0), "greater": F.when(m > 0, 0.0).otherwise(1.0),
             "less": F.when(m < 0, 0.0).otherwise(1.0)}[alternative]
    return out.withColumn("p_value", F.when(flat, F.when(m == 0, 1.0).otherwise(sided)).otherwise(F.col("p_value"))
                          ).withColumn("reject_null", F.col("p_value") < alpha).drop("m", "sd")


# ---------------------------------------------------------------- categorical tests

def chi_square_from(cells: DataFrame, keys=(), correction: bool = False) -> DataFrame:
    """Pearson's statistic over (keys, row_value, column_value, count).

    Cells that were never observed still add their expected count; summed over all cells
    that is n minus the expected counts of the observed ones, so no full grid is built.
    """
    keys = list(keys)
    t = attach_totals(cells, [*keys, "row_value"], __r=F.sum("count"))
    t = attach_totals(t, [*keys, "column_value"], __c=F.sum("count"))
    t = attach_totals(t, keys, __n=F.sum("count"), __rows=F.count_distinct("row_value"),
                      __cols=F.count_distinct("column_value"))
    e = F.col("__r") * F.col("__c") / F.col("__n")
    gap = F.abs(F.col("count") - e)
    yates = F.when((F.col("__rows") == 2) & (F.col("__cols") == 2), gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    term = (yates if correction else gap) ** 2 / e
    s = _agg(t, keys, F.max("__n").alias("n"), F.max("__rows").alias("rows"), F.max("__cols").alias("cols"),
             F.sum(term).alias("seen"), F.sum(e).alias("seen_e"), F.count(F.lit(1)).alias("cells"))
    rows, cols, n = F.col("rows"), F.col("cols"), F.col("n")
    absent = n - F.col("seen_e")
    if correction:
        # A 2x2 table has at most one empty cell per diagonal; its corrected term uses its own expected count.
        empty = rows * cols - F.col("cells")
        each = F.try_divide(absent, empty)
        fixed = F.coalesce(empty * (each - F.least(F.lit(0.5), each)) ** 2 / each, F.lit(0.0))
        absent = F.when((rows == 2) & (cols == 2), fixed).otherwise(absent)
    chi = F.greatest(F.lit(0.0), F.col("seen") + absent)
    deg = ((rows - 1) * (cols - 1)).cast("double")
    small = F.least(rows, cols)
    v = F.sqrt(F.try_divide(chi, n * F.greatest(small - 1, F.lit(1))))
    phi2 = F.greatest(F.lit(0.0), chi / n - (cols - 1) * (rows - 1) / (n - 1))
    rc = rows - (rows - 1) ** 2 / (n - 1)
    cc = cols - (cols - 1) ** 2 / (n - 1)
    return s.select(
        *keys, "n", rows.alias("row_levels"), cols.alias("column_levels"), chi.alias("statistic"),
        deg.alias("degrees_of_freedom"), P.chi2_sf(chi, deg).alias("p_value"), v.alias("cramers_v"),
        F.sqrt(F.coalesce(F.try_divide(phi2, F.least(rc, cc) - 1), F.lit(0.0))).alias("corrected_cramers_v"))


def chi_square_test(df: DataFrame, row_column: str, column_column: str, alpha: float = 0.05,
                    correction: bool = False) -> DataFrame:
    require(row_column != column_column, "SAME_COLUMN")
    cells = contingency_table(df, row_column, column_column).select("row_value", "column_value", "count")
    out = chi_square_from(cells, correction=correction)
    return out.withColumn("reject_null", F.col("p_value") < alpha)


def fisher_exact_test(df: DataFrame, row_column: str, column_column: str, alternative: str = "two-sided",
                      alpha: float = 0.05, confidence_level: float = 0.95) -> DataFrame:
    """2x2 only. The four counts come to the driver; the hypergeometric terms are summed by Spark."""
    _alternative(alternative)
    cells = contingency_table(df, row_column, column_column).limit(5).collect()
    rows = sorted({r["row_value"] for r in cells}, key=str)
    cols = sorted({r["column_value"] for r in cells}, key=str)
    require(len(rows) == 2 and len(cols) == 2, "REQUIRES_2X2",
            shape=[len(rows), len(cols)])
    found = {(r["row_value"], r["column_value"]): r["count"] for r in cells}
    a, b, c, d = (found.get((x, y), 0) for x in rows for y in cols)
    return fisher_from_counts(df.sparkSession, a, b, c, d, alternative, alpha, confidence_level)


def fisher_from_counts(spark, a: int, b: int, c: int, d: int, alternative: str = "two-sided", alpha: float = 0.05,
                       confidence_level: float = 0.95) -> DataFrame:
    r1, r2, c1, n = a + b, c + d, a + c, a + b + c + d
    low, high = max(0, c1 - r2), min(r1, c1)

    def log_choose(top, bottom):
        top, bottom = F.lit(float(top)), bottom.cast("double")
        return P.log_gamma(top + 1) - P.log_gamma(bottom + 1) - P.log_gamma(top - bottom + 1)

    k = F.col("id")
    terms = spark.range(low, high + 1).withColumn(
        "lp", log_choose(r1, k) + log_choose(r2, F.lit(c1) - k) - log_choose(n, F.lit(c1)))
    lg = math.lgamma
    here = sum(lg(t + 1) - lg(x + 1) - lg(t - x + 1) for t, x in ((r1, a), (r2, c1 - a))) - (
        lg(n + 1) - lg(c1 + 1) - lg(n - c1 + 1))
    keep = {"two-sided": F.col("lp") <= here + 1e-7, "greater": k >= a, "less": k <= a}[alternative]
    p = terms.agg(F.least(F.lit(1.0), F.sum(F.when(keep, F.exp("lp")))).alias("p_value"))
    corrected = 0 in (a, b, c, d)
    aa, bb, cc, dd = (x + 0.5 if corrected else float(x) for x in (a, b, c, d))
    log_or, se = math.log(aa * dd / (bb * cc)), math.sqrt(1 / aa + 1 / bb + 1 / cc + 1 / dd)
    z = P.normal_quantile(1 - (1 - confidence_level) / 2)
    risk1, risk2 = aa / (aa + bb), cc / (cc + dd)
    odds = float("inf") if b * c == 0 else a * d / (b * c)
    return p.select(
        F.lit(n).alias("n"), F.lit(odds).alias("odds_ratio"), "p_value", (F.col("p_value") < alpha).alias("reject_null"),
        F.exp(F.lit(log_or) - z * se).alias("odds_ratio_lower"), F.exp(F.lit(log_or) + z * se).alias("odds_ratio_upper"),
        F.lit(risk1).alias("risk_row_1"), F.lit(risk2).alias("risk_row_2"), F.lit(risk1 / risk2).alias("risk_ratio"),
        F.lit(risk1 - risk2).alias("risk_difference"), F.lit(corrected).alias("zero_cell_correction_used"))


# ---------------------------------------------------------------- rank tests

def ranked_counts(samples: DataFrame, keys=()) -> DataFrame:
    """(keys, group, value, count, rank, ties): mid-ranks over the pooled values."""
    keys = list(keys)
    return rank_counts(samples.groupBy(*keys, "group", "value").agg(F.count(F.lit(1)).alias("count")), keys)


def rank_counts(per_group: DataFrame, keys=()) -> DataFrame:
    keys = list(keys)
    pooled = with_below(per_group.groupBy(*keys, "value").agg(F.sum("count").alias("count")), keys)
    side = pooled.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*keys, "value"])],
                         (F.col("below") + (F.col("count") + 1) / 2).alias("rank"), F.col("count").alias("ties"))
    cond = F.lit(True)
    for i, c in enumerate([*keys, "value"]):
        cond = cond & per_group[c].eqNullSafe(side[f"__k{i}"])
    return per_group.join(side, cond).drop(*[f"__k{i}" for i in range(len(keys) + 1)])


def tie_sum() -> Column:
    """Sum of t^3 - t over distinct values, spread over the rows that share a value."""
    t = F.col("ties").cast("double")
    return F.sum(F.col("count") * (t * t - 1))


def mann_whitney(samples: DataFrame, a: str, b: str, alternative: str = "two-sided", alpha: float = 0.05) -> DataFrame:
    _alternative(alternative)
    r = ranked_counts(samples.filter(F.col("group").isin(a, b)))
    in_a = F.col("group") == a
    t = r.agg(
        F.sum(F.when(in_a, F.col("count"))).cast("double").alias("n_a"),
        F.sum(F.when(~in_a, F.col("count"))).cast("double").alias("n_b"),
        F.sum(F.when(in_a, F.col("count") * F.col("rank"))).alias("ra"), tie_sum().alias("ties"))
    return mann_whitney_from(t, alternative).withColumn("reject_null", F.col("p_value") < alpha)


def mann_whitney_from(t: DataFrame, alternative: str = "two-sided", keep=()) -> DataFrame:
    na, nb = F.col("n_a"), F.col("n_b")
    n = na + nb
    u = F.col("ra") - na * (na + 1) / 2
    mid = na * nb / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    gap = {"two-sided": F.greatest(u, na * nb - u) - mid, "greater": u - mid, "less": (na * nb - u) - mid}[alternative]
    z = F.try_divide(gap - 0.5, sd)
    p = P.normal_sf(z)
    p = F.least(F.lit(1.0), 2 * p) if alternative == "two-sided" else p
    return t.select(*keep, u.alias("statistic"), p.alias("p_value"), na.cast("long").alias("n_a"),
                    nb.cast("long").alias("n_b"), (1 - 2 * u / (na * nb)).alias("rank_biserial"))


def kruskal_from(samples: DataFrame, keys=(), counted: bool = False) -> DataFrame:
    """Samples, or with ``counted`` their value counts."""
    keys = list(keys)
    r = rank_counts(samples, keys) if counted else ranked_counts(samples, keys)
    g = r.groupBy(*keys, "group").agg(F.sum("count").cast("double").alias("n"),
                                      F.sum(F.col("count") * F.col("rank")).alias("rs"), tie_sum().alias("ties"))
    return kruskal_of_sums(g, keys)


def kruskal_of_sums(g: DataFrame, keys=()) -> DataFrame:
    """Out of (keys, group, n, rs, ties): rows, rank sums and tie terms of the groups."""
    keys = list(keys)
    t = _agg(g, keys, F.sum("n").alias("total_n"), F.count(F.lit(1)).cast("double").alias("k"),
             F.sum(F.col("rs") ** 2 / F.col("n")).alias("h"), F.sum("ties").alias("ties"))
    n, k = F.col("total_n"), F.col("k")
    raw = 12 / (n * (n + 1)) * F.col("h") - 3 * (n + 1)
    h = F.when(k > 1, F.try_divide(raw, 1 - F.try_divide(F.col("ties"), n * n * n - n)))
    return t.select(*keys, h.alias("statistic"), P.chi2_sf(h, k - 1).alias("p_value"), k.cast("long").alias("groups"),
                    n.cast("long").alias("total_n"),
                    F.greatest(F.lit(0.0), F.try_divide(h - k + 1, n - k)).alias("epsilon_squared"))


def analyze_non_parametric(df: DataFrame, test_type: str, column_a=None, column_b=None, value_column=None,
                           group_column=None, sample_columns=None, alternative: str = "two-sided",
                           alpha: float = 0.05, median0: float = 0.0) -> DataFrame:
    _alternative(alternative)
    if test_type == "mann_whitney_u":
        return mann_whitney(as_samples(df, [column_a, column_b]), column_a, column_b, alternative, alpha)
    if test_type == "kruskal_wallis":
        s = as_samples(df, sample_columns) if sample_columns else grouped_samples(df, value_column, group_column)
        out = kruskal_from(s)
    elif test_type == "wilcoxon_signed_rank":
        _numeric(df, [column_a, column_b])
        gap = _d(column_a) - _d(column_b)
        diffs = df.select(gap.alias("d")).filter("d is not null")
        nonzero = diffs.filter("d <> 0").select(F.when(F.col("d") > 0, "pos").otherwise("neg").alias("group"),
                                                F.abs("d").alias("value"))
        r = ranked_counts(nonzero)
        t = r.agg(
            F.coalesce(F.sum(F.when(F.col("group") == "pos", F.col("count") * F.col("rank"))), F.lit(0.0)).alias("wp"),
            F.coalesce(F.sum(F.when(F.col("group") == "neg", F.col("count") * F.col("rank"))), F.lit(0.0)).alias("wn"),
            F.coalesce(F.sum("count"), F.lit(0)).cast("double").alias("n"), F.coalesce(tie_sum(), F.lit(0.0)).alias("ties"))
        t = t.withColumn("n_pairs", diffs.agg(F.count(F.lit(1)).alias("x")).scalar())
        n, wp, wn = F.col("n"), F.col("wp"), F.col("wn")
        sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
        stat = F.least(wp, wn) if alternative == "two-sided" else wp
        p = P.z_p(F.try_divide(wp - n * (n + 1) / 4, sd), alternative)
        out = t.select(stat.alias("statistic"), F.coalesce(p, F.lit(1.0)).alias("p_value"), "n_pairs",
                       F.coalesce(F.try_divide(wp - wn, wp + wn), F.lit(0.0)).alias("rank_biserial"))
    elif test_type == "friedman":
        columns = _numeric(df, sample_columns, 3)
        k = len(columns)
        row = df.dropna(subset=columns)
        ranks, ties = [], F.lit(0.0)
        for c in columns:
            less = sum(((_d(o) < _d(c)).cast("double") for o in columns), F.lit(0.0))
            same = sum(((_d(o) == _d(c)).cast("double") for o in columns), F.lit(0.0))
            ranks.append(less + (same + 1) / 2)
            ties = ties + (same * same - 1)
        t = row.agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(ties).alias("ties"),
                    *[F.sum(r).alias(f"r{i}") for i, r in enumerate(ranks)])
        n = F.col("n")
        squares = sum((F.col(f"r{i}") ** 2 for i in range(k)), F.lit(0.0))
        c = 1 - F.col("ties") / (k * (k * k - 1) * n)
        chi = (12 / (k * n * (k + 1)) * squares - 3 * n * (k + 1)) / c
        out = t.select(chi.alias("statistic"), P.chi2_sf(chi, k - 1).alias("p_value"), n.cast("long").alias("n_blocks"),
                       F.lit(k).alias("k"), (chi / (n * (k - 1))).alias("kendalls_w"))
    else:
        require(test_type == "sign_test", "INVALID_TEST_TYPE")
        _numeric(df, [column_a])
        v = _d(column_a) - F.lit(float(median0))
        t = df.agg(F.count_if(v > 0).alias("positive"), F.count_if(v < 0).alias("negative"),
                   F.count_if(v == 0).alias("ties"))
        n = F.col("positive") + F.col("negative")
        out = t.select("positive", "negative", "ties", n.alias("n_effective"),
                       P.binomial_half_p(F.col("positive"), n, alternative).alias("p_value"),
                       F.try_divide((F.col("positive") - F.col("negative")).cast("double"), n).alias("sign_effect"))
    return out.withColumn("reject_null", F.col("p_value") < alpha)


# ---------------------------------------------------------------- experiments and power

def analyze_ab_test(df: DataFrame, variant_column: str, control_value, treatment_value, metric_type: str,
                    metric_column: str, success_value=True, alpha: float = 0.05, confidence_level: float = 0.95,
                    expected_treatment_share: float = 0.5, srm_alpha: float = 0.01, segments=()) -> DataFrame:
    """One row, or one per segment: uplift, test, interval, effect and sample-ratio check."""
    require_columns(df, [variant_column, metric_column, *segments])
    require(control_value != treatment_value, "SAME_VARIANT")
    require(metric_type in ("binary", "continuous"), "INVALID_METRIC_TYPE")
    require(0 < expected_treatment_share < 1, "INVALID_EXPECTED_ALLOCATION")
    used = df.filter(F.col(variant_column).isin(control_value, treatment_value) & F.col(metric_column).isNotNull())
    treated = F.col(variant_column) == F.lit(treatment_value)
    if metric_type == "binary":
        v = (F.col(metric_column) == F.lit(success_value)).cast("double")
    else:
        _numeric(df, [metric_column])
        v = _d(metric_column)

    def side(cond):
        return F.when(cond, v)

    t = _agg(used, list(segments), *[
        x for s, cond in (("a", ~treated), ("b", treated)) for x in (
            F.count(side(cond)).cast("double").alias(f"n_{s}"), F.avg(side(cond)).alias(f"mean_{s}"),
            F.var_samp(side(cond)).alias(f"var_{s}"), F.sum(side(cond)).alias(f"sum_{s}"))])
    na, nb, ma, mb = F.col("n_a"), F.col("n_b"), F.col("mean_a"), F.col("mean_b")
    diff = mb - ma
    z = P.normal_quantile(1 - (1 - confidence_level) / 2)
    if metric_type == "binary":
        pooled = (F.col("sum_a") + F.col("sum_b")) / (na + nb)
        stat = F.try_divide(diff, F.sqrt(pooled * (1 - pooled) * (1 / na + 1 / nb)))
        stat = F.coalesce(stat, F.when(diff == 0, 0.0))
        t = t.withColumns({"statistic": stat, "p_value": P.z_p(stat), "degrees_of_freedom": F.lit(None).cast("double")})
        half = z * F.sqrt(ma * (1 - ma) / na + mb * (1 - mb) / nb)
        effect = 2 * (F.asin(F.sqrt(mb)) - F.asin(F.sqrt(ma)))
    else:
        se, deg = _welch(t)
        t = t.withColumns({"__se": se, "degrees_of_freedom": deg})
        stat = F.coalesce(F.try_divide(diff, F.col("__se")), F.when(diff == 0, 0.0))
        t = t.withColumns({"statistic": stat, "p_value": P.t_two_sided(stat, F.col("degrees_of_freedom"))})
        half = P.t_quantile(F.lit(1 - (1 - confidence_level) / 2), F.col("degrees_of_freedom")) * F.col("__se")
        effect = F.try_divide(diff, pooled_sd())
    exp_b = (na + nb) * expected_treatment_share
    exp_a = na + nb - exp_b
    chi = (na - exp_a) ** 2 / exp_a + (nb - exp_b) ** 2 / exp_b
    return t.withColumns({"__half": half, "effect_size": effect, "srm_chi_square": chi,
                          "srm_p_value": P.chi2_sf(chi, 1)}).select(
        *segments, na.cast("long").alias("control_n"), nb.cast("long").alias("treatment_n"),
        ma.alias("control_mean"), mb.alias("treatment_mean"), diff.alias("absolute_uplift"),
        F.try_divide(diff, ma).alias("relative_uplift"), "statistic", "degrees_of_freedom", "p_value",
        (F.col("p_value") < alpha).alias("reject_null"), (diff - F.col("__half")).alias("ci_lower"),
        (diff + F.col("__half")).alias("ci_upper"), "effect_size", P.magnitude(F.col("effect_size"))
        .alias("effect_magnitude"), "srm_chi_square", "srm_p_value",
        (F.col("srm_p_value") < srm_alpha).alias("srm_detected"))


DESIGNS = {"one_sample_mean", "paired_means", "one_proportion", "two_independent_means", "two_proportions",
           "correlation", "one_way_anova"}


def power_columns(design: str, effect: Column, n: Column, n2: Column | None = None, alpha: float = 0.05,
                  power: float = 0.8, alternative: str = "two-sided", allocation_ratio: float = 1.0,
                  groups: int = 3) -> dict[str, Column]:
    """achieved_power for the observed sizes and required_n for the wanted power, per row."""
    require(design in DESIGNS, "INVALID_DESIGN", design=design)
    require(0 < alpha < 1 and 0 < power < 1, "INVALID_ALPHA")
    require(alternative in ("two-sided", "one-sided"), "INVALID_ALTERNATIVE")
    za = P.normal_quantile(1 - alpha / (2 if alternative == "two-sided" else 1))
    zb = P.normal_quantile(power)
    size = F.abs(effect)
    if design == "correlation":
        size = F.log((1 + size) / (1 - size)) / 2
    base = F.try_divide(za + zb, size)
    one_sided = alternative == "one-sided"
    if design in ("two_independent_means", "two_proportions"):
        info = n * n2 / (n + n2)
        need = F.greatest(F.lit(2.0), F.ceil(base * base * (1 + 1 / allocation_ratio)).cast("double"))
        total = need + F.greatest(F.lit(2.0), F.ceil(need * allocation_ratio).cast("double"))
    elif design == "correlation":
        info, need = n - 3, F.greatest(F.lit(4.0), F.ceil(3 + base * base).cast("double"))
        total = need
    elif design == "one_way_anova":
        info, one_sided = n - groups, True
        za_power = P.normal_quantile(1 - alpha)
        need = F.ceil(F.greatest(F.lit(2.0 * groups), F.ceil(base * base + groups).cast("double")) / groups)
        need, total = need.cast("double"), need.cast("double") * groups
    else:
        info, need = n, F.greatest(F.lit(2.0), F.ceil(base * base).cast("double"))
        total = need
    za_here = za_power if design == "one_way_anova" else za
    delta = size * F.sqrt(info)
    achieved = P.normal_sf(za_here - delta)
    if not one_sided:
        achieved = achieved + P.normal_cdf(-za_here - delta)
    return {"achieved_power": achieved, "required_n": need.cast("long"), "required_total_n": total.cast("long")}


def segment_power(df: DataFrame, segments, variant_column: str, control_value, treatment_value, metric_column: str,
                  metric_type: str = "continuous", **options) -> DataFrame:
    """Achieved power and required sizes for every segment of an experiment."""
    ab = analyze_ab_test(df, variant_column, control_value, treatment_value, metric_type, metric_column,
                         segments=segments)
    design = "two_proportions" if metric_type == "binary" else "two_independent_means"
    cols = power_columns(design, F.col("effect_size"), F.col("control_n").cast("double"),
                         F.col("treatment_n").cast("double"), **options)
    return ab.select(*segments, "control_n", "treatment_n", "effect_size").withColumns(cols)


# ---------------------------------------------------------------- report

# Sections of the report and bounds of its findings.
SECTIONS = ["descriptive", "percentiles", "correlation", "covariance", "distribution", "normality"]
MISSING_PCT, VARIABILITY, STRONG_R, STRONG_PAIRS = 20, 1, 0.7, 5


def generate_statistics_report(df: DataFrame, columns=None, alpha: float = 0.05, sections=None) -> dict[str, DataFrame]:
    """The sections asked for plus findings drawn from them and warnings (section, code, message)
    of those that could not be made. Sections stay lazy over value counts that they share."""
    columns = _numeric(df, columns)
    wanted = list(SECTIONS if sections is None else sections)
    require(set(wanted) <= set(SECTIONS), "INVALID_SECTION", sections=sorted(set(wanted) - set(SECTIONS)))
    if {"descriptive", "distribution", "normality"} & set(wanted):
        df = counted_once(df, columns)
    makers = {
        "descriptive": lambda: analyze_descriptive_statistics(df, columns),
        "percentiles": lambda: analyze_percentiles(df, columns),
        "correlation": lambda: analyze_correlations(df, columns),
        "covariance": lambda: analyze_covariance(df, columns),
        "distribution": lambda: analyze_distributions(df, columns),
        "normality": lambda: analyze_normality(df, columns, alpha),
    }
    out, warnings = {}, []
    for name in wanted:
        try:
            require(len(columns) >= 2 or name not in ("correlation", "covariance"), "INSUFFICIENT_COLUMNS")
            out[name] = makers[name]()
        except EngineError as exc:
            warnings.append((name, exc.code, exc.message))
    out["findings"] = statistics_findings(out)
    out["warnings"] = df.sparkSession.createDataFrame(warnings, "section string, code string, message string")
    return out


def statistics_findings(report: dict[str, DataFrame]) -> DataFrame:
    """(severity, code, columns, value) of the sections that the report has."""
    frames = []

    def add(section: str, code: str, found, value: Column, severity: str = "info") -> None:
        if section in report:
            rows = found(report[section])
            names = F.concat_ws(" / ", "column_a", "column_b") if "column_a" in rows.columns else F.col("column")
            frames.append(rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), names.alias("columns"),
                                      value.cast("double").alias("value")))

    add("descriptive", "HIGH_MISSINGNESS", lambda t: t.filter(F.col("null_rate_pct") >= MISSING_PCT), F.col("null_rate_pct"), "warning")
    cv = F.col("coefficient_of_variation")
    add("descriptive", "HIGH_RELATIVE_VARIABILITY", lambda t: t.filter(F.abs(cv) >= VARIABILITY), cv)
    add("distribution", "IQR_OUTLIERS", lambda t: t.filter("iqr_outlier_count > 0"), F.col("iqr_outlier_count"))
    add("distribution", "SKEWED_DISTRIBUTION",
        lambda t: t.filter(F.col("shape").isNotNull() & ~F.col("shape").isin("unknown", "approximately_symmetric")), F.col("skewness"))
    add("correlation", "STRONG_CORRELATION",
        lambda t: strongest_pairs(t, STRONG_PAIRS).filter(F.col("absolute_correlation") >= STRONG_R), F.col("correlation"))
    add("normality", "NON_NORMAL_EVIDENCE", lambda t: t.filter(F.col("consensus") == "evidence_against_normality"),
        F.col("jarque_bera_p_value"))
    if not frames:
        raise EngineError("NO_SECTIONS")
    return reduce(lambda a, b: a.unionByName(b), frames)
