"""Exploratory analysis: profiles, relationships, explorers, group comparison, findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require, require_columns
from quarrylens.functions import tails as P
from quarrylens.ids import data_columns, kind, numeric_columns
from quarrylens.operators import pairwise
from quarrylens.operators import stats as S
from quarrylens.operators.cells import group_moments, pair_cells, rank_sums
from quarrylens.operators.cleaning import duplicate_metrics
from quarrylens.operators.ordered import Key, Ordered, attach_totals
from quarrylens.operators.quantiles import counted_once, cumulative_counts, quantiles_of_counts, value_counts, with_below
from quarrylens.session import cut_lineage


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def _flags(*pairs) -> Column:
    return F.concat_ws(",", *[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in pairs])


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if kind(df, c) != "numeric"]


# ---------------------------------------------------------------- one column

def analyze_numeric_eda(df: DataFrame, columns=None, high_missing_threshold: float = 0.2,
                        high_skew_threshold: float = 1.0) -> DataFrame:
    t = S.analyze_distributions(df, columns, [0.5]).drop("q_0.5")
    rows = F.col("count") + F.col("null_count")
    missing = F.coalesce(F.try_divide(F.col("null_count").cast("double"), rows), F.lit(0.0))
    cv = F.when(F.col("mean") != 0, F.col("std_dev") / F.col("mean"))
    rate = F.coalesce(F.try_divide(F.col("iqr_outlier_count").cast("double"), F.col("count")), F.lit(0.0))
    unique = F.coalesce(F.try_divide(F.col("unique_count").cast("double"), F.col("count")), F.lit(0.0))
    return t.withColumns({
        "missing_rate": missing, "coefficient_of_variation": cv, "iqr_outlier_rate": rate, "unique_ratio": unique,
        "flags": _flags(
            ("constant_or_empty", F.col("unique_count") <= 1), ("high_missingness", missing >= high_missing_threshold),
            ("high_skew", F.abs("skewness") >= high_skew_threshold), ("high_relative_variability", F.abs(cv) >= 1),
            ("id_like_high_uniqueness", (F.col("count") >= 20) & (unique >= 0.98)),
            ("iqr_outliers", F.col("iqr_outlier_count") > 0)),
    })


def eda_categories(df: DataFrame, include_numeric_low_cardinality: bool = True, numeric_cardinality_limit: int = 20):
    """Non-numeric columns plus numeric ones with few values."""
    columns = categorical_columns(df)
    numbers = numeric_columns(df)
    if include_numeric_low_cardinality and numbers:
        few = value_counts(df, numbers).groupBy("column").agg(F.count(F.lit(1)).alias("n")).filter(
            F.col("n") <= numeric_cardinality_limit).select("column").collect()
        columns = [c for c in data_columns(df) if c in columns or c in {r["column"] for r in few}]
    return columns


def analyze_categorical_eda(df: DataFrame, columns=None, rare_threshold: float = 0.01,
                            high_cardinality_threshold: int = 50) -> DataFrame:
    columns = require_columns(df, columns) if columns else eda_categories(df)
    require(bool(columns), "NO_CATEGORICAL_COLUMNS")
    counts = attach_totals(value_counts(df, columns, as_type="string"), ["column"], few=True, __n=F.sum("count"))
    share = F.col("count") / F.col("__n")
    top = F.struct(F.col("count"), F.col("value"))
    t = counts.groupBy("column").agg(
        F.max("__n").alias("count"), F.count(F.lit(1)).alias("unique_count"),
        F.max(F.col("count")).alias("mode_count"),
        F.min_by("value", F.struct((-F.col("count")).alias("c"), F.col("value"))).alias("mode"),
        (-F.sum(share * F.log2(share))).alias("entropy"),
        F.count_if(share < rare_threshold).alias("rare_value_count"))
    rows = df.agg(F.count(F.lit(1)).alias("r")).scalar()
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("name"))
    t = names.join(t, F.col("name") == F.col("column"), "left").withColumn("rows", rows)
    n, u = F.coalesce("count", F.lit(0)), F.coalesce("unique_count", F.lit(0))
    missing = F.coalesce(F.try_divide((F.col("rows") - n).cast("double"), F.col("rows")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(u.cast("double"), n), F.lit(0.0))
    mode_share = F.coalesce(F.try_divide(F.col("mode_count").cast("double"), n), F.lit(0.0))
    entropy = F.when(u > 1, F.col("entropy") / F.log2(u.cast("double"))).otherwise(0.0)
    rare = F.coalesce("rare_value_count", F.lit(0))
    return t.select(
        F.col("name").alias("column"), n.alias("count"), (F.col("rows") - n).alias("missing_count"),
        missing.alias("missing_rate"), u.alias("unique_count"), ratio.alias("cardinality_ratio"), "mode",
        mode_share.alias("mode_share"), entropy.alias("normalized_entropy"), (1 - entropy).alias("concentration"),
        rare.alias("rare_value_count"),
        _flags(("constant_or_empty", u <= 1), ("binary", u == 2), ("high_cardinality", u >= high_cardinality_threshold),
               ("id_like_high_uniqueness", (n >= 20) & (ratio >= 0.98)),
               ("high_imbalance", (mode_share >= 0.9) & (u > 1)), ("high_missingness", missing >= 0.2),
               ("rare_categories", rare > 0)).alias("flags"))


def top_values(df: DataFrame, columns=None, top_n: int = 10) -> DataFrame:
    """Most frequent values per column with shares; ranked on value counts, not on rows."""
    columns = require_columns(df, columns) if columns else categorical_columns(df)
    counts = attach_totals(value_counts(df, columns, as_type="string"), ["column"], few=True, __n=F.sum("count"))
    ranked = Ordered(counts, ["column"], [Key("count", ascending=False), Key("value")]).number("rank").df
    return ranked.filter(F.col("rank") <= top_n).select(
        "column", "rank", "value", "count", (F.col("count") / F.col("__n")).alias("share"))


# ---------------------------------------------------------------- two columns

_PAIR = ["column_a", "column_b"]


def analyze_categorical_relationships(df: DataFrame, columns=None, correction: bool = False) -> DataFrame:
    """Chi-square, both Cramer V forms and expected-count diagnostics for every pair."""
    columns = require_columns(df, columns) if columns else categorical_columns(df)
    require(len(columns) >= 2, "INSUFFICIENT_COLUMNS")
    cells = cut_lineage(pair_cells(df, S._pairs(columns)))
    t = S.chi_square_from(cells, _PAIR, correction)
    rows = cells.groupBy(*_PAIR, "row_value").agg(F.sum("count").alias("r"))
    cols = cells.groupBy(*_PAIR, "column_value").agg(F.sum("count").alias("c"))
    low = rows.groupBy(*_PAIR).agg(F.min("r").alias("mr")).join(
        cols.groupBy(*_PAIR).agg(F.min("c").alias("mc")), _PAIR)
    out = t.join(low, _PAIR).withColumn("minimum_expected_count", F.col("mr") * F.col("mc") / F.col("n"))
    ok = (F.col("row_levels") >= 2) & (F.col("column_levels") >= 2)
    return out.drop("mr", "mc").withColumn("status", F.when(ok, "ok").otherwise("insufficient_levels"))


def strength_label(r: Column) -> Column:
    """Bounds of the strength words."""
    a = F.abs(r)
    return (F.when(r.isNull(), None).when(a < 0.1, "negligible").when(a < 0.3, "weak").when(a < 0.5, "moderate")
            .when(a < 0.7, "strong").otherwise("very_strong"))


def analyze_numeric_relationships(df: DataFrame, columns=None, min_observations: int = 3,
                                  rank_methods: bool = True) -> DataFrame:
    """Pearson with p, regression line, covariance and, on request, both rank correlations."""
    pairs = S._pairs(S._numeric(df, columns, 2))

    def build(a, b):
        x, y = S._both(a, b, a), S._both(a, b, b)
        flat = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y))
        return [
            F.count(x).alias("n"), F.when(~flat, F.corr(a, b)).alias("pearson"), F.covar_samp(a, b).alias("covariance"),
            F.when(~flat, F.regr_slope(b, a)).alias("slope"), F.when(~flat, F.regr_intercept(b, a)).alias("intercept"),
            F.regr_sxx(b, a).alias("sxx"), F.regr_syy(b, a).alias("syy")]

    t = S._pair_aggregate(df, pairs, build)
    n, r = F.col("n").cast("double"), F.col("pearson")
    t = t.withColumn("t_value", r * F.sqrt((n - 2) / F.when(r * r < 1, 1 - r * r)))
    p = F.when(F.abs(r) >= 1, 0.0).otherwise(P.t_two_sided(F.col("t_value"), F.when(n > 2, n - 2)))
    se = F.sqrt((1 - r * r) * F.col("syy") / F.col("sxx") / F.when(n > 2, n - 2))
    t = t.select(
        *_PAIR, "n", "pearson", p.alias("pearson_p_value"), "covariance", "slope", "intercept",
        (r * r).alias("r_squared"), se.alias("slope_std_error"), strength_label(r).alias("strength"),
        F.when(F.col("n") < min_observations, "insufficient_observations")
        .when(r.isNull(), "constant_column").otherwise("ok").alias("status"))
    if rank_methods:
        sp = S.spearman_pairs(df, pairs).select(*_PAIR, F.col("correlation").alias("spearman"))
        kd = S.kendall_pairs(df, pairs).select(*_PAIR, F.col("correlation").alias("kendall"),
                                               F.col("p_value").alias("kendall_p_value"))
        t = t.join(sp, _PAIR, "left").join(kd, _PAIR, "left").withColumn(
            "pearson_spearman_gap", F.abs(F.col("pearson") - F.col("spearman")))
    return t


_NC = ["numeric", "categorical"]


def level_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Distinct values per column; small result that decides which pairs are formed."""
    rows = value_counts(df, columns, as_type="string").groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()
    found = {r["column"]: r["n"] for r in rows}
    return {c: found.get(c, 0) for c in columns}


def _eligible(long: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Group moments of large enough groups, and the value counts of those groups."""
    counts = long.groupBy(*_NC, "group", "value").agg(F.count(F.lit(1)).alias("count"))
    g = S.group_moments(long, _NC).filter(F.col("n") >= least)
    keep = g.select(*[F.col(c).alias(f"__{c}") for c in (*_NC, "group")])
    cond = reduce(lambda a, b: a & b, [counts[c] == keep[f"__{c}"] for c in (*_NC, "group")])
    return g, counts.join(keep, cond, "left_semi")


def analyze_numeric_categorical_relationships(df: DataFrame, numeric_columns_=None, categorical_columns_=None,
                                              max_groups: int | None = None, min_group_size: int = 2) -> DataFrame:
    numbers = S._numeric(df, numeric_columns_)
    cats = require_columns(df, categorical_columns_) if categorical_columns_ else categorical_columns(df)
    require(bool(cats), "NO_CATEGORICAL_COLUMNS")
    levels = level_counts(df, cats)
    usable = [c for c in cats if 2 <= levels[c] and (max_groups is None or levels[c] <= max_groups)]
    status = df.sparkSession.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("numeric"), F.lit(c).alias("categorical"), F.lit(levels[c]).alias("level_count"),
                 F.lit("insufficient_groups" if levels[c] < 2 else "too_many_groups" if c not in usable
                       else "ok").alias("status")) for n in numbers for c in cats])))
    if not usable:
        return status
    moments = cut_lineage(group_moments(df, numbers, usable))
    g = moments.filter(F.col("n") >= min_group_size)
    sums = rank_sums(df, numbers, usable, moments, min_group_size)
    a = S.anova_from(g, _NC).select(*_NC, F.col("total_n").alias("observations"), F.col("k").alias("group_count"),
                                    "grand_mean", "f_statistic", F.col("p_value").alias("anova_p_value"), "eta_squared")
    k = S.kruskal_of_sums(sums, _NC).select(*_NC, F.col("statistic").alias("kruskal_h"),
                                            F.col("p_value").alias("kruskal_p_value"))
    ends = g.groupBy(*_NC).agg(
        F.max_by("group", F.struct("mean", "group")).alias("highest_mean_group"),
        F.min_by("group", F.struct("mean", "group")).alias("lowest_mean_group"),
        (F.max("mean") - F.min("mean")).alias("mean_spread"))
    out = status.join(a, _NC, "left").join(k, _NC, "left").join(ends, _NC, "left")
    few = (F.col("status") == "ok") & (F.coalesce(F.col("group_count"), F.lit(0)) < 2)
    return out.withColumn("status", F.when(few, "insufficient_eligible_groups").otherwise(F.col("status")))


# ---------------------------------------------------------------- explorers

def explore_correlations(df: DataFrame, columns=None, methods=("pearson", "spearman", "kendall"), target_column=None,
                         absolute_threshold: float = 0.0, redundancy_threshold: float = 0.9) -> DataFrame:
    """Long (method, pair, correlation) with target and redundancy marks."""
    columns = S._numeric(df, columns, 2)
    require(target_column is None or target_column in columns, "INVALID_TARGET")
    frames = [S.analyze_correlations(df, columns, m, 3).withColumn("method", F.lit(m)) for m in methods]
    t = reduce(lambda a, b: a.unionByName(b), frames)
    size = F.col("absolute_correlation")
    is_target = F.lit(False) if target_column is None else F.array_contains(F.array("column_a", "column_b"), target_column)
    return t.filter(size.isNull() | (size >= absolute_threshold)).withColumns({
        "involves_target": is_target, "redundancy_candidate": F.coalesce(size >= redundancy_threshold, F.lit(False))})


def explore_distributions(df: DataFrame, columns=None) -> DataFrame:
    columns = S._numeric(df, columns)
    base = S.analyze_distributions(df, columns, [0.01, 0.05, 0.1, 0.9, 0.95, 0.99])
    cum = cumulative_counts(df, columns)
    mid = base.select(F.col("column").alias("mc"), F.col("median").alias("mid"), F.col("count").alias("n"))
    near = cum.join(F.broadcast(mid), F.col("column") == F.col("mc"))
    away = near.groupBy("column", F.abs(F.col("value") - F.col("mid")).alias("value")).agg(F.sum("count").alias("count"))
    mad = quantiles_of_counts(with_below(away, ["column"]), ["column"], [0.5]).select(
        F.col("column").alias("dc"), F.col("q")[0].alias("mad"))
    # How many of a value's copies fall among the largest tenth of all rows.
    take = F.greatest(F.lit(1), F.ceil(F.col("n") * 0.1))
    inside = F.greatest(F.lit(0), F.least(F.col("count"), F.col("below") + F.col("count") - (F.col("n") - take)))
    total = F.sum(F.col("value") * F.col("count"))
    share = near.groupBy("column").agg(F.when(
        (total > 0) & (F.min("value") >= 0), F.sum(F.col("value") * inside) / total).alias("top_10_percent_value_share"))
    share = share.withColumnRenamed("column", "sc")
    logs = df.agg(F.array(*[F.struct(
        F.lit(c).alias("lc"),
        F.when(F.min(_d(c)) > 0, S.adjusted_skew(F.skewness(F.when(_d(c) > 0, F.log(F.when(_d(c) > 0, _d(c))))),
                                                 F.count(c).cast("double"))).alias("log_skewness"))
        for c in columns]).alias("a")).select(F.inline("a"))
    norm = S.moments(df, columns).select(
        F.col("column").alias("jc"),
        F.when((F.col("count") >= 8) & (F.col("var_pop") > 0),
               F.col("count") / 6 * (F.col("g1") ** 2 + F.col("g2") ** 2 / 4)).alias("jarque_bera_statistic"))
    t = base.join(mad, F.col("column") == F.col("dc"), "left").join(share, F.col("column") == F.col("sc"), "left")
    t = t.join(logs, F.col("column") == F.col("lc"), "left").join(norm, F.col("column") == F.col("jc"), "left")
    sigma = 1.4826 * F.col("mad")
    return t.drop("dc", "sc", "lc", "jc").withColumns({
        "robust_sigma": sigma, "robust_to_classical_scale_ratio": F.try_divide(sigma, F.col("std_dev")),
        "jarque_bera_p_value": P.chi2_sf(F.col("jarque_bera_statistic"), 2),
        "log_transform_recommended": F.coalesce(F.abs("log_skewness") + 0.2 < F.abs("skewness"), F.lit(False)),
    })


def ecdf_points(df: DataFrame, columns=None, points: int = 100) -> DataFrame:
    """(column, x, p) at evenly spaced ranks. Each value finds the point numbers that fall
    into its own run of ranks, so no rank is looked up by a range join."""
    require(5 <= points <= 1000, "INVALID_ECDF_POINTS")
    cum = attach_totals(cumulative_counts(df, S._numeric(df, columns)), ["column"], few=True, __n=F.sum("count"))
    n = F.col("__n")
    m = F.least(F.lit(points), n)
    step = (n - 1) / F.greatest(m - 1, F.lit(1))
    numbers = F.filter(
        F.sequence(F.floor(F.coalesce(F.try_divide(F.col("below").cast("double"), step), F.lit(0.0))),
                   F.least(m - 1, F.ceil(F.coalesce(
                       F.try_divide((F.col("below") + F.col("count")).cast("double"), step), F.lit(0.0))))),
        lambda j: (F.floor(j * step) >= F.col("below")) & (F.floor(j * step) < F.col("below") + F.col("count")))
    hit = F.when(F.floor(F.coalesce(F.try_divide(F.col("below").cast("double"), step), F.lit(0.0))) <= m - 1, numbers)
    return cum.withColumn("j", F.explode(hit)).select(
        "column", F.col("j").alias("point"), F.col("value").alias("x"), ((F.floor(F.col("j") * step) + 1) / n).alias("p"))


# ---------------------------------------------------------------- groups

def group_summaries(df: DataFrame, value_column: str, group_column: str, min_group_size: int = 2) -> DataFrame:
    s = S.grouped_samples(df, value_column, group_column)
    g = S.group_moments(s).filter(F.col("n") >= min_group_size)
    mid = quantiles_of_counts(with_below(s.groupBy("group", "value").agg(F.count(F.lit(1)).alias("count")), ["group"]),
                              ["group"], [0.5]).select(F.col("group").alias("mg"), F.col("q")[0].alias("median"))
    return g.join(mid, F.col("group") == F.col("mg")).select(
        "group", "n", "mean", "median", F.sqrt("var").alias("std_dev"), "min", "max")


def pairwise_comparisons(df: DataFrame, value_column: str, group_column: str, alpha: float = 0.05,
                         min_group_size: int = 2, max_groups: int | None = None) -> DataFrame:
    """Welch, Mann-Whitney and Hedges g for every pair of groups, with Holm adjustment.

    Pairs are formed between groups, never between rows, and only on Spark; see ``pairwise``.
    """
    s = S.grouped_samples(df, value_column, group_column)
    cells = cut_lineage(s.groupBy("group", "value").agg(F.count(F.lit(1)).alias("count")))
    g = cut_lineage(pairwise.numbered(S.group_moments(s).filter(F.col("n") >= min_group_size)))
    groups = g.count()
    require(max_groups is None or groups <= max_groups, "TOO_MANY_GROUPS", groups=groups)
    require(groups >= 2, "INSUFFICIENT_ELIGIBLE_GROUPS")
    ids = g.select(F.col("group").alias("__g"), "gid")
    counted = cells.join(ids, F.col("group") == F.col("__g")).select("value", "gid", "count")
    cube = F.col("count").cast("double")
    own = counted.groupBy(F.col("gid").alias("tid")).agg(F.sum(cube * cube * cube - cube).alias("ties"))
    g = g.join(own, F.col("gid") == F.col("tid"))

    def side(name: str) -> DataFrame:
        return g.select(F.col("gid").alias(name), F.col("group").alias(f"group_{name}"), F.col("n").cast("double").alias(f"n_{name}"),
                        F.col("mean").alias(f"mean_{name}"), F.col("var").alias(f"var_{name}"), F.col("ties").alias(f"ties_{name}"))

    t = pairwise.pair_sums(counted, groups).join(side("a"), "a").join(side("b"), "b")
    se, deg = S._welch(t)
    diff = F.col("mean_b") - F.col("mean_a")
    hedges = F.try_divide(diff, S.pooled_sd()) * (1 - 3 / (4 * (F.col("n_a") + F.col("n_b") - 2) - 1))
    t = t.withColumns({
        "__t": F.try_divide(diff, se), "__df": deg, "mean_difference_b_minus_a": diff, "hedges_g": hedges,
        "ra": F.col("u") + F.col("n_a") * (F.col("n_a") + 1) / 2, "ties": F.col("ties_a") + F.col("ties_b") + F.col("x")})
    t = t.withColumn("welch_p_value", P.t_two_sided(F.col("__t"), F.col("__df")))
    keep = ["group_a", "group_b", "mean_a", "mean_b", "mean_difference_b_minus_a", "welch_p_value", "hedges_g"]
    t = S.mann_whitney_from(t, keep=keep).select(
        *keep, F.col("statistic").alias("mann_whitney_u"), F.col("p_value").alias("mann_whitney_p_value"))
    out = holm_adjust(t, "welch_p_value", groups * (groups - 1) // 2, ["group_a", "group_b"])
    return out.withColumn("significant_after_holm", F.col("holm_p_value") < alpha)


def holm_adjust(t: DataFrame, p: str, m: int, order: list[str]) -> DataFrame:
    """Step-down adjustment: running maximum of (m - rank + 1) p in order of p."""
    o = Ordered(t, [], [Key(p), *[Key(c) for c in order]], tiebreak=False).number("__rank")
    o.running(holm_p_value=("max", F.least(F.lit(1.0), (m - F.col("__rank") + 1) * F.col(p))))
    return o.df.drop("__rank")


def analyze_group_comparison(df: DataFrame, value_column: str, group_column: str, alpha: float = 0.05,
                             min_group_size: int = 2) -> DataFrame:
    """One row: ANOVA, Kruskal-Wallis, eta squared, best and worst group."""
    long = S.grouped_samples(df, value_column, group_column).select(
        F.lit(value_column).alias("numeric"), F.lit(group_column).alias("categorical"), "group", "value")
    g, counts = _eligible(long, min_group_size)
    a = S.anova_from(g, _NC).select(*_NC, F.col("k").alias("groups"), "total_n", "f_statistic",
                                    F.col("p_value").alias("anova_p_value"), "eta_squared")
    k = S.kruskal_from(counts, _NC, counted=True).select(*_NC, F.col("statistic").alias("kruskal_h"),
                                                         F.col("p_value").alias("kruskal_p_value"))
    ends = g.groupBy(*_NC).agg(F.max_by("group", F.struct("mean", "group")).alias("best_group"),
                               F.min_by("group", F.struct("mean", "group")).alias("worst_group"))
    return a.join(k, _NC).join(ends, _NC).withColumns({
        "anova_reject_null": F.col("anova_p_value") < alpha, "kruskal_reject_null": F.col("kruskal_p_value") < alpha})


# ---------------------------------------------------------------- findings

def detect_findings(df: DataFrame, high_missing_threshold: float = 0.2, strong_correlation_threshold: float = 0.8,
                    strong_categorical_threshold: float = 0.5, outlier_rate_threshold: float = 0.05,
                    imbalance_threshold: float = 0.9, id_like_threshold: float = 0.98,
                    max_findings: int | None = None) -> DataFrame:
    """Ranked list (code, severity, category, columns, value, priority_score).

    Scores and severities are fixed values of the findings catalogue.
    """
    names, numbers, cats = data_columns(df), numeric_columns(df), categorical_columns(df)

    def add(frame, code, severity, category, columns, value, score):
        severity = severity if isinstance(severity, Column) else F.lit(severity)
        return frame.select(
            F.lit(code).alias("code"), severity.alias("severity"), F.lit(category).alias("category"),
            columns.alias("columns"), value.cast("double").alias("value"), score.cast("double").alias("priority_score"))

    out = []
    dup = duplicate_metrics(df).withColumn("rate", F.try_divide(F.col("redundant_rows").cast("double"), F.col("total_rows")))
    rate = F.col("rate")
    out.append(add(dup.filter("redundant_rows > 0"), "DUPLICATE_ROWS", F.when(rate >= 0.1, "high").otherwise("medium"),
                   "quality", F.lit(""), rate, 75 + 100 * rate))

    counts = attach_totals(value_counts(df, names, as_type="string"), ["column"], few=True, __n=F.sum("count"))
    share = F.col("count") / F.col("__n")
    facts = counts.groupBy("column").agg(F.max("__n").alias("valid"), F.count(F.lit(1)).alias("uniq"),
                                         F.max(share).alias("top"), F.count_if(share < 0.01).alias("rare"))
    rows = df.agg(F.count(F.lit(1)).alias("r")).scalar()
    col = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in names])).alias("name"))
    col = col.join(facts, F.col("name") == F.col("column"), "left").withColumn("rows", rows).fillna(
        {"valid": 0, "uniq": 0, "rare": 0})
    missing = F.coalesce(F.try_divide((F.col("rows") - F.col("valid")).cast("double"), F.col("rows")), F.lit(0.0))
    ratio = F.coalesce(F.try_divide(F.col("uniq").cast("double"), F.col("valid")), F.lit(0.0))
    c = F.col("name")
    out.append(add(col.filter(missing >= high_missing_threshold), "HIGH_MISSINGNESS",
                   F.when(missing >= 0.5, "high").otherwise("medium"), "quality", c, missing, 60 + 60 * missing))
    out.append(add(col.filter("uniq <= 1"), "CONSTANT_COLUMN", "medium", "quality", c, F.col("uniq"), F.lit(55.0)))
    out.append(add(col.filter((F.col("uniq") > 1) & (F.col("valid") >= 20) & (ratio >= id_like_threshold)),
                   "ID_LIKE_COLUMN", "medium", "quality", c, ratio, 50 + 30 * ratio))
    if cats:
        text = col.filter(c.isin(*cats) & (F.col("valid") > 0))
        top = F.col("top")
        out.append(add(text.filter((top >= imbalance_threshold) & (F.col("uniq") > 1)), "CATEGORICAL_IMBALANCE",
                       "medium", "categorical", c, top, 45 + 40 * top))
        out.append(add(text.filter("rare > 0"), "RARE_CATEGORIES", "low", "categorical", c, F.col("rare"),
                       30 + F.least(F.lit(20), F.col("rare"))))
    if numbers:
        d = S.analyze_distributions(df, numbers, [0.5])
        n = F.col("count").cast("double")
        zero, skew = F.col("zero_count") / n, F.col("skewness")
        odd = F.col("iqr_outlier_count") / n
        c2 = F.col("column")
        d = d.filter("count > 0")
        out.append(add(d.filter(zero >= 0.8), "ZERO_CONCENTRATION", "medium", "distribution", c2, zero, 45 + 40 * zero))
        out.append(add(d.filter((n >= 3) & (F.abs(skew) >= 1)), "STRONG_SKEW", "medium", "distribution", c2, skew,
                       45 + F.least(F.lit(30.0), F.abs(skew) * 8)))
        out.append(add(d.filter((n >= 4) & (odd >= outlier_rate_threshold)), "OUTLIER_CONCENTRATION", "medium",
                       "distribution", c2, odd, 50 + 80 * odd))
        logs = df.agg(F.array(*[F.struct(
            F.lit(x).alias("column"), F.min(_d(x)).alias("low"),
            S.adjusted_skew(F.skewness(_d(x)), F.count(x).cast("double")).alias("raw"),
            S.adjusted_skew(F.skewness(F.log(F.when(_d(x) > 0, _d(x)))), F.count(x).cast("double")).alias("logged"))
            for x in numbers]).alias("a")).select(F.inline("a"))
        gain = F.abs("raw") - F.abs("logged")
        out.append(add(logs.filter((F.col("raw") > 1) & (F.col("low") > 0) & (F.abs("logged") + 0.2 < F.abs("raw"))),
                       "LOG_TRANSFORM_CANDIDATE", "low", "distribution", c2, F.col("logged"),
                       35 + F.least(F.lit(20.0), gain)))
    both = F.concat_ws(",", "column_a", "column_b")
    if len(numbers) >= 2:
        r = S.analyze_correlations(df, numbers)
        a = F.col("absolute_correlation")
        out.append(add(r.filter((F.col("pairwise_count") >= 3) & (a >= strong_correlation_threshold)),
                       "STRONG_NUMERIC_RELATIONSHIP", F.when(a >= 0.95, "high").otherwise("medium"), "relationship",
                       both, F.col("correlation"), 55 + 40 * a))
    levels = level_counts(df, cats) if cats else {}
    few = [x for x in cats if levels[x] >= 2]
    if len(few) >= 2:
        v = S.chi_square_from(cut_lineage(pair_cells(df, S._pairs(few))), _PAIR)
        out.append(add(v.filter((F.col("row_levels") >= 2) & (F.col("column_levels") >= 2) & (F.col("n") >= 4)
                                & (F.col("cramers_v") >= strong_categorical_threshold)),
                       "STRONG_CATEGORICAL_RELATIONSHIP", "medium", "relationship", both, F.col("cramers_v"),
                       50 + 40 * F.col("cramers_v")))
    if numbers and few:
        g = group_moments(df, numbers, few).filter("n >= 2")
        e = S.anova_from(g, _NC).filter("k >= 2 and eta_squared >= 0.14")
        out.append(add(e, "LARGE_GROUP_EFFECT", "medium", "relationship", F.concat_ws(",", *_NC), F.col("eta_squared"),
                       55 + 50 * F.col("eta_squared")))
    t = reduce(lambda a, b: a.unionByName(b), out)
    rank = F.when(F.col("severity") == "high", 3).when(F.col("severity") == "medium", 2).otherwise(1)
    t = t.orderBy(F.desc("priority_score"), rank.desc(), "code", "columns")
    return t.limit(max_findings) if max_findings else t


def generate_eda_report(df: DataFrame) -> dict[str, DataFrame]:
    """Nine lazy sections; a section that does not apply to the schema is left out."""
    numbers, cats = numeric_columns(df), categorical_columns(df)
    df = counted_once(df, numbers)
    out = {"findings": detect_findings(df)}
    if numbers:
        out["numeric"] = analyze_numeric_eda(df, numbers)
        out["distributions"] = explore_distributions(df, numbers)
    if cats:
        out["categorical"] = analyze_categorical_eda(df, cats)
    if len(numbers) >= 2:
        out["correlations"] = explore_correlations(df, numbers, ("pearson", "spearman"))
        out["numeric_relationships"] = analyze_numeric_relationships(df, numbers, rank_methods=False)
    if len(cats) >= 2:
        few = [c for c, n in level_counts(df, cats).items() if n >= 2]
        if len(few) >= 2:
            out["categorical_relationships"] = analyze_categorical_relationships(df, few)
    if numbers and cats:
        # A row per pair of columns, which the best comparisons read again.
        groups = cut_lineage(analyze_numeric_categorical_relationships(df, numbers, cats))
        out["group_relationships"] = groups
        if "eta_squared" in groups.columns:
            out["best_group_comparisons"] = groups.filter("eta_squared is not null").orderBy(
                F.desc("eta_squared"), *_NC).limit(5)
    return out
