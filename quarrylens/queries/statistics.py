"""Quality, statistics, exploration and matching queries over the given tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from quarrylens.ids import with_row_id
from quarrylens.operators import eda
from quarrylens.operators import matching as ma
from quarrylens.operators import quality as qu
from quarrylens.operators import stats as sx
from quarrylens.plans import full_run
from quarrylens.queries.registry import query, rounded
from quarrylens.session import shared_folder
from quarrylens.sources import readers, versions

_NUM = {"l_quantity": "l_quantity", "l_extendedprice": "l_extendedprice", "l_discount": "l_discount"}


def _lines(t):
    return t("lineitem").select(*_NUM, "l_returnflag", "l_linestatus")


def _each(select, columns=_NUM, table="lineitem"):
    """The same SELECT for several columns, as one UNION ALL; ``{c}`` stands for the column."""
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {select.format(c=c)} FROM {table}" for c in columns)


# ---- quality --------------------------------------------------------------------------


@query(
    "d1_basic_schema",
    "SELECT * FROM (VALUES (0, 'c_custkey', 'integer'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'integer'), "
    "(3, 'c_acctbal', 'float'), (4, 'c_mktsegment', 'string')) v(position, \"column\", detected_type) JOIN ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c})::BIGINT AS non_null_count, (count(*) - count({c}))::BIGINT AS null_count, "
        f"count(DISTINCT {c})::BIGINT AS unique_count FROM customer"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    )
    + ") USING (\"column\")",
)
def _(t):
    out = qu.detect_basic_schema(t("customer"))
    return rounded(
        out.select("position", "column", "detected_type", "non_null_count", "null_count", "unique_count")
    ).withColumn("position", F.col("position").cast("int"))


@query(
    "d1_sample_values",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", least(5, count({c}))::BIGINT AS n FROM customer"
        for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    ),
)
def _(t):
    out = qu.sample_values(t("customer"))
    return rounded(out.select("column", F.size("sample_values").alias("n")))


@query("d2_semantic_schema")
def _(t):
    return qu.detect_semantic_schema(t("customer"))


@query(
    "d3_numeric_profile",
    _each(
        "count({c})::BIGINT AS non_null_count, round(sum({c}), 2) AS sum, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, "
        "min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(stddev_pop({c}), 4) AS std_dev, round(quantile_cont({c}, 0.25), 4) AS q1, "
        "round(quantile_cont({c}, 0.75), 4) AS q3, count(DISTINCT {c})::BIGINT AS unique_count, "
        "count(*) FILTER (WHERE {c} = 0)::BIGINT AS zero_count, count(*) FILTER (WHERE {c} > 0)::BIGINT AS positive_count",
        ("c_custkey", "c_nationkey", "c_acctbal"),
        "customer",
    ),
)
def _(t):
    out = qu.profile_numeric(t("customer"))
    columns = ["column", "non_null_count", "sum", "mean", "median", "min", "max", "std_dev", "q1", "q3"]
    out = out.select(*columns, "unique_count", "zero_count", "positive_count")
    return rounded(out.withColumn("sum", F.round("sum", 2)), 4)


@query(
    "d4_categorical_profile",
    _each(
        "count({c})::BIGINT AS non_null_count, count(DISTINCT {c})::BIGINT AS unique_count, "
        "round(count(DISTINCT {c}) / count({c}), 6) AS cardinality_ratio",
        ("c_name", "c_mktsegment"),
        "customer",
    ),
)
def _(t):
    out = qu.profile_categorical(t("customer").select("c_name", "c_mktsegment"))
    return rounded(out.select("column", "non_null_count", "unique_count", "cardinality_ratio"))


_HOLES = (
    "(SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, "
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type FROM events)"
)


def _holes(t):
    return t("events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"),
    )


@query(
    "d5_missing_by_column",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL)::BIGINT AS missing_count, "
        f"round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4) AS missing_percentage FROM {_HOLES}"
        for c in ("event_id", "value", "event_type")
    ),
)
def _(t):
    return rounded(qu.missing_by_column(_holes(t)), 4)


@query(
    "d5_missing_totals",
    f"SELECT count(*)::BIGINT AS total_rows, 3::BIGINT AS total_columns, (2 * count(*) - count(value) - count(event_type))::BIGINT "
    f"AS missing_cells, (3 * count(*))::BIGINT AS total_cells, round((2 * count(*) - count(value) - count(event_type)) * 100.0 / "
    f"(3 * count(*)), 4) AS missing_percentage FROM {_HOLES}",
)
def _(t):
    return rounded(qu.missing_totals(_holes(t)), 4)


@query(
    "d5_missing_patterns",
    "SELECT CASE WHEN event_id % 3 = 0 AND event_id % 5 = 0 THEN 'value,event_type' WHEN event_id % 3 = 0 THEN 'value' "
    "ELSE 'event_type' END AS columns, count(*)::BIGINT AS row_count FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0 GROUP BY 1",
)
def _(t):
    return qu.missing_patterns(_holes(t))


_RULES = [
    {"column": "c_acctbal", "rule": "range", "min": 0, "max": 5000},
    {"column": "c_name", "rule": "unique"},
    {"column": "c_nationkey", "rule": "unique"},
    {"column": "absent", "rule": "unique"},
    {"column": "c_mktsegment", "rule": "allowed_values", "values": ["BUILDING", "MACHINERY"]},
    {"column": "c_name", "rule": "regex", "pattern": "Customer#[0-9]+"},
    {"column": "absent", "rule": "required"},
]


@query(
    "d7_validation",
    "SELECT rule_index, \"column\", rule, invalid_count, CASE WHEN invalid_count > 0 THEN 'failed' ELSE 'passed' END AS status FROM ("
    "SELECT 0::BIGINT AS rule_index, 'c_acctbal' AS \"column\", 'range' AS rule, count(*) FILTER (WHERE NOT (c_acctbal BETWEEN 0 AND 5000))::BIGINT AS invalid_count FROM customer "
    "UNION ALL SELECT 1, 'c_name', 'unique', 0 "
    "UNION ALL SELECT 2, 'c_nationkey', 'unique', sum(n)::BIGINT FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1) "
    "UNION ALL SELECT 3, 'absent', 'unique', 0 "
    "UNION ALL SELECT 4, 'c_mktsegment', 'allowed_values', count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) FROM customer "
    "UNION ALL SELECT 5, 'c_name', 'regex', 0 UNION ALL SELECT 6, 'absent', 'required', count(*) FROM customer)",
)
def _(t):
    out = qu.validate_dataset(t("customer"), _RULES)
    return rounded(out.select("rule_index", "column", "rule", "invalid_count", "status"))


@query(
    "d7_examples",
    "SELECT 0::BIGINT AS rule_index, 'c_acctbal' AS \"column\", array_to_string(list(v ORDER BY c_custkey), ',') AS examples FROM ("
    "SELECT c_custkey, round(c_acctbal)::BIGINT::VARCHAR AS v FROM customer WHERE NOT (round(c_acctbal) BETWEEN 0 AND 5000) "
    "ORDER BY c_custkey LIMIT 5) UNION ALL SELECT 1, 'c_nationkey', array_to_string(list(v ORDER BY c_custkey), ',') FROM ("
    "SELECT c_custkey, c_nationkey::VARCHAR AS v FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 "
    "HAVING count(*) > 1) ORDER BY c_custkey LIMIT 5)",
)
def _(t):
    df = with_row_id(t("customer").withColumn("c_acctbal", F.round("c_acctbal").cast("long")), "c_custkey")
    rules = [
        {"column": "c_acctbal", "rule": "range", "min": 0, "max": 5000},
        {"column": "c_nationkey", "rule": "unique"},
        {"column": "absent", "rule": "unique"},
    ]
    out = qu.validation_examples(df, rules)
    return rounded(out.select("rule_index", "column", F.array_join("examples", ",").alias("examples")))


@query(
    "d8_default_rules",
    """WITH c AS (SELECT CASE WHEN c_custkey % 50 <> 0 THEN c_custkey // 2 END AS customer_id, c_acctbal / 50 AS age,
               CASE WHEN c_custkey % 7 = 0 THEN 'none' ELSE 'c' || c_custkey || '@example.org' END AS email, c_acctbal AS revenue,
               CASE WHEN c_custkey % 3 = 0 THEN '1997-13-01' ELSE '1997-01-31' END AS signup_date,
               CASE WHEN c_nationkey < 9 THEN 'Active' WHEN c_nationkey < 20 THEN 'Inactive' ELSE 'Gone' END AS status FROM customer)
    SELECT 'customer_id' AS "column", 'required' AS rule, count(*) FILTER (WHERE customer_id IS NULL)::BIGINT AS invalid_count FROM c
    UNION ALL SELECT 'customer_id', 'unique', coalesce(sum(n), 0)::BIGINT FROM
      (SELECT count(*) AS n FROM c WHERE customer_id IS NOT NULL GROUP BY customer_id HAVING count(*) > 1)
    UNION ALL SELECT 'age', 'range', count(*) FILTER (WHERE age < 0 OR age > 120) FROM c
    UNION ALL SELECT 'email', 'email', count(*) FILTER (WHERE email = 'none') FROM c
    UNION ALL SELECT 'revenue', 'min', count(*) FILTER (WHERE revenue < 0) FROM c
    UNION ALL SELECT 'signup_date', 'date', count(*) FILTER (WHERE signup_date = '1997-13-01') FROM c
    UNION ALL SELECT 'status', 'allowed_values', count(*) FILTER (WHERE status = 'Gone') FROM c""",
)
def _(t):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    df = t("customer").select(
        F.when(key % 50 != 0, F.floor(key / 2)).alias("customer_id"), (F.col("c_acctbal") / 50).alias("age"),
        F.when(key % 7 == 0, "none").otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@example.org"))).alias("email"),
        F.col("c_acctbal").alias("revenue"), F.when(key % 3 == 0, "1997-13-01").otherwise("1997-01-31").alias("signup_date"),
        F.when(nation < 9, "Active").when(nation < 20, "Inactive").otherwise("Gone").alias("status"))
    return rounded(qu.validate_dataset(df, qu.DEFAULT_RULES).select("column", "rule", "invalid_count"))


@query("d9_health_score")
def _(t):
    return qu.health_score(t("orders"))


@query("d10_quality_report")
def _(t):
    from quarrylens.plans.full_run import summary_table

    return summary_table(t("orders"), "o_orderdate", "o_totalprice")


# ---- statistics -----------------------------------------------------------------------


@query(
    "t1_descriptive",
    _each(
        "count({c})::BIGINT AS count, round(avg({c}), 5) AS mean, round(median({c}), 6) AS median, min({c}) AS min, max({c}) AS max, "
        "round(sum({c}), 2) AS sum, round(var_samp({c}), 2) AS variance, round(stddev_samp({c}), 6) AS std_dev, "
        "round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, count(DISTINCT {c})::BIGINT AS unique_count"
    ),
)
def _(t):
    out = sx.analyze_descriptive_statistics(_lines(t))
    columns = ["column", "count", "mean", "median", "min", "max", "sum", "variance", "std_dev", "skewness", "kurtosis"]
    out = out.select(*columns, "unique_count")
    return rounded(out.withColumns({"sum": F.round("sum", 2), "variance": F.round("variance", 2), "mean": F.round("mean", 5)}))


@query(
    "t2_percentiles",
    _each(
        "round(quantile_cont({c}, 0.25), 6) AS q1, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q3, "
        "round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 6) AS iqr, round(quantile_cont({c}, 0.1), 6) AS p10, "
        "round(quantile_cont({c}, 0.9), 6) AS p90"
    ),
)
def _(t):
    out = sx.analyze_percentiles(_lines(t))
    return rounded(out.select("column", "q1", "median", "q3", "iqr", "p10", "p90"))


_PAIRS = [("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_extendedprice", "l_discount")]


def _pairs_sql(select, table="lineitem"):
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, {select.format(a=a, b=b)} FROM {table}" for a, b in _PAIRS
    )


@query(
    "t3_pearson",
    _pairs_sql("round(corr({a}, {b}), 6) AS correlation, count(*)::BIGINT AS pairwise_count"),
)
def _(t):
    out = sx.analyze_correlations(_lines(t))
    return rounded(out.select("column_a", "column_b", "correlation", "pairwise_count"))


@query(
    "t3_spearman",
    "WITH r AS (SELECT "
    + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _NUM
    )
    + " FROM lineitem) "
    + _pairs_sql("round(corr({a}, {b}), 6) AS correlation", "r"),
)
def _(t):
    out = sx.analyze_correlations(_lines(t), method="spearman")
    return rounded(out.select("column_a", "column_b", "correlation"))


@query("t3_kendall")
def _(t):
    return rounded(sx.analyze_correlations(_lines(t), method="kendall"))


@query(
    "t4_covariance",
    " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, round(covar_samp({a}, {b}), 4) AS covariance FROM lineitem"
        for i, a in enumerate(_NUM)
        for b in list(_NUM)[i:]
    ),
)
def _(t):
    out = sx.analyze_covariance(_lines(t)).select("column_a", "column_b", "covariance")
    return rounded(out.where(F.array_position(F.lit(list(_NUM)), "column_a") <= F.array_position(F.lit(list(_NUM)), "column_b")), 4)


@query(
    "t5_distributions",
    _each(
        "round(skewness({c}), 6) AS skewness, round(kurtosis({c}), 6) AS kurtosis, round(quantile_cont({c}, 0.01), 6) AS p01, "
        "round(quantile_cont({c}, 0.99), 6) AS p99, count(*) FILTER (WHERE {c} > 0)::BIGINT AS positive_count"
    ),
)
def _(t):
    out = sx.analyze_distributions(_lines(t))
    return rounded(
        out.select(
            "column",
            "skewness",
            "kurtosis",
            F.col("`q_0.01`").alias("p01"),
            F.col("`q_0.99`").alias("p99"),
            "positive_count",
        )
    )


@query("t6_normality")
def _(t):
    return rounded(sx.analyze_normality(_lines(t)))


@query(
    "t7_mean_interval",
    "SELECT 'mean_t' AS interval_type, round(avg(l_extendedprice), 4) AS estimate, "
    "round(stddev_samp(l_extendedprice) / sqrt(count(*)), 4) AS standard_error FROM lineitem",
)
def _(t):
    out = sx.calculate_confidence_interval(_lines(t), "mean_t", "l_extendedprice")
    return rounded(out.select("interval_type", "estimate", "standard_error"), 4)


@query(
    "t8_effect_size",
    "SELECT 'cohens_d' AS effect_type, round((avg(l_extendedprice) - avg(l_quantity)) / sqrt((var_samp(l_extendedprice) + "
    "var_samp(l_quantity)) / 2), 6) AS value FROM lineitem",
)
def _(t):
    out = sx.calculate_effect_size(_lines(t), "cohens_d", "l_extendedprice", "l_quantity")
    return rounded(out.select("effect_type", "value"))


@query(
    "t9_one_sample_t",
    "SELECT count(*)::DOUBLE AS n, round(avg(l_quantity), 6) AS sample_mean, round((avg(l_quantity) - 25) / "
    "(stddev_samp(l_quantity) / sqrt(count(*))), 6) AS t_statistic FROM lineitem",
)
def _(t):
    out = sx.one_sample_t_test(_lines(t), "l_quantity", 25)
    return rounded(out.select("n", "sample_mean", "t_statistic"))


@query(
    "t10_independent_t",
    "WITH g AS (SELECT l_returnflag AS f, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v, count(*) AS n FROM lineitem "
    "WHERE l_returnflag IN ('A', 'R') GROUP BY 1) SELECT round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t_statistic "
    "FROM g a, g b WHERE a.f = 'A' AND b.f = 'R'",
)
def _(t):
    out = sx.independent_t_test(
        _lines(t),
        "grouped",
        value_column="l_extendedprice",
        group_column="l_returnflag",
        group_a="A",
        group_b="R",
    )
    return rounded(out.select("t_statistic"))


@query(
    "t11_paired_t",
    "SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_statistic, count(*)::DOUBLE AS n FROM "
    "(SELECT l_quantity - l_extendedprice AS d FROM lineitem)",
)
def _(t):
    out = sx.paired_t_test(_lines(t), "l_quantity", "l_extendedprice")
    return rounded(out.select("t_statistic", "n"))


_CHI = (
    "WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), e AS (SELECT *, "
    "sum(n) OVER (PARTITION BY a) * sum(n) OVER (PARTITION BY b) / sum(n) OVER () AS x FROM c) "
)


@query(
    "t12_chi_square",
    _CHI + "SELECT sum(n)::BIGINT AS n, round(sum((n - x) * (n - x) / x), 6) AS statistic, "
    "round(sqrt(sum((n - x) * (n - x) / x) / sum(n)), 6) AS cramers_v FROM e",
)
def _(t):
    out = sx.chi_square_test(_lines(t), "l_returnflag", "l_linestatus")
    return rounded(out.select("n", "statistic", "cramers_v"))


@query(
    "t13_fisher",
    "WITH c AS (SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS a, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS b, "
    "count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS c, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS d FROM labels) "
    "SELECT (a + b + c + d)::BIGINT AS n, round(a * d / (b * c), 6) AS odds_ratio FROM c",
)
def _(t):
    return rounded(sx.fisher_exact_test(t("labels"), "quality", "toxic").select("n", "odds_ratio"))


@query(
    "t14_anova",
    "WITH g AS (SELECT l_returnflag, count(*) AS n, avg(l_extendedprice) AS m, var_pop(l_extendedprice) * count(*) AS w FROM lineitem "
    "GROUP BY 1), s AS (SELECT sum(n * m) / sum(n) AS mm, sum(n) AS nn, count(*) AS k, sum(w) AS ww FROM g) SELECT any_value(k)::BIGINT AS k, "
    "round(sum(n * (m - mm) * (m - mm)) / (any_value(k) - 1) / (any_value(ww) / (any_value(nn) - any_value(k))), 4) AS f_statistic, "
    "round(sum(n * (m - mm) * (m - mm)) / (sum(n * (m - mm) * (m - mm)) + any_value(ww)), 6) AS eta_squared FROM g, s",
)
def _(t):
    out = sx.analyze_anova(_lines(t), "l_extendedprice", "l_returnflag").select("k", "f_statistic", "eta_squared")
    return rounded(out.withColumn("f_statistic", F.round("f_statistic", 4)))


@query(
    "t15_mann_whitney",
    "WITH v AS (SELECT l_quantity AS v, 1 AS g FROM lineitem UNION ALL SELECT l_extendedprice, 2 FROM lineitem), "
    "r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM v), "
    "s AS (SELECT sum(k) AS rs, count(*)::DOUBLE AS n FROM r WHERE g = 1) SELECT round(rs - n * (n + 1) / 2, 2) AS u_statistic FROM s",
)
def _(t):
    out = sx.analyze_non_parametric(
        _lines(t), "mann_whitney_u", "l_quantity", "l_extendedprice"
    )
    name = next(c for c in out.columns if "statistic" in c)
    return rounded(out.select(F.col(name).alias("u_statistic")), 2)


@query(
    "t17_kruskal",
    "WITH r AS (SELECT l_returnflag AS g, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS k FROM lineitem), "
    "t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM lineitem GROUP BY l_quantity)), "
    "s AS (SELECT sum(k) AS rs, count(*)::DOUBLE AS n FROM r GROUP BY g), a AS (SELECT sum(n) AS nn, sum(rs * rs / n) AS q FROM s) "
    "SELECT round((12 / (nn * (nn + 1)) * q - 3 * (nn + 1)) / (1 - ties / (nn * nn * nn - nn)), 4) AS statistic FROM a, t",
)
def _(t):
    out = sx.analyze_non_parametric(
        _lines(t), "kruskal_wallis", value_column="l_quantity", group_column="l_returnflag"
    )
    name = "statistic" if "statistic" in out.columns else "h_statistic"
    return rounded(out.select(F.col(name).alias("statistic")), 4)


@query("t16_wilcoxon")
def _(t):
    return rounded(sx.analyze_non_parametric(_lines(t), "wilcoxon_signed_rank", "l_quantity", "l_discount"))


@query("t18_friedman")
def _(t):
    return rounded(sx.analyze_non_parametric(_lines(t), "friedman", sample_columns=list(_NUM)))


@query(
    "t19_sign_test",
    "SELECT count(*) FILTER (WHERE l_quantity > l_discount)::BIGINT AS positive, count(*) FILTER (WHERE l_quantity < l_discount)::BIGINT AS negative, "
    "count(*) FILTER (WHERE l_quantity = l_discount)::BIGINT AS ties FROM lineitem",
)
def _(t):
    out = sx.analyze_non_parametric(_lines(t), "sign_test", "l_quantity", "l_discount")
    return rounded(out.select("positive", "negative", "ties"))


@query(
    "t20_ab_test",
    "SELECT count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS control_n, count(*) FILTER (WHERE l_linestatus = 'O')::BIGINT AS treatment_n, "
    "round(avg(l_extendedprice) FILTER (WHERE l_linestatus = 'O') - avg(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 4) AS absolute_uplift FROM lineitem",
)
def _(t):
    out = sx.analyze_ab_test(_lines(t), "l_linestatus", "F", "O", "continuous", "l_extendedprice")
    return rounded(out.select("control_n", "treatment_n", "absolute_uplift"), 4)


@query("t21_segment_power")
def _(t):
    return rounded(sx.segment_power(_lines(t), ["l_returnflag"], "l_linestatus", "F", "O", "l_extendedprice"))


@query(
    "t22_findings_of_counts",
    "SELECT 'HIGH_MISSINGNESS' AS code, 'value' AS columns, round(100.0 * (count(*) - count(value)) / count(*), 6) AS value "
    "FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events) UNION ALL "
    "SELECT 'STRONG_CORRELATION', 'value / twice', round(corr(value, 2 * value + event_id % 2), 6) FROM events WHERE event_id % 3 <> 0",
)
def _(t):
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    df = t("events").select(value.alias("value"), (2 * F.col("value") + F.col("event_id") % 2).alias("twice"))
    out = sx.generate_statistics_report(df, sections=["descriptive", "correlation"])["findings"]
    return rounded(out.where("code IN ('HIGH_MISSINGNESS', 'STRONG_CORRELATION')").select("code", "columns", "value"))


@query("t22_statistics_findings")
def _(t):
    return sx.statistics_findings(sx.generate_statistics_report(_lines(t)))


# ---- exploration ----------------------------------------------------------------------


@query(
    "e1_numeric_eda",
    _each("round(avg({c}), 6) AS mean, round(stddev_samp({c}) / avg({c}), 6) AS coefficient_of_variation, 0.0::DOUBLE AS missing_rate"),
)
def _(t):
    out = eda.analyze_numeric_eda(_lines(t))
    return rounded(out.select("column", "mean", "coefficient_of_variation", "missing_rate"))


@query(
    "e2_categorical_eda",
    "SELECT 'c_mktsegment' AS \"column\", sum(n)::BIGINT AS count, count(*)::BIGINT AS unique_count, arg_max(c_mktsegment, n) AS mode, "
    "round(max(n) / sum(n), 6) AS mode_share, round(-sum(n / t * ln(n / t)) / ln(count(*)), 6) AS normalized_entropy FROM ("
    "SELECT c_mktsegment, count(*) AS n, sum(count(*)) OVER () AS t FROM customer GROUP BY 1)",
)
def _(t):
    out = eda.analyze_categorical_eda(t("customer").select("c_mktsegment"))
    return rounded(out.select("column", "count", "unique_count", "mode", "mode_share", "normalized_entropy"))


@query(
    "e2_top_values",
    "SELECT 'o_orderpriority' AS \"column\", row_number() OVER (ORDER BY count(*) DESC, o_orderpriority)::BIGINT AS rank, "
    "o_orderpriority AS value, count(*)::BIGINT AS count, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY o_orderpriority",
)
def _(t):
    return rounded(eda.top_values(t("orders"), ["o_orderpriority"]))


@query(
    "e3_numeric_relationships",
    _pairs_sql(
        "round(corr({a}, {b}), 6) AS pearson, round(regr_slope({b}, {a}), 6) AS slope, round(regr_intercept({b}, {a}), 4) AS intercept"
    ),
)
def _(t):
    out = eda.analyze_numeric_relationships(_lines(t), rank_methods=False)
    out = out.select("column_a", "column_b", "pearson", "slope", "intercept")
    return rounded(out.withColumn("intercept", F.round("intercept", 4)))


@query("e4_numeric_categorical")
def _(t):
    return rounded(eda.analyze_numeric_categorical_relationships(_lines(t)), 4)


@query(
    "e5_categorical_relationships",
    _CHI + "SELECT 'l_returnflag' AS column_a, 'l_linestatus' AS column_b, sum(n)::BIGINT AS n, round(sum((n - x) * (n - x) / x), 6) AS statistic, "
    "round(sqrt(sum((n - x) * (n - x) / x) / sum(n)), 6) AS cramers_v, round(min(x), 4) AS minimum_expected_count FROM e",
)
def _(t):
    out = eda.analyze_categorical_relationships(_lines(t).select("l_returnflag", "l_linestatus"))
    out = out.select("column_a", "column_b", "n", "statistic", "cramers_v", "minimum_expected_count")
    return rounded(out.withColumn("minimum_expected_count", F.round("minimum_expected_count", 4)))


_EFFECTS = """
WITH v AS (SELECT {n} AS v, {c} AS g FROM lineitem),
m AS (SELECT g, count(*) AS n, avg(v) AS m, var_pop(v) * count(*) AS w FROM v GROUP BY g),
s AS (SELECT sum(n * m) / sum(n) AS mm, sum(n) AS nn, count(*) AS k, sum(w) AS ww, arg_max(g, m) AS hi, arg_min(g, m) AS lo,
             max(m) - min(m) AS spread FROM m),
a AS (SELECT sum(n * (m - mm) * (m - mm)) AS b, any_value(k) AS k, any_value(nn) AS nn, any_value(ww) AS ww,
             any_value(hi) AS hi, any_value(lo) AS lo, any_value(spread) AS spread FROM m, s),
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS k FROM v),
t AS (SELECT sum(n * n * n - n) AS ties FROM (SELECT count(*)::DOUBLE AS n FROM v GROUP BY v)),
h AS (SELECT sum(rs * rs / n) AS q FROM (SELECT sum(k) AS rs, count(*)::DOUBLE AS n FROM r GROUP BY g))
SELECT '{n}' AS numeric, '{c}' AS categorical, nn::BIGINT AS observations, k::BIGINT AS group_count,
       round(b / (k - 1) / (ww / (nn - k)), 4) AS f_statistic, round(b / (b + ww), 6) AS eta_squared,
       round((12.0 / (nn::DOUBLE * (nn + 1)) * q - 3 * (nn + 1)) / (1 - ties / (nn::DOUBLE * nn * nn - nn)), 3) AS kruskal_h,
       hi AS highest_mean_group, lo AS lowest_mean_group, round(spread, 4) AS mean_spread
FROM a, t, h"""


@query(
    "e4_group_effects",
    " UNION ALL ".join(
        f"SELECT * FROM ({_EFFECTS.format(n=n, c=c)})" for n in _NUM for c in ("l_returnflag", "l_linestatus")
    ),
)
def _(t):
    out = eda.analyze_numeric_categorical_relationships(_lines(t))
    out = out.select(
        "numeric", "categorical", "observations", "group_count", F.round("f_statistic", 4).alias("f_statistic"), "eta_squared",
        F.round("kruskal_h", 3).alias("kruskal_h"), "highest_mean_group", "lowest_mean_group",
        F.round("mean_spread", 4).alias("mean_spread"),
    )
    return rounded(out)


# Three columns of few values, two with gaps: counts per pair of values are enough for every pair of rows.
_GAPS = "(SELECT l_quantity AS q, nullif(l_discount, 0.05) AS d, CASE WHEN l_linenumber <> 3 THEN l_tax END AS t FROM lineitem)"


def _gaps(t):
    return t("lineitem").select(
        F.col("l_quantity").alias("q"),
        F.nullif("l_discount", F.lit(0.05)).alias("d"),
        F.when(F.col("l_linenumber") != 3, F.col("l_tax")).alias("t"),
    )


_KENDALL = (
    "SELECT '{a}' AS column_a, '{b}' AS column_b, {m}round(s / sqrt(tx) / sqrt(ty), 6) AS correlation, n::BIGINT AS pairwise_count "
    "FROM (WITH c AS (SELECT {a} AS x, {b} AS y, count(*)::DOUBLE AS w FROM {v} WHERE {a} IS NOT NULL AND {b} IS NOT NULL "
    "GROUP BY ALL) SELECT sum(p.w * r.w * sign(p.x - r.x) * sign(p.y - r.y)) AS s, sum(p.w * r.w * abs(sign(p.x - r.x))) AS tx, "
    "sum(p.w * r.w * abs(sign(p.y - r.y))) AS ty, (SELECT sum(w) FROM c) AS n FROM c p, c r)"
)
_SPEARMAN = (
    "SELECT '{a}' AS column_a, '{b}' AS column_b, {m}round(corr(x, y), 6) AS correlation, count(*)::BIGINT AS pairwise_count FROM ("
    "SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0 AS x, "
    "rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0 AS y FROM {v} "
    "WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
)


def _three(sql, method=""):
    return " UNION ALL ".join(sql.format(a=a, b=b, v=_GAPS, m=method) for a, b in (("q", "d"), ("q", "t"), ("d", "t")))


@query("t3_kendall_gaps", _three(_KENDALL))
def _(t):
    return rounded(sx.analyze_correlations(_gaps(t), method="kendall").drop("absolute_correlation"))


@query("t3_spearman_gaps", _three(_SPEARMAN))
def _(t):
    return rounded(sx.analyze_correlations(_gaps(t), method="spearman").drop("absolute_correlation"))


@query("e6_rank_explorer", _three(_KENDALL, "'kendall' AS method, ") + " UNION ALL " + _three(_SPEARMAN, "'spearman' AS method, "))
def _(t):
    out = eda.explore_correlations(_gaps(t), methods=("spearman", "kendall"))
    return rounded(out.select("method", "column_a", "column_b", "correlation", "pairwise_count"))


_BY_GROUP = "(SELECT o_orderpriority || (o_custkey % 7) AS g, round(o_totalprice / 1000) AS v FROM orders)"


@query(
    "e8_pairwise_u",
    f"""WITH c AS (SELECT g, v, count(*)::DOUBLE AS w FROM {_BY_GROUP} GROUP BY ALL),
    n AS (SELECT g, count(*)::DOUBLE AS n, avg(v) AS m, var_samp(v) AS s FROM {_BY_GROUP} GROUP BY g),
    u AS (SELECT a.g AS group_a, b.g AS group_b, sum(a.w * b.w * (CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5 ELSE 0 END)) AS u
          FROM c a JOIN c b ON a.g < b.g GROUP BY ALL)
    SELECT group_a, group_b, round(u, 2) AS mann_whitney_u, round(y.m - x.m, 4) AS mean_difference_b_minus_a,
           round((y.m - x.m) / sqrt(((x.n - 1) * x.s + (y.n - 1) * y.s) / (x.n + y.n - 2))
                 * (1 - 3 / (4 * (x.n + y.n - 2) - 1)), 6) AS hedges_g
    FROM u JOIN n x ON x.g = group_a JOIN n y ON y.g = group_b""",
)
def _(t):
    group = F.concat("o_orderpriority", (F.col("o_custkey") % 7).cast("string"))
    frame = t("orders").select(group.alias("g"), F.round(F.col("o_totalprice") / 1000).alias("v"))
    out = eda.pairwise_comparisons(frame, "v", "g")
    return rounded(out.select(
        "group_a", "group_b", F.round("mann_whitney_u", 2).alias("mann_whitney_u"),
        F.round("mean_difference_b_minus_a", 4).alias("mean_difference_b_minus_a"), "hedges_g",
    ))


@query("e10_eda_report")
def _(t):
    """The rows of every written section of the report."""
    orders = t("orders").select("o_totalprice", "o_orderstatus", "o_orderpriority")
    return _written(orders, eda.generate_eda_report(orders))


def _written(df, sections):
    path = f"{shared_folder(df.sparkSession)}/report-{uuid.uuid4().hex}"
    for name, section in sections.items():
        section.write.parquet(f"{path}/{name}")
    parts = [df.sparkSession.read.parquet(f"{path}/{n}").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("section"), "rows")
             for n in sections]
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("b13_full_run")
def _(t):
    """Sections written by the full analysis of the orders, their rows, and the health before and after."""
    orders = t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    folder = f"{shared_folder(orders.sparkSession)}/run-{uuid.uuid4().hex}"
    store = versions.VersionStore(orders.sparkSession, f"{folder}/versions")
    run = full_run.run_full_analysis(store, orders, "orders", f"{folder}/sections")
    parts = [orders.sparkSession.read.parquet(p).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("section"), "rows")
             for n, p in run["sections"].items()]
    scores = [F.lit(run[k]["score"]).cast("long").alias(k) for k in ("health_before", "health_after")]
    return reduce(lambda a, b: a.unionByName(b), parts).select("*", *scores)


@query("e6_explore_correlations")
def _(t):
    return rounded(eda.explore_correlations(_lines(t)))


@query(
    "e7_explore_distributions",
    "WITH m AS (SELECT median(l_extendedprice) AS m FROM lineitem) SELECT 'l_extendedprice' AS \"column\", "
    "round(median(abs(l_extendedprice - m)), 4) AS mad, round(skewness(ln(l_extendedprice)), 4) AS log_skewness FROM lineitem, m",
)
def _(t):
    out = eda.explore_distributions(_lines(t), ["l_extendedprice"])
    return rounded(out.select("column", "mad", "log_skewness"), 4)


@query("e8_pairwise_comparisons")
def _(t):
    return rounded(eda.pairwise_comparisons(_lines(t), "l_extendedprice", "l_returnflag"))


@query("e8_group_comparison")
def _(t):
    return rounded(eda.analyze_group_comparison(_lines(t), "l_extendedprice", "l_returnflag"))


@query("e9_findings")
def _(t):
    return eda.detect_findings(t("orders").select("o_totalprice", "o_orderstatus", "o_orderpriority"))


# ---- matching, sources ----------------------------------------------------------------


@query("j7_fuzzy_match")
def _(t):
    left = with_row_id(t("supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey")
    right = t("customer").select("c_custkey", "c_nationkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("c_name"))
    return ma.fuzzy_match(
        left,
        with_row_id(right, "c_custkey"),
        [{"left": "s_name", "right": "c_name"}],
        blocking_keys=[{"left": "s_nationkey", "right": "c_nationkey"}],
        right_include_columns=["c_custkey"],
    )


@query("j8_record_linkage")
def _(t):
    left = with_row_id(t("supplier").select("s_suppkey", "s_nationkey", "s_name"), "s_suppkey")
    right = t("customer").select("c_custkey", "c_nationkey", F.replace("c_name", F.lit("Customer"), F.lit("Supplier")).alias("c_name"))
    return ma.link_records(
        left,
        with_row_id(right, "c_custkey"),
        [{"left": "s_name", "right": "c_name"}],
        blocking_keys=[{"left": "s_nationkey", "right": "c_nationkey"}],
        right_include_columns=["c_custkey"],
    )


@query(
    "s4_parquet_inspect",
    "SELECT 'n_nationkey' AS \"column\", count(*)::BIGINT AS row_count FROM nation UNION ALL "
    "SELECT 'n_name', count(*) FROM nation UNION ALL SELECT 'n_regionkey', count(*) FROM nation",
)
def _(t):
    out = readers.inspect(t("nation"))
    return rounded(out.select("column", "row_count"))


@query(
    "l3_version_diff",
    "SELECT 'o_totalprice' AS \"column\", count(*) FILTER (WHERE o_orderkey % 10 = 0 AND o_orderkey % 4 <> 0)::BIGINT AS changed_cells, "
    "count(*) FILTER (WHERE o_orderkey % 4 = 0)::BIGINT AS removed_rows, 0::BIGINT AS added_rows FROM orders",
)
def _(t):
    before = t("orders").select("o_orderkey", "o_totalprice")
    price = F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    after = before.where("o_orderkey % 4 <> 0").select("o_orderkey", price.alias("o_totalprice"))
    return rounded(versions.version_diff(before, after, "o_orderkey"))


@query(
    "l4_safe_cells",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN '''=' || o_orderstatus ELSE o_orderstatus END AS status FROM orders",
)
def _(t):
    status = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("="), "o_orderstatus")).otherwise(F.col("o_orderstatus"))
    return versions.safe_cells(t("orders").select("o_orderkey", status.alias("status")))
