"""Cleaning, sampling, set and SQL queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.ids import with_row_id
from quarrylens.operators import cleaning as cl
from quarrylens.operators import sampling as sa
from quarrylens.plans import recipe as re_
from quarrylens.plans import steps as st
from quarrylens.queries.registry import query, rounded
from quarrylens.sources import sql as sq

# Events with gaps: the value of purchases below 20 is unknown.
GAPS = "(SELECT event_id, user_id, ts, event_type, CASE WHEN event_type = 'purchase' AND value < 20 THEN NULL ELSE value END AS value FROM events)"


def gaps(t):
    value = F.when((F.col("event_type") == "purchase") & (F.col("value") < 20), None).otherwise(F.col("value"))
    return t("events").select("event_id", "user_id", "ts", "event_type", value.alias("value"))


@query("c1_drop_rows_any", f"SELECT event_id FROM {GAPS} WHERE value IS NOT NULL")
def _(t):
    return cl.apply_missing_value_operation(gaps(t), "drop_rows_any").select("event_id")


@query("c1_drop_rows_selected", f"SELECT event_id FROM {GAPS} WHERE value IS NOT NULL AND user_id IS NOT NULL")
def _(t):
    return cl.apply_missing_value_operation(gaps(t), "drop_rows_selected", ["value", "user_id"]).select("event_id")


@query("c2_drop_columns", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    df = gaps(t).select("event_id", "user_id", "event_type", "value")
    return cl.apply_missing_value_operation(df, "drop_columns_any")


@query("c3_fill_constant", f"SELECT event_id, coalesce(value, -1) AS value FROM {GAPS}")
def _(t):
    out = cl.apply_missing_value_operation(gaps(t), "fill_constant", ["value"], fill_value=-1.0)
    return out.select("event_id", "value")


@query(
    "c4_impute_mean",
    f"SELECT event_id, round(coalesce(value, (SELECT avg(value) FROM {GAPS})), 6) AS value FROM {GAPS}",
)
def _(t):
    return rounded(cl.apply_imputation(gaps(t), "mean", ["value"]).select("event_id", "value"))


@query(
    "c4_impute_median",
    f"SELECT event_id, round(coalesce(value, (SELECT median(value) FROM {GAPS})), 6) AS value FROM {GAPS}",
)
def _(t):
    return rounded(cl.apply_imputation(gaps(t), "median", ["value"]).select("event_id", "value"))


@query(
    "c4_impute_mode",
    "WITH e AS (SELECT event_id, nullif(event_type, 'error') AS kind FROM events) SELECT event_id, coalesce(kind, "
    "(SELECT kind FROM e WHERE kind IS NOT NULL GROUP BY kind ORDER BY count(*) DESC, kind LIMIT 1)) AS kind FROM e",
)
def _(t):
    df = t("events").select("event_id", F.nullif("event_type", F.lit("error")).alias("kind"))
    return cl.apply_imputation(df, "mode", ["kind"])


@query(
    "c5_forward_fill",
    f"SELECT event_id, coalesce(value, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS value FROM {GAPS}",
)
def _(t):
    out = cl.apply_imputation(
        gaps(t), "forward_fill", ["value"], order_by=["ts", "event_id"], partition_by=["user_id"]
    )
    return out.select("event_id", "value")


@query(
    "c5_backward_fill",
    f"SELECT event_id, coalesce(value, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS value FROM {GAPS}",
)
def _(t):
    out = cl.apply_imputation(
        gaps(t), "backward_fill", ["value"], order_by=["ts", "event_id"], partition_by=["user_id"]
    )
    return out.select("event_id", "value")


@query(
    "c6_interpolate",
    f"WITH r AS (SELECT *, row_number() OVER w AS i FROM {GAPS} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), "
    "s AS (SELECT event_id, value, i, "
    "last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia, last_value(value IGNORE NULLS) OVER b AS va, "
    "first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib, first_value(value IGNORE NULLS) OVER a AS vb "
    "FROM r WINDOW b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
    "a AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) "
    "SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va "
    "ELSE va + (vb - va) * (i - ia) / (ib - ia) END, 6) AS value FROM s",
)
def _(t):
    out = cl.apply_imputation(
        gaps(t), "interpolate_linear", ["value"], order_by=["ts", "event_id"], partition_by=["user_id"]
    )
    return rounded(out.select("event_id", "value"))


@query(
    "c7_text_cleaning",
    "SELECT p_partkey, replace(upper(trim(regexp_replace('  ' || p_name || '  x ', '\\s+', ' ', 'g'))), 'RED', 'Red') AS p_name FROM part",
)
def _(t):
    df = t("part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("  x ")).alias("p_name"))
    operations = [
        "collapse_whitespace",
        "trim",
        "uppercase",
        {"type": "replace_substring", "old": "RED", "new": "Red"},
    ]
    return cl.apply_string_cleaning(df, ["p_name"], operations)


@query(
    "c7_text_metrics",
    "SELECT 'event_type' AS \"column\", count(*) FILTER (WHERE event_type <> upper(event_type))::BIGINT AS changed_cells, "
    "0::BIGINT AS new_nulls FROM events",
)
def _(t):
    return rounded(cl.string_cleaning_metrics(t("events"), ["event_type"], ["uppercase"]))


@query("c7_unicode_and_title")
def _(t):
    df = t("documents").select("doc_id", F.col("text").alias("text"))
    return cl.apply_string_cleaning(df, ["text"], [{"type": "normalize_unicode", "form": "NFKC"}, "titlecase"])


@query(
    "c8_numeric_cleaning",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE round(-o_totalprice, 2) END AS price FROM orders",
)
def _(t):
    amount = F.concat(F.lit("($"), F.format_number("o_totalprice", 2), F.lit(")"))
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(amount).alias("price"))
    operations = [
        "parse_parentheses_negative",
        {"type": "remove_currency_symbols"},
        "remove_thousands_separators",
        "to_numeric",
    ]
    return rounded(cl.apply_numeric_cleaning(df, ["price"], operations, on_invalid="set_null"), 2)


@query(
    "c9_date_cleaning",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'soon' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
)
def _(t):
    text = F.date_format("o_orderdate", "dd/MM/yyyy")
    df = t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, "soon").otherwise(text).alias("day"))
    return cl.apply_date_cleaning(df, ["day"], input_formats=["%d/%m/%Y"])


@query(
    "c10_categories",
    "SELECT event_id, CASE event_type WHEN 'click' THEN 'touch' WHEN 'view' THEN 'touch' ELSE event_type END AS event_type FROM events",
)
def _(t):
    df = t("events").select("event_id", F.upper("event_type").alias("event_type"))
    return cl.apply_category_normalization(
        df, ["event_type"], ["lowercase"], {"CLICK": "touch", "View": "touch"}, case_insensitive_mapping=True
    )


@query(
    "c10_mapping_report",
    "SELECT 'event_type' AS \"column\", event_type AS from_value, CASE WHEN event_type = 'click' THEN 'touch' ELSE event_type END "
    "AS to_value, CASE WHEN event_type = 'click' THEN 'mapped' ELSE 'unmapped' END AS status, count(*)::BIGINT AS count "
    "FROM events GROUP BY event_type",
)
def _(t):
    return rounded(cl.category_mapping_report(t("events"), ["event_type"], mappings={"click": "touch"}))


@query("c11_remove_duplicates", "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders GROUP BY o_custkey")
def _(t):
    df = t("orders").select("o_orderkey", "o_custkey")
    return cl.remove_duplicates(df, "columns", ["o_custkey"], order_column="o_orderkey")


@query(
    "c11_keep_none",
    "SELECT o_custkey, o_orderdate FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) = 1",
)
def _(t):
    return cl.remove_duplicates(t("orders").select("o_custkey", "o_orderdate"), keep="none")


@query(
    "d6_duplicate_groups",
    "SELECT o_custkey, o_orderpriority, count(*)::BIGINT AS occurrences, min(o_orderkey) AS first_occurrence "
    "FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
)
def _(t):
    return cl.duplicate_groups(t("orders"), "columns", ["o_custkey", "o_orderpriority"], "o_orderkey")


@query(
    "d6_duplicate_metrics",
    "WITH g AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority) SELECT sum(n)::BIGINT AS total_rows, "
    "sum(n) FILTER (WHERE n > 1)::BIGINT AS duplicate_rows, count(*) FILTER (WHERE n > 1)::BIGINT AS duplicate_groups, "
    "sum(n - 1) FILTER (WHERE n > 1)::BIGINT AS redundant_rows, "
    "round(sum(n) FILTER (WHERE n > 1) * 100.0 / sum(n), 6) AS duplicate_percentage FROM g",
)
def _(t):
    return rounded(cl.duplicate_metrics(t("orders"), "columns", ["o_custkey", "o_orderpriority"]))


_IQR = (
    "WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem), "
    "e AS (SELECT a - 0.5 * (b - a) AS low, b + 0.5 * (b - a) AS high FROM q) "
)


@query(
    "c12_detect_outliers",
    "WITH m AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM customer) SELECT c_custkey AS row_id, 'c_acctbal' "
    "AS \"column\", round(c_acctbal, 4) AS value, round((c_acctbal - m) / s, 6) AS score, "
    "CASE WHEN c_acctbal < m THEN 'low' ELSE 'high' END AS direction FROM customer, m WHERE abs((c_acctbal - m) / s) > 1.6",
)
def _(t):
    df = with_row_id(t("customer"), "c_custkey")
    return rounded(cl.detect_outliers(df, "zscore", ["c_acctbal"], z_threshold=1.6))


@query(
    "c12_outlier_summary",
    _IQR + "SELECT 'l_extendedprice' AS \"column\", count(*)::BIGINT AS non_null_count, 0::BIGINT AS null_count, "
    "count(*) FILTER (WHERE l_extendedprice < low OR l_extendedprice > high)::BIGINT AS outlier_count, "
    "round(count(*) FILTER (WHERE l_extendedprice < low OR l_extendedprice > high) * 100.0 / count(*), 6) AS outlier_percentage, "
    "round(any_value(low), 4) AS lower_bound, round(any_value(high), 4) AS upper_bound FROM lineitem, e",
)
def _(t):
    out = cl.outlier_summary(t("lineitem"), "iqr", ["l_extendedprice"], iqr_multiplier=0.5)
    return rounded(out.withColumns({c: F.round(c, 4) for c in ("lower_bound", "upper_bound")}))


@query(
    "c13_cap_outliers",
    _IQR.replace("0.5 *", "0.1 *")
    + "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, round(least(greatest(l_extendedprice, low), high), 4) AS l_extendedprice FROM lineitem, e",
)
def _(t):
    out = cl.apply_outlier_treatment(t("lineitem"), "iqr", ["l_extendedprice"], "cap", iqr_multiplier=0.1)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_extendedprice"), 4)


@query(
    "c13_flag_outliers",
    "WITH q AS (SELECT quantile_cont(p_retailprice, 0.05) AS a, quantile_cont(p_retailprice, 0.95) AS b FROM part) "
    "SELECT p_partkey, p_retailprice < a OR p_retailprice > b AS p_retailprice__outlier FROM part, q",
)
def _(t):
    out = cl.apply_outlier_treatment(
        t("part"), "percentile", ["p_retailprice"], "retain_and_flag", lower_percentile=5.0, upper_percentile=95.0
    )
    return out.select("p_partkey", "p_retailprice__outlier")


@query(
    "c14_recipe",
    f"SELECT event_id, upper(event_type) AS event_type, "
    f"round(coalesce(value, (SELECT median(value) FROM {GAPS})), 6) AS value FROM {GAPS}",
)
def _(t):
    steps = [
        {"type": "string_cleaning", "params": {"columns": ["event_type"], "operations": ["uppercase"]}},
        {"type": "imputation", "params": {"columns": ["value"], "method": "median"}},
    ]
    out = re_.execute_recipe(with_row_id(gaps(t), "event_id"), steps)
    return rounded(out.select("event_id", "event_type", "value"))


@query(
    "c15_safe_clean",
    f"SELECT event_id, event_type, round(coalesce(value, (SELECT median(value) FROM {GAPS})), 6) AS value FROM {GAPS}",
)
def _(t):
    out = re_.safe_clean_frame(with_row_id(gaps(t), "event_id"))
    return rounded(out.select("event_id", "event_type", "value"))


@query(
    "b12_pipeline_steps",
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders "
    "WHERE o_totalprice > 50000 GROUP BY o_orderstatus",
)
def _(t):
    steps = [
        {
            "tool": "row_filter",
            "parameters": {"conditions": [{"column": "o_totalprice", "operator": "gt", "value": 50000}]},
        },
        {
            "tool": "aggregation",
            "parameters": {
                "group_by": ["o_orderstatus"],
                "aggregations": [
                    {"function": "sum", "column": "o_totalprice", "alias": "total"},
                    {"function": "count", "alias": "n"},
                ],
            },
        },
    ]
    return rounded(st.execute_steps(t("orders"), steps)["dataframe"], 2)


@query(
    "c14_recipe_metrics",
    f"SELECT 0::BIGINT AS step_index, 'string_cleaning' AS step_type, count(*)::BIGINT AS rows_before, count(*)::BIGINT AS rows_after, "
    f"count(*) FILTER (WHERE event_type <> upper(event_type))::BIGINT AS changed_cells FROM {GAPS} "
    f"UNION ALL SELECT 1, 'missing_values', count(*), count(value), 0 FROM {GAPS} "
    f"UNION ALL SELECT 2, 'outlier_treatment', count(value), count(value), "
    f"(SELECT count(*) FROM {GAPS}, (SELECT quantile_cont(value, 0.05) AS a, quantile_cont(value, 0.95) AS b FROM {GAPS}) "
    f"WHERE value < a OR value > b) FROM {GAPS}",
)
def _(t):
    steps = [
        {"type": "string_cleaning", "params": {"columns": ["event_type"], "operations": ["uppercase"]}},
        {"type": "missing_values", "params": {"operation": "drop_rows_selected", "columns": ["value"]}},
        {
            "type": "outlier_treatment",
            "params": {"method": "percentile", "columns": ["value"], "action": "cap", "lower_percentile": 5.0, "upper_percentile": 95.0},
        },
    ]
    out = re_.recipe_metrics(with_row_id(gaps(t), "event_id"), steps)
    return rounded(out.select("step_index", "step_type", "rows_before", "rows_after", "changed_cells"))


@query(
    "b12_step_metrics",
    "SELECT 0::BIGINT AS step_index, 'row_filter' AS tool, count(*)::BIGINT AS rows_before, "
    "count(*) FILTER (WHERE o_totalprice > 50000)::BIGINT AS rows_after, 5::BIGINT AS columns_after FROM orders UNION ALL "
    "SELECT 1, 'aggregation', count(*), count(DISTINCT o_orderstatus), 2 FROM orders WHERE o_totalprice > 50000",
)
def _(t):
    frame = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    steps = [
        {"tool": "row_filter", "parameters": {"conditions": [{"column": "o_totalprice", "operator": "gt", "value": 50000}]}},
        {
            "tool": "aggregation",
            "parameters": {"group_by": ["o_orderstatus"], "aggregations": [{"function": "count", "alias": "n"}]},
        },
    ]
    out = st.step_metrics(st.execute_steps(frame, steps))
    return rounded(out.select("step_index", "tool", "rows_before", "rows_after", "columns_after"))


# ---- sampling -------------------------------------------------------------------------


def _orders(t):
    return with_row_id(t("orders"), "o_orderkey")


@query("o5_simple_random", "SELECT 500::BIGINT AS n, 500::BIGINT AS different")
def _(t):
    sample = sa.sample_dataframe(_orders(t), "simple_random", sample_size=500, seed=7)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"))


@query("o6_systematic", "SELECT ceil(count(*) * 0.1)::BIGINT AS n, ceil(count(*) * 0.1)::BIGINT AS different FROM orders")
def _(t):
    sample = sa.sample_dataframe(_orders(t), "systematic", sample_fraction=0.1, seed=7)
    return sample.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("different"))


@query(
    "o7_stratified",
    "WITH s AS (SELECT o_orderpriority, count(*) AS size, min(o_orderkey) AS first FROM orders GROUP BY 1), "
    "p AS (SELECT *, size * 1000 // sum(size) OVER () AS whole, size * 1000 % sum(size) OVER () AS rest FROM s), "
    "r AS (SELECT *, row_number() OVER (ORDER BY rest DESC, first) AS k, 1000 - sum(whole) OVER () AS missing FROM p) "
    "SELECT o_orderpriority, size::BIGINT AS population_rows, (whole + CASE WHEN k <= missing THEN 1 ELSE 0 END)::BIGINT AS sample_rows FROM r",
)
def _(t):
    df = _orders(t)
    sample = sa.sample_dataframe(df, "stratified", sample_size=1000, seed=7, strata=["o_orderpriority"])
    return sa.stratum_counts(df, sample, ["o_orderpriority"])


@query("o8_bootstrap", "SELECT count(*)::BIGINT AS n FROM orders")
def _(t):
    return sa.sample_dataframe(_orders(t), "bootstrap", seed=7).agg(F.count(F.lit(1)).alias("n"))


# ---- SQL ------------------------------------------------------------------------------


@query(
    "q0_read_only_sql",
    "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderstatus, count(*)::BIGINT AS n, "
    "round(max(o_totalprice), 2) AS most FROM big GROUP BY o_orderstatus",
)
def _(t):
    df = t("orders")
    text = (
        "WITH big AS (SELECT * FROM dataset WHERE o_totalprice > 300000) SELECT o_orderstatus, count(*) AS n, "
        "round(max(o_totalprice), 2) AS most FROM big GROUP BY o_orderstatus"
    )
    return sq.sql_frame(df.sparkSession, {"dataset": df}, text)


@query(
    "u3_sql_over_frames",
    "SELECT c_mktsegment, count(*)::BIGINT AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 "
    "UNION ALL SELECT 'all', count(*) FROM orders",
)
def _(t):
    df = t("orders")
    text = (
        "SELECT c_mktsegment, count(*) AS orders FROM dataset JOIN people ON o_custkey = c_custkey GROUP BY 1 "
        "UNION ALL SELECT 'all', count(*) FROM dataset"
    )
    return sq.sql_frame(df.sparkSession, {"dataset": df, "people": t("customer")}, text)
