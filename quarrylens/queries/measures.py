"""KPI, period, chart and business queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.ids import with_row_id
from quarrylens.operators import business as bu
from quarrylens.operators import charts as ch
from quarrylens.operators import kpi as kp
from quarrylens.queries.registry import query, rounded


def _change_sql(where_current, where_prior, edges, keys=""):
    """Two ranges of orders side by side, with their change."""
    head = f"{keys}, " if keys else ""
    group = f" GROUP BY {keys}" if keys else ""
    current, prior = f"FILTER (WHERE {where_current})", f"FILTER (WHERE {where_prior})"
    a, b, c, d = edges
    return (
        f"SELECT {head}round(cv, 2) AS current_value, round(pv, 2) AS prior_value, cr AS current_rows, pr AS prior_rows, "
        "round(cv - pv, 2) AS absolute_change, round((cv - pv) / abs(pv) * 100, 4) AS percent_change, "
        "CASE WHEN cv > pv THEN 'increase' WHEN cv < pv THEN 'decrease' ELSE 'no_change' END AS movement, "
        f"CAST(NULL AS BOOLEAN) AS favorable, '{a}' AS current_start, '{b}' AS current_end, '{c}' AS prior_start, '{d}' AS prior_end "
        f"FROM (SELECT {head}sum(o_totalprice) {current} AS cv, sum(o_totalprice) {prior} AS pv, "
        f"(count(*) {current})::BIGINT AS cr, (count(*) {prior})::BIGINT AS pr FROM orders{group})"
    )


def _between(a, b):
    return f"o_orderdate >= DATE '{a}' AND o_orderdate < DATE '{b}' + INTERVAL 1 DAY"


def _edges(a, b, c, d):
    return _between(a, b), _between(c, d), (a, b, c, d)


def _change(df):
    money = {c: F.round(c, 2) for c in ("current_value", "prior_value", "absolute_change")}
    return rounded(df.withColumns({**money, "percent_change": F.round("percent_change", 4)}))


def _history(df):
    return rounded(df.withColumn("value", F.round("value", 2)))


@query(
    "k1_ratio_kpi",
    "SELECT o_orderstatus, period, round(n, 2) AS component_numerator, d AS component_denominator, round(n / d, 4) AS value, "
    "250000.0::DOUBLE AS target_value, CASE WHEN n / d >= 250000 THEN 'met' ELSE 'below_target' END AS status FROM ("
    "SELECT o_orderstatus, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS period, sum(o_totalprice) AS n, "
    "count(*)::BIGINT AS d FROM orders GROUP BY 1, 2)",
)
def _(t):
    definition = {
        "definition_type": "ratio",
        "components": {"numerator": {"column": "o_totalprice"}, "denominator": {"aggregation": "count"}},
        "target_value": 250000,
        "target_direction": "higher_is_better",
    }
    out = kp.calculate_kpi(
        t("orders"), definition, dimensions=["o_orderstatus"], time_column="o_orderdate", time_grain="quarter"
    )
    out = out.select(
        "o_orderstatus", "period", "component_numerator", "component_denominator", "value", "target_value", "status"
    )
    return rounded(out.withColumn("component_numerator", F.round("component_numerator", 2)), 4)


@query(
    "k2_formula_kpi_monthly",
    "SELECT strftime(o_orderdate, '%Y-%m') AS period, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') / "
    "sum(o_totalprice) * 100, 4) AS value FROM orders GROUP BY 1",
)
def _(t):
    definition = {
        "definition_type": "formula",
        "formula": "filled / total * 100",
        "components": {
            "filled": {
                "column": "o_totalprice",
                "filters": [{"column": "o_orderstatus", "operator": "eq", "value": "F"}],
            },
            "total": {"column": "o_totalprice"},
        },
    }
    out = kp.calculate_kpi(t("orders"), definition, time_column="o_orderdate", time_grain="month")
    return rounded(out.select("period", "value"), 4)


@query(
    "k2_kpi_with_total",
    "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS value, false AS is_total FROM orders GROUP BY 1 UNION ALL "
    "SELECT NULL, round(sum(o_totalprice), 2), true FROM orders",
)
def _(t):
    definition = {"definition_type": "aggregate", "components": {"value": {"column": "o_totalprice"}}}
    out = kp.calculate_kpi(t("orders"), definition, dimensions=["o_orderpriority"], include_total=True)
    return rounded(out.select("o_orderpriority", "value", "is_total"), 2)


_P = ("1998-01-01", "1998-03-31", "1997-01-01", "1997-03-31")


@query("k3_compare_periods", _change_sql(*_edges(*_P), keys="o_orderstatus"))
def _(t):
    dates = dict(zip(("current_start", "current_end", "prior_start", "prior_end"), _P, strict=True))
    out = kp.compare_periods(t("orders"), "o_orderdate", "o_totalprice", dimensions=["o_orderstatus"], **dates)
    return _change(out)


@query("k4_week_over_week", _change_sql(*_edges("1998-03-16", "1998-03-22", "1998-03-09", "1998-03-15")))
def _(t):
    return _change(kp.analyze_wow(t("orders"), "o_orderdate", "o_totalprice", reference_date="1998-03-18")[0])


@query("k5_month_over_month", _change_sql(*_edges("1998-03-01", "1998-03-31", "1998-02-01", "1998-02-28")))
def _(t):
    return _change(kp.analyze_mom(t("orders"), "o_orderdate", "o_totalprice", reference_date="1998-03-18")[0])


@query("k6_quarter_over_quarter", _change_sql(*_edges("1998-01-01", "1998-03-31", "1997-10-01", "1997-12-31")))
def _(t):
    out = kp.analyze_qoq(
        t("orders"), "o_orderdate", "o_totalprice", reference_date="1998-03-18", fiscal_year_start_month=4
    )
    return _change(out[0])


@query("k7_year_over_year", _change_sql(*_edges("1998-01-01", "1998-12-31", "1997-01-01", "1997-12-31")))
def _(t):
    return _change(kp.analyze_yoy(t("orders"), "o_orderdate", "o_totalprice", reference_date="1998-03-18")[0])


@query(
    "k11_month_history",
    "SELECT row_number() OVER (ORDER BY m)::BIGINT AS position, strftime(m, '%Y-%m') AS label, strftime(m, '%Y-%m-%d') AS start, "
    "strftime(last_day(m), '%Y-%m-%d') AS \"end\", round(coalesce(sum(o_totalprice), 0), 2) AS value, count(o_orderkey)::BIGINT AS rows "
    "FROM (SELECT unnest(generate_series(TIMESTAMP '1997-04-01', TIMESTAMP '1998-03-01', INTERVAL 1 MONTH)) AS m) "
    "LEFT JOIN orders ON date_trunc('month', o_orderdate) = m GROUP BY m",
)
def _(t):
    return _history(kp.analyze_mom(t("orders"), "o_orderdate", "o_totalprice", reference_date="1998-03-18")[1])


@query(
    "k11_year_history",
    "SELECT row_number() OVER (ORDER BY y)::BIGINT AS position, y::VARCHAR AS label, y || '-01-01' AS start, y || '-12-31' AS \"end\", "
    "round(coalesce(sum(o_totalprice), 0), 2) AS value, count(o_orderkey)::BIGINT AS rows FROM range(1994, 1999) r(y) "
    "LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y",
)
def _(t):
    return _history(kp.analyze_yoy(t("orders"), "o_orderdate", "o_totalprice", reference_date="1998-03-18")[1])


@query(
    "k8_target_variance",
    "SELECT o_orderpriority, round(a, 2) AS actual, 250000.0::DOUBLE AS target, round(a - 250000, 2) AS variance, "
    "round((a - 250000) / 250000 * 100, 4) AS variance_pct, round(a / 250000 * 100, 4) AS attainment_pct "
    "FROM (SELECT o_orderpriority, avg(o_totalprice) AS a FROM orders GROUP BY 1)",
)
def _(t):
    out = kp.analyze_target_variance(
        t("orders"), "o_totalprice", "mean", target_value=250000, dimensions=["o_orderpriority"]
    )
    out = out.select("o_orderpriority", "actual", "target", "variance", "variance_pct", "attainment_pct")
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("actual", "variance")}), 4)


@query(
    "k9_alert_rules",
    "WITH s AS (SELECT o_orderstatus AS region, sum(o_totalprice) AS v FROM orders GROUP BY 1), r AS (SELECT region, v, 0::BIGINT AS rule_index, "
    "'above' AS rule_type, v > 200000000 AS triggered FROM s UNION ALL SELECT region, v, 1, 'outside_range', v < 0 OR v > 1 FROM s WHERE region = 'F') "
    "SELECT region, round(v, 2) AS value, rule_index, rule_type, triggered, CASE WHEN triggered THEN 'triggered' ELSE 'condition_not_met' END AS reason FROM r",
)
def _(t):
    snapshots = t("orders").groupBy(F.col("o_orderstatus").alias("region")).agg(F.sum("o_totalprice").alias("value"))
    snapshots = snapshots.withColumn("kpi_slug", F.lit("sales"))
    rules = [
        {"rule_type": "above", "kpi_slug": "sales", "threshold": 200000000},
        {"rule_type": "outside_range", "kpi_slug": "sales", "lower_bound": 0, "upper_bound": 1, "dimensions": {"region": "F"}},
    ]
    return rounded(kp.evaluate_rules(snapshots, rules).drop("kpi_slug"), 2)


@query(
    "k10_cards",
    "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS current_value, "
    "format('{:,.2f}', sum(o_totalprice)) AS formatted_value FROM orders GROUP BY 1",
)
def _(t):
    sums = t("orders").groupBy("o_orderstatus").agg(F.sum("o_totalprice").alias("current_value"))
    return rounded(kp.build_cards(sums), 2)


# ---- charts ---------------------------------------------------------------------------


@query(
    "v1_bar_chart",
    "SELECT o_orderpriority, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1 ORDER BY avg(o_totalprice) DESC LIMIT 3",
)
def _(t):
    return rounded(ch.build_bar_chart(t("orders"), "o_orderpriority", "o_totalprice", aggregation="mean", top_n=3), 4)


@query(
    "v1_bar_chart_percent",
    "SELECT o_orderpriority, o_orderstatus, round(v / sum(v) OVER (PARTITION BY o_orderpriority) * 100, 6) AS value FROM ("
    "SELECT o_orderpriority, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)",
)
def _(t):
    return rounded(
        ch.build_bar_chart(
            t("orders"), "o_orderpriority", "o_totalprice", "o_orderstatus", normalize_percent=True
        )
    )


@query(
    "v2_line_chart_monthly",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
)
def _(t):
    out = ch.build_line_chart(
        t("orders"), "o_orderdate", "o_totalprice", parse_datetime=True, frequency="MS", fill_missing_intervals=True
    )
    return rounded(out.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("month"), "value"), 2)


@query(
    "v2_line_chart_rolling",
    "SELECT strftime(m, '%Y-%m-%d') AS month, round(avg(v) OVER (ORDER BY m ROWS 2 PRECEDING), 2) AS value FROM ("
    "SELECT date_trunc('month', o_orderdate) AS m, sum(o_totalprice) AS v FROM orders GROUP BY 1)",
)
def _(t):
    out = ch.build_line_chart(
        t("orders"), "o_orderdate", "o_totalprice", parse_datetime=True, frequency="MS", rolling_window=3
    )
    return rounded(out.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("month"), "value"), 2)


@query(
    "v3_area_chart_cumulative",
    "SELECT strftime(q, '%Y-%m-%d') AS quarter, o_orderstatus, round(sum(v) OVER (PARTITION BY o_orderstatus ORDER BY q), 2) AS value "
    "FROM (SELECT date_trunc('quarter', o_orderdate) AS q, o_orderstatus, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2)",
)
def _(t):
    out = ch.build_area_chart(
        t("orders"),
        "o_orderdate",
        "o_totalprice",
        series_column="o_orderstatus",
        parse_datetime=True,
        frequency="Q",
        cumulative=True,
    )
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("quarter")
    return rounded(out.select(day, "o_orderstatus", "value"), 2)


@query(
    "v4_pie_chart",
    "WITH g AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER "
    "(ORDER BY n DESC, o_orderpriority) AS k FROM g) SELECT CASE WHEN k <= 3 THEN o_orderpriority ELSE 'Other' END AS o_orderpriority, "
    "sum(n)::DOUBLE AS value, round(sum(n) / (SELECT sum(n) FROM g), 6) AS share FROM r GROUP BY 1",
)
def _(t):
    out = ch.build_pie_donut(t("orders"), "o_orderpriority", top_n=3)
    return rounded(out.withColumn("value", F.col("value").cast("double")))


@query(
    "v5_histogram",
    "WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part) SELECT b AS bin, "
    "round(lo + b * (hi - lo) / 8, 6) AS lower, round(lo + (b + 1) * (hi - lo) / 8, 6) AS upper, "
    "(SELECT count(*) FROM part WHERE p_retailprice >= lo + b * (hi - lo) / 8 AND (p_retailprice < lo + (b + 1) * (hi - lo) / 8 "
    "OR b = 7))::DOUBLE AS value FROM e, range(0, 8) r(b)",
)
def _(t):
    return rounded(ch.build_histogram(t("part"), "p_retailprice", bins=8))


@query("v6_scatter_points", "SELECT l_quantity, l_extendedprice FROM lineitem")
def _(t):
    return ch.build_scatter_bubble(t("lineitem"), "l_quantity", "l_extendedprice")


@query(
    "v7_box_summary",
    "WITH q AS (SELECT o_orderstatus AS g, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS m, "
    "quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY 1) SELECT g AS \"group\", count(*)::BIGINT AS count, "
    "round(avg(o_totalprice), 4) AS mean, round(m, 4) AS median, round(a, 4) AS q1, round(b, 4) AS q3, round(b - a, 4) AS iqr, "
    "round(a - 1.5 * (b - a), 4) AS lower_fence, round(b + 1.5 * (b - a), 4) AS upper_fence, min(o_totalprice) AS min, "
    "max(o_totalprice) AS max, count(*) FILTER (WHERE o_totalprice < a - 1.5 * (b - a) OR o_totalprice > b + 1.5 * (b - a))::BIGINT "
    "AS outlier_count FROM orders JOIN q ON o_orderstatus = g GROUP BY g, m, a, b",
)
def _(t):
    return rounded(ch.build_box_violin(t("orders"), "o_totalprice", "o_orderstatus"), 4)


@query(
    "v8_heatmap",
    "WITH v AS (SELECT l_quantity AS a, l_extendedprice AS b, l_discount AS c FROM lineitem) "
    "SELECT 'l_quantity' AS column_a, 1.0::DOUBLE AS l_quantity, round(corr(a, b), 6) AS l_extendedprice, round(corr(a, c), 6) AS l_discount FROM v "
    "UNION ALL SELECT 'l_extendedprice', round(corr(a, b), 6), 1.0, round(corr(b, c), 6) FROM v "
    "UNION ALL SELECT 'l_discount', round(corr(a, c), 6), round(corr(b, c), 6), 1.0 FROM v",
)
def _(t):
    return rounded(ch.build_heatmap(t("lineitem").select("l_quantity", "l_extendedprice", "l_discount")))


@query(
    "v9_pareto",
    "WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1) SELECT o_orderpriority, round(v, 2) AS value, "
    "round(sum(v) OVER w, 2) AS cumulative_value, round(sum(v) OVER w / sum(v) OVER () * 100, 4) AS cumulative_pct FROM g "
    "WINDOW w AS (ORDER BY v DESC ROWS UNBOUNDED PRECEDING)",
)
def _(t):
    out = ch.build_business_chart(t("orders"), "pareto", "o_orderpriority", "o_totalprice")
    return rounded(out.withColumns({c: F.round(c, 2) for c in ("value", "cumulative_value")}), 4)


@query(
    "v9_variance",
    "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS value, round(sum(l_quantity), 2) AS comparison, "
    "round(sum(l_extendedprice) - sum(l_quantity), 2) AS variance, "
    "round((sum(l_extendedprice) - sum(l_quantity)) / sum(l_quantity) * 100, 2) AS variance_pct FROM lineitem GROUP BY 1",
)
def _(t):
    out = ch.build_business_chart(
        t("lineitem"), "variance", "l_returnflag", "l_extendedprice", comparison_column="l_quantity"
    )
    return rounded(out, 2)


@query(
    "v9_funnel",
    "WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS v, min(o_orderkey) AS p FROM orders GROUP BY 1) "
    "SELECT o_orderpriority, round(v, 2) AS value, p::BIGINT AS position, round(v / first_value(v) OVER (ORDER BY p) * 100, 4) AS conversion_from_start_pct, "
    "round(coalesce(v / lag(v) OVER (ORDER BY p) * 100, 100), 4) AS conversion_from_previous_pct FROM g",
)
def _(t):
    out = ch.build_business_chart(
        t("orders"), "funnel", "o_orderpriority", "o_totalprice", order_column="o_orderkey"
    )
    return rounded(out.withColumn("value", F.round("value", 2)), 4)


@query("v10_recommendations")
def _(t):
    return ch.recommend_charts(t("lineitem"))


# ---- business -------------------------------------------------------------------------


def _sales(t):
    return t("orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("sales"),
        F.col("o_orderpriority").alias("category"),
    )


@query(
    "b1_bi_kpis",
    "SELECT count(*)::BIGINT AS rows, round(sum(o_totalprice), 2) AS total_sales, round(avg(o_totalprice), 2) AS average_sales FROM orders",
)
def _(t):
    return rounded(bu.bi_kpis(_sales(t)), 2)


@query(
    "b2_sales_over_time",
    "SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
)
def _(t):
    out = bu.build_bi_report(_sales(t))["sales_over_time"]
    return rounded(out.select(F.date_format("date", "yyyy-MM-dd").alias("month"), "value"), 2)


@query(
    "b3_project",
    "SELECT count(*)::BIGINT AS rows, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 2) AS average FROM orders",
)
def _(t):
    frames = bu.build_project(with_row_id(_sales(t), "order_id"), "superstore_sales_dashboard")
    return rounded(frames["kpis"], 2)


@query(
    "b3_project_trend",
    "WITH m AS (SELECT date_trunc('month', o_orderdate) AS d, sum(o_totalprice) AS v FROM orders GROUP BY 1), "
    "s AS (SELECT unnest(generate_series((SELECT min(d) FROM m), (SELECT max(d) FROM m), INTERVAL 1 MONTH)) AS d) "
    "SELECT strftime(s.d, '%Y-%m') AS month, round(coalesce(m.v, 0), 2) AS value FROM s LEFT JOIN m ON m.d = s.d",
)
def _(t):
    frame = bu.build_project(with_row_id(_sales(t), "order_id"), "superstore_sales_dashboard")["chart_1"]
    return rounded(frame.select(F.date_format("date", "yyyy-MM").alias("month"), "value"), 2)


@query(
    "b3_project_averages",
    "SELECT p_brand AS genre, round(avg(p_size), 6) AS value FROM part GROUP BY 1 ORDER BY avg(p_size) DESC, 1 LIMIT 12",
)
def _(t):
    films = t("part").select("p_partkey", F.col("p_brand").alias("genre"), F.col("p_size").alias("rating"))
    return rounded(bu.build_project(with_row_id(films, "p_partkey"), "movie_ratings_exploration")["chart_1"].select("genre", "value"))


@query(
    "b3_project_sums",
    "SELECT c_mktsegment AS department, sum((c_acctbal < 0)::INT)::DOUBLE AS value FROM customer GROUP BY 1",
)
def _(t):
    staff = t("customer").select(
        F.col("c_custkey").alias("employee_id"), F.col("c_mktsegment").alias("department"),
        (F.col("c_acctbal") < 0).cast("int").alias("left_company"), F.col("c_acctbal").alias("salary"))
    return rounded(bu.build_project(with_row_id(staff, "employee_id"), "hr_attrition")["chart_1"].select("department", "value"))


@query(
    "b3_project_funnel",
    "SELECT count(*)::BIGINT AS rows, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 2) AS average, "
    "round(avg(coalesce(l_linenumber * 100.0 / nullif(l_quantity, 0), 0)), 2) AS conversion_rate FROM lineitem",
)
def _(t):
    visits = t("lineitem").select(
        F.col("l_shipdate").alias("event_date"), F.col("l_returnflag").alias("channel"), F.col("l_quantity").alias("visitors"),
        F.col("l_linenumber").alias("purchases"), F.col("l_extendedprice").alias("revenue"))
    return rounded(bu.build_project(visits, "ecommerce_funnel")["kpis"], 2)


@query(
    "b3_project_driver",
    "SELECT o_orderpriority AS merchant_category, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 1 LIMIT 24",
)
def _(t):
    paid = t("orders").select(F.col("o_totalprice").alias("amount"), F.col("o_orderpriority").alias("merchant_category"))
    return rounded(bu.build_project(paid, "fraud_detection")["chart_driver"], 2)


@query(
    "b3_project_detail",
    "SELECT o_orderpriority AS region, count(*)::BIGINT AS count, round(sum(o_totalprice), 2) AS sum, round(avg(o_totalprice), 2) AS mean "
    "FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 12",
)
def _(t):
    sold = _sales(t).withColumnRenamed("category", "region")
    return rounded(bu.build_project(with_row_id(sold, "order_id"), "superstore_sales_dashboard")["detail_2"], 2)


@query(
    "b4_rfm",
    "WITH g AS (SELECT o_custkey AS customer_id, max(o_orderdate) AS d, count(DISTINCT o_orderkey)::BIGINT AS frequency, sum(o_totalprice) AS m "
    "FROM orders GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY m, customer_id) AS k, count(*) OVER () AS n, max(d) OVER () AS a FROM g) "
    "SELECT customer_id, date_diff('day', d, a)::BIGINT AS recency_days, frequency, round(m, 2) AS monetary_value, 1::BIGINT AS customer_count, "
    "['Bronze', 'Silver', 'Gold', 'Platinum'][greatest(1, ceil(4.0 * (k - 1) / (n - 1)))::INT] AS rfm_segment FROM r",
)
def _(t):
    return rounded(bu.rfm_segments(t("orders"), "o_custkey", "o_orderdate", "o_totalprice", "o_orderkey"), 2)


@query(
    "b5_conversion_rate",
    "SELECT l_returnflag, round(sum(l_quantity) / sum(l_extendedprice) * 100, 6) AS conversion_rate FROM lineitem GROUP BY 1",
)
def _(t):
    sums = t("lineitem").groupBy("l_returnflag").agg(
        F.sum("l_quantity").alias("a"), F.sum("l_extendedprice").alias("b")
    )
    return rounded(bu.conversion_rate(sums, "a", "b").select("l_returnflag", "conversion_rate"))


@query(
    "b6_ab_lift",
    "WITH g AS (SELECT quality, avg(toxic) * 100 AS r FROM labels GROUP BY 1) SELECT round(a.r, 6) AS control_rate, "
    "round(b.r, 6) AS treatment_rate, 2::BIGINT AS groups, round(b.r - a.r, 6) AS lift FROM g a, g b WHERE a.quality = 0 AND b.quality = 1",
)
def _(t):
    return rounded(bu.ab_lift(t("labels"), "quality", "toxic"))


@query(
    "b7_forecast_baseline",
    "SELECT o_orderkey, round(avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS 2 PRECEDING), 4) AS forecast_baseline FROM orders",
)
def _(t):
    out = bu.forecast_baseline(with_row_id(t("orders"), "o_orderkey"), "o_orderdate", "o_totalprice")
    return rounded(out.select("o_orderkey", "forecast_baseline"), 4)


@query(
    "b8_inventory",
    "WITH c AS (SELECT *, p_size * p_retailprice AS v FROM part), s AS (SELECT *, sum(v) OVER (ORDER BY v DESC, p_partkey ROWS UNBOUNDED PRECEDING) / sum(v) OVER () AS x FROM c) "
    "SELECT p_partkey, round(v, 4) AS inventory_value, CASE WHEN x <= 0.8 THEN 'A' WHEN x <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM s",
)
def _(t):
    df = with_row_id(t("part").withColumn("sold", F.col("p_size") % 5), "p_partkey")
    out = bu.inventory_metrics(df, "p_size", "p_retailprice", "sold")
    return rounded(out.select("p_partkey", "inventory_value", "abc_class"), 4)


@query(
    "b9_abc_classes",
    "WITH c AS (SELECT p_partkey, sum(p_retailprice) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) / "
    "sum(p_retailprice) OVER () AS s FROM part) SELECT p_partkey, CASE WHEN s <= 0.8 THEN 'A' WHEN s <= 0.95 THEN 'B' ELSE 'C' END AS abc_class FROM c",
)
def _(t):
    out = bu.abc_classes(with_row_id(t("part"), "p_partkey"), "p_retailprice")
    return out.select("p_partkey", "abc_class")


@query(
    "b10_returns_and_volatility",
    "WITH r AS (SELECT event_id, user_id, coalesce(value / lag(value) OVER (PARTITION BY user_id ORDER BY event_id) - 1, 0) AS x, "
    "lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events WHERE value > 0) "
    "SELECT event_id, round(x, 6) AS \"return\" FROM r",
)
def _(t):
    out = bu.returns_and_volatility(t("events").where("value > 0"), "user_id", "value", "event_id")
    return rounded(out.select("event_id", "return"))


@query(
    "b11_marketing_roi",
    "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_tax > 0 THEN round((l_extendedprice - l_tax) / l_tax, 2) END AS marketing_roi "
    "FROM lineitem WHERE l_tax > 0",
)
def _(t):
    out = bu.marketing_roi(t("lineitem").where("l_tax > 0"), "l_extendedprice", "l_tax")
    return rounded(out.select("l_orderkey", "l_linenumber", "marketing_roi"), 2)


@query(
    "o2_top_table",
    "SELECT p_brand, round(sum(p_retailprice), 2) AS p_retailprice FROM part GROUP BY 1 ORDER BY sum(p_retailprice) DESC, p_brand LIMIT 10",
)
def _(t):
    return rounded(bu.top_table(t("part"), "p_brand", "p_retailprice"), 2)
