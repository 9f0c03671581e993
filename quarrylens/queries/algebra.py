"""Projections, filters, sorting, aggregation, joins and windows over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarrylens.errors import EngineError
from quarrylens.functions.formulas import compile_formula
from quarrylens.ids import with_row_id
from quarrylens.operators import aggregate as ag
from quarrylens.operators import columns as co
from quarrylens.operators import filters as fi
from quarrylens.operators import joins as jo
from quarrylens.operators import kpi as kp
from quarrylens.operators import windows as wi
from quarrylens.queries.registry import query, rounded

L_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


@query("p1_rename_columns", "SELECT c_custkey AS id, c_name AS customer, c_acctbal FROM customer")
def _(t):
    df = t("customer").select("c_custkey", "c_name", "c_acctbal")
    return co.rename_columns(df, {"c_custkey": "id", "c_name": "customer"})


@query("p2_delete_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def _(t):
    return co.delete_columns(t("customer"), ["c_name", "c_nationkey"])


@query("p3_reorder_columns", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def _(t):
    return co.reorder_columns(t("customer"), ["c_mktsegment", "c_custkey"], append_unspecified=True)


@query("p4_duplicate_column", "SELECT *, c_acctbal AS balance_copy FROM customer")
def _(t):
    return co.duplicate_column(t("customer"), "c_acctbal", "balance_copy", insert_after_source=True)


@query("p5_column_operations", "SELECT c_mktsegment AS segment, c_mktsegment AS segment2, c_custkey, c_acctbal FROM customer")
def _(t):
    return co.apply_column_operations(
        t("customer"),
        [
            {"type": "rename", "mapping": {"c_mktsegment": "segment"}},
            {"type": "delete", "columns": ["c_name", "c_nationkey"]},
            {"type": "duplicate", "source": "segment", "target": "segment2"},
            {"type": "reorder", "columns": ["segment"], "append_unspecified": True},
        ],
    )


@query(
    "p6_type_conversions",
    "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS o_custkey, round(o_totalprice, 4) AS o_totalprice, "
    "CAST(left(o_orderpriority, 1) AS BIGINT) AS level, o_orderstatus = 'F' AS filled, "
    "strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders",
)
def _(t):
    df = t("orders").select(
        "o_orderkey",
        F.col("o_orderkey").alias("o_custkey"),
        F.col("o_totalprice").cast("string").alias("o_totalprice"),
        F.substring("o_orderpriority", 1, 1).alias("level"),
        F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("filled"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )
    out = co.apply_type_conversions(
        df,
        [
            {"column": "o_custkey", "target_type": "string"},
            {"column": "o_totalprice", "target_type": "float"},
            {"column": "level", "target_type": "integer", "policy": "coerce"},
            {"column": "filled", "target_type": "boolean"},
            {"column": "day", "target_type": "date"},
        ],
    )
    return rounded(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 4)


@query(
    "p6_conversion_metrics",
    "SELECT 'o_orderpriority' AS \"column\", 'integer' AS target_type, count(*)::BIGINT AS invalid_count, "
    "0::BIGINT AS changed_cells FROM orders",
)
def _(t):
    spec = {"column": "o_orderpriority", "target_type": "integer", "policy": "coerce"}
    return rounded(co.conversion_metrics(t("orders"), [spec]))


def _col(name):
    return {"op": "column", "name": name}


def _lit(value):
    return {"op": "literal", "value": value}


def _two(op, left, right):
    return {"op": op, "left": left, "right": right}


@query(
    "p7_calculated_columns",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, "
    "round(l_extendedprice / nullif(l_quantity, 0), 8) AS unit, "
    "round(l_quantity - 7 * floor(l_quantity / 7), 4) AS rest, round(power(l_tax, 2), 6) AS squared, "
    "l_discount >= 0.05 AND l_quantity < 20 AS small_deal, "
    "upper(l_returnflag) || '-' || l_linestatus AS flags, "
    "CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'kept' END AS state, "
    "round(abs(-l_tax), 6) AS tax, coalesce(l_returnflag, 'none') AS flag FROM lineitem",
)
def _(t):
    calc = [
        ("net", _two("multiply", _col("l_extendedprice"), _two("subtract", _lit(1), _col("l_discount")))),
        ("unit", _two("divide", _col("l_extendedprice"), _col("l_quantity"))),
        ("rest", _two("mod", _col("l_quantity"), _lit(7))),
        ("squared", _two("power", _col("l_tax"), _lit(2))),
        (
            "small_deal",
            _two("and", _two("gte", _col("l_discount"), _lit(0.05)), _two("lt", _col("l_quantity"), _lit(20))),
        ),
        (
            "flags",
            {
                "op": "concat",
                "separator": "-",
                "args": [{"op": "upper", "value": _col("l_returnflag")}, _col("l_linestatus")],
            },
        ),
        (
            "state",
            {
                "op": "if_else",
                "condition": _two("eq", _col("l_returnflag"), _lit("R")),
                "then": _lit("returned"),
                "else": _lit("kept"),
            },
        ),
        ("tax", {"op": "abs", "value": {"op": "negate", "value": _col("l_tax")}}),
        ("flag", {"op": "coalesce", "args": [_col("l_returnflag"), _lit("none")]}),
    ]
    out = co.apply_calculated_columns(t("lineitem"), [{"name": n, "expression": e} for n, e in calc])
    out = out.select("l_orderkey", "l_linenumber", *[n for n, _ in calc])
    return out.withColumns(
        {
            "l_linenumber": F.col("l_linenumber").cast("int"),
            "net": F.round("net", 4),
            "unit": F.round("unit", 8),
            "rest": F.round("rest", 4),
            "squared": F.round("squared", 6),
            "tax": F.round("tax", 6),
        }
    )


@query(
    "p8_equal_width_bins",
    "WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) "
    "SELECT c_custkey, 'bin_' || (CASE WHEN c_acctbal <= lo + (hi - lo) / 4 THEN 1 "
    "WHEN c_acctbal <= lo + 2 * (hi - lo) / 4 THEN 2 WHEN c_acctbal <= lo + 3 * (hi - lo) / 4 THEN 3 ELSE 4 END) "
    "AS band FROM customer, e",
)
def _(t):
    spec = {"column": "c_acctbal", "method": "equal_width", "bins": 4, "output_column": "band"}
    return co.apply_binning(t("customer"), [spec]).select("c_custkey", "band")


@query(
    "p8_custom_bins",
    "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium' "
    "WHEN p_size > 25 AND p_size <= 40 THEN 'large' END AS size_class FROM part",
)
def _(t):
    spec = {
        "column": "p_size",
        "method": "custom",
        "edges": [1, 10, 25, 40],
        "labels": ["small", "medium", "large"],
        "output_column": "size_class",
    }
    return co.apply_binning(t("part"), [spec]).select("p_partkey", "size_class")


@query(
    "p8_quantile_bins",
    "WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.5) AS b, "
    "quantile_cont(o_totalprice, 0.75) AS c FROM orders) SELECT quarter, count(*) AS n FROM (SELECT CASE WHEN "
    "o_totalprice <= a THEN 'bin_1' WHEN o_totalprice <= b THEN 'bin_2' WHEN o_totalprice <= c THEN 'bin_3' ELSE 'bin_4' "
    "END AS quarter FROM orders, q) GROUP BY quarter",
)
def _(t):
    spec = {"column": "o_totalprice", "method": "quantile", "bins": 4, "output_column": "quarter"}
    return co.apply_binning(t("orders"), [spec]).groupBy("quarter").agg(F.count(F.lit(1)).alias("n"))


@query(
    "p9_formula",
    "SELECT l_returnflag, round(sum(l_extendedprice) / nullif(sum(l_quantity), 0) * 100 - 5, 4) AS value "
    "FROM lineitem GROUP BY l_returnflag",
)
def _(t):
    sums = t("lineitem").groupBy("l_returnflag").agg(
        F.sum("l_extendedprice").alias("price"), F.sum("l_quantity").alias("quantity")
    )
    value = compile_formula("price / quantity * 100 - 5", {"price": F.col("price"), "quantity": F.col("quantity")})
    return sums.select("l_returnflag", F.round(value, 4).alias("value"))


def _one(op, value, **more):
    return {"op": op, "value": value, **more}


@query(
    "p7_tests_and_texts",
    "SELECT event_id, coalesce(user_id = 3, false) AS eq, NOT coalesce(user_id = 3, false) AS ne, coalesce(value > 50, false) AS gt, "
    "coalesce(value <= 50, false) AS lte, coalesce(value > 50, false) OR coalesce(user_id = 3, false) AS either, "
    "NOT coalesce(value > 50, false) AS no, value IS NULL AS missing, value IS NOT NULL AS there, "
    "lower(event_type) AS small, trim('  ' || event_type || ' ') AS bare, round_even(value, 1) AS near "
    "FROM (SELECT event_id, user_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, event_type FROM events)",
)
def _(t):
    value = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    df = t("events").select("event_id", "user_id", value.alias("value"), "event_type")
    big, three = _two("gt", _col("value"), _lit(50)), _two("eq", _col("user_id"), _lit(3))
    padded = {"op": "concat", "args": [_lit("  "), _col("event_type"), _lit(" ")]}
    calc = {
        "eq": three, "ne": _two("ne", _col("user_id"), _lit(3)), "gt": big, "lte": _two("lte", _col("value"), _lit(50)),
        "either": _two("or", big, three), "no": _one("not", big), "missing": _one("is_null", _col("value")),
        "there": _one("not_null", _col("value")), "small": _one("lower", _col("event_type")), "bare": _one("trim", padded),
        "near": _one("round", _col("value"), digits=1),
    }
    out = co.apply_calculated_columns(df, [{"name": n, "expression": e} for n, e in calc.items()])
    return rounded(out.select("event_id", *calc))


@query(
    "p10_built_in_ratios",
    "SELECT o_orderstatus, round((r - c) / r * 100, 6) AS gross_margin_pct, round(r / n, 4) AS average_order_value FROM ("
    "SELECT o_orderstatus, sum(o_totalprice) AS r, sum(o_totalprice * 0.6) AS c, count(*) AS n FROM orders GROUP BY 1)",
)
def _(t):
    sums = t("orders").groupBy("o_orderstatus").agg(
        F.sum("o_totalprice").alias("revenue"), F.sum(F.col("o_totalprice") * 0.6).alias("cost"),
        F.count(F.lit(1)).alias("orders"))
    out = kp.built_in_ratios(sums)
    return rounded(out.select("o_orderstatus", "gross_margin_pct", F.round("average_order_value", 4).alias("average_order_value")))


# ---- filters --------------------------------------------------------------------------


@query(
    "f1_nulls_and_endings",
    "SELECT event_id FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN value END AS value, "
    "CASE WHEN event_id % 3 <> 0 THEN event_type END AS event_type FROM events) WHERE (value IS NULL AND event_type IS NOT NULL "
    "AND NOT contains(event_type, 'ick')) OR (value IS NOT NULL AND ends_with(event_type, 'e'))",
)
def _(t):
    value = F.when(F.col("event_id") % 4 != 0, F.col("value"))
    kind = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    df = t("events").select("event_id", value.alias("value"), kind.alias("event_type"))
    empty = fi.apply_row_filter(df, [
        {"column": "value", "operator": "is_null"}, {"column": "event_type", "operator": "not_null"},
        {"column": "event_type", "operator": "not_contains", "value": "ick"}])
    filled = fi.apply_row_filter(df, [
        {"column": "value", "operator": "not_null"}, {"column": "event_type", "operator": "ends_with", "value": "e"}])
    return empty.unionByName(filled).select("event_id")


@query(
    "j4_cardinality",
    "SELECT v AS validate, CASE v WHEN 'one_to_one' THEN o AND c WHEN 'one_to_many' THEN o ELSE c END AS holds FROM "
    "(SELECT count(*) = count(DISTINCT o_custkey) AS o FROM orders), (SELECT count(*) = count(DISTINCT c_custkey) AS c FROM customer), "
    "(SELECT unnest(['one_to_one', 'one_to_many', 'many_to_one']) AS v)",
)
def _(t):
    orders, customers = t("orders"), t("customer")
    found = []
    for rule in ("one_to_one", "one_to_many", "many_to_one"):
        try:
            jo.check_cardinality(orders, customers, [{"left": "o_custkey", "right": "c_custkey"}], rule)
            found.append((rule, True))
        except EngineError as exc:
            if exc.code != "CARDINALITY_VIOLATION":
                raise
            found.append((rule, False))
    return orders.sparkSession.createDataFrame(found, "validate string, holds boolean")


@query(
    "f1_row_filter",
    "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 "
    "AND o_orderstatus IN ('F', 'O') AND contains(lower(o_orderpriority), 'high') AND o_custkey <> 5",
)
def _(t):
    found = fi.apply_row_filter(
        t("orders"),
        [
            {"column": "o_totalprice", "operator": "between", "lower": 1000, "upper": 200000},
            {"column": "o_orderstatus", "operator": "in", "values": ["F", "O"]},
            {"column": "o_orderpriority", "operator": "contains", "value": "HIGH", "case_sensitive": False},
            {"column": "o_custkey", "operator": "ne", "value": 5},
        ],
    )
    return found.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(
    "f1_row_filter_or_inverted",
    "SELECT p_partkey FROM part WHERE NOT (p_size < 10 OR p_name LIKE 'red%' OR p_type NOT IN ('ECONOMY'))",
)
def _(t):
    found = fi.apply_row_filter(
        t("part"),
        [
            {"column": "p_size", "operator": "lt", "value": 10},
            {"column": "p_name", "operator": "starts_with", "value": "red"},
            {"column": "p_type", "operator": "not_in", "values": ["ECONOMY"]},
        ],
        logic="or",
        invert=True,
    )
    return found.select("p_partkey")


@query(
    "f1_filter_metrics",
    "SELECT count(*)::BIGINT AS rows_before, count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'F')::BIGINT "
    "AS matched_rows, count(*) FILTER (WHERE NOT (o_totalprice > 100000 AND o_orderstatus = 'F'))::BIGINT AS removed_rows, "
    "round(count(*) FILTER (WHERE o_totalprice > 100000 AND o_orderstatus = 'F') * 100.0 / count(*), 6) AS match_percentage, "
    "count(*) FILTER (WHERE o_totalprice > 100000)::BIGINT AS condition_0_matched, "
    "count(*) FILTER (WHERE o_orderstatus = 'F')::BIGINT AS condition_1_matched FROM orders",
)
def _(t):
    conditions = [
        {"column": "o_totalprice", "operator": "gt", "value": 100000},
        {"column": "o_orderstatus", "operator": "eq", "value": "F"},
    ]
    return rounded(fi.row_filter_metrics(t("orders"), conditions))


@query(
    "f2_kpi_filters",
    "SELECT count(*)::BIGINT AS n FROM orders WHERE o_totalprice >= 5000 AND o_orderstatus IN ('O') "
    "AND contains(lower(o_orderpriority), 'low')",
)
def _(t):
    from quarrylens.functions.conditions import kpi_filters

    df = t("orders")
    conditions = [
        {"column": "o_totalprice", "operator": "gte", "value": 5000},
        {"column": "o_orderstatus", "operator": "in", "value": ["O"]},
        {"column": "o_orderpriority", "operator": "contains", "value": "LOW"},
    ]
    return df.where(kpi_filters(df, conditions)).agg(F.count(F.lit(1)).alias("n"))


@query(
    "f3_dashboard_filters",
    "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate <= TIMESTAMP '1998-06-30' "
    "AND o_orderstatus = 'F' AND o_totalprice > 1000",
)
def _(t):
    specs = [
        {"id": "when", "column": "o_orderdate", "operator": "date_range", "value_type": "date"},
        {"id": "status", "column": "o_orderstatus", "operator": "eq", "default": "F"},
        {"id": "least", "column": "o_totalprice", "operator": "gt", "value_type": "number", "scope": ["table"]},
    ]
    state = {"when": {"start": "1997-01-01", "end": "1998-06-30"}, "least": 1000}
    return fi.apply_dashboard_filters(t("orders"), specs, state, widget="table").select("o_orderkey")


@query("f4_report_filters", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 7")
def _(t):
    values = {"c_mktsegment": "BUILDING", "c_nationkey": 7, "c_name": ""}
    return fi.filter_fields(t("customer"), values).select("c_custkey")


@query(
    "f5_slicer_values",
    "SELECT DISTINCT 'o_orderstatus' AS field, o_orderstatus AS value FROM orders UNION ALL "
    "SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders",
)
def _(t):
    return fi.slicer_values(t("orders"), ["o_orderstatus", "o_orderpriority"])


@query(
    "o1_sort",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, "
    "row_number() OVER (ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders",
)
def _(t):
    keys = [
        "o_orderstatus",
        {"column": "o_totalprice", "direction": "desc"},
        {"column": "o_orderkey", "direction": "asc"},
    ]
    from quarrylens.operators.ordered import Ordered, order_keys

    return (
        Ordered(t("orders"), [], order_keys(keys))
        .number("place")
        .df.select("o_orderkey", "o_orderstatus", "o_totalprice", "place")
    )


@query(
    "o4_table_view",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' "
    "ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
)
def _(t):
    return fi.table_view(
        t("orders"),
        ["o_orderkey", "o_totalprice"],
        [{"column": "o_orderstatus", "operator": "eq", "value": "F"}],
        [{"column": "o_totalprice", "direction": "desc"}, "o_orderkey"],
        page=3,
        page_size=25,
    )


@query(
    "o4_table_totals",
    "SELECT count(*)::BIGINT AS total_rows, round(sum(o_totalprice), 2) AS total_o_totalprice FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    condition = {"column": "o_orderstatus", "operator": "eq", "value": "F"}
    return rounded(fi.table_totals(t("orders"), ["o_totalprice"], [condition]), 2)


# ---- aggregation ----------------------------------------------------------------------


@query(
    "a1_aggregate",
    "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS row_count, round(sum(l_quantity), 4) AS quantity, "
    "round(avg(l_extendedprice), 4) AS mean_price, min(l_discount) AS least, max(l_discount) AS most, "
    "round(median(l_extendedprice), 4) AS middle, count(DISTINCT l_suppkey)::BIGINT AS suppliers "
    "FROM lineitem GROUP BY l_returnflag, l_linestatus",
)
def _(t):
    out = ag.aggregate_dataframe(
        t("lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            {"function": "count", "alias": "row_count"},
            {"function": "sum", "column": "l_quantity", "alias": "quantity"},
            {"function": "avg", "column": "l_extendedprice", "alias": "mean_price"},
            {"function": "min", "column": "l_discount", "alias": "least"},
            {"function": "max", "column": "l_discount", "alias": "most"},
            {"function": "median", "column": "l_extendedprice", "alias": "middle"},
            {"function": "distinct", "column": "l_suppkey", "alias": "suppliers"},
        ],
    )
    return rounded(out, 4)


@query(
    "a2_group_annotations",
    "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey)::BIGINT AS group_size, "
    "dense_rank() OVER (ORDER BY first_key)::BIGINT AS group_id FROM (SELECT *, min(o_orderkey) OVER "
    "(PARTITION BY o_custkey) AS first_key FROM orders)",
)
def _(t):
    out = ag.analyze_groups(
        t("orders"),
        ["o_custkey"],
        add_group_id=True,
        group_id_column="group_id",
        add_group_size=True,
        group_size_column="group_size",
        order_column="o_orderkey",
    )
    return rounded(out.select("o_orderkey", "group_size", "group_id"))


@query(
    "a2_group_statistics",
    "SELECT count(*)::BIGINT AS group_count, sum(n)::BIGINT AS grouped_rows, min(n)::BIGINT AS min_group_size, "
    "max(n)::BIGINT AS max_group_size, round(avg(n), 6) AS mean_group_size, count(*) FILTER (WHERE n = 1)::BIGINT AS "
    "singleton_groups, median(n)::DOUBLE AS median_group_size FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)",
)
def _(t):
    return rounded(ag.group_statistics(t("orders"), ["o_custkey"]))


@query(
    "a3_pivot",
    "SELECT o_orderpriority, "
    + ", ".join(
        f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS total__{s}, "
        f"count(*) FILTER (WHERE o_orderstatus = '{s}')::BIGINT AS n__{s}"
        for s in "FOP"
    )
    + ", round(sum(o_totalprice), 2) AS \"total__Total\", count(*)::BIGINT AS \"n__Total\" FROM orders GROUP BY o_orderpriority",
)
def _(t):
    out = ag.pivot_dataframe(
        t("orders"),
        ["o_orderpriority"],
        ["o_orderstatus"],
        [
            {"function": "sum", "column": "o_totalprice", "alias": "total"},
            {"function": "count", "alias": "n"},
        ],
        add_column_totals=True,
    )
    return rounded(out, 2)


@query(
    "a4_unpivot",
    "SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL "
    "SELECT p_partkey, 'p_retailprice', round(p_retailprice, 4) FROM part",
)
def _(t):
    return rounded(ag.unpivot_dataframe(t("part"), ["p_partkey"], ["p_size", "p_retailprice"]), 4)


@query(
    "a5_contingency",
    "SELECT row_value, column_value, n AS count, rt AS row_total, ct AS column_total, total, round(n / rt, 6) AS row_share, "
    "round(n / ct, 6) AS column_share, round(n / total, 6) AS total_share, round(rt * ct / total, 6) AS expected FROM ("
    "SELECT row_value, column_value, n, (sum(n) OVER (PARTITION BY row_value))::BIGINT AS rt, "
    "(sum(n) OVER (PARTITION BY column_value))::BIGINT AS ct, (sum(n) OVER ())::BIGINT AS total FROM ("
    "SELECT o_orderstatus AS row_value, o_orderpriority AS column_value, count(*)::BIGINT AS n FROM orders GROUP BY 1, 2))",
)
def _(t):
    return rounded(ag.contingency_table(t("orders"), "o_orderstatus", "o_orderpriority"))


@query("a6_approximate_summary")
def _(t):
    out = ag.approximate_summary(t("lineitem"), ["l_quantity", "l_extendedprice"])
    return out.withColumn("approx_quantiles", F.concat_ws(",", F.col("approx_quantiles").cast("array<string>")))


@query(
    "u1_concatenate",
    "SELECT 'customers' AS origin, c_custkey AS id, round(c_acctbal, 2) AS balance FROM customer UNION ALL "
    "SELECT 'suppliers', s_suppkey, round(s_acctbal, 2) FROM supplier",
)
def _(t):
    a = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    b = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    frames = [("customers", a), ("suppliers", b)]
    return rounded(ag.concatenate_dataframes(frames, add_source_column=True, source_column_name="origin"), 2)


@query(
    "u1_concatenate_distinct",
    "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier",
)
def _(t):
    a = t("customer").select(F.col("c_nationkey").alias("nation"))
    b = t("supplier").select(F.col("s_nationkey").alias("nation"))
    return ag.concatenate_dataframes([("a", a), ("b", b)], drop_duplicate_rows=True)


@query(
    "o2_top_categories",
    "WITH s AS (SELECT p_brand, sum(p_retailprice) AS v FROM part GROUP BY 1), "
    "r AS (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) AS k FROM s) "
    "SELECT CASE WHEN k <= 5 THEN p_brand ELSE 'Other' END AS p_brand, round(sum(v), 2) AS v, "
    "round(sum(v) / (SELECT sum(v) FROM s), 2) AS share FROM r GROUP BY 1",
)
def _(t):
    sums = t("part").groupBy("p_brand").agg(F.sum("p_retailprice").alias("v"))
    return rounded(ag.top_categories(sums, "p_brand", "v", 5), 2)


# ---- joins ----------------------------------------------------------------------------


@query(
    "j1_inner_join",
    "SELECT o_orderkey, c_custkey, c_name, round(o_totalprice, 2) AS o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def _(t):
    keys = [{"left": "o_custkey", "right": "c_custkey"}]
    out = jo.apply_join(t("orders"), t("customer"), "inner", keys, validate="many_to_one")
    return rounded(out.select("o_orderkey", "c_custkey", "c_name", "o_totalprice"), 2)


@query(
    "j1_full_join_status",
    "SELECT c_custkey, o_orderkey, CASE WHEN c_custkey IS NULL THEN 'right_only' WHEN o_orderkey IS NULL THEN 'left_only' "
    "ELSE 'both' END AS __join_status FROM customer FULL JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') ON c_custkey = o_custkey",
)
def _(t):
    keys = [{"left": "c_custkey", "right": "o_custkey"}]
    right = t("orders").where("o_orderstatus = 'P'")
    out = jo.apply_join(t("customer"), right, "full", keys, add_match_status=True)
    return out.select("c_custkey", "o_orderkey", "__join_status")


@query(
    "j1_null_keys_match",
    "SELECT a.p_partkey, b.s_suppkey FROM (SELECT p_partkey, nullif(p_size % 5, 0) AS k FROM part) a "
    "LEFT JOIN (SELECT s_suppkey, nullif(s_suppkey % 50, 0) AS k FROM supplier) b ON a.k IS NOT DISTINCT FROM b.k",
)
def _(t):
    a = t("part").select("p_partkey", F.nullif(F.col("p_size") % 5, F.lit(0)).alias("k"))
    b = t("supplier").select("s_suppkey", F.nullif(F.col("s_suppkey") % 50, F.lit(0)).alias("k"))
    out = jo.apply_join(a, b, "left", [{"left": "k", "right": "k"}], null_keys="match")
    return out.select("p_partkey", "s_suppkey")


@query("j2_cross_join", "SELECT c_custkey, n_name FROM customer CROSS JOIN nation")
def _(t):
    return jo.apply_join(t("customer"), t("nation"), "cross").select("c_custkey", "n_name")


@query(
    "j3_self_join_suffixes",
    "SELECT a.n_nationkey AS n_nationkey_left, a.n_name AS n_name_left, a.n_regionkey, b.n_nationkey AS n_nationkey_right, "
    "b.n_name AS n_name_right FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey",
)
def _(t):
    keys = [{"left": "n_regionkey", "right": "n_regionkey"}]
    return jo.apply_join(t("nation"), t("nation"), "inner", keys)


@query("j5_matched_rows", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def _(t):
    keys = [{"left": "c_custkey", "right": "o_custkey"}]
    return jo.matched_rows(t("customer"), t("orders"), keys).select("c_custkey")


@query("j5_unmatched_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    keys = [{"left": "c_custkey", "right": "o_custkey"}]
    return jo.unmatched_keys(t("customer"), t("orders"), keys, limit=None).select("c_custkey")


@query(
    "j5_join_metrics",
    "SELECT (SELECT count(*) FROM customer)::BIGINT AS left_rows, (SELECT count(*) FROM orders)::BIGINT AS right_rows, "
    "count(*)::BIGINT AS matched_output_rows, count(DISTINCT c_custkey)::BIGINT AS matched_left_rows, count(DISTINCT o_orderkey)::BIGINT AS matched_right_rows, "
    "count(DISTINCT c_custkey)::BIGINT AS matched_keys, ((SELECT count(*) FROM customer) - count(DISTINCT c_custkey))::BIGINT AS unmatched_left_rows, "
    "((SELECT count(*) FROM orders) - count(DISTINCT o_orderkey))::BIGINT AS unmatched_right_rows FROM customer JOIN orders ON c_custkey = o_custkey",
)
def _(t):
    return jo.join_metrics(t("customer"), t("orders"), [{"left": "c_custkey", "right": "o_custkey"}])


@query("j6_merge_compatibility")
def _(t):
    keys = [{"left": "c_custkey", "right": "o_custkey"}]
    return jo.analyze_merge_compatibility(t("customer"), t("orders"), keys)


# ---- windows --------------------------------------------------------------------------


@query(
    "w1_ranking",
    "SELECT o_orderkey, rank() OVER w::BIGINT AS by_price, dense_rank() OVER d::BIGINT AS by_day, "
    "round(percent_rank() OVER w, 6) AS share FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC), "
    "d AS (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC)",
)
def _(t):
    price = {"partition_by": ["o_orderstatus"], "order_by": [{"column": "o_totalprice"}]}
    out = wi.apply_ranking(
        t("orders"),
        [
            {"method": "rank", "output_column": "by_price", **price},
            {
                "method": "dense_rank",
                "output_column": "by_day",
                "partition_by": ["o_orderpriority"],
                "order_by": [{"column": "o_orderdate"}],
            },
            {"method": "percent_rank", "output_column": "share", **price},
        ],
    )
    return rounded(out.select("o_orderkey", "by_price", "by_day", "share"))


@query(
    "w2_running_totals",
    "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id "
    "ROWS UNBOUNDED PRECEDING), 4) AS spent FROM events",
)
def _(t):
    spec = {
        "source_column": "value",
        "partition_by": ["user_id"],
        "order_by": ["ts", "event_id"],
        "output_column": "spent",
    }
    return rounded(wi.apply_running_totals(t("events"), [spec]).select("event_id", "spent"), 4)


@query(
    "w2_final_totals",
    "SELECT user_id, round(sum(value), 4) AS final_total FROM events GROUP BY user_id",
)
def _(t):
    spec = {"source_column": "value", "partition_by": ["user_id"]}
    return rounded(wi.running_final_totals(t("events"), spec), 4)


@query(
    "w3_lag_lead",
    "SELECT event_id, lag(event_type) OVER w AS before, coalesce(lead(value, 2) OVER w, -1) AS after FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
)
def _(t):
    place = {"partition_by": ["user_id"], "order_by": ["ts", "event_id"]}
    out = wi.apply_lag_lead(
        t("events"),
        [
            {"source_column": "event_type", "direction": "lag", "output_column": "before", **place},
            {
                "source_column": "value",
                "direction": "lead",
                "offset": 2,
                "default": -1.0,
                "output_column": "after",
                **place,
            },
        ],
    )
    return out.select("event_id", "before", "after")


@query(
    "w4_rolling",
    "SELECT event_id, CASE WHEN count(value) OVER w >= 3 THEN round(avg(value) OVER w, 4) END AS mean3, "
    "round(max(value) OVER w, 4) AS most3, CASE WHEN count(value) OVER w >= 2 THEN round(stddev_samp(value) OVER w, 4) END AS dev3, "
    "round(median(value) OVER w, 4) AS mid3 FROM events "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)",
)
def _(t):
    place = {"source_column": "value", "window": 3, "partition_by": ["user_id"], "order_by": ["ts", "event_id"]}
    out = wi.apply_rolling_windows(
        t("events"),
        [
            {"function": "avg", "output_column": "mean3", **place},
            {"function": "max", "output_column": "most3", "min_periods": 1, **place},
            {"function": "std", "output_column": "dev3", "min_periods": 2, **place},
            {"function": "median", "output_column": "mid3", "min_periods": 1, **place},
        ],
    )
    return rounded(out.select("event_id", "mean3", "most3", "dev3", "mid3"), 4)


@query(
    "w5_cumulative_share",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey "
    "ROWS UNBOUNDED PRECEDING) / sum(o_totalprice) OVER (PARTITION BY o_orderstatus), 6) AS cumulative_share FROM orders",
)
def _(t):
    out = wi.cumulative_share(t("orders"), "o_totalprice", ["o_totalprice", "o_orderkey"], keys=["o_orderstatus"])
    return rounded(out.select("o_orderkey", "cumulative_share"))


@query(
    "w6_share_of_total",
    "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 6) AS share FROM orders",
)
def _(t):
    out = wi.share_of_total(t("orders"), "o_totalprice", ["o_custkey"])
    return rounded(out.select("o_orderkey", "share"))


@query("o3_first_rows_by_id", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50")
def _(t):
    return fi.preview(with_row_id(t("orders"), "o_orderkey"), limit=50).select("o_orderkey")
