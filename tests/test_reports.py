"""Report warnings, findings, validation examples and moved rows."""

from quarrylens.ids import with_row_id
from quarrylens.operators import business, filters, quality
from quarrylens.operators import stats as sx


def test_sections_that_cannot_be_made_are_warnings(spark):
    frame = spark.createDataFrame([(float(i) if i % 4 else None,) for i in range(40)], "v double")
    report = sx.generate_statistics_report(frame)
    assert {(r.section, r.code) for r in report["warnings"].collect()} == {
        ("correlation", "INSUFFICIENT_COLUMNS"), ("covariance", "INSUFFICIENT_COLUMNS")}
    found = {(r.severity, r.code): r.value for r in report["findings"].collect()}
    assert found["warning", "HIGH_MISSINGNESS"] == 25.0
    assert set(report) == {"descriptive", "percentiles", "distribution", "normality", "findings", "warnings"}


def test_failing_rows_of_an_absent_unique_column(spark):
    frame = with_row_id(spark.createDataFrame([(1, "a"), (2, "a"), (3, None)], "id long, name string"), "id")
    rules = [{"column": "absent", "rule": "unique"}, {"column": "name", "rule": "unique"}, {"column": "name", "rule": "required"}]
    rows = {(r.rule_index, r.row_id, r.value) for r in quality.failing_rows(frame, rules).collect()}
    assert rows == {(1, 1, "a"), (1, 2, "a"), (2, 3, None)}
    counted = with_nulls = quality.failing_rows(frame, [{"column": "absent", "rule": "unique", "ignore_nulls": False}])
    assert counted.count() == with_nulls.count() == 3
    found = {r["rule_index"]: r["examples"] for r in quality.validation_examples(frame, rules, 1).collect()}
    assert found == {1: ["a"], 2: [None]}


def test_moved_rows(spark):
    frame = with_row_id(spark.createDataFrame([(i, v) for i, v in enumerate([1, 3, 2, 2, 5])], "id long, v long"), "id")
    assert tuple(filters.sort_summary(frame, ["v"]).first()) == (5, 3)
    assert tuple(filters.sort_summary(frame, ["id"]).first()) == (5, 0)


def test_project_lines_without_dates_and_projects_without_charts(spark):
    rows = [(1, "early", 2.0), (2, "late", None), (3, "early", 5.0)]
    frame = with_row_id(spark.createDataFrame(rows, "id long, date string, amount double"), "id")
    out = business.build_project(frame, "personal_expense_tracker")
    assert [tuple(r) for r in out["chart_2"].collect()] == [("early", 7.0)]
    assert [tuple(r) for r in out["chart_driver"].collect()] == [("early", 4.0), ("late", 2.0)]  # sums of id
    years = spark.createDataFrame([(1990, 3.0), (1992, 4.0), (1990, 1.0)], "release_year int, minutes double")
    out = business.build_project(years, "media_catalog_analysis")
    assert {tuple(r) for r in out["chart_2"].collect()} == {(1990, 4.0), (1992, 4.0)}
    alone = business.build_project(spark.createDataFrame([(2.5,), (None,)], "x double"), "hr_attrition")
    assert set(alone) == {"kpis", "detail_sample"}
    assert tuple(alone["kpis"].first()) == (2, 2.5, 2.5)


def test_main_measure_skips_fields_without_numbers(spark):
    frame = spark.createDataFrame([(None, "7"), (None, "x")], "revenue double, orders string")
    assert business.main_measure(frame, {"revenue": "revenue", "purchases": "orders"}) == "orders"
