"""Rules that once were broken: caps, ignored parameters, merged keys, refused statements."""

import pytest
from pyspark.sql import functions as F

from quarrylens.errors import EngineError
from quarrylens.ids import with_row_id
from quarrylens.operators import aggregate as ag
from quarrylens.operators import charts as ch
from quarrylens.operators import columns as co
from quarrylens.operators import filters as fi
from quarrylens.operators import joins as jo
from quarrylens.operators import quality as qu
from quarrylens.operators import sampling as sa
from quarrylens.operators import windows as wi
from quarrylens.sources import sql as sq
from quarrylens.sources import versions as ve


def code(excinfo):
    return excinfo.value.code


def test_sort_direction(spark):
    frame = spark.range(20)
    first = fi.apply_sort(frame, [{"column": "id", "direction": "desc"}]).first()
    assert first.id == 19
    view = fi.table_view(with_row_id(frame, "id"), sort_by=[{"column": "id", "direction": "desc"}], page=2, page_size=5)
    assert [r.id for r in view.collect()] == [14, 13, 12, 11, 10]
    for bad in ({"column": "id", "order": "desc"}, {"column": "id", "direction": "down"}):
        with pytest.raises(EngineError):
            fi.apply_sort(frame, [bad])


def test_table_view_pages_past_a_thousand_rows(spark):
    view = fi.table_view(with_row_id(spark.range(3000), "id"), page=101, page_size=25)
    assert [r.id for r in view.collect()] == list(range(2500, 2525))


def test_column_operation_options(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    with pytest.raises(EngineError) as found:
        co.reorder_columns(frame, ["b"], append_unspecified=False)
    assert code(found) == "INCOMPLETE_COLUMN_ORDER"
    assert co.duplicate_column(frame, "a", "d").columns == ["a", "d", "b", "c"]
    assert co.duplicate_column(frame, "a", "d", insert_after_source=False).columns == ["a", "b", "c", "d"]
    with pytest.raises(EngineError) as found:
        co.apply_column_operations(frame, [{"type": "reorder", "columns": ["a"], "append_remaining": True}])
    assert code(found) == "UNKNOWN_PARAMETER"
    with pytest.raises(EngineError) as found:
        co.delete_columns(frame, ["a", "b", "c"])
    assert code(found) == "CANNOT_DELETE_ALL_COLUMNS"


def test_pivot_keys_are_never_merged(spark):
    clash = spark.createDataFrame([("a__b", "c", 1), ("a", "b__c", 2)], "x string, y string, v int")
    value = [{"function": "sum", "column": "v", "alias": "s"}]
    with pytest.raises(EngineError) as found:
        ag.pivot_dataframe(clash, [], ["x", "y"], value)
    assert code(found) == "PIVOT_COLUMN_COLLISION"
    null = spark.createDataFrame([("None", 1), (None, 2)], "x string, v int")
    with pytest.raises(EngineError):
        ag.pivot_dataframe(null, [], ["x"], value)
    wide = spark.range(1500).selectExpr("id AS k", "id AS v")
    assert len(ag.pivot_dataframe(wide, [], ["k"], value).columns) == 1500


def test_unique_on_an_absent_column(spark):
    frame = spark.range(5)
    rules = [{"column": "gone", "rule": "unique"}, {"column": "gone", "rule": "unique", "ignore_nulls": False}]
    assert [r.invalid_count for r in qu.validate_dataset(frame, rules).orderBy("rule_index").collect()] == [0, 5]


def test_nothing_is_cut(spark, tmp_path):
    frame = spark.range(6000).selectExpr("id", "cast(id AS double) AS x", "cast(id % 60 AS string) AS g")
    assert ch.build_scatter_bubble(frame, "id", "x").count() == 6000
    assert ch.build_box_violin(frame, "x", "g").count() == 60
    ve.export_table(spark.range(60_000), str(tmp_path / "out"), "parquet")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60_000
    late = spark.range(5000).selectExpr("id", "if(id < 4000, null, id) AS late")
    found = {r.column: r.sample_values for r in qu.sample_values(with_row_id(late, "id")).collect()}
    assert found["late"] == ["4000", "4001", "4002", "4003", "4004"]
    big = spark.range(15_000).withColumnRenamed("id", "a")
    assert jo.apply_join(big, spark.range(20).withColumnRenamed("id", "b"), "cross").count() == 300_000


def test_stratified_allocation(spark):
    frame = with_row_id(spark.range(1000).selectExpr("id", "CASE WHEN id < 10 THEN 'a' WHEN id < 300 THEN 'b' ELSE 'c' END AS g"), "id")

    def counts(**options):
        sample = sa.sample_dataframe(frame, "stratified", strata=["g"], seed=1, **options)
        return {r.g: r["count"] for r in sample.groupBy("g").count().collect()}

    assert counts(sample_size=101) == {"a": 1, "b": 29, "c": 71}
    assert counts(sample_size=101, allocation="equal") == {"a": 10, "b": 46, "c": 45}
    assert counts(sample_size=1000, allocation="equal") == {"a": 10, "b": 290, "c": 700}
    first = sa.sample_dataframe(frame, "simple_random", sample_size=333, seed=5)
    again = sa.sample_dataframe(frame.repartition(7), "simple_random", sample_size=333, seed=5)
    assert first.count() == 333 and {r.id for r in first.collect()} == {r.id for r in again.collect()}


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM elsewhere",
        "SELECT * FROM parquet.`/tmp/x`",
        "WITH a AS (SELECT * FROM elsewhere) SELECT * FROM a",
        "SELECT (SELECT max(id) FROM elsewhere) FROM dataset",
        "SELECT * FROM dataset WHERE EXISTS (SELECT 1 FROM elsewhere)",
        "SELECT reflect('java.lang.System', 'getenv', 'PATH')",
        "SELECT java_method('java.lang.System', 'getenv', 'PATH') FROM dataset",
        "SELECT transform(id) USING 'cat' FROM dataset",
        "INSERT INTO dataset SELECT 1",
        "DROP TABLE dataset",
        "CREATE TABLE t AS SELECT 1",
        "SET spark.sql.ansi.enabled=false",
        "SELECT 1; SELECT 2",
        "",
    ],
)
def test_refused_statements(spark, text):
    frame = spark.range(3)
    spark.range(9).createOrReplaceTempView("elsewhere")
    with pytest.raises(EngineError):
        sq.sql_frame(spark, {"dataset": frame}, text)


def test_statements_that_run(spark):
    frame = spark.range(3)
    text = "SELECT replace('drop', 'd', 'c') AS word, count(*) AS n FROM dataset"
    assert sq.execute_dataset_sql(frame, text)["rows"] == [{"word": "crop", "n": 3}]
    one = sq.sql_frame(spark, {"dataset": frame}, "SELECT max(id) AS m FROM dataset")
    sq.sql_frame(spark, {"dataset": spark.range(100)}, "SELECT * FROM dataset").count()
    assert one.first().m == 2
    assert sq.validate_read_only_sql(spark, "EXPLAIN SELECT * FROM dataset", ["dataset"]) == "explain"
    assert sq.execute_dataset_sql(frame, "SELECT id FROM dataset", max_rows=2)["truncated"]


@pytest.fixture
def small_groups(spark):
    """Forces the range-partitioned form of every ordered operator."""
    spark.conf.set("spark.quarrylens.maxGroupRows", "40")
    yield
    spark.conf.unset("spark.quarrylens.maxGroupRows")


def ordered_frames(spark):
    frame = with_row_id(
        spark.range(600).selectExpr("id", "pmod(hash(id), 50) AS v", "if(id % 3 = 0, 'hot', cast(id % 5 AS string)) AS g"), "id"
    )
    place = {"partition_by": ["g"], "order_by": [{"column": "v", "ascending": True}]}
    yield wi.apply_ranking(frame, [{"method": m, "output_column": m, **place} for m in ("rank", "dense_rank", "row_number", "percent_rank")])
    yield wi.apply_running_totals(frame, [{"source_column": "v", **place}])
    yield wi.apply_lag_lead(frame, [{"source_column": "v", "offset": 3, **place}, {"source_column": "v", "direction": "lead", **place}])
    yield wi.apply_rolling_windows(frame, [{"source_column": "v", "window": 5, "function": f, **place} for f in ("sum", "avg", "max", "median")])
    yield ag.aggregate_dataframe(frame, ["g"], [{"function": "median", "column": "v"}])
    yield jo.apply_join(frame, frame.select("g", F.col("id").alias("other")).where("id < 90"), "left", [{"left": "g", "right": "g"}])


def seen(frame):
    return sorted(
        str(tuple(round(v, 6) if isinstance(v, float) else v for v in r)) for r in frame.select(sorted(frame.columns)).collect()
    )


def test_both_forms_of_ordered_operators_agree(spark, request):
    plain = [seen(f) for f in ordered_frames(spark)]
    request.getfixturevalue("small_groups")
    split = [seen(f) for f in ordered_frames(spark)]
    assert plain == split


def test_a_chain_of_windows_counts_its_groups_once(spark, monkeypatch):
    from quarrylens.operators import ordered

    counted = []
    plain = ordered.group_sizes
    monkeypatch.setattr(ordered, "group_sizes", lambda df, keys: counted.append(tuple(keys)) or plain(df, keys))
    frame = with_row_id(spark.range(50).selectExpr("id", "id % 3 AS g", "id * 2 AS v"), "id")
    place = {"source_column": "v", "partition_by": ["g"], "order_by": ["id"]}
    out = wi.apply_running_totals(frame, [place])
    out = wi.apply_lag_lead(out, [{"offset": 1, "default": 0, **place}, {"offset": 2, **place}])
    out = wi.apply_rolling_windows(out, [{"function": "sum", "window": 3, **place}])
    assert counted == [("g",)] and out.count() == 50


def test_files_are_routed_by_name(spark, tmp_path):
    from quarrylens.sources import readers

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.csv").write_text("p,q\n1,2\n3,4\n")
    assert readers.read_any(spark, str(tmp_path / "a")).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.parquet").write_text("p,q\n1,2\n")
    with pytest.raises(EngineError) as found:
        readers.read_any(spark, str(tmp_path / "b")).count()
    assert code(found) == "FILE_TYPE_MISMATCH"


def test_version_store(spark, tmp_path):
    store = ve.VersionStore(spark, str(tmp_path / "store"))
    frame = with_row_id(spark.range(10).selectExpr("id", "id * 2 AS v"), "id")
    first = store.write(frame, "t")
    again = store.write(frame.repartition(3), "t")
    assert again["version_number"] == 1 and not again["created"]
    second = store.write(frame.where("id <> 4"), "t", step="filter", health_score=90.0)
    assert (first["version_number"], second["version_number"]) == (1, 2)
    assert store.catalog().first().health_score == 90.0 and store.read("t", 1).count() == 10
    assert not ve.same_content(frame, frame.union(frame))


def test_binning_rules(spark):
    frame = spark.createDataFrame([(float(v),) for v in (0, 1, 5, 10, 11)] + [(None,)], "v double")

    def bins(**spec):
        out = co.apply_binning(frame, [{"column": "v", "method": "custom", "edges": [0, 5, 10], "output_column": "b", **spec}])
        return {r.v: r.b for r in out.collect()}

    assert bins() == {0: "bin_1", 1: "bin_1", 5: "bin_1", 10: "bin_2", 11: None, None: None}
    assert bins(include_lowest=False)[0] is None
    assert bins(right=False) == {0: "bin_1", 1: "bin_1", 5: "bin_2", 10: None, 11: None, None: None}
    assert bins(out_of_range="clip", labels=["x", "y"]) == {0: "x", 1: "x", 5: "x", 10: "y", 11: "y", None: None}
    for bad in ({"edges": [5, 0]}, {"edges": [1]}, {"labels": ["x"]}, {"labels": ["x", "x"]}, {"method": "odd"}):
        with pytest.raises(EngineError):
            bins(**bad)
    flat = frame.where("v = 1")
    with pytest.raises(EngineError) as found:
        co.apply_binning(flat, [{"column": "v", "method": "equal_width", "bins": 3}])
    assert code(found) == "CONSTANT_COLUMN"


def test_numbers_profile_alike_as_text(spark):
    frame = spark.range(500).selectExpr("pmod(hash(id), 40) - 7 AS v", "id")
    numbers = qu.profile_numeric(frame.select("v")).drop("position").first().asDict()
    text = qu.profile_numeric(frame.selectExpr("concat(' ', v, '.0') AS v")).drop("position").first().asDict()
    assert numbers.keys() == text.keys()
    for key, value in numbers.items():
        assert text[key] == (pytest.approx(value) if isinstance(value, float) else value), key
    mixed = frame.selectExpr("v", "if(id % 5 = 0, null, cast(id AS double)) AS w", "'x' AS s", "CAST('NaN' AS double) AS n")
    found = {r.column: r for r in qu.profile_numeric(mixed).collect()}
    assert set(found) >= {"v", "w"} and found["w"].null_count == 100
