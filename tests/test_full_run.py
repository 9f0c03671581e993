"""The full analysis computes what its sections share once."""

import pytest
from pyspark.sql import functions as F

from quarrylens.operators import cleaning, quality, quantiles
from quarrylens.operators import stats as sx
from quarrylens.operators.ordered import Key, Ordered
from quarrylens.plans import full_run
from quarrylens.sources.versions import VersionStore

ROWS = [(i, f"{' ' * (i % 3)}{'Ab' if i % 2 else 'ab'}", float(i % 7) if i % 11 else None) for i in range(60)]
SCHEMA = "id long, name string, v double"


@pytest.fixture
def ordered(monkeypatch):
    calls, before = [], quantiles.with_below
    monkeypatch.setattr(quantiles, "with_below", lambda counts, keys: calls.append(keys) or before(counts, keys))
    return calls


def test_the_sections_of_a_report_order_values_once(spark, ordered):
    report = sx.generate_statistics_report(spark.createDataFrame(ROWS, SCHEMA))
    assert ordered == [["column"]]
    found = {r["column"]: (r["unique_count"], r["median"]) for r in report["descriptive"].collect()}
    assert found == {"id": (60, 29.5), "v": (7, 3.0)}


def test_sections_are_those_of_the_quality_given(spark, ordered):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    given = quality.quality_frames(frame)
    sections = full_run.analysis_sections(frame, given)
    assert ordered == [["column"]]
    assert all(sections[f"quality.{k}"] is v for k, v in given.items() if k != "value_counts")


def test_known_counts_serve_only_the_columns_they_hold(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    shared = quantiles.counted_once(frame, ["v"])
    for columns in (["v"], ["id", "v"]):
        for count in (quantiles.value_counts, quantiles.cumulative_counts):
            assert sorted(count(shared, columns).collect()) == sorted(count(frame, columns).collect())
    assert sorted(quantiles.value_counts(shared, ["v"], as_type="string").collect()) == sorted(
        quantiles.value_counts(frame, ["v"], as_type="string").collect())


def test_variant_totals_count_the_groups_of_variants(spark):
    values = ["ab", "Ab", "AB", " ab", "ab ", "x", "X", "y", " Z", "Z ", "ΑΣ", "ας", "İ", "i̇", " q", "q", "1.0E7", "  ", "\t", "W\n", "w"]
    counts = spark.createDataFrame([(c, v, i + 1) for c in "pq" for i, v in enumerate(values)] + [("r", "one", 1)],
                                   "column string, value string, count long")
    for normal in (F.lower("value"), F.lower(quality._stripped(F.col("value")))):
        groups = quality._variant_groups(counts, normal).groupBy("column").agg(F.count(F.lit(1)).alias("groups"))
        assert sorted(quality._variant_totals(counts, normal).collect()) == sorted(groups.collect())
    assert counts.filter(~quality._stripped(F.col("value")).eqNullSafe(quality.strip(F.col("value")))).count() == 0


def test_the_cleaned_rows_are_judged_once(spark, monkeypatch, tmp_path):
    """The raw rows and the cleaned ones: two qualities. That of the sections is that of the stored version."""
    calls, before = [], full_run.quality_frames
    monkeypatch.setattr(full_run, "quality_frames", lambda df, **k: calls.append(df) or before(df, **k))
    rows = [(i % 50, f"{' ' * (i % 3)}ab", float(i % 5) if i % 11 else None) for i in range(60)] + [(None, None, None)] * 2
    store = VersionStore(spark, str(tmp_path / "versions"))
    run = full_run.run_full_analysis(store, spark.createDataFrame(rows, SCHEMA), "d", str(tmp_path / "out"))
    assert len(calls) == 2
    stored = quality.quality_frames(store.read("d"), keep=False)
    for name in ("basic_schema", "numeric_profile", "categorical_profile", "missing_by_column", "duplicates", "health"):
        written = spark.read.parquet(run["sections"][f"quality.{name}"])
        assert sorted(map(str, written.collect())) == sorted(map(str, stored[name].collect())), name
    assert run["versions"][1]["row_count"] == store.read("d").count() < 62


@pytest.mark.parametrize("keep", ["first", "last", "none"])
def test_copies_are_folded_without_a_sort(spark, keep):
    rows = [(i % 7, None if i % 3 else "x", i if i % 5 else None) for i in range(40)] + [(9, "z", None)]
    frame = spark.createDataFrame(rows, "a long, b string, __row_id long")
    out = cleaning.remove_duplicates(frame, keep=keep)
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()
    groups = {}
    for a, b, i in rows:
        groups.setdefault((a, b), []).append(i)
    pick = {"first": min, "last": max, "none": min}[keep]
    want = [(a, b, pick([i for i in own if i is not None], default=None)) for (a, b), own in groups.items() if keep != "none" or len(own) == 1]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))


def test_ranges_are_summed_without_a_sort(spark, monkeypatch):
    """Running counts, whole-number sums and extremes over ranges; a sum of fractions keeps its order."""
    spark.conf.set("spark.quarrylens.maxGroupRows", "10")
    try:
        frame = spark.range(200).selectExpr("id", "pmod(id, 3) AS k", "if(pmod(id, 7) = 0, null, pmod(id * 37, 101)) AS v", "id / 8 AS d")
        whole = Ordered(frame, ["k"], [Key("id")]).running(
            s=("sum", F.col("v")), n=("count", F.col("v")), hi=("max", F.col("v")), lo=("min", F.col("v"))).df
        part = Ordered(frame, ["k"], [Key("id")]).running(x=("sum", F.col("d")), last=("last", F.col("v"))).df
        found = {r.id: r for r in whole.collect()}
        parts = {r.id: r for r in part.collect()}
    finally:
        spark.conf.unset("spark.quarrylens.maxGroupRows")
    assert whole._jdf.queryExecution().optimizedPlan().toString().count("Window") < part._jdf.queryExecution().optimizedPlan().toString().count("Window")
    for k in range(3):
        seen, d = [], 0.0
        for i in range(k, 200, 3):
            v = None if i % 7 == 0 else i * 37 % 101
            seen += [] if v is None else [v]
            d += i / 8
            got = found[i]
            assert (got.s, got.n, got.hi, got.lo) == (sum(seen) if seen else None, len(seen), max(seen, default=None), min(seen, default=None))
            assert (parts[i].x, parts[i].last) == (d, seen[-1] if seen else None)
