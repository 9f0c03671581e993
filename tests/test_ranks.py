"""Rank correlations against all pairs of rows, with gaps, ties and ranges of one value."""

import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from quarrylens.operators import quantiles, ranks
from quarrylens.operators import stats as sx


def sign(x):
    return (x > 0) - (x < 0)


def tau(rows):
    score = sx_ = sy_ = 0
    for p, q in combinations(rows, 2):
        a, b = sign(p[0] - q[0]), sign(p[1] - q[1])
        score, sx_, sy_ = score + a * b, sx_ + a * a, sy_ + b * b
    return score / (sx_ * sy_) ** 0.5 if sx_ and sy_ else None


def mid(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def rho(rows):
    x, y = mid([r[0] for r in rows]), mid([r[1] for r in rows])
    return float(np.corrcoef(x, y)[0, 1]) if len(set(x)) > 1 and len(set(y)) > 1 else None


def data(seed, n=90):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        a = rng.choice([7.0, 7.0, rng.randrange(40) / 2])  # a third or more in one value
        row = [a, a + rng.gauss(0, 5), float(rng.randrange(4)), rng.choice([1.0, rng.random()])]
        rows.append([None if rng.random() < 0.15 else v for v in row])
    return rows


@pytest.mark.parametrize("size", [8, 30, 50_000])
def test_all_pairs_with_gaps(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE", size)
    rows = data(size)
    frame = spark.createDataFrame(rows, "a double, b double, c double, d double")
    pairs = list(combinations("abcd", 2))
    kendall = {(r.column_a, r.column_b): r for r in sx.kendall_pairs(frame, pairs).collect()}
    spearman = {(r.column_a, r.column_b): r for r in sx.spearman_pairs(frame, pairs).collect()}
    for (i, a), (j, b) in combinations(enumerate("abcd"), 2):
        whole = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        assert kendall[a, b].n == spearman[a, b].n == len(whole)
        assert kendall[a, b].correlation == pytest.approx(tau(whole))
        assert spearman[a, b].correlation == pytest.approx(rho(whole))


def test_constant_and_empty_columns(spark):
    frame = spark.createDataFrame([(1.0, None, float(i)) for i in range(6)], "a double, b double, c double")
    got = {(r.column_a, r.column_b): r.correlation for r in sx.analyze_correlations(frame, method="kendall").collect()}
    assert set(got.values()) <= {None}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=150))
def test_inversions(points):
    x, y = (np.array([p[k] for p in points], np.int64) for k in (0, 1))
    assert ranks.inversions(x, y) == sum(
        (p[0] < q[0] and p[1] > q[1]) or (q[0] < p[0] and q[1] > p[1]) for p, q in combinations(points, 2))


def test_cells_are_moved_once_per_column(spark, monkeypatch):
    """Rows behind the exchange of the range tasks: rows times columns, whatever the pairs."""
    frame = spark.range(500).selectExpr("id * 1.0 AS a", "pmod(hash(id), 50) * 1.0 AS b", "-id * 1.0 AS c", "id % 7 * 1.0 AS d")
    places, size = ranks.column_places(frame, list("abcd"))
    assert ranks._sent(places, size, 4).count() == 500 * 4
    assert ranks.range_counts(places, size, list(combinations(range(4), 2))).count() == 6  # one range a column


def test_frequent_values_do_not_meet_in_one_task(spark, monkeypatch):
    """Cells of a frequent value are looked up where they lie; rare ones, zeros of both signs and NaN meet as before."""
    monkeypatch.setattr(quantiles, "TASK_CELLS", 100)
    rows = [(float(i % 3), float(i), [0.0, -0.0, float("nan"), 7.5][i % 4]) for i in range(900)]
    long = spark.createDataFrame([(i, k, v) for i, r in enumerate(rows) for k, v in enumerate(r)], "row long, k int, value double")
    counts = long.groupBy("k", "value").agg(F.count(F.lit(1)).alias("count"))
    values = quantiles.with_below(counts, ["k"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        wide = quantiles.rows_of_cells(long.repartition(4), values, 900, 3, "below")
        plan = wide._jdf.queryExecution().executedPlan().toString()
        found = {r["row"]: tuple(r[1:]) for r in wide.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" in plan
    below = [{0.0: 0, 1.0: 300, 2.0: 600}, {float(i): i for i in range(900)}, None]
    for i, (a, b, c) in enumerate(rows):
        assert found[i] == (below[0][a], below[1][b], {0: 0, 1: 0, 2: 675, 3: 450}[i % 4])


def test_values_do_not_meet_by_column_name(spark):
    """Facts of a column go to its values; met by name, all values of a column would lie in one task."""
    df = spark.createDataFrame([(float(i * 7 % 50), float(i)) for i in range(200)], "a double, b double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cum = quantiles.cumulative_counts(df, ["a", "b"])
        found = quantiles.quantiles_of_counts(cum, ["column"], [0.5])
        plan = found._jdf.queryExecution().executedPlan().toString()
        got = {r["column"]: r["q"][0] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and got == {"a": 24.5, "b": 99.5}
