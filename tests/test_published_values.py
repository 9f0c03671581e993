"""Tails of distributions and test results against published tables and worked examples."""

import pytest
from pyspark.sql import functions as F

from quarrylens.functions import tails as ta
from quarrylens.operators import stats as sx


@pytest.mark.parametrize(
    ("build", "value"),
    [
        (lambda: ta.t_two_sided(F.lit(2.228), F.lit(10.0)), 0.05),
        (lambda: ta.t_two_sided(F.lit(2.750), F.lit(30.0)), 0.01),
        (lambda: ta.chi2_sf(F.lit(3.841), F.lit(1.0)), 0.05),
        (lambda: ta.chi2_sf(F.lit(23.209), F.lit(10.0)), 0.01),
        (lambda: ta.f_sf(F.lit(3.708), F.lit(3.0), F.lit(10.0)), 0.05),
        (lambda: ta.f_sf(F.lit(4.10), F.lit(2.0), F.lit(10.0)), 0.05),
        (lambda: ta.normal_sf(F.lit(1.959964)), 0.025),
        (lambda: ta.normal_quantile(F.lit(0.995)), 2.575829),
        (lambda: ta.t_quantile(F.lit(0.975), F.lit(10.0)), 2.228139),
    ],
)
def test_tables(spark, build, value):
    found = spark.range(1).select(build().alias("x")).first().x
    assert found == pytest.approx(value, rel=2e-3)


def test_sleep_data(spark):
    """Student's sleep data: paired t = -4.0621, p = 0.002833; Welch t = -1.8608, p = 0.07939."""
    first = [0.7, -1.6, -0.2, -1.2, -0.1, 3.4, 3.7, 0.8, 0.0, 2.0]
    second = [1.9, 0.8, 1.1, 0.1, -0.1, 4.4, 5.5, 1.6, 4.6, 3.4]
    frame = spark.createDataFrame(list(zip(first, second, strict=True)), "a double, b double")
    paired = sx.paired_t_test(frame, "a", "b").first()
    assert paired.t_statistic == pytest.approx(-4.0621, abs=1e-4)
    assert paired.p_value == pytest.approx(0.002833, abs=1e-6)
    welch = sx.independent_t_test(frame, "columns", "a", "b").first()
    assert welch.t_statistic == pytest.approx(-1.8608, abs=1e-4)
    assert welch.p_value == pytest.approx(0.07939, abs=1e-5)


def test_tea_tasting(spark):
    """Fisher's tea tasting, three of four right on either side: two-sided p = 0.4857."""
    rows = [("milk", "milk")] * 3 + [("milk", "tea")] + [("tea", "milk")] + [("tea", "tea")] * 3
    found = sx.fisher_exact_test(spark.createDataFrame(rows, "truth string, guess string"), "truth", "guess").first()
    assert found.p_value == pytest.approx(0.4857, abs=1e-4)


def test_rank_correlations_with_ties(spark):
    """tau-b of (1,1), (2,2), (2,3), (3,1) is 0 concordant balance over tied pairs, by hand."""
    rows = [(1.0, 1.0), (2.0, 2.0), (2.0, 3.0), (3.0, 1.0), (4.0, 4.0)]
    frame = spark.createDataFrame(rows, "a double, b double")
    pairs = [(p, q) for i, p in enumerate(rows) for q in rows[:i]]
    sign = lambda x: (x > 0) - (x < 0)
    score = sum(sign(p[0] - q[0]) * sign(p[1] - q[1]) for p, q in pairs)
    ties = [sum(p[k] != q[k] for p, q in pairs) for k in (0, 1)]
    tau = sx.analyze_correlations(frame, method="kendall").first().correlation
    assert tau == pytest.approx(score / (ties[0] * ties[1]) ** 0.5)


def test_linkage_is_greedy(spark):
    """One-to-one links in the order of scores equal a plain greedy pass."""
    import random

    from quarrylens.operators.matching import greedy_runs

    rng = random.Random(11)
    pairs = sorted({(rng.randrange(25), rng.randrange(25)) for _ in range(160)})
    scored = [(a, b, float(rng.randrange(60, 101))) for a, b in pairs]
    left, right, want = set(), set(), set()
    for a, b, s in sorted(scored, key=lambda r: (-r[2], r[0], r[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, s))
    frame = spark.createDataFrame(scored, "leid long, reid long, score double")
    members = lambda e, i: spark.range(25).selectExpr(f"id AS {e}", f"id AS {i}")
    found = greedy_runs(frame, members("leid", "lid"), members("reid", "rid"))
    assert {(r.lid, r.rid, r.score) for r in found.select("lid", "rid", "score").collect()} == want


def test_both_rank_forms_agree(spark):
    frame = spark.range(200).selectExpr("pmod(hash(id), 17) AS a", "pmod(hash(id, 1), 29) AS b", "5 AS c")
    once = {(r.column_a, r.column_b): r.correlation for r in sx.spearman_pairs(frame, [("a", "b"), ("a", "c")]).collect()}
    anew = {(r.column_a, r.column_b): r.correlation for r in sx._spearman_with_gaps(frame, [("a", "b"), ("a", "c")]).collect()}
    assert once["a", "b"] == pytest.approx(anew["a", "b"]) and once["a", "c"] is anew["a", "c"] is None
    gap = frame.selectExpr("if(a = 3, null, a) AS a", "b", "c AS d")
    found = sx.spearman_pairs(gap, [("a", "b"), ("b", "d")]).collect()
    assert {(r.column_a, r.n) for r in found} == {("a", gap.where("a IS NOT NULL").count()), ("b", 200)}
