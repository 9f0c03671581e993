"""Counts of all pairs of columns and rank sums of groups against one pair at a time."""

import random
from collections import Counter

import pytest

from quarrylens.operators import cells, eda, ranks
from quarrylens.operators import stats as sx


def frame_of(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        row = [rng.choice("xyyy"), rng.choice("pqr"), f"id{i % 149}", rng.choice([2.0, 2.0, rng.random()]), float(rng.randrange(7))]
        rows.append([None if rng.random() < 0.1 else v for v in row])
    return spark.createDataFrame(rows, "a string, b string, c string, u double, w double")


def test_cells_of_all_pairs(spark):
    frame = frame_of(spark)
    rows = frame.collect()
    want = Counter()
    for p, q in (("a", "b"), ("a", "c"), ("b", "c")):
        want.update((p, q, r[p], r[q]) for r in rows if r[p] is not None and r[q] is not None)
    got = cells.pair_cells(frame, [("a", "b"), ("a", "c"), ("b", "c")]).collect()
    assert {tuple(r)[:4]: r["count"] for r in got} == dict(want)


@pytest.mark.parametrize("size", [6, 40, 50_000])
def test_rank_tests_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "RANGE", size)
    frame = frame_of(spark)
    got = {(r.numeric, r.categorical): r for r in eda.analyze_numeric_categorical_relationships(frame, ["u", "w"], ["a", "b", "c"]).collect()}
    assert len(got) == 6
    for n in ("u", "w"):
        for c in ("a", "b"):
            one = sx.analyze_non_parametric(frame, "kruskal_wallis", value_column=n, group_column=c).first()
            assert got[n, c].kruskal_h == pytest.approx(one.statistic)
            anova = sx.analyze_anova(frame, n, c).first()
            assert got[n, c].f_statistic == pytest.approx(anova.f_statistic)
        # nearly unique ids: at most one group has two rows
        assert got[n, "c"].status == "insufficient_eligible_groups"


def test_groups_below_the_least_size_are_not_ranked(spark):
    rows = [("x", float(i)) for i in range(6)] + [("y", float(i) + 0.5) for i in range(6)] + [("z", 2.2)]
    frame = spark.createDataFrame(rows, "g string, v double")
    with_z = eda.analyze_numeric_categorical_relationships(frame, ["v"], ["g"]).first()
    without = sx.analyze_non_parametric(frame.filter("g <> 'z'"), "kruskal_wallis", value_column="v", group_column="g").first()
    assert with_z.kruskal_h == pytest.approx(without.statistic)


def test_scan_does_not_grow_with_the_pairs(spark):
    """One scan and no expansion of rows for ten pairs as for one."""
    frame = frame_of(spark)
    plan = cells.pair_cells(frame, [(p, q) for i, p in enumerate("abcuw") for q in "abcuw"[i + 1 :]])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("LogicalRDD") == 1 and "Generate" not in text and "Expand" not in text
