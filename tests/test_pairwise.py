"""All pairs of groups against one test per pair."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quarrylens.errors import EngineError
from quarrylens.operators import eda, pairwise
from quarrylens.operators import stats as sx


def frame_of(spark, seed=3):
    rng = random.Random(seed)
    rows = [(f"g{rng.choice([0, 0, 0, 1, 2, 3])}", rng.choice([5.0, rng.gauss(0, 3), float(rng.randrange(6))])) for _ in range(160)]
    rows += [("alone", 1.0), (None, 3.0), ("g1", None)]
    return spark.createDataFrame(rows, "g string, v double")


@pytest.mark.parametrize("cells, block", [(200_000, 1_000), (10, 1_000), (10, 2)])
def test_equals_one_test_per_pair(spark, monkeypatch, cells, block):
    monkeypatch.setattr(pairwise, "CELLS", cells)
    monkeypatch.setattr(pairwise, "GROUP_BLOCK", block)
    frame = frame_of(spark)
    got = {(r.group_a, r.group_b): r for r in eda.pairwise_comparisons(frame, "v", "g").collect()}
    assert sorted(got) == [(f"g{i}", f"g{j}") for i in range(4) for j in range(i + 1, 4)]
    samples = sx.grouped_samples(frame, "v", "g")
    for (a, b), r in got.items():
        one = sx.mann_whitney(samples, a, b).first()
        assert r.mann_whitney_p_value == pytest.approx(one.p_value)
        welch = sx.independent_t_test(frame, "grouped", value_column="v", group_column="g", group_a=a, group_b=b).first()
        assert r.welch_p_value == pytest.approx(welch.p_value)


def test_u_counts_pairs_of_rows(spark):
    rng = random.Random(1)
    rows = [(float(rng.randrange(9)), rng.randrange(5)) for _ in range(120)]
    cells = spark.createDataFrame(rows, "value double, gid long").groupBy("value", "gid").agg(F.count(F.lit(1)).alias("count"))
    got = {(r.a, r.b): r.u for r in pairwise.pair_sums(cells, 5).collect()}
    for a in range(5):
        for b in range(a + 1, 5):
            want = sum((x > y) + (x == y) / 2 for x, i in rows for y, j in rows if i == a and j == b)
            assert got[a, b] == want


def test_a_thousand_groups(spark):
    """No name or pair comes to the driver; all pairs of 1 000 groups are there."""
    frame = spark.range(20_000).selectExpr("concat('g', id % 1000) AS g", "pmod(hash(id), 977) * 1.0 AS v")
    begun = time.time()
    out = eda.pairwise_comparisons(frame, "v", "g")
    assert out.count() == 1000 * 999 // 2
    assert time.time() - begun < 120


def test_too_few_groups(spark):
    with pytest.raises(EngineError):
        eda.pairwise_comparisons(spark.createDataFrame([("a", 1.0), ("a", 2.0)], "g string, v double"), "v", "g")
