import corpus_pipeline as cp
from quarrylens.llm import quality_rules
from tests.llm.conftest import prose
from tests.llm.test_decontamination import brute
from tests.llm.test_simhash import brute_fingerprint


def test_stages_against_brute_force(spark, docs, write):
    passage = prose(40, 900)
    more = [(100 + i, prose(80 + i, 500 + i), "en", f"s{i % 3}", 1) for i in range(40)]
    more += [(200 + i, prose(80, 500) + f" tail{i}", "en", "s0", 1) for i in range(5)]
    more += [(300, prose(60, 700) + " " + passage, "en", "s1", 1)]
    frame = docs.union(spark.createDataFrame(more, docs.schema))
    items = [("b1", passage)]
    folder = write(documents=frame, benchmark=spark.createDataFrame(items, "item_id string, text string"))
    rows = [tuple(r) for r in frame.collect()]

    now = frame
    out = {}
    for name, stage in cp.STAGES:
        now = stage(spark, now, folder)
        out[name] = [tuple(r) for r in now.collect()]
        if name != "shard":
            assert now.columns == frame.columns

    mask = [i for i, (rule, _) in enumerate(quality_rules.rules()) if rule in quality_rules.POLICIES["v1"]]
    assert mask == list(range(6))
    good = [r for r in rows if (m := quality_rules.measure(r[1]))[0] >= 50 and 2 * m[4] <= m[0]]
    assert sorted(map(str, out["quality"])) == sorted(map(str, good))

    prints = {r: brute_fingerprint(r[1]) for r in set(good)}
    firsts, left = set(), set(prints)
    while left:
        queue = [left.pop()]
        members = list(queue)
        while queue:
            at = prints[queue.pop()]
            near = {r for r in left if (prints[r] ^ at).bit_count() <= 3}
            left -= near
            queue += near
            members += near
        firsts.add(min(members, key=lambda r: (r[0] is None, r[0] or 0)))
    assert sorted(map(str, out["near_dedup"])) == sorted(map(str, firsts))

    clean = [r for r in out["near_dedup"] if not brute(r[1], items)[4]]
    assert sorted(map(str, out["decontaminate"])) == sorted(map(str, clean))
    assert 300 not in {r[0] for r in clean} and len(clean) == len(out["near_dedup"]) - 1

    assert set(out["mix"]) <= set(clean)
    counts = {r: out["mix"].count(r) for r in set(out["mix"])}
    assert max(counts.values()) <= 3
    assert sorted(str(r[:-1]) for r in out["shard"]) == sorted(map(str, out["mix"]))
    assert {r[-1] for r in out["shard"]} <= set(range(8))


def test_run_and_registration(spark, docs, write):
    import __spark_entry__ as entry

    bench = spark.createDataFrame([], "item_id string, text string")
    folder = write(documents=docs, benchmark=bench)
    found = entry.queries()["pipeline"](spark, folder)
    assert found.columns == [*docs.columns, "shard"] and found.count() > 0
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_empty(spark, empty, write):
    bench = spark.createDataFrame([("a", "some item")], "item_id string, text string")
    assert cp.run(spark, write(documents=empty, benchmark=bench)).count() == 0
