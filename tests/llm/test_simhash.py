import random

import numpy as np
import pytest
import xxhash

from quarrylens.llm import components as cc
from quarrylens.llm import simhash as sm
from quarrylens.llm.common import saved
from quarrylens.llm.components import components


def brute_fingerprint(text):
    words = (text or "").encode().translate(sm.LOWER_ASCII).split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", "A", "a B", "Aa bb CC dd é", "x " * 500, "to be or not to be that is the question"):
        assert sm.fingerprint(text) == brute_fingerprint(text)


def test_golay_code_is_perfect():
    tables = sm.golay_tables()
    seen = np.zeros(1 << 12, np.int64)
    for high in range(1 << 7):
        words = np.arange(high << 16, (high + 1) << 16, dtype=np.int64)
        seen += np.bincount(sm.wide_keys(words, tables)[:, 0], minlength=1 << 12)
    assert set(seen.tolist()) == {1 << 11}
    rng = random.Random(1)
    for _ in range(300):
        word = rng.getrandbits(23)
        other = word ^ (1 << rng.randrange(23))
        a, b = sm.wide_keys(np.array([word, other]), tables)
        assert a[0] in b and b[0] in a


def test_every_link_shares_a_bucket():
    rng = random.Random(7)
    tables = sm.golay_tables()
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(1, 4)):
            b ^= 1 << bit
        keys, index = sm.bucket_keys(np.array([a, b], np.uint64), tables)
        assert set(keys[index == 0].tolist()) & set(keys[index == 1].tolist())


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        fp = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randrange(1, 5)):
            fp ^= 1 << bit
        fps.append(fp)
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                parent[root(a)] = root(b)
    want = {}
    for f in fps:
        want.setdefault(root(f), set()).add(f)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    links = sm.golay_links(spark.createDataFrame(signed, "fp long"))
    got = {}
    for r in components(links).collect():
        got.setdefault(r.root, set()).add(r.node & (1 << 64) - 1)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v")
    assert {r.root for r in components(edges).collect()} == {0}
    assert components(edges.limit(0)).count() == 0


@pytest.mark.parametrize(("finish", "written"), [(10_000, 1), (0, None)])
def test_small_edge_tables_write_no_rounds(spark, monkeypatch, finish, written):
    """Every round wrote its edges and shuffles; a small table now needs none, and rounds agree."""
    calls = []
    monkeypatch.setattr(cc, "saved", lambda df: calls.append(df) or saved(df))
    monkeypatch.setattr(cc, "FINISH", finish)
    links = [(i, i + 1) for i in range(60, 90)] + [(3, 7), (7, 3), (-4, 7), (5, 5)]
    rows = components(spark.createDataFrame(links, "u long, v long")).collect()
    want = [(i, 60) for i in range(60, 91)] + [(i, -4) for i in (-4, 3, 7)]
    assert sorted((r.node, r.root) for r in rows) == sorted(want)
    assert len(calls) == written if written else len(calls) > 1


def test_query_and_representatives(spark, docs, empty, clash, write):
    rows = sm.op9_simhash_golay(spark, write(documents=docs)).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1].component_id == by_id[2].component_id == 1
    assert {by_id[k].component_id for k in (3, 4, 10)} == {3}
    assert by_id[3].fingerprint == "0" * 16
    assert by_id[5].component_id == by_id[9].component_id == 5
    kept = sm.representatives(clash(docs))
    assert kept.columns == clash(docs).columns
    ids = sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect())
    assert ids == sorted({r.component_id for r in rows if r.component_id is not None})
    assert sm.representatives(empty).count() == 0 and sm.near_duplicate_groups(empty).count() == 0
