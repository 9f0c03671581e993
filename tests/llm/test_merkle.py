import hashlib
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrylens.llm import merkle

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def way(levels, i):
    found = []
    for below in levels[:-1]:
        first = i - i % 3
        found.append((i % 3, [d for k, d in enumerate(below[first : first + 3]) if k != i % 3]))
        i //= 3
    return found


def brute(rows):
    """The contract, one tree at a time."""

    def leaf(r, text):
        fields = [r["doc_id"], r["source"], r["lang"], r["n_chars"], text]
        return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields])

    groups = defaultdict(list)
    for r in rows:
        groups[r["source"]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[name] = (own, levels_of([leaf(r, r["text"]) for r in own]))
    top = levels_of([trees[n][1][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        own, levels = trees[name]
        for i, r in enumerate(own):
            path = way(levels, i) + way(top, k)
            text = r["text"]
            if text is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = leaf(r, text)
            for place, others in path:
                folded = h(*others[:place], folded, *others[place:])
            root = top[-1][0]
            proof = h(*[d for _, others in path for d in others])
            out.append((r["doc_id"], levels[0][i], levels[-1][0], root, proof, folded, folded == root))
    return out


def same(got, want):
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    return sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture
def many(docs):
    """The awkward rows and a hot source beside small ones, down to a single leaf."""
    spark = docs.sparkSession
    n = spark.range(700).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("line\n"), F.col("id")).alias("text"), F.lit("en").alias("lang"),
        F.when(F.col("id") < 500, "hot").when(F.col("id") < 590, F.concat(F.lit("s"), F.col("id") % 30)).when(
            F.col("id") < 600, "é").when(F.col("id") < 601, "").otherwise(F.lit("z")).alias("source"),
        F.col("id").alias("n_chars"))
    return docs.unionByName(n)


@pytest.mark.parametrize("height", [2, 7])
def test_equals_brute_force(spark, many, write, clash, monkeypatch, height):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    frame = clash(many).withColumn("tree", F.lit("own")) if height == 2 else many
    got = merkle.op12_merkle_manifest(spark, write(documents=frame)).select(COLUMNS).collect()
    assert same(got, brute(many.collect()))


def test_blocks_hold_every_node_once(many, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    _, rounds, top = merkle.manifest(many)
    hot = [b.where("tree = '=hot'").collect() for b in rounds]
    assert [len(b) for b in hot] == [56, 7, 1]
    assert sum(len(r["nodes"]) // 32 for b in hot for r in b) == sum(
        merkle.up(500, k) for k in range(7)) + merkle.up(500, 2) + merkle.up(500, 4)
    assert all(merkle.unpacked(bytes(r["nodes"]))[0] == r["root"] for b in hot for r in b)
    assert len(top) > 1


def test_empty_table_and_all_null(spark, empty, docs):
    assert merkle.manifest(empty)[0].collect() == []
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 4, docs.schema)
    got = merkle.manifest(nulls)[0].select(COLUMNS).collect()
    assert same(got, brute(nulls.collect()))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 800))
def test_addresses_are_places(leaves):
    height = merkle.height_of(leaves)
    places = [p for level in merkle.layout(leaves, height) for p in level.tolist()]
    assert sorted(places) == list(range(merkle.size(leaves, height + 1)))
    assert merkle.layout(leaves, height)[-1].tolist() == [0]


def test_subtrees_are_contiguous():
    """27 leaves, four levels: two on top (4 nodes), then nine bottom subtrees of four nodes."""
    lowest, above, third, root = (p.tolist() for p in merkle.layout(27, 3))
    assert [root, third] == [[0], [1, 2, 3]]
    for k in range(9):
        assert above[k] == 4 + 4 * k
        assert lowest[3 * k : 3 * k + 3] == [5 + 4 * k, 6 + 4 * k, 7 + 4 * k]


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 300), st.data())
def test_every_path_folds_to_the_root(leaves, data):
    digests = [h(str(i)) for i in range(leaves)]
    height = merkle.height_of(leaves)
    nodes = merkle.build(digests, height)
    places = [p.tolist() for p in merkle.layout(leaves, height)]
    i = data.draw(st.integers(0, leaves - 1))
    path = merkle.siblings(nodes, places, i)
    assert merkle.fold(digests[i], merkle.heard(merkle.said(path))) == nodes[0] == levels_of(digests)[-1][0]
    assert merkle.unpacked(merkle.packed(nodes)) == nodes
