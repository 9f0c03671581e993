import struct
import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylens.llm import packing, tokens


def encoded(texts):
    """Ids of whole texts."""
    model = Tokenizer.from_file(tokens.BYTE_BPE)
    return [model.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check(rows, data, capacity=packing.CAPACITY):
    """Every document once and whole, every sequence without gap or overlap."""
    want = defaultdict(int)
    for r, ids in zip(data, encoded([r["text"] for r in data]), strict=True):
        first = len(ids) % capacity or capacity
        starts = [0, *range(first, len(ids), capacity)] if len(ids) > capacity else [0]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
            raw = struct.pack(f"<{b - a}I", *ids[a:b])
            want[(r["doc_id"], k, a, b - a, zlib.crc32(raw))] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(n * key[3] for key, n in want.items())
    return len(bins), -(-total // capacity)


def test_whole_documents_in_gapless_sequences(spark, docs, clash):
    more = spark.createDataFrame([(50, "a <|endoftext|> b▁ ünï 中文 " * 900, "x", "y", 1), (51, " x", "", "", 0)], docs.schema)
    frame = docs.unionByName(more)
    used, least = check(packing.pack(clash(frame).withColumn("bin", F.lit("own"))).collect(), frame.collect())
    assert used <= least + 1


@pytest.mark.parametrize("gather", [1, 3])
def test_rounds_over_many_tasks(spark, monkeypatch, gather):
    """Open bins of many tasks meet in rounds; four of them for 25 documents waste a little."""
    monkeypatch.setattr(packing, "OPEN", 4)
    monkeypatch.setattr(packing, "GATHER", 2 * gather)
    frame = spark.range(0, 600, 1, 24).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("word "), (F.col("id") * 37 % 61).cast("int")).alias("text"))
    used, least = check(packing.pack(frame, capacity=128).collect(), frame.collect(), 128)
    assert used <= 1.1 * least


def test_empty_table_and_null_texts(spark, empty):
    assert packing.pack(empty).collect() == []
    frame = spark.createDataFrame([(None, None)] * 3 + [(1, "")], "doc_id long, text string")
    assert check(packing.pack(frame).collect(), frame.collect()) == (1, 1)


def test_exact_multiples_are_cut_evenly():
    assert packing.cuts(4096, 2048) == [(0, 2048), (2048, 2048)]
    assert packing.cuts(2048, 2048) == [(0, 2048)]
    assert packing.cuts(4097, 2048) == [(0, 1), (1, 2048), (2049, 2048)]
    assert packing.cuts(1, 2048) == [(0, 1)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(1, 6))
def test_best_fit_with_the_fullest_closed_first(lengths, limit):
    """Against a plain list of open bins."""
    bins = packing.OpenBins(0, 50, limit)
    plain, next_number = {}, 0
    for length in lengths:
        number, place = bins.add(length)
        fitting = [free for free in plain.values() if free >= length]
        if fitting:
            assert 50 - place == min(fitting) == plain[number]
        else:
            if len(plain) == limit:
                fullest = min(plain.values())
                # Among bins that are equally full any may close.
                gone = next(n for n in plain if plain[n] == fullest and n not in bins.left())
                del plain[gone]
            assert (number, place) == (next_number, 0)
            next_number += 1
            plain[number] = 50
        plain[number] -= length
        if plain[number] == 0:
            del plain[number]
        assert {n: 50 - free for n, free in plain.items()} == bins.left()
