import hashlib

import numpy as np

from quarrylens.llm import anchors as an
from quarrylens.llm import suffix_array as sa
from quarrylens.llm import substring_automata as su
from quarrylens.llm.anchors import Rule, anchors, gram_hashes, numbered, piece_rows, settled
from tests.llm.conftest import prose


def ordered(docs):
    """Distinct rows in the order of ids, nulls last."""
    rows = {(r.doc_id, r.text) for r in docs.collect()}
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def brute_bytes(docs, window=100):
    seen, out = set(), {}
    for key, text in ordered(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - window + 1):
            part = raw[s : s + window]
            if part in seen:
                gone[s : s + window] = b"\1" * window
            seen.add(part)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[key] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs, window=50):
    seen, out = set(), {}
    for key, text in ordered(docs):
        words = (text or "").encode().split()
        gone, mine = bytearray(len(words)), set()
        for s in range(len(words) - window + 1):
            part = tuple(words[s : s + window])
            if part in seen:
                gone[s : s + window] = b"\1" * window
            mine.add(part)
        seen |= mine
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[key] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def extra(spark, docs):
    period = "abcde " * 200
    more = [
        (11, period, "en", "a", 1),
        (12, "x" + period + "y", "en", "a", 1),
        (13, prose(70, 2)[:300] + prose(40, 55) + prose(80, 77)[50:400], "en", "a", 1),
        (14, "é" * 120 + prose(60, 2) + "é" * 130, "en", "a", 1),
    ]
    return docs.union(spark.createDataFrame(more, docs.schema))


def test_suffix_array_matches_brute_force(spark, docs, write):
    frame = extra(spark, docs)
    rows = sa.op6_suffix_columns(spark, write(documents=frame)).collect()
    assert len(rows) == frame.count()
    want = brute_bytes(frame)
    for r in rows:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_automata_match_brute_force(spark, docs, write):
    frame = extra(spark, docs)
    rows = su.op7_suffix_automata(spark, write(documents=frame)).collect()
    assert len(rows) == frame.count()
    want = brute_words(frame)
    for r in rows:
        assert tuple(r)[1:] == want[r.doc_id], r.doc_id


def test_column_wise_order_is_the_suffix_order():
    strings = sorted([b"banana", b"ananas", b"nab", b"an"], key=len, reverse=True)
    data = np.frombuffer(b"".join(strings), np.uint8)
    lengths = np.array([len(s) for s in strings])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = sa.suffix_order(data, starts, lengths)
    assert len(order) == len(data) + len(strings)
    found = []
    for at in order[len(strings) :]:
        piece = np.searchsorted(starts, at, "right") - 1
        found.append(data[at : starts[piece] + lengths[piece]].tobytes())
    assert found == sorted(found)


def test_automaton_matches_substrings():
    machine = su.SuffixAutomaton()
    first, second = list("abcabxabcd"), list("zabxz")
    machine.add(first)
    machine.add(second)
    probe = list("xabcabxq")
    texts = ("".join(first), "".join(second))
    want = [i for i in range(len(probe) - 2) if any("".join(probe[i : i + 3]) in t for t in texts)]
    assert machine.matches(probe, 3) == want


def test_small_shards_give_the_same_spans():
    shared = prose(120, 3).split()
    rows = []
    for doc in range(12):
        words = prose(30, 100 + doc).split() + shared[doc : doc + 80]
        ids = su.word_tokens(" ".join(words))[1]
        rows.append((1, doc, 0, ids))
    whole = sorted(set(su.matched_spans(rows, 50)))
    split = sorted(set(su.matched_spans(rows, 50, shard_words=150)))
    assert cover(whole) == cover(split) and whole


def cover(spans):
    return {(d, i) for d, a, b in spans for i in range(a, b)}


def test_anchors_agree_on_shared_windows():
    rng = np.random.default_rng(5)
    shared = rng.integers(0, 50, 90).astype(np.uint64)
    texts = [np.concatenate((rng.integers(0, 50, n).astype(np.uint64), shared)) for n in (13, 40)]
    assert len(gram_hashes(texts[0], 11)) == len(texts[0]) - 10
    found = []
    for text in texts:
        hashes, first, count = anchors(text, 60, 24)
        at = len(text) - 90
        windows = {}
        for h, a, n in zip(hashes, first, count, strict=True):
            windows.update({int(s) - at: h for s in range(a, a + n)})
        found.append([windows[i] for i in range(31)])
    assert found[0] == found[1]


def test_empty_tables_and_clashing_columns(spark, docs, empty, clash, write):
    folder = write(documents=clash(docs))
    assert sa.op6_suffix_columns(spark, folder).count() == docs.count()
    assert su.op7_suffix_automata(spark, folder).count() == docs.count()


def test_empty(spark, empty, write):
    folder = write(documents=empty)
    assert sa.op6_suffix_columns(spark, folder).count() == 0
    assert su.op7_suffix_automata(spark, folder).count() == 0


def around(spark, docs, middle, n=60):
    """Documents that hold one short passage each in surroundings of their own, some copied."""
    rows = [
        (100 + i, prose(90, 300 + i) + " " + middle + " " + prose(90, 500 + i % 50), "en", "a", 1)
        for i in range(n)
    ]
    return docs.union(spark.createDataFrame(rows, docs.schema))


def spans_of(frame):
    return cover([tuple(r) for r in frame.collect()])


def test_hot_anchors_are_cut_again(spark, docs):
    frame = around(spark, extra(spark, docs), "the same short words here again and so on")
    rows = numbered(frame)
    want = spans_of(sa.repeated_byte_spans(rows))
    tight = Rule(sa.byte_tokens, sa.piece_tokens, 100, 24, True, 900)
    found = settled(piece_rows(rows, tight), tight)
    assert found.where("kind = 2").count() > 0
    assert spans_of(sa.repeated_byte_spans(rows, most=900)) == want
    assert spans_of(sa.repeated_byte_spans(rows, most=0)) == want and want


def test_hot_anchors_of_words_are_cut_again(spark, docs):
    frame = around(spark, extra(spark, docs), prose(30, 9))
    rows = numbered(frame)
    want = spans_of(su.repeated_word_spans(rows))
    assert spans_of(su.repeated_word_spans(rows, most=300)) == want
    assert spans_of(su.repeated_word_spans(rows, most=0)) == want and want


def test_hot_anchors_move_no_texts(spark, docs, monkeypatch):
    """Cutting again shuffled the texts once more per length; now one fetch serves all lengths."""
    calls = []
    fetch = an.fetched
    monkeypatch.setattr(an, "fetched", lambda *a: calls.append(a) or fetch(*a))
    rows = numbered(around(spark, extra(spark, docs), prose(30, 9)))
    want = spans_of(su.repeated_word_spans(rows))
    assert len(calls) == 1
    # Few cells: pieces that are not hot are cut again as well, with the same result.
    monkeypatch.setattr(an, "CELLS", 2)
    assert spans_of(su.repeated_word_spans(rows, most=300)) == want
    assert len(calls) == 2


def test_texts_longer_than_the_place_bits(monkeypatch):
    rng = np.random.default_rng(8)
    text = rng.integers(0, 20, 3000).astype(np.uint64)
    shifted = np.concatenate((rng.integers(0, 20, 77).astype(np.uint64), text))

    def by_window(tokens):
        hashes, first, count = anchors(tokens, 60, 24)
        out = {}
        for h, a, n in zip(hashes.tolist(), first.tolist(), count.tolist(), strict=True):
            for s in range(a, a + n):
                assert s not in out
                out[s] = h
        return out

    whole = by_window(text)
    assert sorted(whole) == list(range(2941))
    monkeypatch.setattr("quarrylens.llm.anchors.PLACE_BITS", 10)
    parted, later = by_window(text), by_window(shifted)
    assert sorted(parted) == list(range(2941)) and sorted(later) == list(range(3018))
    assert all(parted[s] == later[s + 77] for s in parted)
