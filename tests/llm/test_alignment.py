import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from quarrylens.llm import alignment, tokens

COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [
    "Hello  there, world.\nNew\tline <s> <|endoftext|> it's 12 345 ", " leading", "a", "▁ bar ▁x", "naïve Ünïcode и русский 中文字符 ﬁ",
    "\x00\x01 nul", "   x", "é ́ y", "🙂🙂 ok", "x" * 3000, "don't can't we'll", "   ",
]


def brute(texts):
    """Alignments from whole texts, all pairs of tokens compared."""
    a_model = Tokenizer.from_file(tokens.BYTE_BPE)
    a_model.encode_special_tokens = True
    b_model = SentencePieceProcessor(model_file=tokens.PIECE_BPE)
    table = tokens.byte_level()
    found, links = [], []
    for text in texts:
        if not text:
            found.append(None)
            continue
        a = a_model.encode(" " + text, add_special_tokens=False).ids
        b = b_model.encode(text)
        a_raw = [bytes(table[c] for c in a_model.id_to_token(i)) for i in a]
        b_raw = [
            bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
            for i in b
        ]
        raw = (" " + text).encode()
        if not raw == b"".join(a_raw) == b"".join(b_raw):
            found.append(None)
            continue
        ea, eb = np.cumsum([len(x) for x in a_raw]), np.cumsum([len(x) for x in b_raw])
        pairs, j = [], 0
        for i in range(len(a)):
            begin = ea[i] - len(a_raw[i])
            while eb[j] <= begin:
                j += 1
            k = j
            while k < len(b) and eb[k] - len(b_raw[k]) < ea[i]:
                pairs.append((a[i], b[k]))
                k += 1
        cuts = sorted(set(ea.tolist()) & set(eb.tolist()))
        groups, low = [], 0
        for cut in cuts:
            groups.append(
                ",".join(str(a[i]) for i in range(len(a)) if low < ea[i] <= cut) + "|"
                + ",".join(str(b[i]) for i in range(len(b)) if low < eb[i] <= cut)
            )
            low = cut
        found.append((len(a), len(b), len(groups), pairs, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(set(pairs))
    counts = Counter(p for own in links for p in own)
    top = defaultdict(int)
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    return [
        (0, 0, 0, 0, 0, 0, "") if f is None else
        (*f[:3], len(f[3]), sum(counts[p] == top[p[0]] for p in f[3]), sum(counts[p] for p in f[3]), f[4])
        for f in found
    ]


@pytest.fixture(scope="module")
def models():
    return tokens.ByteBpe(tokens.contents(tokens.BYTE_BPE), True), tokens.PieceBpe(tokens.contents(tokens.PIECE_BPE))


def rows(frame, common=alignment.COMMON):
    aligned, ids_b = alignment.align(frame)
    got = alignment.with_counts(aligned, alignment.pair_counts(aligned, ids_b), common).collect()
    return sorted([(r["doc_id"] is not None, r["doc_id"] or 0, *[r[c] for c in COLUMNS]) for r in got])


@pytest.mark.parametrize("common", [0, 5, alignment.COMMON])
def test_equals_brute_force_on_whole_texts(spark, docs, clash, common):
    more = spark.createDataFrame([(100 + i, t, "x", "y", 1) for i, t in enumerate(ODD)], docs.schema)
    # The longest texts of the fixture are left to the next test: the brute force is quadratic in groups.
    frame = docs.where("doc_id is null or doc_id not in (5, 9)").unionByName(more)
    data = frame.collect()
    want = brute([r["text"] for r in data])
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, *w) for r, w in zip(data, want, strict=True))
    extra = clash(frame).withColumnsRenamed({"u": "row", "a": "pairs"}) if common == 5 else frame
    assert rows(extra, common) == want


def test_segments_of_a_long_text_give_the_same(spark, docs, monkeypatch):
    long = docs.where("doc_id in (5, 6)")
    whole = rows(long)
    aligner = alignment.Aligner(tokens.contents(tokens.BYTE_BPE), tokens.contents(tokens.PIECE_BPE))
    monkeypatch.setattr(alignment, "SEGMENT", 37)
    for r in long.collect():
        n_a, n_b, n_groups, n_links, digest, _, _ = aligner.long_text(r["text"])
        assert (n_a, n_b, n_groups, n_links, digest) in [(w[2], w[3], w[4], w[5], w[8]) for w in whole]


def test_empty_table(spark, empty):
    assert rows(empty) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40), st.data())
def test_terminals_are_common_ends(sizes, data):
    ends_a = np.cumsum(sizes)
    total = int(ends_a[-1])
    inner = data.draw(st.sets(st.integers(1, total), max_size=total))
    ends_b = np.array(sorted(inner | {total}))
    label_a, label_b = alignment.terminals(ends_a, ends_b)
    common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    for ends, labels in ((ends_a, label_a), (ends_b, label_b)):
        assert [int(ends_b[j]) for j in labels] == [min(c for c in common if c >= e) for e in ends]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*"ab c'1,.\n\té▁中<>|", "<|endoftext|>", "  ", "the"]), min_size=1, max_size=60).map("".join))
def test_segments_encode_like_the_whole(models, text):
    a, b = models
    cut = list(tokens.segments(text, 0))
    assert " ".join(cut) == text
    assert [i for c in cut for i in a.encode(" " + c)] == a.encode(" " + text)
    assert [i for c in cut for i in b.encode(c)] == b.encode(text)


@pytest.mark.parametrize("as_text", [True, False])
def test_merging_gives_the_ids_of_tokenizers(as_text):
    """Every code point between letters, blanks, digits and itself, and specials."""
    model = tokens.ByteBpe(tokens.contents(tokens.BYTE_BPE), as_text)
    assert model.fast
    step = 1 if as_text else 97
    points = [c for c in range(0, 0x110000, step) if not 0xD800 <= c < 0xE000]
    texts = [
        "".join(f"a{chr(c)}b {chr(c)}{chr(c)} {chr(c)}1 \n{chr(c)}\n" for c in points[i : i + 500])
        for i in range(0, len(points), 500)
    ]
    texts += ["x <|endoftext|> y<|endoftext|>", "don't we'll '", " \n \n\n  a", "z" * 5000, " " * 900 + "b", " " * 200_000 + "b"]
    for text in texts:
        assert model.encode(text) == model.model.encode(text, add_special_tokens=False).ids


def test_other_files_go_to_tokenizers():
    import json

    file = json.loads(tokens.contents(tokens.BYTE_BPE))
    file["normalizer"] = {"type": "NFC"}
    model = tokens.ByteBpe(json.dumps(file).encode(), True)
    assert model.fast is None and model.encode("e\u0301") == model.encode("é")
