import random

import corpus_pipeline as cp
from quarrylens.llm import simhash
from quarrylens.llm import similar_texts as st


def brute_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = brute_shingles(a), brute_shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def near_copies(seed, groups=30):
    """Texts with a few words replaced, of similarities around 0.8 and above."""
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(3000)]
    out = []
    for _ in range(groups):
        first = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        out.append(" ".join(first))
        for _ in range(3):
            other = list(first)
            for _ in range(rng.randrange(1, max(2, len(first) // 40))):
                other[rng.randrange(len(other))] = rng.choice(words)
            out.append(" ".join(other))
    return out


def test_stage_joins_near_copies_at_08(spark, docs):
    texts = [*near_copies(5), "one two three", "One two  three", "one two four"]
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], docs.schema)
    firsts, left = set(), set(range(len(texts)))
    while left:
        queue = [min(left)]
        members = set(queue)
        left -= members
        while queue:
            at = queue.pop()
            near = {i for i in left if similarity(texts[i], texts[at]) >= 0.8}
            left -= near
            members |= near
            queue += near
        firsts.add(min(members))
    assert len(firsts) < len(texts) - 60
    kept = cp.near_dedup(spark, frame, None)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(firsts)


def test_awkward_rows(docs, empty, clash):
    rows = clash(docs)
    kept = st.representatives(rows)
    assert kept.columns == rows.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 3, 5, 6, 7, 8] and ids.count(None) == 1
    assert st.representatives(empty).count() == 0


def test_stage_joins_by_fingerprints_too(spark, docs):
    """Texts of nearly one fingerprint that share less than 0.8 of their shingles go as one."""
    rng = random.Random(1)
    words = [f"word{i}" for i in range(3000)]
    body = " ".join(" ".join(rng.choice(words) for _ in range(60)).split() * 200)
    tail = lambda: " " + " ".join(rng.choice(words) for _ in range(30))
    texts = [body + tail(), body + tail(), tail() * 3]
    a, b, c = (simhash.fingerprint(t) for t in texts)
    assert (a ^ b).bit_count() <= 3 < (a ^ c).bit_count() and similarity(*texts[:2]) < 0.8
    frame = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], docs.schema)
    assert sorted(r.doc_id for r in cp.near_dedup(spark, frame, None).collect()) == [0, 2]
