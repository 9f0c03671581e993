import hashlib
import re

from quarrylens.llm import decontamination as dc
from tests.llm.conftest import prose


def tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(text, items):
    words = tokens(text)
    hit, names = set(), set()
    for name, item in items:
        parts = tokens(item)
        n = min(10, len(parts))
        if not n:
            continue
        windows = {tuple(parts[i : i + n]) for i in range(len(parts) - n + 1)}
        for s in range(len(words) - n + 1):
            if tuple(words[s : s + n]) in windows:
                hit |= set(range(s, s + n))
                names |= {name} - {None}
    ids = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


def test_query_matches_brute_force(spark, docs, write):
    passage = prose(40, 900)
    more = [
        (20, f"{prose(30, 11)} {passage} {prose(20, 12)}", "en", "a", 1),
        (21, passage.upper().replace(" ", ", "), "en", "a", 1),
        (22, " ".join(passage.split()[5:15]), "en", "a", 1),
        (23, " ".join(passage.split()[5:14]), "en", "a", 1),
        (24, "Short Item here", "en", "a", 1),
        (25, ("seven words that make one small item " * 40), "en", "a", 1),
    ]
    items = [
        ("b1", passage),
        ("a2", passage + " " + prose(15, 901)),
        ("c3", "short item"),
        ("d4", "seven words that make one small item"),
        ("e5", ""),
        (None, prose(12, 11)),
        ("b1", "one two"),
    ]
    all_docs = docs.union(spark.createDataFrame(more, docs.schema))
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = dc.op3_winnowing(spark, write(documents=all_docs, benchmark=bench)).collect()
    want = sorted(str((r.doc_id, *brute(r.text, items))) for r in all_docs.collect())
    assert sorted(str(tuple(r)) for r in rows) == want


def test_empty_tables_and_clashing_columns(spark, docs, empty, clash):
    bench = spark.createDataFrame([], "item_id string, text string")
    assert dc.contaminated_words(empty, bench).count() == 0
    assert dc.contaminated_words(docs, bench).where("n_hit > 0").count() == 0
    items = spark.createDataFrame([(1, prose(60, 1))], "item_id long, text string")
    clean = dc.uncontaminated(clash(docs), clash(items))
    assert clean.columns == clash(docs).columns
    assert {1, 2}.isdisjoint({r.doc_id for r in clean.collect()}) and clean.count() == docs.count() - 2
