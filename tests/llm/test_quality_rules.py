import re
from collections import Counter

from quarrylens.llm import quality_rules as qr


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if counts[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(repeated)


def test_measures_match_brute_force():
    texts = [None, "", "a b c a b c", "x\nx\n \nx y", "#*$ é ß z\x1c", "a a a a a", "one\r\none\r\n", "a b c d a b c"]
    for text in texts:
        assert qr.measure(text)[:5] == brute(text), text


def test_query_policies_and_ablations(spark, docs, write):
    rows = qr.op2_rule_ledger(spark, write(documents=docs)).collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[4].n_words == 0 and by_id[4].base_failed and not by_id[4].kept
    assert by_id[1].kept and not by_id[1].base_failed
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    entries = qr.ledger(docs.select("doc_id", "text"))
    found = {r.rule: r for r in qr.ablations(entries, "v1").collect()}
    assert found["few_words"].failed_docs == sum(r.n_words < 50 for r in rows)
    assert found["few_words"].only_this == sum(r.failed == 1 for r in rows)


def test_names_of_measurements_in_any_case(docs):
    from pyspark.sql import functions as F

    wide = docs.withColumns({"N_WORDS": F.lit("own"), "Failed": F.lit("own")})
    assert qr.ledger(wide).count() == docs.count()
    kept = qr.accepted(wide, "v1")
    assert kept.columns == wide.columns
    assert {(r["N_WORDS"], r["Failed"]) for r in kept.collect()} == {("own", "own")}


def test_accepted_keeps_own_columns(docs, empty, clash):
    wide = clash(docs)
    kept = qr.accepted(wide, "v1")
    assert kept.columns == wide.columns
    assert {r.n_words for r in kept.select("n_words").collect()} == {"own n_words"}
    assert qr.accepted(empty, "v1").count() == 0 and qr.ledger(empty).count() == 0
