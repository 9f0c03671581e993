from quarrylens.llm import toxicity as tx
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int"


def test_folding():
    assert tx.fold("IDI0T, m0r0n!") == " idiot moron "
    assert tx.fold("іdіоt") == " idiot "
    assert tx.fold("call 555-1234") == " call 555 1234 "
    assert tx.fold(None) == tx.fold("") == "  "


def test_exceptions_and_length():
    lexicon = tx.Lexicon({" trash ": 3.0, " idio": 2.0}, {"trash can"}, (-3.0, 1.0, 0.5))
    machine = lexicon.automaton()
    assert tx.hits(machine, tx.fold("a trash can and an idiotic trash heap")) == [(19, 2.0), (27, 3.0)]
    near = tx.sums(machine, tx.fold("trash"))
    far = tx.sums(machine, tx.fold("trash " + prose(400, 1)))
    assert near[0] == far[0] and near[1] > far[1]
    assert lexicon.score(near) > lexicon.score(far)


def frames(spark):
    docs, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        docs.append((i, prose(60, i) + (" you vilecreep" if toxic else ""), "en", "a", 1))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None, "en", "a", 1), (1001, "", "en", "a", 1), (None, "vilecreep", "en", "a", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(docs, schema), spark.createDataFrame(labels, LABELS)


def test_learns_and_scores(spark, write):
    docs, labels = frames(spark)
    rows = tx.op5_toxic_lexicon(spark, write(documents=docs, labels=labels)).collect()
    assert len(rows) == docs.count()
    truth = {i: i % 4 == 0 for i in range(400)}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(held) > 40 and all(r.predicted == truth[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[1000].score == by_id[1001].score < 0.5
    assert by_id[None].predicted == 1 and not by_id[None].held_out


def test_no_labels_or_rows(spark, docs, empty, clash):
    none = spark.createDataFrame([], LABELS)
    lexicon = tx.learn(docs, none)
    assert tx.labelled_sample(clash(docs), spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")).count() >= 1
    scored = tx.score_documents(clash(docs), lexicon)
    assert scored.count() == docs.count() and scored.where("score >= 0.5").count() == 0
    assert tx.score_documents(empty, lexicon).count() == 0
