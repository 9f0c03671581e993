import re

from quarrylens.llm import surrogates as sg

TEXTS = [
    (1, "Write Mrs. Smith at a.b7@c-d.com or +1 (017) 555-7713; card 4111 1111 1111 1111."),
    (2, "Mrs. Smith again: a.b7@c-d.com, host 10.0.0.1, ssn 123-45-6789"),
    (3, "Mr Smith, A.B7@C-D.COM and 4111111111111112; Госпожа Иванова"),
    (4, None),
    (5, ""),
    (6, "no entities in 2024, version 4.0 and 1.2.3"),
    (6, "no entities in 2024, version 4.0 and 1.2.3"),
    (None, "ping 10.0.0.1 " * 3),
]


def luhn(number):
    digits = [int(c) for c in re.sub("[ -]", "", number)][::-1]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_replacements(spark):
    frame = spark.createDataFrame(TEXTS, "doc_id long, text string")
    out, mapped = sg.pseudonymize(frame)
    rows = {r.doc_id: r for r in out.collect()}
    pairs = {r.entity: (r.kind, r.surrogate) for r in mapped.collect()}
    assert out.count() == len(TEXTS)
    for r in out.collect():
        assert not any(e in (r.text or "") for e in pairs)
    assert len({s for _, s in pairs.values()}) == len(pairs)
    assert rows[4].text is None and rows[5].text == "" and rows[6].text == TEXTS[5][1]
    assert [rows[k].n_entities for k in (1, 2, 3, 4, 6)] == [4, 4, 4, 0, 0]
    for entity, (kind, new) in pairs.items():
        if kind != "name" and kind != "ipv4" and kind != "email":
            assert re.sub(r"\d", "9", entity) == re.sub(r"\d", "9", new)
        if kind == "card":
            assert luhn(entity) == luhn(new)
        if kind == "ipv4":
            assert all(0 < int(o) < 256 for o in new.split("."))
    assert pairs["Mrs. Smith"][1].startswith("Mrs. ") and pairs["Mr Smith"][1].startswith("Mr ")
    assert re.search("[а-я]", pairs["Госпожа Иванова"][1].split()[1])
    assert rows[None].text == TEXTS[-1][1].replace("10.0.0.1", pairs["10.0.0.1"][1])
    assert pairs["10.0.0.1"][1] in rows[2].text and pairs["a.b7@c-d.com"][1] in rows[1].text
    again = {r.entity: r.surrogate for r in sg.pseudonymize(frame)[1].collect()}
    assert again == {e: s for e, (_, s) in pairs.items()}
    assert sg.pseudonymize(frame, key="other")[1].collect() != mapped.collect()


def test_clashes_are_drawn_again(spark):
    many = spark.range(150).selectExpr("concat('1.0.0.', id) AS entity", "'ipv4' AS kind")
    short = spark.range(100).selectExpr("concat('a@', lpad(id, 2, '0'), '.x') AS entity", "'email' AS kind")
    tiny = spark.range(10).selectExpr("cast(id AS string) AS entity", "'phone' AS kind")
    for frame in (many, short, tiny):
        mapped = sg.surrogate_map(frame.select("kind", "entity")).collect()
        assert len({r.surrogate for r in mapped}) == len(mapped) == frame.count()
        assert not {r.surrogate for r in mapped} & {r.entity for r in mapped}


def test_other_columns_stay_whatever_their_names(docs, clash):
    wide = clash(docs)
    changed, _ = sg.pseudonymize(wide)
    assert changed.columns == [c for c in wide.columns if c != "n_entities"] + ["n_entities"]
    rows = changed.collect()
    assert len(rows) == docs.count()
    assert {r["__surrogates"] for r in rows} == {"own __surrogates"} and {r["toxic"] for r in rows} == {"own toxic"}


def test_long_words_and_empty_table(spark, empty, clash):
    frame = spark.createDataFrame([(1, "x" * 300_000 + " 5"), (2, "1" * 50_000)], "doc_id long, text string")
    assert [r.n_entities for r in sg.pseudonymize(frame)[0].collect()] == [0, 0]
    assert sg.pseudonymize(clash(empty))[0].count() == 0


NAMES = [
    ("Mr. John Smith", " said so."),
    ("Mr. Smith", "'s dog. The end"),
    ("Mrs. McDonald", ", I think"),
    ("Ms. Anna-Maria Lopez", "\nnext"),
    ("Mr O'Brien", " I know"),
    ("Dr. Jane Roe", "; Then"),
    ("Frau Dr. Ursula von der Leyen", "."),
    ("Prof. J. R. R. Tolkien", ". It"),
    ("Mr. J.R. Ewing", " left"),
    ("Mr. T", " left"),
    ("Mr. D’Angelo", " Mrs. Jones met"),
    ("Госпожа Анна Иванова-Петрова", " и"),
]


def test_whole_names(spark):
    frame = spark.createDataFrame([(i, n + rest) for i, (n, rest) in enumerate(NAMES)], "doc_id long, text string")
    out, mapped = sg.pseudonymize(frame)
    pairs = {r.entity: r.surrogate for r in mapped.collect()}
    assert set(pairs) == {n for n, _ in NAMES} | {"Mrs. Jones"}
    assert len(set(pairs.values())) == len(pairs)
    rows = {r.doc_id: r.text for r in out.collect()}
    for i, (name, rest) in enumerate(NAMES):
        assert rows[i] == pairs[name] + rest.replace("Mrs. Jones", pairs["Mrs. Jones"])
        title = {"Mr.", "Mrs.", "Ms.", "Mr", "Dr.", "Prof.", "Frau", "Госпожа", "von", "der"}
        for word in re.findall(r"[^ .]{2,}\.?", name):
            assert word in title or word not in rows[i]
    assert pairs["Mr. John Smith"].split()[-1] == pairs["Mr. Smith"].split()[-1]
    assert pairs["Frau Dr. Ursula von der Leyen"].startswith("Frau Dr. ")
    assert " von der " in pairs["Frau Dr. Ursula von der Leyen"]


def test_long_runs_of_capitalised_words(spark):
    texts = [(1, "Mr. " + "A " * 50_000), (2, "Mr. X" + "y" * 300_000), (3, "Mr. " + "A." * 50_000)]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert [r.n_entities for r in sg.pseudonymize(frame)[0].orderBy("doc_id").collect()] == [1, 1, 1]
