from collections import defaultdict

from quarrylens.llm import mixing as mx


def targets(sizes: dict) -> dict:
    """Share, cap, share the excess again, until nothing is above its ceiling."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    open_, out, left = set(names), {}, float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        above = [s for s in open_ if left * weight[s] / total >= 3 * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in above:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_and_words_taken(spark, docs, write):
    folder = write(documents=docs)
    rows = mx.op4_pareto_mix(spark, folder).collect()
    assert len(rows) == docs.count()
    source = {(r.doc_id, r.text): r.source for r in docs.collect()}
    by_id = {k[0]: v for k, v in source.items()}
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        s = by_id[r.doc_id]
        sizes[s] += r["size"]
        taken[s] += r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r["size"]
    want = targets(sizes)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s])
        assert abs(taken[s] - target[s]) <= 1
    again = mx.op4_pareto_mix(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_many_documents_meet_their_target(spark):
    frame = spark.range(5000).selectExpr(
        "id AS doc_id", "concat('s', id % 7) AS source", "repeat('w ', cast(id % 53 AS int)) AS text"
    )
    rows = mx.pareto_mix(frame).selectExpr("source", "copies * size + part AS taken", "target")
    for r in rows.groupBy("source").agg({"taken": "sum", "target": "max"}).collect():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 1


def test_mixed_documents(docs, empty, clash):
    wide = clash(docs)
    mixed = mx.mixed_documents(wide)
    assert mixed.columns == wide.columns
    assert mixed.where("text IS NULL OR trim(text) = ''").count() == 0
    assert mx.mixed_documents(empty).count() == 0 and mx.pareto_mix(empty).count() == 0


def test_rows_that_differ_in_where_nulls_are(spark):
    rows = [(1, "one two three", None, "a"), (1, "one two three", "a", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mixed = mx.mixed_documents(frame)
    assert {(r["lang"], r["source"]) for r in mixed.collect()} == {(None, "a"), ("a", None)}


def scale_by_hand(sizes, due):
    """Certain documents by trial: the largest one goes as long as its probability reaches 1."""
    rest, certain = sorted((s for s in sizes if s), reverse=True), []
    while True:
        scale = (due - sum(certain)) / sum(s * s for s in rest)
        if scale * rest[0] < 1:
            return scale, certain
        certain.append(rest.pop(0))


def test_inclusion_grows_with_size_and_large_documents_are_certain(spark):
    # The longest documents are certain in source a, which gives two thirds of its words, and
    # not in source b, which gives a third on top of a whole copy.
    frame = spark.range(24000).selectExpr(
        "id AS doc_id", "if(id % 2 = 0, 'a', 'b') AS source",
        "repeat('w ', cast(if(id % 40 < 2, 400, id % 40) AS int)) AS text",
    )
    rows = mx.pareto_mix(frame).collect()
    for source in "ab":
        mine = [r for r in rows if r.source == source]
        sizes = [r["size"] for r in mine]
        due = round(mine[0].target) - mine[0].copies * mine[0].source_size
        assert 0 < due < sum(sizes)
        scale, certain = scale_by_hand(sizes, due)
        assert set(certain) == ({400} if source == "a" else set())
        assert all(r.part == r["size"] for r in mine if r["size"] in certain)
        for size in sorted(set(sizes) - {0, *certain}):
            group = [r.part == size for r in mine if r["size"] == size]
            p = scale * size
            assert abs(sum(group) / len(group) - p) < 5 * (p * (1 - p) / len(group)) ** 0.5 + 0.01
        assert sum(r.part for r in mine) == due
