import zlib

from quarrylens.llm import sharding as sh


def test_every_row_once_and_places_gapless(spark, docs, write):
    rows = sh.op1_shard_slots(spark, write(documents=docs)).collect()
    assert len(rows) == docs.count()
    for shard in {r.shard for r in rows}:
        places = sorted(r.slot for r in rows if r.shard == shard)
        assert places == list(range(len(places)))
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in rows}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for key, text in texts.items():
        raw = (text or "").encode()
        assert sizes[key] == (len(raw) + 1, zlib.crc32(raw))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_bytes_come_out_near_equal(spark):
    frame = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(id % 97 AS int)) AS text")
    placed = sh.placements(frame, shards=8).groupBy("shard").sum("size").collect()
    loads = [r[1] for r in placed]
    assert len(loads) == 8 and max(loads) - min(loads) < 0.01 * max(loads)


def test_rebalancing_moves_whole_slots_to_the_new_shard_only(spark, tmp_path):
    loads = [{"slot": s, "rows": 1, "bytes": 1 + s % 13} for s in range(sh.SLOTS)]
    first = sh.deal(loads, 8)
    second = sh.rebalance(first, loads, 9)
    moved = [s for s in range(sh.SLOTS) if first.owner[s] != second.owner[s]]
    assert second.version == 2 and len(moved) < sh.SLOTS / 6
    held = [sum(r["bytes"] for r in loads if second.owner[r["slot"]] == k) for k in range(9)]
    assert max(held) - min(held) <= 0.05 * max(held)
    for version in (first, second):
        sh.save_map(spark, version, str(tmp_path / "maps"))
    assert sh.load_map(spark, str(tmp_path / "maps"), 1) == first
    assert sh.load_map(spark, str(tmp_path / "maps"), 2) == second


def test_empty_table_and_clashing_columns(docs, empty, clash):
    assert sh.placements(empty, 8).count() == 0
    assert sh.shard_documents(empty, 8).count() == 0
    assert sh.placements(clash(docs), 8).count() == docs.count()
    sharded = sh.shard_documents(clash(docs), 8)
    assert sharded.columns == clash(docs).columns and dict(sharded.dtypes)["shard"] == "int"
