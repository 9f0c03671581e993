"""SQLite tables and routing by signature."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from quarrylens.errors import EngineError
from quarrylens.sources import readers, sqlite


def test_round_trip_over_ranges(spark, tmp_path):
    rows = [(i, f"name'{i}" if i % 5 else None, i / 7, i % 2 == 0) for i in range(1000)]
    frame = spark.createDataFrame(rows, 'id long, "the name" string, v double, flag boolean'.replace('"the name"', "`the name`"))
    path = f"file://{tmp_path}/x.db"
    sqlite.write_sqlite(frame.limit(3), path, "small")
    sqlite.write_sqlite(frame, path, "large")
    sqlite.write_sqlite(frame, path, "large")  # again: replaced, not doubled
    assert sqlite.table_sizes(path) == {"small": 3, "large": 1000} and sqlite.largest_table(path) == "large"
    read = sqlite.read_sqlite(spark, path, partitions=7)
    assert read.rdd.getNumPartitions() == 7
    assert sorted(map(tuple, read.collect()), key=lambda r: r[0]) == [(a, b, c, int(d)) for a, b, c, d in rows]
    some = read.where((F.col("id") >= 990) & F.col("the name").isNotNull() & (F.col("v") < 142.5))
    assert {r["id"] for r in some.collect()} == {r[0] for r in rows if r[0] >= 990 and r[1] is not None and r[2] < 142.5}


def test_filters_run_in_the_database(spark, tmp_path):
    reader = sqlite._Reader({"path": "x", "table": "t"}, [("id", "bigint")])
    from pyspark.sql.datasource import EqualTo, StringContains

    left = list(reader.pushFilters([EqualTo(("id",), 3), StringContains(("id",), "x")]))
    assert [type(f) for f in left] == [StringContains] and reader.where == [('"id" = ?', 3)]


def test_tables_without_rowids_and_empty_ones(spark, tmp_path):
    path = str(tmp_path / "k.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE k (a TEXT PRIMARY KEY, b REAL) WITHOUT ROWID")
        db.execute("INSERT INTO k VALUES ('x', 1.5), ('y', NULL)")
        db.execute("CREATE TABLE e (a INTEGER)")
    assert sorted(map(tuple, sqlite.read_sqlite(spark, path).collect())) == [("x", 1.5), ("y", None)]
    assert sqlite.read_sqlite(spark, path, "e").collect() == []
    with pytest.raises(EngineError):
        sqlite.read_sqlite(spark, path, "none")


def test_broken_files(spark, tmp_path):
    (tmp_path / "bad.db").write_bytes(b"not a database at all, but long enough to be read")
    with pytest.raises(EngineError) as info:
        readers.read_any(spark, str(tmp_path / "bad.db"))
    assert info.value.code == "INVALID_SQLITE"


def test_names_and_signatures(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    body = next((tmp_path / "p").glob("*.parquet")).read_bytes()
    cases = {"a.csv": body, "b.parquet": b"x,y\n1,2\n", "c.parquet": body[:-1], "d.csv": b"x,y\n1,2\n", "e.parquet": body}
    for name, data in cases.items():
        folder = tmp_path / name.replace(".", "_")
        folder.mkdir()
        (folder / name).write_bytes(data)
    problems = {}
    for name in cases:
        row = readers.detect_file_types(spark, str(tmp_path / name.replace(".", "_"))).first()
        problems[name] = (row["file_type"], row["problem"])
    assert problems == {
        "a.csv": ("csv", "PARQUET_UNDER_OTHER_NAME"), "b.parquet": ("parquet", "NOT_PARQUET"),
        "c.parquet": ("parquet", "NOT_PARQUET"), "d.csv": ("csv", None), "e.parquet": ("parquet", None)}
    for name in ("a.csv", "b.parquet"):
        with pytest.raises(EngineError) as info:
            readers.read_any(spark, str(tmp_path / name.replace(".", "_")))
        assert info.value.code == "FILE_TYPE_MISMATCH"
    assert readers.read_any(spark, str(tmp_path / "e_parquet")).count() == 3


def test_sqlite_signature_without_a_name(spark, tmp_path):
    sqlite.write_sqlite(spark.range(4), str(tmp_path / "data"), "t")
    assert readers.read_any(spark, str(tmp_path / "data")).count() == 4
