"""Tables of a SQLite file as a partitioned Spark source, and a sink for such files.

The file lies in a folder that driver and executors share. A scan is split into ranges of rowid,
one connection per task; simple comparisons go into the statement. A table without rowids is read
by one task. Column types follow the declared ones; a value that does not fit its column's type
ends the scan with an error.
"""

from __future__ import annotations

import sqlite3
from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan,
    LessThanOrEqual,
)

from quarrylens.errors import EngineError, require
from quarrylens.session import cut_lineage

BATCH = 10_000
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def local_path(path: str) -> str:
    return path.removeprefix("file://")


def _open(path: str):
    return sqlite3.connect(f"file:{quote(local_path(path))}?mode=ro", uri=True)


def _name(text: str) -> str:
    return '"' + text.replace('"', '""') + '"'


def _type(declared: str) -> str:
    """Affinity of a declared type: the first name found in it decides."""
    text = (declared or "").upper()
    for names, kind in ((("INT",), "bigint"), (("CHAR", "CLOB", "TEXT"), "string"), (("BLOB",), "binary")):
        if any(n in text for n in names):
            return kind
    return "double" if text else "binary"


def table_columns(path: str, table: str) -> list[tuple[str, str]]:
    with _open(path) as db:
        found = db.execute(f"PRAGMA table_info({_name(table)})").fetchall()
    require(bool(found), "UNKNOWN_TABLE", table=table)
    return [(row[1], _type(row[2])) for row in found]


def table_sizes(path: str) -> dict[str, int]:
    """Rows per table, by one statement."""
    try:
        with _open(path) as db:
            names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite%'")]
            if not names:
                return {}
            counts = " UNION ALL ".join(f"SELECT {i}, COUNT(*) FROM {_name(n)}" for i, n in enumerate(names))
            return {names[i]: n for i, n in db.execute(counts)}
    except sqlite3.DatabaseError as exc:
        raise EngineError("INVALID_SQLITE", details={"path": path, "reason": str(exc)}) from exc


def largest_table(path: str) -> str:
    """The table with most rows, the first of equal ones."""
    sizes = table_sizes(path)
    require(bool(sizes), "NO_TABLES", path=path)
    return max(sizes, key=lambda n: sizes[n])


class _Range(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, options: dict, columns: list[tuple[str, str]]):
        self.path, self.table = options["path"], options["table"]
        self.count = int(options.get("partitions", "64"))
        self.columns = columns
        self.where: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column is not None and type(f) in _COMPARE and isinstance(f.value, (int, float, str)):
                self.where.append((f"{_name(column)} {_COMPARE[type(f)]} ?", f.value))
            elif column is not None and type(f) is IsNotNull:
                self.where.append((f"{_name(column)} IS NOT NULL", None))
            else:
                yield f

    def partitions(self):
        try:
            with _open(self.path) as db:
                low, high = db.execute(f"SELECT MIN(rowid), MAX(rowid) FROM {_name(self.table)}").fetchone()
        except sqlite3.OperationalError:
            return [_Range(None, None)]  # no rowids
        if low is None:
            return [_Range(None, None)]
        width = max(1, -(-(high - low + 1) // self.count))
        return [_Range(at, min(at + width - 1, high)) for at in range(low, high + 1, width)]

    def read(self, part):
        import pyarrow as pa

        kinds = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}
        names = [n for n, _ in self.columns]
        tests = [t for t, _ in self.where]
        values = [v for _, v in self.where if v is not None]
        if part.low is not None:
            tests.append("rowid BETWEEN ? AND ?")
            values += [part.low, part.high]
        text = f"SELECT {', '.join(map(_name, names))} FROM {_name(self.table)}"
        text += f" WHERE {' AND '.join(tests)}" if tests else ""
        with _open(self.path) as db:
            cursor = db.execute(text, values)
            while rows := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), self.columns)], names=names)


class SqliteTable(DataSource):
    """``format("sqlite_table")`` with the options path, table and partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        columns = table_columns(self.options["path"], self.options["table"])
        return ", ".join(f"`{n}` {k}" for n, k in columns)

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), [(f.name, f.dataType.simpleString()) for f in schema.fields])


def read_sqlite(spark: SparkSession, path: str, table: str | None = None, partitions: int = 64) -> DataFrame:
    """A table of the file, the largest one unless it is named."""
    table = table or largest_table(path)
    table_columns(path, table)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteTable)
    return spark.read.format("sqlite_table").options(path=path, table=table, partitions=partitions).load()


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """Writes one table; others in the file stay. A SQLite file has one writer, so one task takes
    the rows batch by batch in one transaction: a task that is run again starts over."""
    declared = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL",
                "boolean": "INTEGER", "binary": "BLOB"}
    columns = [(f.name, declared.get(f.dataType.simpleString(), "TEXT")) for f in df.schema.fields]
    typed = df.select(*[
        F.col(f"`{n}`").cast({"INTEGER": "long", "REAL": "double", "BLOB": "binary"}.get(k, "string")).alias(f"c{i}")
        for i, (n, k) in enumerate(columns)])

    def put(batches):
        import pyarrow as pa

        db = sqlite3.connect(local_path(path), timeout=600)
        rows = 0
        with db:
            db.execute(f"DROP TABLE IF EXISTS {_name(table)}")
            db.execute(f"CREATE TABLE {_name(table)} ({', '.join(f'{_name(n)} {k}' for n, k in columns)})")
            marks = ", ".join("?" * len(columns))
            for batch in batches:
                values = zip(*[c.to_pylist() for c in batch.columns], strict=True)
                db.executemany(f"INSERT INTO {_name(table)} VALUES ({marks})", values)
                rows += batch.num_rows
        db.close()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    cut_lineage(typed.coalesce(1).mapInArrow(put, "rows long"))
