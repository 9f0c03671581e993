"""Readers for delimited text, JSON, Parquet and database tables, with format routing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.errors import EngineError, require
from quarrylens.ids import nan_to_null
from quarrylens.sources.sqlite import read_sqlite

# Candidate delimiters and how many lines are looked at.
DELIMITERS = {",": ",", ";": ";", "tab": "\t", "pipe": "|"}
SNIFF_LINES = 100
CORRUPT = "__corrupt_record"


def detect_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """The candidate whose parsed width above one is shared by most of the first lines."""
    lines = spark.read.option("encoding", encoding).text(path).filter(F.trim("value") != "").limit(SNIFF_LINES)
    bare = F.regexp_replace("value", r'"(?:""|[^"])*"', "q")
    widths = F.array(*[
        F.struct(F.lit(i).alias("order"), F.lit(d).alias("d"),
                 (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))) + 1).alias("w"))
        for i, d in enumerate(DELIMITERS.values())])
    counts = lines.select(F.inline(widths)).filter("w > 1").groupBy("order", "d", "w").agg(
        F.count(F.lit(1)).alias("n"))
    best = counts.orderBy(F.desc("n"), F.desc("w"), "order").limit(1).collect()
    return best[0]["d"] if best else ","


def _check_headers(names: list[str]) -> None:
    require(all(n and n.strip() for n in names), "BLANK_HEADER")
    folded = [n.strip().lower() for n in names]
    repeated = sorted({n for n in folded if folded.count(n) > 1})
    require(not repeated, "DUPLICATE_HEADER", columns=repeated)


def read_delimited(spark: SparkSession, path: str, has_header: bool = True, delimiter: str | None = None,
                   encoding: str = "UTF-8", infer_types: bool = False, check_ragged: bool = True) -> DataFrame:
    """Text columns unless ``infer_types``. Ragged rows are found by one count and refused.

    Large inputs should leave ``infer_types`` off and cast with the type operators, which
    saves a pass over the files.
    """
    sep = delimiter or detect_delimiter(spark, path, encoding)
    head = spark.read.option("sep", sep).option("encoding", encoding).option("header", "false").csv(path).limit(1)
    first = head.collect()
    require(bool(first), "EMPTY_FILE")
    if has_header:
        raw = (spark.read.option("encoding", encoding).text(path).limit(1).collect()[0][0]).lstrip("﻿")
        row = spark.createDataFrame([(raw,)], "line string").select(F.from_csv(
            "line", ", ".join(f"c{i} string" for i in range(len(first[0]))), {"sep": sep}).alias("h")).collect()[0]["h"]
        names = [("" if v is None else v) for v in row]
        _check_headers(names)
        names = [n.strip() for n in names]
    else:
        names = [f"column_{i + 1}" for i in range(len(first[0]))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("escape", '"')
        .option("header", str(has_header).lower()).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", "true")
    )
    df = reader.csv(path)
    if check_ragged:
        bad = df.filter(F.col(CORRUPT).isNotNull()).limit(1).select(CORRUPT, *names).collect()
        require(not bad, "RAGGED_ROWS",
                example=bad[0][CORRUPT] if bad else None)
    df = df.drop(CORRUPT)
    if infer_types:
        typed = (
            spark.read.option("sep", sep).option("encoding", encoding).option("escape", '"')
            .option("header", str(has_header).lower()).option("inferSchema", "true").csv(path)
        )
        df = df.withColumns({n: F.col(n).try_cast(f.dataType) for n, f in zip(names, typed.schema.fields)})
    return df


def flatten(df: DataFrame) -> DataFrame:
    """Struct leaves become columns named ``a.b``; arrays are kept as JSON text."""
    out = []

    def walk(path: list[str], dtype):
        c = F.col(".".join(f"`{p}`" for p in path))
        if isinstance(dtype, T.StructType):
            for f in dtype.fields:
                walk([*path, f.name], f.dataType)
        elif isinstance(dtype, (T.ArrayType, T.MapType)):
            out.append(F.to_json(c).alias(".".join(path)))
        else:
            out.append(c.alias(".".join(path)))

    for f in df.schema.fields:
        walk([f.name], f.dataType)
    return df.select(*out)


def read_json(spark: SparkSession, path: str, is_jsonl: bool | None = None) -> DataFrame:
    """JSON lines, an array of objects, or one object whose single key holds the array.

    A file starting with ``{`` counts as JSON lines unless told otherwise.
    """
    if is_jsonl is None:
        start = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        require(bool(start), "EMPTY_FILE")
        is_jsonl = start[0][0].lstrip("﻿ \t").startswith("{")
    df = spark.read.option("multiLine", str(not is_jsonl).lower()).json(path)
    fields = df.schema.fields
    if not is_jsonl and len(fields) == 1 and isinstance(fields[0].dataType, T.ArrayType) and isinstance(
            fields[0].dataType.elementType, T.StructType):
        df = df.select(F.inline(F.col(f"`{fields[0].name}`")))
    return flatten(df)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def inspect(df: DataFrame, file_type: str = "parquet") -> DataFrame:
    """One row per column plus the row count; for Parquet the count reads footers only."""
    items = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                               F.lit(f.dataType.simpleString()).alias("type"))
                      for i, f in enumerate(df.schema.fields)])
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    return counted.withColumn("i", F.explode(items)).select(
        F.lit(file_type).alias("file_type"), "i.*", "row_count", F.lit(len(df.columns)).alias("column_count"))


# ---------------------------------------------------------------- databases

def read_table(spark: SparkSession, url: str, table: str, partition_column: str | None = None,
               partitions: int = 64, fetch_size: int = 10_000, **properties) -> DataFrame:
    """JDBC scan. With a numeric or date ``partition_column`` it is split into range reads,
    whose bounds come from one pushed-down min/max query."""
    base = spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size).options(**properties)
    if not partition_column:
        return base.option("dbtable", table).load()
    ends = base.option("query", f"SELECT MIN({partition_column}) AS lo, MAX({partition_column}) AS hi FROM {table}"
                       ).load().first()
    if ends[0] is None:
        return base.option("dbtable", table).load()
    return (
        base.option("dbtable", table).option("partitionColumn", partition_column).option("numPartitions", partitions)
        .option("lowerBound", str(ends[0])).option("upperBound", str(ends[1])).load()
    )


def largest_table(spark: SparkSession, url: str, tables: list[str], **properties) -> str:
    """Name of the table with most rows; the counts run inside the database."""
    require(bool(tables), "NO_TABLES")
    base = spark.read.format("jdbc").option("url", url).options(**properties)
    sizes = {t: base.option("query", f"SELECT COUNT(*) AS n FROM {t}").load().first()[0] for t in tables}
    return max(sorted(sizes), key=lambda t: sizes[t])


# ---------------------------------------------------------------- routing

EXTENSIONS = {"csv": "csv", "tsv": "csv", "txt": "csv", "json": "json", "jsonl": "json", "ndjson": "json",
              "parquet": "parquet", "sqlite": "sqlite", "sqlite3": "sqlite", "db": "sqlite"}
# What files of a kind begin with, and Parquet's end.
SIGNATURES = {"parquet": b"PAR1", "sqlite": b"SQLite format 3\x00"}


def _ends(batches):
    """The first sixteen and last four bytes of each file; nulls where its store cannot be opened
    from here."""
    import pyarrow as pa
    from pyarrow import fs

    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                store, inner = fs.FileSystem.from_uri(path)
                with store.open_input_file(inner) as file:
                    size = file.size()
                    rows.append((path, file.read_at(min(16, size), 0), file.read_at(min(4, size), max(0, size - 4))))
            except (pa.ArrowInvalid, OSError):
                rows.append((path, None, None))
        columns = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary())],
            names=["path", "head", "tail"])


def detect_file_types(spark: SparkSession, path: str) -> DataFrame:
    """(path, file_type, problem) for every file below a path, by its name and its signature. The
    listing and twenty bytes of each file are read, spread over the tasks, no file body.

    A Parquet or SQLite signature under a name of another kind, and a name ``.parquet`` without
    the signature at both ends, are problems. A SQLite signature counts under a name that says
    nothing. In a store that only Spark's own readers can open names decide alone."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    seen = files.mapInArrow(_ends, "path string, head binary, tail binary").withColumn("named", F.try_element_at(by_name, ext))

    def begins(kind_: str):
        mark = SIGNATURES[kind_]
        return F.substring("head", 1, len(mark)) == F.lit(mark)

    known, parquet, sqlite = F.col("head").isNotNull(), begins("parquet"), begins("sqlite")
    whole = parquet & (F.col("tail") == F.lit(SIGNATURES["parquet"]))
    problem = (
        F.when(known & parquet & ~F.col("named").eqNullSafe(F.lit("parquet")), "PARQUET_UNDER_OTHER_NAME")
        .when(known & (F.col("named") == "parquet") & ~whole, "NOT_PARQUET")
        .when(known & sqlite & F.col("named").isin("csv", "json", "parquet"), "SQLITE_UNDER_OTHER_NAME"))
    kind_ = F.coalesce("named", F.when(sqlite, "sqlite"))
    return seen.select("path", kind_.alias("file_type"), problem.alias("problem"))


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """Route one path to its reader by the names and signatures of its files; a file that is not
    what its name says is refused before any reader starts."""
    kinds = detect_file_types(spark, path).where("file_type IS NOT NULL OR problem IS NOT NULL")
    rows = kinds.groupBy("file_type", "problem").agg(F.min("path").alias("example")).collect()
    wrong = [r for r in rows if r["problem"]]
    require(not wrong, "FILE_TYPE_MISMATCH", path=wrong[0]["example"] if wrong else path,
            reason=wrong[0]["problem"] if wrong else None)
    found = sorted(r["file_type"] for r in rows)
    require(bool(found), "UNSUPPORTED_FILE_TYPE", path=path)
    require(len(found) == 1, "MIXED_FILE_TYPES", types=found)
    reader = {"csv": read_delimited, "json": read_json, "parquet": read_parquet, "sqlite": read_sqlite}[found[0]]
    try:
        return reader(spark, path, **options)
    except EngineError:
        raise
    except Exception as exc:
        raise EngineError("FILE_TYPE_MISMATCH", details={"path": path, "reason": str(exc).split("\n")[0]}) from exc
