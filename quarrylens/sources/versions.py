"""Versioned tables, their catalog, lineage and differences. All state is Parquet."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.errors import require
from quarrylens.ids import ROW_ID, data_columns, with_row_id

VERSIONS = ("dataset string, version_number int, parent_version int, path string, row_count long, column_count int, "
            "content_hash string, health_score double, created_at timestamp")
LINEAGE = ("dataset string, step string, input_version int, output_version int, parameters string, "
           "affected_rows long, affected_columns int, before_stats string, after_stats string, at timestamp")


def content_hash(df: DataFrame) -> str:
    """Order-free fingerprint from one pass: exact sums of two independent hashes of the rows
    (128 bits in all), with the row count and the schema."""
    cols = sorted(data_columns(df))
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(salt), *cols).cast("decimal(38,0)")), F.lit(0)).alias(salt)
            for salt in ("a", "b")]
    row = df.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    shape = ",".join(f"{c}:{df.schema[c].dataType.simpleString()}" for c in cols)
    return f"{row['n']}:{row['a']}:{row['b']}:{shape}"


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Equal columns and equal fingerprints; rows are never shuffled to compare them."""
    return sorted(data_columns(a)) == sorted(data_columns(b)) and content_hash(a) == content_hash(b)


class VersionStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _table(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/_{name}")
        except Exception as exc:  # nothing written yet
            if "PATH_NOT_FOUND" in str(exc):
                return self.spark.createDataFrame([], schema)
            raise

    def _append(self, name: str, schema: str, row: tuple) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{self.root}/_{name}")

    def versions(self, dataset: str | None = None) -> DataFrame:
        t = self._table("versions", VERSIONS)
        return t.filter(F.col("dataset") == dataset) if dataset else t

    def lineage(self, dataset: str) -> DataFrame:
        return self._table("lineage", LINEAGE).filter(F.col("dataset") == dataset).orderBy("at")

    def catalog(self) -> DataFrame:
        """Latest version of every dataset with its counts and health."""
        latest = F.max_by(F.struct("version_number", "path", "row_count", "column_count", "health_score", "created_at"),
                          "version_number")
        return self.versions().groupBy("dataset").agg(latest.alias("v"), F.count(F.lit(1)).alias("versions")).select(
            "dataset", "versions", "v.*").orderBy("dataset")

    def latest(self, dataset: str) -> dict | None:
        rows = self.versions(dataset).orderBy(F.desc("version_number")).limit(1).collect()
        return rows[0].asDict() if rows else None

    def read(self, dataset: str, version: int | None = None) -> DataFrame:
        info = self.versions(dataset)
        if version is not None:
            info = info.filter(F.col("version_number") == version)
        rows = info.orderBy(F.desc("version_number")).limit(1).collect()
        require(bool(rows), "VERSION_NOT_FOUND", dataset=dataset, version=version)
        return self.spark.read.parquet(rows[0]["path"])

    def write(self, df: DataFrame, dataset: str, step: str = "import", parameters: dict | None = None,
              health_score: float | None = None) -> dict:
        """Next version, unless the content equals the current one; then the current one is
        returned with ``created`` false and no lineage is added."""
        parent = self.latest(dataset)
        if ROW_ID not in df.columns:
            df = with_row_id(df)
        if parent and content_hash(df) == parent["content_hash"]:
            return {**parent, "created": False}
        number = (parent["version_number"] if parent else 0) + 1
        path = f"{self.root}/{dataset}/v{number}"
        df.write.mode("errorifexists").parquet(path)
        stored = self.spark.read.parquet(path)
        rows, columns = stored.count(), len(data_columns(stored))
        digest, now = content_hash(stored), datetime.now(timezone.utc).replace(tzinfo=None)
        parent_number = parent["version_number"] if parent else None
        self._append("versions", VERSIONS, (dataset, number, parent_number, path, rows, columns, digest,
                                            None if health_score is None else float(health_score), now))
        before = {"row_count": parent["row_count"], "column_count": parent["column_count"]} if parent else {}
        self._append("lineage", LINEAGE, (
            dataset, step, parent_number, number, json.dumps(parameters or {}, default=str),
            abs(rows - before.get("row_count", 0)), abs(columns - before.get("column_count", 0)),
            json.dumps(before), json.dumps({"row_count": rows, "column_count": columns}), now))
        return {"dataset": dataset, "version_number": number, "parent_version": parent_number, "path": path,
                "row_count": rows, "column_count": columns, "content_hash": digest, "created": True}


def version_diff(before: DataFrame, after: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Per shared column the changed cells of rows in both; plus rows only on one side."""
    shared = [c for c in before.columns if c in after.columns and c != row_id]
    a = before.select(F.col(row_id).alias("__a"), *[F.col(c).cast("string").alias(f"__a_{c}") for c in shared])
    b = after.select(F.col(row_id).alias("__b"), *[F.col(c).cast("string").alias(f"__b_{c}") for c in shared])
    t = a.join(b, F.col("__a") == F.col("__b"), "full")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    parts = [F.struct(F.lit(c).alias("column"), F.count_if(both & F.coalesce(
        F.col(f"__a_{c}") != F.col(f"__b_{c}"), F.lit(False))).alias("changed_cells")) for c in shared]
    return t.agg(F.array(*parts).alias("x"), F.count_if(F.col("__b").isNull()).alias("removed_rows"),
                 F.count_if(F.col("__a").isNull()).alias("added_rows")).select(
        F.inline("x"), "removed_rows", "added_rows")


def export_table(df: DataFrame, path: str, fmt: str = "csv", max_rows: int | None = None) -> DataFrame:
    """Report sink: all rows (``max_rows`` is the caller's own bound); text that a spreadsheet
    would run gets a quote in front."""
    require(fmt in ("csv", "parquet"), "UNSUPPORTED_FORMAT")
    out = safe_cells(df)
    out = out if max_rows is None else out.limit(max_rows)
    writer = out.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)
    return out


def safe_cells(df: DataFrame) -> DataFrame:
    text = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return df.withColumns({
        c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)) for c in text
    }) if text else df
