"""Sources, sinks and versions: tables are written to the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.ids import with_row_id
from quarrylens.operators import filters
from quarrylens.queries.registry import query, rounded
from quarrylens.session import shared_folder
from quarrylens.sources import readers, sqlite, versions


def _path(df: DataFrame, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


def _part(t):
    return t("part").select("p_partkey", "p_name", "p_size", "p_retailprice")


_PART = "SELECT p_partkey, p_name, p_size::BIGINT AS p_size, round(p_retailprice, 2) AS p_retailprice FROM part"


def _typed(df: DataFrame) -> DataFrame:
    kinds = {"p_partkey": "long", "p_size": "long", "p_retailprice": "double"}
    return rounded(df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items()}), 2)


@query("s1_delimited", _PART)
def _(t):
    df = _part(t)
    path = _path(df, "csv")
    df.write.option("header", "true").csv(path)
    return _typed(readers.read_delimited(df.sparkSession, path))


@query("s2_delimiter", "SELECT ';' AS delimiter, count(*)::BIGINT AS rows FROM part")
def _(t):
    df = _part(t)
    path = _path(df, "csv")
    df.write.option("header", "true").option("sep", ";").csv(path)
    found = readers.detect_delimiter(df.sparkSession, path)
    read = readers.read_delimited(df.sparkSession, path, delimiter=found)
    return read.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(found).alias("delimiter"), "rows")


@query(
    "s3_nested_json",
    "SELECT p_partkey, p_name AS \"about.name\", p_size::BIGINT AS \"about.size\" FROM part",
)
def _(t):
    df = _part(t)
    path = _path(df, "json")
    about = F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"))
    df.select("p_partkey", about.alias("about")).write.json(path)
    out = readers.read_json(df.sparkSession, path, is_jsonl=True)
    return out.select("p_partkey", F.col("`about.name`"), F.col("`about.size`").cast("long").alias("about.size"))


@query("s6_routing", _PART)
def _(t):
    df = _part(t)
    path = _path(df, "any")
    df.write.parquet(path)
    return _typed(readers.read_any(df.sparkSession, path))


@query("l4_export", "SELECT count(*)::BIGINT AS rows FROM lineitem")
def _(t):
    df = t("lineitem")
    path = _path(df, "export")
    versions.export_table(df, path, "parquet")
    return df.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"))


def _store(t):
    df = with_row_id(t("orders"), "o_orderkey")
    store = versions.VersionStore(df.sparkSession, _path(df, "store"))
    store.write(df, "orders", health_score=80.0)
    store.write(df.repartition(3), "orders")
    store.write(df.where("o_orderstatus = 'F'"), "orders", step="row_filter", health_score=90.0)
    return store


@query(
    "l1_versions",
    "SELECT 1::BIGINT AS version_number, count(*)::BIGINT AS row_count, 80.0::DOUBLE AS health_score FROM orders UNION ALL "
    "SELECT 2, count(*), 90.0 FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    return rounded(_store(t).versions("orders").select("version_number", "row_count", "health_score"))


@query(
    "l2_lineage",
    "SELECT 'import' AS step, 1::BIGINT AS output_version, count(*)::BIGINT AS affected_rows FROM orders UNION ALL "
    "SELECT 'row_filter', 2, count(*) FILTER (WHERE o_orderstatus <> 'F') FROM orders",
)
def _(t):
    return rounded(_store(t).lineage("orders").select("step", "output_version", "affected_rows"))


@query(
    "s9_catalog",
    "SELECT 'orders' AS dataset, 2::BIGINT AS versions, count(*)::BIGINT AS row_count, 90.0::DOUBLE AS health_score "
    "FROM orders WHERE o_orderstatus = 'F'",
)
def _(t):
    return rounded(_store(t).catalog().select("dataset", "versions", "row_count", "health_score"))


@query(
    "s5_sqlite_table",
    "SELECT s_suppkey::BIGINT AS s_suppkey, s_name, round(s_acctbal, 2) AS s_acctbal FROM supplier WHERE s_acctbal > 1000",
)
def _(t):
    df = t("supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = _path(df, "tables") + ".db"
    sqlite.write_sqlite(t("region"), path, "region")
    sqlite.write_sqlite(df, path, "supplier")
    read = readers.read_any(df.sparkSession, path)
    return rounded(read.where("s_acctbal > 1000"), 2)


@query(
    "o1_sort_summary",
    "SELECT count(*)::BIGINT AS rows, count(*) FILTER (WHERE a <> b)::BIGINT AS moved_rows FROM (SELECT row_number() OVER "
    "(ORDER BY o_orderkey) AS a, row_number() OVER (ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey) AS b FROM orders)",
)
def _(t):
    rows = with_row_id(t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return filters.sort_summary(rows, [{"column": "o_orderstatus", "direction": "desc"}, "o_totalprice"])


@query("s7_preview", "SELECT o_orderkey::BIGINT AS o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def _(t):
    rows = with_row_id(t("orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
    return filters.preview(rows, 100, 50).select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice")


@query(
    "s6_signatures",
    "SELECT 'parquet' AS file_type, CAST(NULL AS VARCHAR) AS problem, count(*) > 0 AS some FROM part UNION ALL "
    "SELECT 'csv', 'PARQUET_UNDER_OTHER_NAME', count(*) > 0 FROM part UNION ALL "
    "SELECT 'parquet', 'NOT_PARQUET', count(*) > 0 FROM part",
)
def _(t):
    df = _part(t)
    spark, path = df.sparkSession, _path(df, "routed")
    df.write.parquet(f"{path}/right")
    df.write.csv(f"{path}/text")
    hadoop = spark._jvm.org.apache.hadoop.fs
    store = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for name, old, new in (("right", "parquet", "csv"), ("text", "csv", "parquet")):
        first = next(str(f.getPath()) for f in store.listStatus(hadoop.Path(f"{path}/{name}")) if str(f.getPath()).endswith(old))
        target = hadoop.Path(f"{path}/renamed-{name}.{new}")
        hadoop.FileUtil.copy(store, hadoop.Path(first), store, target, False, spark._jsc.hadoopConfiguration())
    found = readers.detect_file_types(spark, path).where("NOT contains(path, '/text/')")
    return found.groupBy("file_type", "problem").agg((F.count(F.lit(1)) > 0).alias("some"))
