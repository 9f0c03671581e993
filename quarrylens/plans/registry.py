"""Every query of the library by name, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrylens.queries import algebra, cleaning, measures, sources, statistics
from quarrylens.queries.registry import QUERIES, SQL

MODULES = [algebra, cleaning, measures, sources, statistics]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column profiles, quality totals and the measure by month of one table, in long form."""
    from quarrylens.plans.full_run import summary_table

    return summary_table(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderdate", "o_totalprice")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
