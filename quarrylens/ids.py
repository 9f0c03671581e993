"""Row identity. Order-dependent operators break ties on ``__row_id``; sources attach it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.errors import require_columns

ROW_ID = "__row_id"
# A row's values before a measured step; travels with the row, belongs to no table.
CARRIED = "__carried"


def with_row_id(df: DataFrame, key: str | None = None) -> DataFrame:
    """Attach ``__row_id`` from the source's own unique key, else by position.

    Positional ids follow the scan order of the files and are only stable once the
    frame has been written, so the version store calls this before its write.
    """
    if key is not None:
        require_columns(df, [key])
        return df.withColumn(ROW_ID, F.col(key).cast("long"))
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def nan_to_null(df: DataFrame) -> DataFrame:
    """Collapse NaN into null once, at ingest."""
    floats = {
        f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (ROW_ID, CARRIED)]


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Join condition over same-named keys where null equals null."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def kind(df: DataFrame, column: str) -> str:
    """numeric / boolean / datetime / string / other, from the schema alone."""
    t = df.schema[column].dataType
    if isinstance(t, T.BooleanType):
        return "boolean"
    if isinstance(t, T.NumericType):
        return "numeric"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    if isinstance(t, T.StringType):
        return "string"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c in data_columns(df) if kind(df, c) == "numeric"]
