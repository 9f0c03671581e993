"""Helpers the operators share: table access and the fixed text rules of their contracts."""

from __future__ import annotations

import string
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# bytes.split() without an argument splits at exactly \x20 and \x09-\x0D.
LOWER_ASCII = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def saved(df: DataFrame) -> DataFrame:
    """A small derived table, written once to the shared checkpoint folder and reread."""
    return cut_lineage(df)


def uniform(*parts: Column) -> Column:
    """A reproducible number strictly between 0 and 1 from the md5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    number = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(float(2**52))


def row_key(*columns: Column) -> list[Column]:
    """Two hashes over the same values: equal rows agree, different ones practically never. A
    null has no hash of its own, so where the nulls are is hashed too."""
    nulls = F.array(*[c.isNull() for c in columns])
    return [
        F.xxhash64(F.lit("a"), nulls, *columns).alias("__key_a"),
        F.xxhash64(F.lit("b"), nulls, *columns).alias("__key_b"),
    ]


KEY = ["__key_a", "__key_b"]
ROW = "__row"


def boxed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator works on, and the whole row in one column beside them: whatever
    other columns a table has, none of them can clash with an inner name."""
    return docs.select(*needed, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(ROW))


def unboxed(names: list[str]) -> list[Column]:
    """The row's own columns again."""
    return [F.col(ROW).getField(c).alias(c) for c in names]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the folder that all executors share, and read again."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        folder = tempfile.mkdtemp(prefix="quarrylens-")
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)
