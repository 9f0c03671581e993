"""Text helpers with the whitespace, title-case and number rules of the data model."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER_PATTERN = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
# Default symbols, date formats and the special-character pattern.
CURRENCY_SYMBOLS = ["$", "€", "£", "₹", "¥", "₩", "₽", "₺", "R$", "A$", "C$"]
SPECIAL_CHARACTERS = r"[^\w\s\-.,@/]"
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def title(c: Column) -> Column:
    """Every run of letters gets one capital, also after an apostrophe or a digit."""
    runs = F.regexp_extract_all(c, F.lit(r"(?U)\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def unicode_normalize(c: Column, form: str = "NFKC") -> Column:
    """No built-in exists for Unicode normal forms: one Arrow-batched UDF."""

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else unicodedata.normalize(form, v))

    return normalize(c)


def literal_replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def to_number(c: Column) -> Column:
    """Double or null; the pattern keeps out forms only Java parses ("1d", "0x1p3")."""
    return F.when(c.rlike(NUMBER_PATTERN), strip(c).try_cast("double"))


def changed(before: Column, after: Column) -> Column:
    """A cell counts as changed only when both sides hold a value."""
    return F.coalesce(before.cast("string") != after.cast("string"), F.lit(False))
