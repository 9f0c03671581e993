"""Date parsing over an ordered, finite list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.functions.text import strip

AMBIGUOUS = r"^\s*(\d{1,2})[/-](\d{1,2})[/-](\d{2}|\d{4})\s*$"
# Strptime directives and the matching Spark pattern letters.
DIRECTIVES = {
    "%Y": "yyyy", "%y": "yy", "%m": "M", "%d": "d", "%H": "H", "%M": "m", "%S": "s",
    "%b": "MMM", "%B": "MMMM", "%I": "h", "%p": "a", "%f": "SSSSSS", "%a": "E", "%A": "EEEE",
}
ISO = ["yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyyMMdd"]
NAMED = ["d MMM yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "d-MMMM-yyyy", "d-MMM-yy"]
MONTH_FIRST = ["M/d/yyyy", "M-d-yyyy", "M.d.yyyy", "M/d/yy", "M-d-yy"]
DAY_FIRST = ["d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d/M/yy", "d-M-yy"]
YEAR_FIRST = ["yy/M/d", "yy-M-d"]
TIME_TAIL = "[ H:m[:s[.SSSSSS]]]['T'H:m[:s[.SSSSSS]]]"


def spark_pattern(fmt: str) -> str:
    """Translate a strptime format; letters outside directives are quoted."""
    out, i = "", 0
    while i < len(fmt):
        two = fmt[i:i + 2]
        if two in DIRECTIVES:
            out, i = out + DIRECTIVES[two], i + 2
        else:
            out, i = out + (f"'{fmt[i]}'" if fmt[i].isalpha() else fmt[i]), i + 1
    return out


def candidate_formats(dayfirst: bool, yearfirst: bool) -> list[str]:
    numeric = (DAY_FIRST + MONTH_FIRST) if dayfirst else (MONTH_FIRST + DAY_FIRST)
    days = ISO + (YEAR_FIRST if yearfirst else []) + numeric + NAMED
    return [d + TIME_TAIL for d in days]


def parse_timestamp(c: Column, formats=None, dayfirst=False, yearfirst=False) -> Column:
    """Timestamp or null. Explicit formats are tried before the general list.

    A shape guard keeps each cell to the formats that can match it at all: digits first
    with a year, digits first without, or a month name.
    """
    text = strip(c.cast("string"))
    tried = [F.try_to_timestamp(text, F.lit(spark_pattern(f))) for f in formats or []]
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    zoned = F.when(
        text.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}.*(Z|[+-]\d{2}:?\d{2})$"), text.try_cast("timestamp")
    )
    everything = candidate_formats(dayfirst, yearfirst)
    named = [f for f in everything if "MMM" in f]
    yeared = [f for f in everything if f.startswith("yyyy")]
    other = [f for f in everything if f not in named and f not in yeared]

    def first_of(source: Column, options) -> Column:
        return F.coalesce(*[F.try_to_timestamp(source, F.lit(f)) for f in options])

    general = (
        F.when(text.rlike(r"[A-Za-z]{3}") & text.rlike(r"\d"), first_of(text, named))
        .when(text.rlike(r"^\d{4}"), first_of(plain, yeared))
        .when(text.rlike(r"^\d"), first_of(text, other))
    )
    return F.coalesce(*tried, zoned, general)


def is_ambiguous(c: Column) -> Column:
    a = F.regexp_extract(c, AMBIGUOUS, 1).try_cast("int")
    b = F.regexp_extract(c, AMBIGUOUS, 2).try_cast("int")
    return F.coalesce(a.between(1, 12) & b.between(1, 12) & (a != b), F.lit(False))


def period_label(c: Column, grain: str) -> Column:
    """day 2024-01-31, week start/end, month 2024-01, quarter 2024Q1, year 2024."""
    d = c.cast("date")
    if grain == "day":
        return F.date_format(d, "yyyy-MM-dd")
    if grain == "week":
        start = F.trunc(d, "week")
        return F.concat_ws("/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd"))
    if grain == "month":
        return F.date_format(d, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.year(d).cast("string"), F.lit("Q"), F.quarter(d).cast("string"))
    return F.year(d).cast("string")
