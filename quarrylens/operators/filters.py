"""Row filters, dashboard and report filters, slicer lists, sorting and table views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require, require_columns
from quarrylens.functions.conditions import combine, condition
from quarrylens.functions.text import strip, to_number
from quarrylens.ids import ROW_ID, numeric_columns
from quarrylens.operators.ordered import Key, Ordered, order_keys

VALUE_TYPES = {"string", "number", "integer", "boolean", "date", "datetime"}
STATE_OPERATORS = {
    "eq", "ne", "gt", "gte", "lt", "lte", "in", "not_in", "contains", "starts_with", "ends_with",
    "between", "date_range", "is_null", "not_null",
}


def apply_row_filter(df: DataFrame, conditions: list[dict], logic: str = "and", invert: bool = False) -> DataFrame:
    return df.filter(combine(df, conditions, logic, invert))


def row_filter_metrics(df: DataFrame, conditions: list[dict], logic: str = "and", invert: bool = False) -> DataFrame:
    """Matched, removed and per-condition counts in one aggregate."""
    final = F.coalesce(combine(df, conditions, logic, invert), F.lit(False))
    each = [F.count_if(condition(df, c, i)).alias(f"condition_{i}_matched") for i, c in enumerate(conditions)]
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"), F.count_if(final).alias("matched_rows"),
        F.count_if(~final).alias("removed_rows"),
        F.round(F.coalesce(F.try_divide(F.count_if(final) * 100.0, F.count(F.lit(1))), F.lit(0.0)), 6)
        .alias("match_percentage"), *each,
    )


def _typed(c: Column, value_type: str) -> Column:
    text = strip(c.cast("string"))
    return {
        "string": lambda: c.cast("string"),
        "number": lambda: to_number(text),
        "integer": lambda: F.when(to_number(text) == F.floor(to_number(text)), to_number(text)).try_cast("long"),
        "boolean": lambda: F.when(F.lower(text).isin("true", "1", "yes"), True)
                            .when(F.lower(text).isin("false", "0", "no"), False),
        "date": lambda: text.try_cast("timestamp").cast("date"),
        "datetime": lambda: text.try_cast("timestamp"),
    }[value_type]()


def validate_state(filters: list[dict], state: dict) -> dict:
    """Defaults filled in, required filters present, no unknown ids. Driver only."""
    known = {f["id"]: f for f in filters}
    unknown = sorted(set(state) - set(known))
    require(not unknown, "UNKNOWN_FILTER", filters=unknown)
    out = {}
    for name, f in known.items():
        require(f.get("value_type", "string") in VALUE_TYPES, "INVALID_VALUE_TYPE")
        require(f.get("operator", "eq") in STATE_OPERATORS, "UNSUPPORTED_OPERATOR")
        value = state.get(name, f.get("default"))
        missing = value is None or value == "" or value == []
        require(not (missing and f.get("required")), "FILTER_VALUE_REQUIRED",
                filter=name)
        if not missing or f.get("operator") in ("is_null", "not_null"):
            out[name] = value
    return out


def state_condition(spec: dict, value) -> Column:
    """A null or unparsable cell never matches, except under the null operators."""
    op, vt = spec.get("operator", "eq"), spec.get("value_type", "string")
    raw = F.col(spec["column"])
    if op == "is_null":
        return raw.isNull()
    if op == "not_null":
        return raw.isNotNull()
    cell = _typed(raw, vt)

    def lit(v):
        return _typed(F.lit(v).cast("string"), vt)

    if op in ("in", "not_in"):
        hit = reduce(lambda a, b: a | b, [cell == lit(v) for v in value])
        return hit if op == "in" else (~hit & cell.isNotNull())
    if op in ("between", "date_range"):
        low, high = (value["start"], value["end"]) if isinstance(value, dict) else value
        parts = [cell.isNotNull()]
        if low is not None:
            parts.append(cell >= lit(low))
        if high is not None:
            parts.append(cell <= lit(high))
        return reduce(lambda a, b: a & b, parts)
    text = F.lower(cell.cast("string"))
    if op == "contains":
        return text.contains(str(value).lower())
    if op == "starts_with":
        return text.startswith(str(value).lower())
    if op == "ends_with":
        return text.endswith(str(value).lower())
    v = lit(value)
    return {"eq": cell == v, "ne": cell != v, "gt": cell > v, "gte": cell >= v, "lt": cell < v, "lte": cell <= v}[op]


def active_filters(filters: list[dict], state: dict, widget: str | None = None) -> list[tuple[dict, object]]:
    """Filters that hold for a widget: scope absent or "all", or a list naming it."""
    values = validate_state(filters, state)
    out = []
    for f in filters:
        scope = f.get("scope") or "all"
        if f["id"] in values and (scope in ("all", "global") or widget is None or widget in scope):
            out.append((f, values[f["id"]]))
    return out


def apply_dashboard_filters(df: DataFrame, filters: list[dict], state: dict, widget: str | None = None) -> DataFrame:
    for f, value in active_filters(filters, state, widget):
        require_columns(df, [f["column"]])
        df = df.filter(state_condition(f, value))
    return df


def filter_fields(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Report filters compare as strings; an absent value is no filter."""
    for column, value in values.items():
        if value not in (None, ""):
            df = df.filter(F.col(column).cast("string") == str(value))
    return df


def slicer_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct values per field in one pass, long form (field, value)."""
    require_columns(df, columns)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns
    ]))
    return df.select(pairs.alias("p")).select("p.*").filter("value is not null").distinct()


def apply_sort(df: DataFrame, sort_by: list, nulls: str = "last") -> DataFrame:
    require(bool(sort_by), "SORT_KEYS_REQUIRED")
    require(nulls in ("first", "last"), "INVALID_NULL_PLACEMENT")
    keys = order_keys(sort_by, nulls)
    names = [k.column for k in keys]
    require(len(names) == len(set(names)), "DUPLICATE_SORT_COLUMN")
    require_columns(df, names)
    tie = [F.col(ROW_ID)] if ROW_ID in df.columns and ROW_ID not in names else []
    return df.orderBy(*[k.expr() for k in keys], *tie)


def sort_summary(df: DataFrame, sort_by: list, nulls: str = "last") -> DataFrame:
    """One row: rows, and how many of them the sort moves to another position."""
    require(bool(sort_by), "SORT_KEYS_REQUIRED")
    keys = order_keys(sort_by, nulls)
    require_columns(df, [ROW_ID, *[k.column for k in keys]])
    rows = df.select(ROW_ID, *[k.column for k in keys if k.column != ROW_ID])
    was = Ordered(rows, [], [Key(ROW_ID)]).number("__was").df
    both = Ordered(was, [], keys).number("__is").df
    return both.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("__was") != F.col("__is")).alias("moved_rows"))


def preview(df: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of rows in row order; at most 500 of them."""
    require(offset >= 0 and 1 <= limit <= 500, "INVALID_PAGE")
    ordered = df.orderBy(ROW_ID) if ROW_ID in df.columns else df
    return ordered.offset(offset).limit(limit)


def table_view(df: DataFrame, columns: list[str] | None = None, conditions: list[dict] | None = None,
               sort_by: list | None = None, page: int = 1, page_size: int = 25,
               max_rows: int | None = None) -> DataFrame:
    """A page of the filtered table in the given order, else in row order. ``max_rows`` is the
    caller's own bound on how far paging goes."""
    require(page >= 1 and page_size >= 1, "INVALID_PAGE")
    if conditions:
        df = apply_row_filter(df, conditions)
    if sort_by:
        df = apply_sort(df, sort_by)
    elif ROW_ID in df.columns:
        df = df.orderBy(ROW_ID)
    start = (page - 1) * page_size
    take = page_size if max_rows is None else max(0, min(page_size, max_rows - start))
    keep = require_columns(df, columns) if columns else df.columns
    return df.offset(start).limit(take).select(*keep)


def table_totals(df: DataFrame, columns: list[str] | None = None, conditions: list[dict] | None = None) -> DataFrame:
    if conditions:
        df = apply_row_filter(df, conditions)
    names = [c for c in numeric_columns(df) if columns is None or c in columns]
    return df.agg(F.count(F.lit(1)).alias("total_rows"), *[F.sum(c).alias(f"total_{c}") for c in names])
