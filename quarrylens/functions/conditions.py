"""Filter conditions as dictionaries, compiled to Columns that push down to the scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import EngineError, require
from quarrylens.ids import kind

COMPARE = {
    "eq": lambda c, v: c == v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v,
}
TEXT = {"contains", "not_contains", "starts_with", "ends_with"}
OPERATORS = set(COMPARE) | TEXT | {"ne", "in", "not_in", "between", "is_null", "not_null"}


def typed_literal(df: DataFrame, column: str, value) -> Column:
    """A literal of the column's own type, so that the comparison stays push-down-able."""
    if kind(df, column) == "datetime" and value is not None:
        return F.lit(value).cast(df.schema[column].dataType)
    return F.lit(value)


def _never_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def condition(df: DataFrame, cond: dict, index: int = 0) -> Column:
    column, op = cond.get("column"), cond.get("operator")
    require(bool(column), "COLUMN_REQUIRED", condition_index=index)
    require(column in df.columns, "UNKNOWN_COLUMN",
            condition_index=index, column=column)
    require(op in OPERATORS, "UNSUPPORTED_OPERATOR",
            condition_index=index, operator=op)
    c = F.col(column)
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    sensitive = bool(cond.get("case_sensitive", True))
    text = c.cast("string") if sensitive else F.lower(c.cast("string"))

    if op in TEXT:
        require(cond.get("value") is not None, "VALUE_REQUIRED",
                condition_index=index)
        needle = str(cond["value"]) if sensitive else str(cond["value"]).lower()
        if op == "starts_with":
            return text.startswith(needle)
        if op == "ends_with":
            return text.endswith(needle)
        return text.contains(needle) if op == "contains" else ~_never_null(text.contains(needle))
    if op in ("in", "not_in"):
        values = cond.get("values")
        require(isinstance(values, list) and bool(values), "VALUES_REQUIRED", condition_index=index)
        if sensitive:
            hit = c.isin(*[typed_literal(df, column, v) for v in values])
        else:
            hit = text.isin(*[str(v).lower() for v in values])
        return hit if op == "in" else ~_never_null(hit)
    if op == "between":
        require("lower" in cond and "upper" in cond, "BOUNDS_REQUIRED", condition_index=index)
        try:
            ordered = cond["lower"] <= cond["upper"]
        except TypeError as exc:
            raise EngineError("INCOMPATIBLE_FILTER_VALUE", details={"condition_index": index}) from exc
        require(ordered, "INVALID_BOUNDS", condition_index=index)
        return c.between(typed_literal(df, column, cond["lower"]), typed_literal(df, column, cond["upper"]))
    require("value" in cond, "VALUE_REQUIRED",
            condition_index=index, operator=op)
    value = typed_literal(df, column, cond["value"])
    if op == "ne":
        return ~c.eqNullSafe(value)  # a null cell differs from any value
    return COMPARE[op](c, value)


def combine(df: DataFrame, conditions, logic: str = "and", invert: bool = False) -> Column:
    require(bool(conditions), "CONDITIONS_REQUIRED")
    require(logic in ("and", "or"), "INVALID_LOGIC", logic=logic)
    parts = [condition(df, c, i) for i, c in enumerate(conditions)]
    merged = reduce((lambda a, b: a & b) if logic == "and" else (lambda a, b: a | b), parts)
    return ~_never_null(merged) if invert else merged


def kpi_filters(df: DataFrame, filters) -> Column:
    """ANDed list in the KPI notation: ``value`` also carries lists, contains ignores case."""
    parts = [F.lit(True)]
    for i, f in enumerate(filters or []):
        op = f.get("operator", "eq")
        require(f.get("column") in df.columns, "UNKNOWN_FILTER_COLUMN",
                column=f.get("column"))
        require(op in {*COMPARE, "ne", "in", "not_in", "is_null", "not_null", "contains"},
                "INVALID_FILTER_OPERATOR", operator=op)
        spec = {"column": f["column"], "operator": op, "value": f.get("value"), "values": f.get("value")}
        if op == "contains":
            spec["case_sensitive"] = False
        parts.append(condition(df, spec, i))
    return reduce(lambda a, b: a & b, parts)
