"""Calculated-column trees compiled to Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require
from quarrylens.functions.text import strip

_ARITHMETIC = {"add", "subtract", "multiply", "divide", "mod", "power"}
_COMPARISON = {"eq", "ne", "gt", "gte", "lt", "lte"}
_LOGIC = {"and", "or"}
_UNARY = {"abs", "round", "negate", "not", "is_null", "not_null", "lower", "upper", "trim"}
_SPECIAL = {"column", "literal", "coalesce", "concat", "if_else"}
OPERATIONS = _ARITHMETIC | _COMPARISON | _LOGIC | _UNARY | _SPECIAL


def _truth(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def floor_mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor."""
    return a - b * F.floor(F.try_divide(a, b))


def _guard_zero(divisor: Column, policy: str) -> Column:
    if policy == "error":
        return F.when(divisor == 0, F.raise_error("DIVIDE_BY_ZERO").cast("double")).otherwise(divisor)
    return F.when(divisor == 0, None).otherwise(divisor)


def compile_expression(df: DataFrame, node, divide_by_zero: str = "null") -> Column:
    require(isinstance(node, dict), "INVALID_EXPRESSION")
    op = node.get("op")
    require(op in OPERATIONS, "UNSUPPORTED_EXPRESSION", op=op)

    def sub(key):
        return compile_expression(df, node[key], divide_by_zero)

    if op == "column":
        name = node.get("name")
        require(bool(name), "COLUMN_NAME_REQUIRED")
        require(name in df.columns, "UNKNOWN_COLUMN", column=name)
        return F.col(name)
    if op == "literal":
        return F.lit(node.get("value"))
    if op in _ARITHMETIC | _COMPARISON | _LOGIC:
        require("left" in node and "right" in node, "OPERANDS_REQUIRED")
        a, b = sub("left"), sub("right")
        if op == "divide":
            return a / _guard_zero(b, divide_by_zero)
        if op == "mod":
            return floor_mod(a, _guard_zero(b, divide_by_zero))
        return {
            "add": lambda: a + b, "subtract": lambda: a - b, "multiply": lambda: a * b,
            "power": lambda: F.pow(a, b),
            "eq": lambda: F.coalesce(a == b, F.lit(False)),
            "ne": lambda: ~F.coalesce(a == b, F.lit(False)),
            "gt": lambda: F.coalesce(a > b, F.lit(False)), "gte": lambda: F.coalesce(a >= b, F.lit(False)),
            "lt": lambda: F.coalesce(a < b, F.lit(False)), "lte": lambda: F.coalesce(a <= b, F.lit(False)),
            "and": lambda: _truth(a) & _truth(b), "or": lambda: _truth(a) | _truth(b),
        }[op]()
    if op in _UNARY:
        require("value" in node, "VALUE_REQUIRED")
        v = sub("value")
        return {
            "abs": lambda: F.abs(v), "round": lambda: F.bround(v, int(node.get("digits", 0))),
            "negate": lambda: -v, "not": lambda: ~_truth(v), "is_null": v.isNull, "not_null": v.isNotNull,
            "lower": lambda: F.lower(v.cast("string")), "upper": lambda: F.upper(v.cast("string")),
            "trim": lambda: strip(v.cast("string")),
        }[op]()
    if op in ("coalesce", "concat"):
        args = node.get("args")
        require(isinstance(args, list) and bool(args), "ARGS_REQUIRED")
        parts = [compile_expression(df, a, divide_by_zero) for a in args]
        if op == "coalesce":
            return F.coalesce(*parts)
        filler = F.lit(str(node.get("null_as", "")))
        return F.concat_ws(str(node.get("separator", "")), *[F.coalesce(p.cast("string"), filler) for p in parts])
    for field in ("condition", "then", "else"):
        require(field in node, "IF_ELSE_FIELD_REQUIRED")
    return F.when(_truth(sub("condition")), sub("then")).otherwise(sub("else"))
