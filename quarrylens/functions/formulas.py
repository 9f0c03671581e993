"""KPI formula text (arithmetic over named components) compiled to a Column."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylens.errors import EngineError, require
from quarrylens.functions.expressions import floor_mod

MAX_LENGTH, MAX_EXPONENT = 512, 1024
# The built-in ratio formulas.
BUILT_IN = {
    "gross_margin_pct": "(revenue - cost) / revenue * 100",
    "conversion_rate": "conversions / visitors * 100",
    "average_order_value": "revenue / orders",
    "churn_rate": "churned / customers * 100",
    "inventory_turnover": "cost_of_goods_sold / average_inventory",
}


def compile_formula(text: str, components: dict[str, Column]) -> Column:
    """Only numbers, names, ``+ - * / % **`` and signs are accepted; 1/0 gives null."""
    require(bool(text and text.strip()), "FORMULA_REQUIRED")
    require(len(text) <= MAX_LENGTH, "FORMULA_TOO_LONG")
    try:
        tree = ast.parse(text, mode="eval").body
    except SyntaxError as exc:
        raise EngineError("INVALID_FORMULA") from exc

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            require(node.id in components, "UNKNOWN_COMPONENT",
                    component=node.id)
            return components[node.id].cast("double")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.BinOp):
            a, b = build(node.left), build(node.right)
            if isinstance(node.op, ast.Add):
                return a + b
            if isinstance(node.op, ast.Sub):
                return a - b
            if isinstance(node.op, ast.Mult):
                return a * b
            if isinstance(node.op, ast.Div):
                return F.try_divide(a, b)
            if isinstance(node.op, ast.Mod):
                return floor_mod(a, F.when(b != 0, b))
            if isinstance(node.op, ast.Pow):
                guarded = F.when(F.abs(b) > MAX_EXPONENT, F.raise_error("UNSAFE_FORMULA").cast("double"))
                return F.pow(a, guarded.otherwise(b))
        raise EngineError("UNSAFE_FORMULA")

    return build(tree)
