"""Cleaning recipes: an ordered list of steps folded into one lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarrylens.errors import EngineError, require
from quarrylens.functions.text import changed, strip
from quarrylens.functions.dates import parse_timestamp
from quarrylens.ids import CARRIED, ROW_ID, data_columns, kind
from quarrylens.operators import cleaning as C
from quarrylens.operators.quantiles import quantile_row

STEPS = {"missing_values", "imputation", "string_cleaning", "numeric_cleaning", "date_cleaning",
         "category_normalization", "duplicate_removal", "outlier_treatment"}
# What the recipe's own numeric step strips by default.
RECIPE_SYMBOLS = ["$", "€", "£", "₹", "¥"]


def validate_recipe_steps(steps: list[dict]) -> None:
    require(bool(steps), "STEPS_REQUIRED")
    for i, s in enumerate(steps):
        require(s.get("type") in STEPS, "UNSUPPORTED_STEP", step_index=i)
        require(isinstance(s.get("params", {}), dict), "INVALID_STEP_PARAMS",
                step_index=i)


def _numeric_operations(p: dict) -> list:
    ops: list = ["trim"]
    if p.get("parse_parentheses_negative", True):
        ops.append("parse_parentheses_negative")
    if p.get("remove_commas", True):
        ops.append({"type": "remove_thousands_separators", "separators": [","]})
    ops.append({"type": "remove_currency_symbols", "symbols": p.get("currency_symbols") or RECIPE_SYMBOLS})
    if p.get("parse_percentage"):
        ops.append("parse_percentage")
    return [*ops, "to_numeric"] if p.get("to_numeric", True) else ops


def apply_step(df: DataFrame, kind_: str, p: dict) -> DataFrame:
    """One recipe step through the stand-alone cleaner, with the recipe's parameter names."""
    if kind_ == "missing_values":
        return C.apply_missing_value_operation(df, p.get("operation"), p.get("columns"), p.get("threshold"),
                                               p.get("fill_value"))
    if kind_ == "imputation":
        method = p.get("method")
        limit = None if method == "interpolate_linear" else p.get("limit")
        return C.apply_imputation(df, method, p.get("columns"), limit, p.get("order_by"), p.get("partition_by") or ())
    if kind_ == "string_cleaning":
        return C.apply_string_cleaning(df, p.get("columns"), p.get("operations") or [])
    if kind_ == "numeric_cleaning":
        return C.apply_numeric_cleaning(df, p.get("columns"), _numeric_operations(p),
                                        p.get("invalid_policy", "keep_original"))
    if kind_ == "date_cleaning":
        return C.apply_date_cleaning(df, p.get("columns"), p.get("target_type", "date"), None,
                                     bool(p.get("dayfirst")), bool(p.get("yearfirst")), False,
                                     p.get("on_invalid", "keep_original"))
    if kind_ == "category_normalization":
        return C.apply_category_normalization(df, p.get("columns"), p.get("operations"), p.get("mappings"),
                                              bool(p.get("case_insensitive_mapping")))
    if kind_ == "duplicate_removal":
        return C.remove_duplicates(df, p.get("mode", "exact"), p.get("columns"), p.get("keep", "first"))
    options = {k: p[k] for k in ("iqr_multiplier", "z_threshold", "lower_percentile", "upper_percentile",
                                 "replacement_constant", "flag_suffix") if k in p}
    return C.apply_outlier_treatment(df, p.get("method", "iqr"), p.get("columns"), p.get("action"), **options)


def execute_recipe(df: DataFrame, steps: list[dict]) -> DataFrame:
    """All steps as one plan. Only data-dependent decisions (which columns to drop, fill
    values, outlier bounds) run small aggregates on the way."""
    validate_recipe_steps(steps)
    for i, s in enumerate(steps):
        try:
            df = apply_step(df, s["type"], s.get("params", {}))
        except EngineError as exc:
            exc.details.update(step_index=i, step_type=s["type"])
            raise
    return df


def recipe_metrics(df: DataFrame, steps: list[dict]) -> DataFrame:
    """Per step: rows and columns before and after, and changed cells by row id.

    The counts are observed on the rows as they pass each step; a row carries its values from
    before the step along. All steps together cost one job, whatever their number."""
    validate_recipe_steps(steps)
    current, last = watched(df)
    seen = []
    for i, s in enumerate(steps):
        names = data_columns(current)
        carry = names if ROW_ID in df.columns else []
        if carry:
            current = current.withColumn(CARRIED, F.struct(*names))
        following = apply_step(current, s["type"], s.get("params", {}))
        hits = [changed(F.col(CARRIED)[c], F.col(c)).cast("long") for c in carry if c in following.columns]
        following, now = watched(following, sum(hits, F.lit(0).cast("long")))
        current = following.drop(CARRIED)
        seen.append((i, s["type"], last, now, len(names), len(data_columns(current))))
        last = now
    current.write.format("noop").mode("overwrite").save()
    rows = [(i, kind_, a.get["rows"], b.get["rows"], m, n, b.get["cells"]) for i, kind_, a, b, m, n in seen]
    return df.sparkSession.createDataFrame(
        rows, "step_index int, step_type string, rows_before long, rows_after long, columns_before int, columns_after int, "
        "changed_cells long")


def watched(df: DataFrame, cells=None) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its rows (and changed cells) once it has been read."""
    seen = Observation()
    cells = F.lit(0).cast("long") if cells is None else cells
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).alias("cells")), seen


def step_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and changed cells between two frames that share row ids."""
    shared = [c for c in data_columns(before) if c in after.columns]
    counts = before.agg(F.count(F.lit(1)).alias("rows_before")).withColumn(
        "rows_after", after.agg(F.count(F.lit(1)).alias("n")).scalar())
    cells = F.lit(0).cast("long")
    if ROW_ID in before.columns and ROW_ID in after.columns and shared:
        a = before.select(F.col(ROW_ID).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in shared])
        b = after.select(F.col(ROW_ID).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in shared])
        hits = [changed(F.col(f"__a_{c}"), F.col(f"__b_{c}")).cast("long") for c in shared]
        total = hits[0]
        for h in hits[1:]:
            total = total + h
        cells = F.coalesce(a.join(b, F.col("__a") == F.col("__b")).agg(F.sum(total).alias("n")).scalar(), F.lit(0))
    return counts.withColumns({
        "columns_before": F.lit(len(data_columns(before))), "columns_after": F.lit(len(data_columns(after))),
        "changed_cells": cells})


def safe_clean_frame(df: DataFrame) -> DataFrame:
    """Conservative automatic cleaning: strip text and blank it to null, parse date-named text
    when four fifths parse, fill gaps by median or mode, drop exact copies."""
    texts = [c for c in data_columns(df) if kind(df, c) == "string"]
    tidy = df.withColumns({c: F.nullif(strip(F.col(c)), F.lit("")) for c in texts}) if texts else df
    named = [c for c in texts if any(t in c.lower() for t in ("date", "time", "timestamp"))]
    if named:
        row = tidy.agg(*[F.avg(F.when(F.col(c).isNotNull(), parse_timestamp(F.col(c)).isNotNull().cast("double")))
                         .alias(c) for c in named]).first()
        dated = [c for c in named if (row[c] or 0) >= 0.8]
        tidy = tidy.withColumns({c: parse_timestamp(F.col(c)) for c in dated}) if dated else tidy
    gaps = {c: r for c, r in C.null_rates(tidy).items() if r > 0}
    numbers = [c for c in gaps if kind(tidy, c) == "numeric"]
    fills = {}
    if numbers:
        mids = quantile_row(tidy, numbers, [0.5])
        for c in numbers:
            value = mids[c][0] if mids[c][0] is not None else 0.0
            fills[c] = F.coalesce(F.col(c).cast("double"), F.lit(value))
    for c in [c for c in gaps if c not in numbers]:
        value = C.mode_value(tidy, c)
        if value is None and kind(tidy, c) == "string":
            value = "UNKNOWN"
        if value is not None:
            fills[c] = F.coalesce(F.col(c), F.lit(value).cast(tidy.schema[c].dataType))
    filled = tidy.withColumns(fills) if fills else tidy
    return C.remove_duplicates(filled, "exact", keep="first") if data_columns(filled) else filled

