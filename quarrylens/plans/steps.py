"""Transformation step lists: nineteen tools folded over one lazy frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quarrylens.errors import EngineError, require
from quarrylens.ids import data_columns
from quarrylens.operators import aggregate as A
from quarrylens.operators import columns as K
from quarrylens.operators import filters as R
from quarrylens.operators import joins as J
from quarrylens.operators import matching as M
from quarrylens.operators import windows as W
from quarrylens.plans.recipe import watched

# Tool names and numbers.
TOOLS = {
    "column_operations": 21, "type_conversion": 22, "row_filter": 23, "sorting": 24, "calculated_columns": 25,
    "group_by": 26, "aggregation": 27, "pivot": 28, "unpivot": 29, "binning": 30, "join": 31, "concatenate": 32,
    "merge_compatibility": 33, "fuzzy_match": 34, "record_linkage": 35, "ranking": 36, "running_total": 37,
    "lag_lead": 38, "rolling_window": 39,
}
_PREVIEW = {"max_examples", "max_preview_rows", "max_group_examples"}


def _external(frames: dict, ref, index: int, tool: str) -> DataFrame:
    require(bool(ref), "EXTERNAL_DATASET_REQUIRED", step_index=index, tool=tool)
    require(ref in frames, "EXTERNAL_DATASET_NOT_FOUND", step_index=index,
            tool=tool, ref=ref)
    return frames[ref]


def apply_tool(df: DataFrame, tool: str, parameters: dict, frames: dict, index: int = 0):
    """(next frame, analysis frame or None)."""
    p = {k: v for k, v in (parameters or {}).items() if k not in _PREVIEW}
    simple = {
        "column_operations": K.apply_column_operations, "type_conversion": K.apply_type_conversions,
        "row_filter": R.apply_row_filter, "sorting": R.apply_sort, "calculated_columns": K.apply_calculated_columns,
        "group_by": A.analyze_groups, "aggregation": A.aggregate_dataframe, "pivot": A.pivot_dataframe,
        "unpivot": A.unpivot_dataframe, "binning": K.apply_binning, "ranking": W.apply_ranking,
        "running_total": W.apply_running_totals, "lag_lead": W.apply_lag_lead, "rolling_window": W.apply_rolling_windows,
    }
    if tool in simple:
        return simple[tool](df, **p), None
    if tool == "concatenate":
        parts = [("current", df)]
        for s in p.pop("source_refs", None) or []:
            parts.append((s.get("source_name") or s.get("ref"), _external(frames, s.get("ref"), index, tool)))
        return A.concatenate_dataframes(parts, **p), None
    right = _external(frames, p.pop("right_ref", None), index, tool)
    if tool == "merge_compatibility":
        return df, J.analyze_merge_compatibility(df, right, **p)
    return {"join": J.apply_join, "fuzzy_match": M.fuzzy_match, "record_linkage": M.link_records}[tool](df, right, **p), None


def execute_steps(df: DataFrame, steps: list[dict], external_frames: dict[str, DataFrame] | None = None,
                  measured: bool = False) -> dict:
    """Final frame, the frame after each step, and what analysis-only steps found.

    Names and parameters are checked against schemas while the plan is built, so a bad
    step fails before any data is read. With ``measured`` every frame counts its rows as they
    pass; ``step_metrics`` reads the counts.
    """
    require(bool(steps), "STEPS_REQUIRED")
    frames = external_frames or {}
    history, analyses = [], []
    given = df
    df, last = watched(df) if measured else (df, None)
    for i, s in enumerate(steps):
        tool = s.get("tool")
        require(tool in TOOLS, "UNKNOWN_TOOL", step_index=i, tool=tool)
        try:
            following, found = apply_tool(df, tool, s.get("parameters") or {}, frames, i)
        except EngineError as exc:
            if exc.code.startswith("EXTERNAL_DATASET"):
                raise
            raise EngineError("STEP_FAILED", details={**exc.details, "step_index": i, "tool": tool, "engine_code": exc.code}) from exc
        except TypeError as exc:
            raise EngineError("STEP_FAILED", details={"step_index": i, "tool": tool, "reason": str(exc)}) from exc
        if found is not None:
            analyses.append({"step_index": i, "tool": tool, "result": found})
        following, now = watched(following) if measured and found is None else (following, last)
        history.append({"step_index": i, "tool": tool, "tool_number": TOOLS[tool], "before": df, "after": following,
                        "mutated": found is None, "rows": (last, now)})
        df, last = following, now
    return {"dataframe": df, "steps": history, "analyses": analyses, "inputs": (given, steps, external_frames)}


def step_metrics(result: dict) -> DataFrame:
    """Rows and columns before and after every step: one job that reads the last frame, whose rows
    are counted on their way through the steps."""
    if result["steps"][0]["rows"][0] is None:
        result = execute_steps(*result["inputs"], measured=True)
    df = result["dataframe"]
    df.write.format("noop").mode("overwrite").save()
    rows = [
        (s["rows"][0].get["rows"], s["rows"][1].get["rows"], s["step_index"], s["tool"], s["tool_number"],
         len(data_columns(s["before"])), len(data_columns(s["after"])), s["mutated"]) for s in result["steps"]
    ]
    return df.sparkSession.createDataFrame(
        rows, "rows_before long, rows_after long, step_index int, tool string, tool_number int, columns_before int, "
        "columns_after int, mutated boolean")
