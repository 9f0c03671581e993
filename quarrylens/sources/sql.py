"""Read-only SQL over named frames.

A statement is judged by the plan Spark's own parser makes of it, not by its text: only query
nodes are let through, every relation must be one of the given frames or a name the statement
itself defines, and functions that reach out of the data are refused. Spark then plans and runs
the statement.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from quarrylens.errors import EngineError, require

MAX_SQL_LENGTH = 100_000
# Functions that call into the JVM or tell about the session.
OUTSIDE_FUNCTIONS = {
    "reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start",
    "input_file_block_length", "current_user", "session_user", "user", "current_catalog",
    "current_database", "current_schema", "version", "raise_error", "read_files",
}
_QUERY_PACKAGE = "org.apache.spark.sql.catalyst.plans.logical."
# Nodes of that package that change something or run a command.
_NOT_QUERIES = ("Command", "Statement", "Insert", "Overwrite", "Append", "Create", "Drop", "Alter", "Set",
                "Delete", "Update", "Merge", "Call", "Script")


def _nodes(found):
    """Every node of a plan in the JSON form Spark gives, also those of subqueries."""
    if isinstance(found, dict):
        if "class" in found:
            yield found
        for value in found.values():
            yield from _nodes(value)
    elif isinstance(found, list):
        for value in found:
            yield from _nodes(value)


def _parsed(spark: SparkSession, sql: str) -> tuple[str, list[dict], object]:
    require(isinstance(sql, str) and bool(sql.strip()), "SQL_REQUIRED", "There is no statement to run.")
    require(len(sql) <= MAX_SQL_LENGTH, "SQL_TOO_LARGE", "The statement is too long.", limit=MAX_SQL_LENGTH)
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:
        text = str(exc)
        several = "PARSE_SYNTAX_ERROR" in text and ";" in sql.strip().rstrip(";")
        code = "MULTIPLE_STATEMENTS_NOT_ALLOWED" if several else "SQL_SYNTAX_ERROR"
        raise EngineError(code, "The statement cannot be parsed.", {"reason": text.split("\n")[0]}) from exc
    kind = "select"
    name = plan.getClass().getSimpleName()
    if name == "ExplainCommand":
        kind, plan = "explain", plan.logicalPlan()
    elif name == "UnresolvedWith":
        kind = "with"
    return kind, list(_nodes(json.loads(plan.toJSON()))), plan


def _text(value) -> str:
    return value if isinstance(value, str) else json.dumps(value)


def validate_read_only_sql(spark: SparkSession, sql, names=()) -> str:
    """Type of the statement (select, with or explain) if it is a query over ``names`` alone."""
    kind, nodes, plan = _parsed(spark, sql)
    defined = {n.lower() for n in names}
    shown = plan.toString()
    for node in nodes:
        full = node["class"]
        short = full.rsplit(".", 1)[-1]
        if full.startswith(_QUERY_PACKAGE) or ".command." in full or ".execution." in full:
            bad = any(part in short for part in _NOT_QUERIES) or not full.startswith(_QUERY_PACKAGE)
            require(not bad, "UNSAFE_SQL", "Only queries are let through.", node=short)
        if short == "UnresolvedFunction":
            called = _text(node.get("nameParts", "")).strip("[]").replace('"', "").lower()
            outside = called.rsplit(".", 1)[-1].strip() in OUTSIDE_FUNCTIONS or "." in called
            require(not outside, "UNSAFE_SQL", "This function is not available here.", function=called)
        if short in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
            called = _text(node.get("name", "")).lower()
            require("range" in called or "explode" in called or "inline" in called, "UNSAFE_SQL",
                    "This table function is not available here.", function=called)
    local = {part.lower() for part in _common_names(plan)}
    for node in nodes:
        if node["class"].rsplit(".", 1)[-1] == "UnresolvedRelation":
            name = _text(node.get("multipartIdentifier", "")).strip("[]").replace('"', "").lower()
            require(name in defined | local, "UNKNOWN_TABLE", "The statement reads something else than its tables.",
                    table=name)
    require(bool(shown), "SQL_REQUIRED", "There is no statement to run.")
    return kind


def _common_names(plan) -> list[str]:
    """Names that WITH clauses anywhere in the plan define."""
    found, stack = [], [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "UnresolvedWith":
            relations = node.cteRelations()
            for i in range(relations.size()):
                pair = relations.apply(i)
                found.append(pair._1())
                stack.append(pair._2())
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
        inner = node.subqueries()
        stack += [inner.apply(i) for i in range(inner.size())]
    return found


def sql_frame(spark: SparkSession, frames: dict[str, DataFrame], sql: str) -> DataFrame:
    """The lazy result of a checked query. Frames get view names of their own for this call, and
    the query sees them under the given names only."""
    kind = validate_read_only_sql(spark, sql, frames)
    for name in frames:
        require(name.isidentifier(), "INVALID_FRAME_NAME", "A frame name is not a plain identifier.", name=name)
    body = sql.strip().rstrip(";")
    lead = ""
    if kind == "explain":
        lead, body = "EXPLAIN ", body[len("explain"):].lstrip()
        for mode in ("extended", "codegen", "cost", "formatted"):
            if body.lower().startswith(mode + " "):
                lead, body = f"EXPLAIN {mode} ", body[len(mode):].lstrip()
    call = uuid.uuid4().hex
    views = {name: f"__frame_{call}_{i}" for i, name in enumerate(frames)}
    for name, view in views.items():
        frames[name].createTempView(view)
    heads = ", ".join(f"{name} AS (SELECT * FROM {view})" for name, view in views.items())
    try:
        return spark.sql(f"{lead}WITH {heads} SELECT * FROM ({body})" if heads else lead + body)
    except Exception as exc:
        raise EngineError("SQL_EXECUTION_ERROR", str(exc).split("\n")[0]) from exc
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)


def execute_dataset_sql(df: DataFrame, sql: str, max_rows: int | None = None, timeout_seconds: float | None = None,
                        frames: dict[str, DataFrame] | None = None) -> dict:
    """Rows of a report query for a caller that wants them on the driver: ``max_rows`` is the
    caller's own bound, and ``truncated`` tells whether there were more. Larger results are
    for ``sql_frame``. With a time limit, a timer cancels the job group on the cluster."""
    require(max_rows is None or max_rows >= 1, "INVALID_MAX_ROWS", "max_rows is a positive number.")
    spark = df.sparkSession
    out = sql_frame(spark, {"dataset": df, **(frames or {})}, sql)
    if max_rows is not None:
        out = out.limit(max_rows + 1)
    context, group = spark.sparkContext, f"sql-{uuid.uuid4().hex}"
    fired = threading.Event()

    def stop():
        fired.set()
        context.cancelJobGroup(group)

    context.setJobGroup(group, "read-only sql", interruptOnCancel=True)
    timer = threading.Timer(timeout_seconds, stop) if timeout_seconds else None
    if timer:
        timer.start()
    try:
        rows = [r.asDict() for r in out.collect()]
    except Exception as exc:
        code = "SQL_TIMEOUT" if fired.is_set() else "SQL_EXECUTION_ERROR"
        raise EngineError(code, str(exc).split("\n")[0]) from exc
    finally:
        if timer:
            timer.cancel()
        context.setLocalProperty("spark.jobGroup.id", None)
        context.setLocalProperty("spark.job.description", None)
    more = max_rows is not None and len(rows) > max_rows
    return {"columns": out.columns, "rows": rows[:max_rows], "truncated": more}
