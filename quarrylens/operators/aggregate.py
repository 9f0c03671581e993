"""Grouping, pivoting, unpivoting, contingency tables, concatenation and top-N."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import require, require_columns
from quarrylens.ids import ROW_ID, kind
from quarrylens.operators.ordered import Key, Ordered, attach_totals, fits_one_task
from quarrylens.operators.quantiles import exact_quantiles

FUNCTIONS = {"count", "sum", "avg", "median", "min", "max", "distinct"}


def _specs(df: DataFrame, keys: list[str], aggregations) -> list[dict]:
    require(bool(aggregations), "AGGREGATIONS_REQUIRED")
    out = []
    for i, a in enumerate(aggregations):
        fn, column = a.get("function"), a.get("column")
        require(fn in FUNCTIONS, "UNSUPPORTED_AGGREGATION",
                aggregation_index=i)
        require(fn == "count" or bool(column), "AGGREGATION_COLUMN_REQUIRED",
                aggregation_index=i)
        if column is not None:
            require_columns(df, [column])
        require(fn not in ("sum", "avg", "median") or kind(df, column) == "numeric", "INCOMPATIBLE_COLUMN_TYPE", column=column)
        alias = str(a.get("alias") or ("row_count" if column is None else f"{column}_{fn}")).strip()
        require(alias not in keys, "ALIAS_COLLISION", alias=alias)
        require(alias not in [s["alias"] for s in out], "DUPLICATE_ALIAS", alias=alias)
        out.append({"fn": fn, "column": column, "alias": alias, "drop_nulls": bool(a.get("drop_nulls", True))})
    return out


def _aggregate_column(spec: dict) -> Column:
    c = F.lit(1) if spec["column"] is None else F.col(spec["column"])
    if spec["fn"] == "distinct":
        extra = F.lit(0) if spec["drop_nulls"] else F.coalesce(F.max(c.isNull().cast("int")), F.lit(0))
        return F.count_distinct(c) + extra
    return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[spec["fn"]](c)


def _grouped(df: DataFrame, keys: list[str], specs: list[dict]) -> DataFrame:
    """Aggregate; medians of groups too big for one buffer go through value ranks."""
    plain = [s for s in specs if s["fn"] != "median"]
    medians = [s for s in specs if s["fn"] == "median"]
    inline = not medians or fits_one_task(df, keys)
    aggs = [_aggregate_column(s).alias(s["alias"]) for s in plain]
    if inline:
        aggs += [F.median(s["column"]).alias(s["alias"]) for s in medians]
        out = df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)
    else:
        columns = list(dict.fromkeys(s["column"] for s in medians))
        mids = exact_quantiles(df, columns, [0.5], keys, bounded=False)
        mids = mids.select(*[F.col(k).alias(f"__m_{i}") for i, k in enumerate(keys)],
                           *[F.col(s["column"])[0].alias(s["alias"]) for s in medians])
        base = df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("__n")]))
        cond = reduce(lambda a, b: a & b, [base[k].eqNullSafe(mids[f"__m_{i}"]) for i, k in enumerate(keys)],
                      F.lit(True))
        out = base.join(mids, cond, "left")
    return out.select(*keys, *[s["alias"] for s in specs])


def _drop_null_keys(df: DataFrame, keys: list[str], include: bool) -> DataFrame:
    return df if include or not keys else df.dropna(how="any", subset=keys)


def aggregate_dataframe(df: DataFrame, group_by=None, aggregations=None, include_null_keys: bool = True,
                        sort_groups: bool = False) -> DataFrame:
    keys = list(group_by or [])
    require(len(keys) == len(set(keys)), "DUPLICATE_GROUP_COLUMN")
    require_columns(df, keys)
    specs = _specs(df, keys, aggregations)
    out = _grouped(_drop_null_keys(df, keys, include_null_keys), keys, specs)
    return out.orderBy(*[F.col(k).cast("string").asc_nulls_last() for k in keys]) if sort_groups and keys else out


def analyze_groups(df: DataFrame, group_by, include_null_keys: bool = True, sort_groups: bool = False,
                   add_group_id: bool = False, group_id_column: str = "__group_id",
                   add_group_size: bool = False, group_size_column: str = "__group_size",
                   order_column: str = ROW_ID) -> DataFrame:
    """Annotate rows with the group's size and its number in first-seen (or sorted) order."""
    keys = list(group_by or [])
    require(bool(keys), "GROUP_BY_REQUIRED")
    require_columns(df, keys)
    for flag, name in ((add_group_id, group_id_column), (add_group_size, group_size_column)):
        require(not flag or name not in df.columns, "ANNOTATION_COLUMN_EXISTS", column=name)
    require(not (add_group_id and add_group_size and group_id_column == group_size_column),
            "ANNOTATION_COLUMN_COLLISION")
    if add_group_id:
        require_columns(df, [order_column])
    source = _drop_null_keys(df, keys, include_null_keys)
    first = [F.min(order_column).alias("__first")] if add_group_id else []
    groups = source.groupBy(*keys).agg(F.count(F.lit(1)).alias(group_size_column), *first)
    if add_group_id:
        if sort_groups:
            groups = groups.withColumns({f"__o{i}": F.col(k).cast("string") for i, k in enumerate(keys)})
            order = [Key(f"__o{i}") for i in range(len(keys))]
        else:
            order = [Key("__first")]
        groups = Ordered(groups, [], order).number(group_id_column).df
    wanted = ([group_id_column] if add_group_id else []) + ([group_size_column] if add_group_size else [])
    side = groups.select(*[F.col(k).alias(f"__g_{i}") for i, k in enumerate(keys)], *wanted)
    cond = reduce(lambda a, b: a & b, [df[k].eqNullSafe(side[f"__g_{i}"]) for i, k in enumerate(keys)])
    return df.join(side, cond, "left").select(df["*"], *[side[w] for w in wanted])


def group_statistics(df: DataFrame, group_by, include_null_keys: bool = True) -> DataFrame:
    keys = require_columns(df, group_by)
    sizes = _drop_null_keys(df, keys, include_null_keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))
    middle = exact_quantiles(sizes, ["size"], [0.5])
    out = sizes.agg(
        F.count(F.lit(1)).alias("group_count"), F.coalesce(F.sum("size"), F.lit(0)).alias("grouped_rows"),
        F.coalesce(F.min("size"), F.lit(0)).alias("min_group_size"),
        F.coalesce(F.max("size"), F.lit(0)).alias("max_group_size"),
        F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 6).alias("mean_group_size"),
        F.count_if(F.col("size") == 1).alias("singleton_groups"),
    )
    return out.withColumn("median_group_size", middle.select(F.coalesce(F.col("size")[0], F.lit(0.0))).scalar())


def pivot_dataframe(df: DataFrame, rows=None, columns=None, values=None, include_null_keys: bool = True,
                    sort_dimensions: bool = False, fill_value=None, add_row_totals: bool = False,
                    add_column_totals: bool = False, total_label: str = "Total",
                    max_columns: int | None = None) -> DataFrame:
    """Named ``alias__key1__key2``. Totals are recomputed from the rows, not from cells.

    The distinct column keys become columns, so they come to the driver; ``max_columns`` is the
    caller's own bound on them. Keys whose names coincide are refused, never merged.
    """
    rows, columns = list(rows or []), list(columns or [])
    require(len(rows) == len(set(rows)) and len(columns) == len(set(columns)), "DUPLICATE_DIMENSION")
    require(not set(rows) & set(columns), "DIMENSION_COLLISION")
    require(bool(rows or columns), "PIVOT_DIMENSION_REQUIRED")
    require_columns(df, rows + columns)
    specs = _specs(df, rows + columns, values)
    work = _drop_null_keys(df, rows + columns, include_null_keys)
    key = F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(columns)]) if columns else None

    names = []
    if columns:
        distinct = work.select(key.alias("k")).distinct()
        found = [tuple(r["k"]) for r in (distinct if max_columns is None else distinct.limit(max_columns + 1)).collect()]
        require(max_columns is None or len(found) <= max_columns, "TOO_MANY_PIVOT_COLUMNS")
        named = [("__".join("None" if v is None else v for v in values), values) for values in found]
        names = sorted(named, key=lambda item: item[0])
        labels = [label for label, _ in names]
        require(len(labels) == len(set(labels)), "PIVOT_COLUMN_COLLISION",
                names=sorted({x for x in labels if labels.count(x) > 1}))

    def block(label_rows: bool) -> DataFrame:
        """One level of totals: grouped by the row dimensions, or by none of them."""
        keys = [] if label_rows else rows
        frame = work.withColumn("__k", key) if columns else work
        pieces = None
        if columns:
            cells = _grouped(frame, keys + ["__k"], specs)
            def cell(values) -> Column:
                parts = [F.lit(v).cast("string").alias(f"k{i}") for i, v in enumerate(values)]
                return F.col("__k").eqNullSafe(F.struct(*parts))

            pick = [
                F.max(F.when(cell(values), F.col(s["alias"]))).alias(f"{s['alias']}__{label}")
                for s in specs for label, values in names
            ]
            pieces = cells.groupBy(*keys).agg(*pick) if keys else cells.agg(*pick)
        if not columns or add_column_totals:
            suffix = f"__{total_label}" if columns else ""
            renamed = [{**s, "alias": s["alias"] + suffix} for s in specs]
            totals = _grouped(frame, keys, renamed)
            if pieces is None:
                pieces = totals
            else:
                side = totals.select(*[F.col(k).alias(f"__p_{i}") for i, k in enumerate(keys)],
                                     *[s["alias"] for s in renamed])
                cond = reduce(lambda a, b: a & b,
                              [pieces[k].eqNullSafe(side[f"__p_{i}"]) for i, k in enumerate(keys)], F.lit(True))
                if keys:
                    pieces = pieces.join(side, cond, "left").drop(*[f"__p_{i}" for i in range(len(keys))])
                else:
                    pieces = pieces.withColumns({s["alias"]: side.select(s["alias"]).scalar() for s in renamed})
        zero = {
            c: 0 for s in specs if s["fn"] in ("count", "distinct")
            for c in pieces.columns if c == s["alias"] or c.startswith(s["alias"] + "__")
        }
        pieces = pieces.fillna(zero) if zero else pieces
        if add_row_totals and rows:
            text = {r: (F.lit(total_label) if label_rows else F.col(r).cast("string")) for r in rows}
            pieces = pieces.withColumns(text)
        return pieces

    out = block(False)
    if add_row_totals and rows:
        out = out.unionByName(block(True))
    data = [c for c in out.columns if c not in rows]
    if fill_value is not None:
        out = out.fillna(fill_value, subset=data)
    out = out.select(*rows, *data)
    return out.orderBy(*[F.col(r).cast("string").asc_nulls_last() for r in rows]) if sort_dimensions and rows else out


def unpivot_dataframe(df: DataFrame, id_vars=None, value_vars=None, variable_name: str = "variable",
                      value_name: str = "value", drop_null_values: bool = False) -> DataFrame:
    ids = require_columns(df, id_vars)
    measures = require_columns(df, value_vars) if value_vars else [c for c in df.columns if c not in ids]
    require(bool(measures), "VALUE_COLUMNS_REQUIRED")
    require(not set(ids) & set(measures), "COLUMN_ROLE_COLLISION")
    require(variable_name != value_name and variable_name not in ids and value_name not in ids,
            "OUTPUT_NAME_COLLISION")
    if len({df.schema[m].dataType for m in measures}) > 1:
        numeric = all(kind(df, m) == "numeric" for m in measures)
        df = df.withColumns({m: F.col(m).cast("double" if numeric else "string") for m in measures})
    out = df.unpivot([F.col(c) for c in ids], [F.col(c) for c in measures], variable_name, value_name)
    return out.filter(F.col(value_name).isNotNull()) if drop_null_values else out


def contingency_table(df: DataFrame, row: str, column: str, dropna: bool = True) -> DataFrame:
    """Counts with row, column and overall proportions; one shuffle of the cells."""
    require_columns(df, [row, column])
    base = df.dropna(subset=[row, column]) if dropna else df
    cells = base.groupBy(F.col(row).alias("row_value"), F.col(column).alias("column_value")).agg(
        F.count(F.lit(1)).alias("count"))
    cells = attach_totals(cells, ["row_value"], row_total=F.sum("count"))
    cells = attach_totals(cells, ["column_value"], column_total=F.sum("count"))
    cells = attach_totals(cells, [], total=F.sum("count"))
    return cells.withColumns({
        "row_share": F.col("count") / F.col("row_total"),
        "column_share": F.col("count") / F.col("column_total"),
        "total_share": F.col("count") / F.col("total"),
        "expected": F.col("row_total") * F.col("column_total") / F.col("total"),
    })


def approximate_summary(df: DataFrame, columns: list[str], probabilities=(0.25, 0.5, 0.75),
                        accuracy: int = 10000) -> DataFrame:
    """Opt-in sketches for tables where exact counts are not worth their cost."""
    require_columns(df, columns)
    parts = [
        F.struct(F.lit(c).alias("column"), F.approx_count_distinct(c).alias("approx_distinct"),
                 F.percentile_approx(F.col(c).cast("double"), list(probabilities), accuracy).alias("approx_quantiles"))
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def concatenate_dataframes(frames: list[tuple[str, DataFrame]], schema_mode: str = "strict",
                           add_source_column: bool = False, source_column_name: str = "__source_dataset",
                           drop_duplicate_rows: bool = False) -> DataFrame:
    require(len(frames) >= 2, "INSUFFICIENT_FRAMES")
    require(schema_mode in ("strict", "union", "intersection"), "INVALID_SCHEMA_MODE")
    names = [n for n, _ in frames]
    require(len(names) == len(set(names)), "DUPLICATE_SOURCE_NAME")
    first = frames[0][1].columns
    if schema_mode == "strict":
        for name, frame in frames[1:]:
            require(frame.columns == first, "SCHEMA_MISMATCH",
                    source_name=name)
        keep = first
    elif schema_mode == "union":
        keep = list(dict.fromkeys(c for _, f in frames for c in f.columns))
    else:
        keep = [c for c in first if all(c in f.columns for _, f in frames)]
        require(bool(keep), "NO_COMMON_COLUMNS")
    require(not add_source_column or source_column_name not in keep, "SOURCE_COLUMN_COLLISION")
    parts = []
    for name, frame in frames:
        part = frame.select(*[c for c in keep if c in frame.columns])
        parts.append(part.withColumn(source_column_name, F.lit(name)) if add_source_column else part)
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.dropDuplicates() if drop_duplicate_rows else out


def top_categories(grouped: DataFrame, category: str, value: str, top_n: int, other_label: str = "Other",
                   group_other: bool = True, min_share: float = 0.0) -> DataFrame:
    """Keep the largest categories, fold the rest. The kept list has ``top_n`` rows."""
    shared = attach_totals(grouped, [], __total=F.sum(value)).withColumn(
        "share", F.coalesce(F.try_divide(F.col(value), F.col("__total")), F.lit(0.0))).drop("__total")
    head = shared.filter(F.col("share") >= min_share).orderBy(F.desc(value), F.asc(category)).limit(top_n)
    if not group_other:
        return head
    marked = shared.join(head.select(F.col(category).alias("__top"), F.lit(True).alias("__kept")),
                         F.col(category).eqNullSafe(F.col("__top")), "left")
    folded = F.when(F.col("__kept"), F.col(category).cast("string")).otherwise(F.lit(other_label))
    return marked.groupBy(folded.alias(category)).agg(F.sum(value).alias(value), F.sum("share").alias("share"))
