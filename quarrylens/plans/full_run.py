"""The whole automated analysis: quality, safe cleaning, quality again, statistics,
exploration, findings, chart recommendations and business summary, with versions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.errors import EngineError
from quarrylens.ids import ROW_ID, data_columns, numeric_columns
from quarrylens.operators.business import build_bi_report
from quarrylens.operators.charts import recommend_charts
from quarrylens.operators.eda import generate_eda_report
from quarrylens.operators.quality import quality_frames
from quarrylens.operators.quantiles import counted_once, with_counts
from quarrylens.operators.stats import generate_statistics_report
from quarrylens.plans.recipe import safe_clean_frame
from quarrylens.session import cut_lineage
from quarrylens.sources.versions import VersionStore


# Codes of a table that fits no chart.
NO_CHART = {"INSUFFICIENT_COLUMNS", "INVALID_INTENT"}


def analysis_sections(df: DataFrame, quality: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Every section of the analysis of one table, lazy, by name. The quality sections are those
    given, or made here; the others share their value counts."""
    quality = quality_frames(df, keep=False) if quality is None else quality
    body = with_counts(df.drop(ROW_ID), "string", data_columns(df), quality["value_counts"])
    body = counted_once(body, numeric_columns(body))
    out = {f"quality.{k}": v for k, v in quality.items() if k != "value_counts"}
    if numeric_columns(body):
        out.update({f"statistics.{k}": v for k, v in generate_statistics_report(body).items()})
    out.update({f"eda.{k}": v for k, v in generate_eda_report(body).items()})
    if data_columns(body):
        try:
            out["recommendations"] = recommend_charts(body)
        except EngineError as exc:
            # A table whose columns fit no chart has no recommendations; all else is an error.
            if exc.code not in NO_CHART:
                raise
    out.update({f"business.{k}": v for k, v in build_bi_report(body).items()})
    return out


def _health(df: DataFrame) -> dict:
    """The health row, with the sections below it computed once and freed again."""
    frames = quality_frames(df)
    found = frames["health"].first().asDict()
    for frame in frames.values():
        frame.unpersist()
    return found


def run_full_analysis(store: VersionStore, df: DataFrame, dataset: str, output: str, workers: int = 4) -> dict:
    """Import, clean and analyse; sections are written as Parquet below ``output``.

    Sections are independent jobs, submitted from a few driver threads so that small ones
    fill the gaps of large ones. Both versions and the cleaning step go to the lineage.
    """
    first_health = _health(df)
    first = store.write(df, dataset, step="import", health_score=first_health["score"])
    raw = store.read(dataset, first["version_number"])
    before = first_health
    # Quality and the store read the cleaned rows many times; the store gives the same rows back, so
    # the quality that the version is written with is that of the sections too.
    cleaned = cut_lineage(safe_clean_frame(raw))
    quality = quality_frames(cleaned)
    clean_health = quality["health"].first().asDict()
    second = store.write(cleaned, dataset, step="safe_clean", parameters={"before": before["score"]},
                         health_score=clean_health["score"])
    clean = store.read(dataset, second["version_number"])
    sections = analysis_sections(clean, quality)

    def save(item):
        name, frame = item
        path = f"{output.rstrip('/')}/{dataset}/v{second['version_number']}/{name}"
        frame.write.mode("overwrite").parquet(path)
        return name, path

    with ThreadPoolExecutor(workers) as pool:
        written = dict(pool.map(save, sections.items()))
    for frame in quality.values():
        frame.unpersist()
    after = clean.sparkSession.read.parquet(written["quality.health"]).first().asDict()
    return {"versions": [first, second], "sections": written, "health_before": before, "health_after": after}


def summary_table(df: DataFrame, date_column: str, value_column: str) -> DataFrame:
    """One long table (section, item, metric, value): column profiles, quality totals and the
    measure by month."""
    from quarrylens.operators.kpi import calculate_kpi

    # The shared sections stay cached for as long as the caller uses the table.
    frames = quality_frames(df)

    def long(frame, section, item, metrics):
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return frame.select(F.lit(section).alias("section"), item.alias("item"), F.explode(pairs).alias("p")).select(
            "section", "item", "p.metric", "p.value")

    out = long(frames["basic_schema"], "column", F.col("column"), ["non_null_count", "null_count", "unique_count"])
    out = out.unionByName(long(frames["numeric_profile"], "numeric", F.col("column"), ["mean", "median", "std_dev"]))
    out = out.unionByName(long(frames["duplicates"], "duplicates", F.lit("table"), ["duplicate_rows", "duplicate_groups"]))
    out = out.unionByName(long(frames["health"], "health", F.lit("table"), ["score"]))
    monthly = calculate_kpi(df, {"definition_type": "aggregate", "components": {
        "value": {"aggregation": "sum", "column": value_column}}}, time_column=date_column, time_grain="month")
    return out.unionByName(long(monthly, "month", F.col("period"), ["value"]))
