"""Mixing sources to target weights by Pareto order sampling.

Sources share all words of the corpus by weight; no source may be asked for more than
``ceiling`` times its own words, and what such sources cannot take is shared again among the
others. A source that needs more words than it has gets certain whole copies of every
document first. The rest, fewer words than the source has, is drawn without replacement and
with unequal probabilities: a document's inclusion probability is p = c * size, where c makes
the expected words of the sample equal to the words due. Documents whose p would reach 1 are
certain; they are taken whole and c is found for the others. Each document gets a random number
u from its id, documents are ranked by the ratio of odds (u / (1 - u)) / (p / (1 - p)), and the
first ones in that order are taken until the words still due are met exactly: the fixed size of
the sample is its words. The document at the boundary gives only the words that are due.

The order inside a source is cut into narrow buckets of the ranking number. Words are summed
per (source, bucket), so only the rows of the one bucket where a source's quota ends are ever
sorted; a source with a third of all rows is spread over all tasks.

Defined cases: a null text has no words; the null source is a source of its own, last in
order; a null id draws its number from the word null and is ranked last on ties; repeated
rows are separate documents (equal rows are interchangeable); sources without words get
none; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import KEY, boxed, row_key, saved, table, unboxed, uniform, word_count

BUCKETS = 4096
CEILING = 3
SEED = "mix-1"
# The largest double below 1: a rounded product must not make a drawn document certain.
BELOW_ONE = 1 - 2.0**-53


def source_targets(sized: DataFrame, ceiling: int = CEILING) -> DataFrame:
    """(source, source_size, target): one row per source.

    Water-filling: in the order of ceiling per weight, sources are full as long as their
    ceiling lies below their share of what the fuller ones leave over.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows without a key see one row per source, never a document.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    weighted = weighted.withColumn("most", F.col("source_size") * F.lit(ceiling))
    everything = Window.partitionBy()
    fill = Window.orderBy(
        (F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last()
    )
    earlier = fill.rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    ) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0))
    )
    ranked = weighted.withColumn("level", level).withColumn(
        "full", F.col("most") <= F.col("level") * F.col("weight")
    )
    # Levels fall after the first source that is not full: its level holds for all others.
    highest = F.max(F.when(~F.col("full"), F.col("level")))
    ranked = ranked.withColumn("final", highest.over(everything))
    target = F.when(
        F.col("full") | F.col("final").isNull(), F.col("most").cast("double")
    ).otherwise(F.col("final") * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def inclusion(sized: DataFrame, quotas: DataFrame) -> DataFrame:
    """(i_source, scale, largest): per source with words due, documents of up to ``largest`` words
    have the inclusion probability scale * size, larger ones are certain.

    With all sizes above t certain, scale is (due - their words) / (sum of squares up to t); t is
    the largest size that keeps scale * t below 1. Documents are counted per (source, size)
    first, so the window sees the sizes that occur, never a document.
    """
    counted = sized.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.join(
        quotas.where("rest > 0").select("q_source", "source_size", "rest"),
        counted["source"].eqNullSafe(F.col("q_source")),
    )
    exact = "decimal(38,0)"
    up_to = Window.partitionBy("q_source").orderBy("size")
    square = F.col("size").cast("decimal(19,0)") * F.col("size").cast("decimal(19,0)")
    cells = counted.select(
        "q_source",
        "size",
        (F.col("rest") - F.col("source_size") + F.sum(F.col("n") * F.col("size")).over(up_to))
        .cast("double")
        .alias("left"),
        F.sum((square * F.col("n")).cast(exact)).over(up_to).cast("double").alias("squares"),
    ).where(F.col("left") * F.col("size") < F.col("squares"))
    return cells.groupBy(F.col("q_source").alias("i_source")).agg(
        F.max_by(F.col("left") / F.col("squares"), "size").alias("scale"),
        F.max("size").alias("largest"),
    )


def pareto_mix(
    docs: DataFrame, ceiling: int = CEILING, seed: str = SEED, keep: list[str] = ()
) -> DataFrame:
    """One row per document with ``copies`` (certain whole copies) and ``part`` (words of the
    drawn copy), so that a source's taken words equal its rounded target."""
    sized = saved(
        docs.select(
            "doc_id", "source", *keep, word_count(F.col("text")).alias("size")
        ).withColumn("u", uniform(F.col("doc_id"), F.lit(seed)))
    )
    due = F.round("target").cast("long")
    quotas = source_targets(sized, ceiling).select(
        F.col("source").alias("q_source"),
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(due / F.col("source_size")))
        .otherwise(0)
        .cast("long")
        .alias("copies"),
        F.when(F.col("source_size") > 0, due % F.col("source_size"))
        .otherwise(0)
        .cast("long")
        .alias("rest"),
    )
    odds_of = inclusion(sized, quotas)
    # One row per source, written so that the join below knows its size.
    quotas = saved(quotas.join(odds_of, quotas["q_source"].eqNullSafe(odds_of["i_source"]), "left"))
    p = F.least(F.col("scale") * F.col("size"), F.lit(BELOW_ONE))
    drawn = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    odds = F.when(F.col("size") > F.col("largest"), 0.0).when(F.col("size") > 0, drawn)
    ranked = sized.join(quotas, sized["source"].eqNullSafe(quotas["q_source"])).withColumn(
        "odds", F.when(F.col("rest") > 0, odds)
    )
    ranked = ranked.withColumn(
        "bucket", F.floor(F.col("odds") / (1 + F.col("odds")) * F.lit(BUCKETS)).cast("int")
    )
    cells = (
        ranked.where("odds IS NOT NULL")
        .groupBy("q_source", "bucket")
        .agg(F.sum("size").alias("words"), F.first("rest").alias("due"))
    )
    up_to = Window.partitionBy("q_source").orderBy("bucket")
    cells = cells.withColumn("end", F.sum("words").over(up_to)).select(
        F.col("q_source").alias("c_source"),
        F.col("bucket").alias("c_bucket"),
        (F.col("end") - F.col("words")).alias("begin"),
        "end",
    )
    placed = ranked.join(
        cells,
        ranked["q_source"].eqNullSafe(cells["c_source"])
        & (ranked["bucket"] == cells["c_bucket"]),
        "left",
    )
    columns = ["doc_id", *keep, "source", "size", "source_size", "target", "copies"]
    edge = (F.col("begin") < F.col("rest")) & (F.col("rest") < F.col("end"))
    inside = placed.where(~F.coalesce(edge, F.lit(False))).select(
        *columns,
        F.when(F.col("end") <= F.col("rest"), F.col("size")).otherwise(0).alias("part"),
    )
    order = (
        Window.partitionBy("source")
        .orderBy("odds", F.col("doc_id").asc_nulls_last(), "size")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left = F.col("rest") - F.col("begin") - (F.sum("size").over(order) - F.col("size"))
    cut = placed.where(edge).select(
        *columns, F.least("size", F.greatest(left, F.lit(0).cast("long"))).alias("part")
    )
    return inside.unionByName(cut)


def mixed_documents(docs: DataFrame, ceiling: int = CEILING, seed: str = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken. Documents stay whole, so the one
    at the boundary of a source is in if at least half of its words are due."""
    keyed = boxed(docs, "doc_id", "source", "text")
    keyed = keyed.withColumns(dict(zip(KEY, row_key(*unboxed(docs.columns)), strict=True)))
    # Documents without words add nothing to any target and are left out.
    drawn = F.when(2 * F.col("part") >= F.col("size"), 1).otherwise(0)
    whole = F.when(F.col("size") > 0, F.col("copies") + drawn).otherwise(0)
    # Equal rows stand for each other: their copies are added up and dealt to one of them.
    times = pareto_mix(keyed, ceiling, seed, KEY).groupBy(*KEY).agg(F.sum(whole).alias("__times"))
    taken = keyed.dropDuplicates(KEY).join(times.where("__times > 0"), KEY)
    copies = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times").cast("int"))))
    return copies.select(unboxed(docs.columns))


def op4_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = pareto_mix(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size") + F.col("part")).alias("taken"),
        "copies",
        "part",
    )


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':mix-1'), 1, 13))::BIGINT::DOUBLE
          + 0.5) / 4503599627370496.0 AS u
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (
  SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight,
         source_size * 3 AS most FROM sources),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM weighted
  WINDOW before AS (ORDER BY most / weight, source NULLS LAST
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
ends AS (
  SELECT max(level) FILTER (WHERE most > level * weight) AS final FROM levels),
targets AS (
  SELECT source, source_size,
         CASE WHEN most <= level * weight OR final IS NULL THEN most::DOUBLE
              ELSE final * weight END AS target
  FROM levels, ends),
quotas AS (
  SELECT *, CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS copies,
         CASE WHEN source_size > 0 THEN round(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM targets),
counted AS (
  SELECT s.source, s.size, any_value(q.rest) AS rest, any_value(q.source_size) AS source_size,
         count(*) AS n
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
  WHERE s.size > 0 AND q.rest > 0 GROUP BY 1, 2),
cells AS (
  SELECT source, size,
         (rest - source_size + sum(n * size) OVER up_to)::DOUBLE AS due_left,
         (sum(n::HUGEINT * size * size) OVER up_to)::DOUBLE AS squares
  FROM counted WINDOW up_to AS (PARTITION BY source ORDER BY size)),
inclusion AS (
  SELECT source, max_by(due_left / squares, size) AS scale, max(size) AS largest
  FROM cells WHERE due_left * size < squares GROUP BY source),
ranked AS (
  SELECT s.doc_id, s.size, q.*,
         CASE WHEN s.size > i.largest THEN 0.0
              WHEN s.size > 0 THEN (u / (1 - u)) / (least(i.scale * s.size, 1 - pow(2.0, -53))
                                                    / (1 - least(i.scale * s.size, 1 - pow(2.0, -53))))
         END AS odds
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
  LEFT JOIN inclusion i ON s.source IS NOT DISTINCT FROM i.source),
summed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST, doc_id NULLS LAST, size
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM ranked)
SELECT doc_id, size, source_size, target,
       (copies * size + CASE WHEN rest > 0 THEN least(size, greatest(rest - earlier, 0)) ELSE 0 END)::BIGINT AS taken,
       copies::BIGINT AS copies,
       (CASE WHEN rest > 0 THEN least(size, greatest(rest - earlier, 0)) ELSE 0 END)::BIGINT AS part
FROM summed
"""
