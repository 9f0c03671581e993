"""Benchmark decontamination by winnowing.

A text is read as words in lower case. Each run of ``GRAM`` words is hashed, and of the
hashes in every window of ``WINDOW`` words the least is kept as a fingerprint: whatever span
of at least one window two texts share, both keep the same fingerprint for it, so the join of
fingerprints misses nothing. Documents are joined with the benchmark's fingerprints; in texts
with a hit, each window whose fingerprint was hit is compared with the item's window word by
word, and hits are extended over all windows of the text. An item shorter than a window is
one window of its own length, found through hashes of runs of that length.

Texts themselves never move for the search: documents give fingerprints, which are joined
where they are made (a broadcast if Spark finds the benchmark's side small, a shuffle of
fingerprints otherwise) and added up per document on the map side. Only the texts with hits
are read again, each distinct text once however many copies it has.

Defined cases: a null text has no words and is never hit; items without words take no part;
an item with a null id still hits, but is not counted or named; equal item ids count once;
repeated rows are answered each; empty tables give no hits or no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import BREAKS, lower_ascii, saved, table

GRAM = 5
WINDOW = 10


def words(text: Column) -> Column:
    """Words of lower-cased text between ASCII characters that are no letter or digit."""
    found = F.split(lower_ascii(F.coalesce(text, F.lit(""))), BREAKS)
    return F.filter(found, lambda w: w != "")


def _positions(size: Column, length: Column | int) -> Column:
    """0 .. size - length, or nothing."""
    last = size - length
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(ids: Column, n: Column) -> Column:
    parts = lambda i: [F.get(ids, i + k) for k in range(GRAM)]
    return F.transform(_positions(n, GRAM), lambda i: F.xxhash64(*parts(i)))


def window_minima(grams: Column) -> Column:
    """The least hash of each window, in the order of the windows."""
    span = WINDOW - GRAM + 1
    return F.transform(
        _positions(F.size(grams), span), lambda i: F.array_min(F.slice(grams, i + 1, span))
    )


def short_hashes(ids: Column, n: Column, length: int) -> Column:
    """Hashes of all runs of ``length`` words, for items that short."""
    return F.transform(
        _positions(n, length), lambda i: F.xxhash64(F.lit(length), F.slice(ids, i + 1, length))
    )


def _tokens(texts: DataFrame) -> DataFrame:
    found = texts.withColumn("words", words(F.col("text")))
    found = found.withColumn("n_words", F.size("words"))
    found = found.withColumn("ids", F.transform("words", lambda w: F.xxhash64(w)))
    # A column of its own: inside a lambda an expression would be evaluated for each window.
    return found.withColumn("grams", gram_hashes(F.col("ids"), F.col("n_words")))


def _windows(tokens: DataFrame, lengths: list[int], keep: list[str]) -> DataFrame:
    """One row per window with its fingerprint, place, length and words."""
    ids, n = F.col("ids"), F.col("n_words")

    def rows(prints: Column, length: int) -> Column:
        return F.transform(
            prints,
            lambda p, i: F.struct(
                p.alias("fp"),
                i.alias("at"),
                F.lit(length).alias("length"),
                F.slice("words", i + 1, length).alias("window"),
            ),
        )

    found = [rows(window_minima(F.col("grams")), WINDOW)]
    found += [rows(short_hashes(ids, n, length), length) for length in lengths]
    return tokens.select(*keep, F.inline(F.concat(*found)))


def _item_windows(benchmark: DataFrame) -> tuple[DataFrame, list[int]]:
    """(item_id, fp, length, window) and the lengths of items shorter than a window."""
    items = _tokens(benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text"))
    items = items.where("n_words > 0")
    # At most WINDOW - 1 lengths.
    short = items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()
    lengths = sorted(r["n_words"] for r in short)
    found = _windows(items, lengths, ["item_id", "n_words"])
    whole = (F.col("length") == WINDOW) | (F.col("length") == F.col("n_words"))
    return saved(found.where(whole).select("item_id", "fp", "length", "window").distinct()), lengths


def _fingerprint_hits(source: DataFrame, known: DataFrame, lengths: list[int]) -> DataFrame:
    """One row per document (doc_id, text_hash, n_words): does a fingerprint of it hit?"""
    prints = [window_minima(F.col("grams"))]
    prints += [short_hashes(F.col("ids"), F.col("n_words"), length) for length in lengths]
    tokens = _tokens(source.withColumn("row", F.monotonically_increasing_id()))
    spread = tokens.select(
        "row",
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        "n_words",
        F.explode_outer(F.array_distinct(F.concat(*prints))).alias("fp"),
    )
    # The row number is used inside this one job only.
    return (
        spread.join(known.withColumn("known", F.lit(True)), "fp", "left")
        .groupBy("row", "doc_id", "text_hash", "n_words")
        .agg(F.bool_or(F.col("known").isNotNull()).alias("hit"))
        .drop("row")
    )


def _hits_by_text(
    source: DataFrame, rows: DataFrame, item_windows: DataFrame, lengths: list[int]
) -> DataFrame:
    """(text_hash, n_hit, items) of the texts that share a window with an item."""
    wanted = rows.where("hit").select("text_hash").distinct()
    texts = (
        source.withColumn("text_hash", F.xxhash64("text"))
        .join(wanted, "text_hash", "left_semi")
        .groupBy("text_hash")
        .agg(F.first("text").alias("text"))
    )
    places = _windows(_tokens(texts), lengths, ["text_hash"])
    hits = places.join(item_windows, ["fp", "length", "window"]).select(
        "text_hash", "item_id", "at", "length"
    )
    by_text = hits.groupBy("text_hash").agg(
        F.collect_set(F.struct("at", "length")).alias("spans"),
        F.array_sort(F.collect_set("item_id")).alias("items"),
    )
    covered = F.array_distinct(
        F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["length"] - 1)))
    )
    return by_text.select("text_hash", "items", F.size(covered).cast("long").alias("n_hit"))


def contaminated_words(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: n_words, n_hit and the sorted ids of the items as ``items``."""
    source = docs.select("doc_id", "text")
    item_windows, lengths = _item_windows(benchmark)
    known = item_windows.select("fp").distinct()
    rows = saved(_fingerprint_hits(source, known, lengths))
    by_text = _hits_by_text(source, rows, item_windows, lengths)
    return rows.join(by_text, "text_hash", "left").select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with any item, with their own columns."""
    source = docs.select("doc_id", "text")
    item_windows, lengths = _item_windows(benchmark)
    known = item_windows.select("fp").distinct()
    rows = saved(_fingerprint_hits(source, known, lengths))
    found = _hits_by_text(source, rows, item_windows, lengths).select("text_hash")
    return docs.join(found, F.xxhash64(docs["text"]) == found["text_hash"], "left_anti")


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_words(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS l, w[i:i + least(len(w), 10) - 1] AS x
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT rid, i, l, w[i:i + l - 1] AS x
  FROM (SELECT rid, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT rid, i, dw.l, item_id FROM dw JOIN bw ON dw.l = bw.l AND dw.x = bw.x),
n_hit AS (
  SELECT rid, count(DISTINCT p)::BIGINT AS n
  FROM (SELECT rid, unnest(range(i, i + l)) AS p FROM hits) GROUP BY rid),
named AS (
  SELECT rid, list_sort(list(DISTINCT item_id)) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit,
       coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit USING (rid) LEFT JOIN named USING (rid)
"""
