"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
failed rule; policies are versioned masks over these bits, so a new policy or an ablation
reads the ledger only, never a text again. An ablation of rule r over any group of rows is
bitwise: a document is lost because of r alone if its failures under the policy are exactly
the bit of r.

Texts are measured in Arrow batches of a map-only stage; nothing is shuffled.

Defined cases: a null text has no words and no lines; repeated rows are measured each; an
empty table gives an empty ledger; other columns pass through ``ledger`` untouched unless
they have the name of a measurement, which then replaces them.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrylens.llm.common import table

MEASURES = [
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_shouted",
]
_NOT_SYMBOL = re.compile(r"[^#*$%&|<>]+")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    breaks = sum(raw.count(c) for c in b" \t\n\x0b\x0c\r")
    symbols = len(_NOT_SYMBOL.sub("", text))
    seen: set[bytes] = set()
    lines = dup = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        end = 0
        for i, gram in enumerate(grams):
            if counts[gram] > 1:
                repeated += i + 3 - max(end, i)
                end = i + 3
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1)
    return n, len(text) - breaks, symbols, dup, repeated, lines, shouted


# Rule name -> failure condition over the measurements. The position is the bit; rules are
# only ever appended, so masks of old policies keep their meaning.
def rules() -> list[tuple[str, Column]]:
    c = F.col
    return [
        ("few_words", c("n_words") < 50),
        ("repeated_words", 100 * c("n_repeat_words") > 50 * c("n_words")),
        ("symbols", 10 * c("n_symbols") > 3 * c("n_words")),
        ("repeated_lines", 10 * c("n_dup_lines") > 5 * c("n_lines")),
        ("shouting", 10 * c("n_shouted") > 5 * c("n_words")),
        ("word_length", (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 40 * c("n_words"))),
    ]


# Policy version -> names of the rules that reject a document.
POLICIES: dict[str, list[str]] = {
    "base": ["few_words", "repeated_words"],
    "v1": ["few_words", "repeated_words", "symbols", "repeated_lines", "shouting", "word_length"],
}


def mask(policy: str) -> int:
    names = [name for name, _ in rules()]
    return sum(1 << names.index(rule) for rule in POLICIES[policy])


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed`` (bit i set: rule i failed)."""
    kept = [f for f in docs.schema.fields if f.name.lower() not in {*MEASURES, "failed"}]
    schema = T.StructType([*kept, *(T.StructField(m, T.LongType()) for m in MEASURES)])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [measure(t) for t in batch.column(text_col).to_pylist()]
            columns = list(zip(*rows, strict=True)) or [()] * len(MEASURES)
            arrays = [batch.column(f.name) for f in kept]
            arrays += [pa.array(c, type=pa.int64()) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    measured = docs.select(*[f"`{f.name}`" for f in kept]).mapInArrow(run, schema)
    bits = [F.when(bad, F.lit(1 << i)).otherwise(0) for i, (_, bad) in enumerate(rules())]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measured.withColumn("failed", failed.cast("long"))


def accepted(docs: DataFrame, policy: str) -> DataFrame:
    """The documents that the policy keeps, with their own columns only."""
    # Columns are moved by number, so that no name of theirs can clash with a measurement.
    aside = docs.select([F.col(f"`{c}`").alias("text" if c == "text" else f"own {i}") for i, c in enumerate(docs.columns)])
    kept = ledger(aside).where(~rejected(policy))
    return kept.select([F.col("text" if c == "text" else f"`own {i}`").alias(c) for i, c in enumerate(docs.columns)])


def rejected(policy: str) -> Column:
    return F.col("failed").bitwiseAND(F.lit(mask(policy))) != 0


def ablations(entries: DataFrame, policy: str, by: list[str] | None = None) -> DataFrame:
    """Per rule (and group): documents that fail it, that only it rejects under the policy,
    and the rules that ever failed together, as one bitwise OR."""
    names = [name for name, _ in rules()]
    under = F.col("failed").bitwiseAND(F.lit(mask(policy)))
    found = []
    for rule in POLICIES[policy]:
        bit = 1 << names.index(rule)
        hit = under.bitwiseAND(F.lit(bit)) != 0
        found.append(
            F.struct(
                F.lit(rule).alias("rule"),
                F.count_if(hit).alias("failed_docs"),
                F.count_if(under == bit).alias("only_this"),
                F.coalesce(F.bit_or(F.when(hit, under)), F.lit(0)).alias("failed_with"),
            )
        )
    keys = by or []
    rows = entries.groupBy(*keys).agg(F.array(*found).alias("found"))
    return rows.select(*keys, F.inline("found"))


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return entries.select(
        "doc_id",
        *MEASURES[:5],
        rejected("base").alias("base_failed"),
        (~rejected("v1")).alias("kept"),
        "failed",
    )


OP2_SQL = r"""
WITH parts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM parts WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
repeats AS (
  SELECT rid, count(DISTINCT i + k)::BIGINT AS n
  FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
lines AS (
  SELECT rid, unnest(string_split(t, chr(10))) AS line FROM parts),
line_counts AS (
  SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS dup, count(*)::BIGINT AS n_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(l.n_lines, 0) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '[a-z]')
                                      AND strlen(x) > 1)) AS n_shouted
  FROM parts p LEFT JOIN repeats r USING (rid) LEFT JOIN line_counts l USING (rid)),
f AS (
  SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END)
          | (CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END)
          | (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END)
          | (CASE WHEN 10 * n_dup_lines > 5 * n_lines THEN 8 ELSE 0 END)
          | (CASE WHEN 10 * n_shouted > 5 * n_words THEN 16 ELSE 0 END)
          | (CASE WHEN word_chars < 2 * n_words OR word_chars > 40 * n_words THEN 32 ELSE 0 END) AS failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed
FROM f
"""
