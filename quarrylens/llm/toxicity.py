"""Toxicity by a weighted lexicon and the Aho-Corasick automaton.

Texts are folded first: lower case, look-alike letters of other scripts to Latin, and digits
or signs that stand for letters inside words. The lexicon holds whole words and word
beginnings with log-odds weights learned from labelled documents; exception phrases (given
ones and those that labelled clean documents use) cancel the hits inside them. One automaton
finds all entries and exceptions in one pass over a text. The weights found are normalised
by the length of the text, and a logistic curve over the two sums turns them into a score.

Learning reads a bounded sample: at most ``SAMPLE`` labelled rows of either class, the first
in the order of a hash of their ids. The automaton has at most ``ENTRIES`` entries, which
bounds what is sent to every task. Scoring is map-only and covers every text whole.

Defined cases: a null text is empty; texts without hits (empty ones too) get the base score;
labels that are null or neither 0 nor 1 are not learned from; repeated rows are scored each;
with no labelled rows of either class every score is 0.5 or lower and nothing is predicted
toxic; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import saved, table

SAMPLE = 6000
ENTRIES = 2000
PREFIXES = range(4, 9)
MIN_LIFT = math.log(10)

# Letters that look like Latin ones, and signs written for letters.
LOOKALIKES = str.maketrans(
    {
        "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i",
        "ѕ": "s", "ј": "j", "ԁ": "d", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
        "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ι": "i", "κ": "k", "ν": "v", "τ": "t",
        "υ": "u", "ɡ": "g", "ı": "i", "ո": "n", "ѵ": "v", "ⅼ": "l",
    }
)
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"})
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "class clown", "garbage collection", "sore loser")
_TOKEN = re.compile(r"[^\W_]+")
_MIXED = re.compile(r"[^\W\d_]+[0-9@$]+(?=[^\W_])[^\W_]*|\b[0-9@$]+[^\W\d_][\w@$]*")


def fold(text: str | None) -> str:
    """Folded words between single spaces, with one at either end."""
    folded = (text or "").lower().translate(LOOKALIKES)
    folded = _MIXED.sub(lambda m: m[0].translate(SIGNS), folded)
    return f" {' '.join(_TOKEN.findall(folded))} "


def features(folded: str) -> set[str]:
    """Whole words (space at both ends) and beginnings (space in front) of a folded text."""
    words = set(folded.split())
    found = {f" {w} " for w in words}
    for n in PREFIXES:
        found.update(f" {w[:n]}" for w in words if len(w) >= n)
    return found


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[str] = field(default_factory=set)
    curve: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            machine.add_word(f" {phrase} ", (len(phrase) + 2, None))
        if len(machine):
            machine.make_automaton()
        return machine

    def score(self, sums: tuple[float, float]) -> float:
        z = self.curve[0] + self.curve[1] * sums[0] + self.curve[2] * sums[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def hits(machine, folded: str) -> list[tuple[int, float]]:
    """(start, weight) of the best entry at each word that no exception phrase covers."""
    if not len(machine):
        return []
    best: dict[int, float] = {}
    shelters = []
    for end, (length, weight) in machine.iter(folded):
        start = end - length + 1
        if weight is None:
            shelters.append((start, end))
        elif weight > best.get(start, 0.0):
            best[start] = weight
    for a, b in shelters:
        for start in [s for s in best if a <= s < b]:
            del best[start]
    return sorted(best.items())


def sums(machine, folded: str) -> tuple[float, float]:
    """Summed weight on a log scale, and per hundred words (at least fifty)."""
    total = sum(w for _, w in hits(machine, folded))
    words = max(50, folded.count(" ") - 1)
    return math.log1p(total), 100 * total / words


# ---- learning -------------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> DataFrame:
    """(toxic, text) of at most ``bound`` training rows of either class."""
    keyed = labels.select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    keyed = keyed.where(F.col("l_id").isNotNull() & ~held_out(F.col("l_id")))
    order = [F.xxhash64("l_id", F.lit("toxicity")), F.col("l_id")]
    texts = docs.select(F.col("doc_id").alias("d_id"), "text")
    chosen = [keyed.where(F.col("toxic") == c).orderBy(*order).limit(bound) for c in (0, 1)]
    picked = chosen[0].union(chosen[1])
    return texts.join(F.broadcast(picked), F.col("d_id") == F.col("l_id")).select("toxic", "text")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _counted(sample: DataFrame, find) -> DataFrame:
    """Sum over the sample of what ``find(folded)`` gives, by class, combined per task."""

    def run(batches):
        import pyarrow as pa

        counts = {0: Counter(), 1: Counter()}
        for batch in batches:
            for toxic, text in zip(
                batch.column("toxic").to_pylist(), batch.column("text").to_pylist(), strict=True
            ):
                counts[toxic].update(find(fold(text)))
        names = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_pydict(
            {
                "entry": pa.array(names, pa.string()),
                "clean": pa.array([counts[0][n] for n in names], pa.int64()),
                "toxic": pa.array([counts[1][n] for n in names], pa.int64()),
            }
        )

    counted = sample.mapInArrow(run, "entry string, clean long, toxic long")
    return counted.groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def learn(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE) -> Lexicon:
    sample = saved(labelled_sample(docs, labels, bound))
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        return Lexicon()
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    least = max(4, math.ceil(0.015 * n_toxic))
    rows = (
        _counted(sample, features)
        .where(F.col("toxic") >= least)
        .withColumn("lift", lift)
        .where(F.col("lift") >= MIN_LIFT)
        .orderBy(F.desc(F.col("lift") * F.log("toxic")), "entry")
        .limit(ENTRIES)
        .collect()
    )
    weights: dict[str, float] = {}
    # Shortest first: an entry is dropped if a kept beginning of it weighs about as much.
    for r in sorted(rows, key=lambda r: (len(r["entry"].rstrip()), r["entry"])):
        shorter = [r["entry"][:k] for k in range(2, len(r["entry"]))]
        if all(weights.get(s, -9.0) < r["lift"] - 0.5 for s in shorter):
            weights[r["entry"]] = r["lift"]
    lexicon = Lexicon(weights, set(EXCEPTIONS))
    lexicon.exceptions |= _learned_exceptions(sample, lexicon)
    lexicon.curve = _curve(sample, lexicon, labels)
    return lexicon


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> set[str]:
    """Pairs of words around a hit that several clean documents and no toxic ones use."""
    plain = Lexicon(lexicon.weights, set())

    def pairs(folded: str) -> set[str]:
        machine = cache.get("machine") or cache.setdefault("machine", plain.automaton())
        found = set()
        for start, _ in hits(machine, folded):
            stop = folded.index(" ", start + 1)
            before = folded.rfind(" ", 0, start)
            after = folded.find(" ", stop + 1)
            if before >= 0:
                found.add(folded[before + 1 : stop])
            if after > 0:
                found.add(folded[start + 1 : after])
        return found

    cache: dict = {}
    kept = _counted(sample, pairs).where("toxic = 0 AND clean >= 5")
    return {r["entry"] for r in kept.orderBy(F.desc("clean"), "entry").limit(ENTRIES).collect()}


def _curve(sample: DataFrame, lexicon: Lexicon, labels: DataFrame) -> tuple[float, float, float]:
    """Logistic curve over the two sums, by Newton steps on the bounded sample; the class
    shares of all training labels correct for the bound."""
    measured = _with_sums(sample, lexicon, ["toxic"]).select("toxic", "total", "dense").collect()
    x = np.array([[1.0, r["total"], r["dense"]] for r in measured])
    y = np.array([float(r["toxic"]) for r in measured])
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = p * (1 - p) + 1e-6
        step = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-2 * np.eye(3), x.T @ (y - p) - 1e-2 * beta)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    train = labels.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    shares = train.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    beta[0] += math.log(shares[0] / shares[1]) - math.log(y.sum() / (len(y) - y.sum()))
    return tuple(float(b) for b in beta)


# ---- scoring --------------------------------------------------------------------------


def _with_sums(frame: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    kept = [f"{c} {frame.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        import pyarrow as pa

        machine = lexicon.automaton()
        for batch in batches:
            found = [sums(machine, fold(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array([f[0] for f in found], pa.float64()),
                    pa.array([f[1] for f in found], pa.float64()),
                    pa.array([lexicon.score(f) for f in found], pa.float64()),
                ],
                names=[*keep, "total", "dense", "score"],
            )

    columns = ", ".join([*kept, "total double", "dense double", "score double"])
    return frame.select(*keep, "text").mapInArrow(run, columns)


def score_documents(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    return _with_sums(docs.select("doc_id", "text"), lexicon, ["doc_id"])


def op5_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = learn(docs, table(spark, sf_dir, "labels"))
    return score_documents(docs, lexicon).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
