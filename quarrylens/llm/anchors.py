"""Anchored pieces: how texts that share long spans meet without comparing all of them.

In every window of ``window`` tokens the run of ``gram`` tokens with the least hash is the
window's anchor (the rightmost of equals). Equal windows have equal anchors at equal places,
so it is enough to compare windows of the same anchor. Consecutive windows with one anchor
form a piece. Pieces are dealt by the hash of their anchor; a piece that equals an earlier one
is settled there, an anchor with a single piece is dropped, and only what is left (pieces that
share their anchor but differ) is fetched from the texts for a closer look.

Copies inside one batch of documents are settled before the shuffle, so an anchor that a third
of all documents share arrives as one row per batch.

A short passage that very many documents hold in different surroundings is the anchor of as many
different pieces. Where these come to more than ``most`` tokens, the pieces are cut again by longer
runs (halfway to the window each time), which reach into the surroundings and so part them. The
last length is the window itself: pieces of one anchor are then equal, and nothing is left to
compare. So no closer look ever gets more than ``most`` tokens of one anchor.

Cutting again reads the texts once more where they lie and moves hashes only; the pieces of all
lengths are fetched together, in the one shuffle of the texts that the answer needs anyway. The
hot anchors go along as cells, a fixed number of remainders of their hashes. A piece that shares
a cell with a hot anchor by chance is cut again too, which repeats spans and loses none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import saved

GONE, PIECE, HOT = 0, 1, 2
# Places of a text are packed beside its hashes; longer texts are cut into parts of this many bits.
PLACE_BITS = 27
# Remainders that name hot anchors: 8 MB of them at the most.
CELLS = 1 << 20
ROW = "fp long, ph long, doc long, start int, n int, kind int"
FETCHED = "fp long, doc long, start int, n int, content binary"
SPANS = "doc long, a int, b int"


@dataclass(frozen=True)
class Rule:
    """Tokens of a text and of a piece's content, the window and anchor lengths, whether a string
    that is repeated inside one document counts (else only documents with smaller numbers do), and
    the most tokens of one anchor that are looked at together."""

    tokens: Callable
    read: Callable
    window: int
    gram: int
    inside: bool
    most: int


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def gram_hashes(tokens: np.ndarray, gram: int) -> np.ndarray:
    """Hash of every run of ``gram`` tokens, from hashes of runs of powers of two."""
    power, length = mixed(tokens + np.uint64(0x1F83D9ABFB41BD6B)), 1
    whole, done = None, 0
    left = gram
    while left:
        if left & 1:
            whole = power if whole is None else mixed(
                whole[: len(tokens) - done - length + 1] * np.uint64(3) + power[done:]
            )
            done += length
        left >>= 1
        if left:
            power = mixed(power[:-length] * np.uint64(5) + power[length:])
            length *= 2
    return whole


def anchors(tokens: np.ndarray, window: int, gram: int):
    """(hash, first window, number of windows) of every piece of a text. A text of 2^27 tokens
    or more is worked through in parts that share all but one token of a window, so that every
    window lies in one part and has the anchor it has anywhere."""
    part = 1 << PLACE_BITS
    if len(tokens) > part:
        step = part - window + 1
        found = []
        for at in range(0, len(tokens) - window + 1, step):
            fp, first, count = anchors(tokens[at : at + part], window, gram)
            found.append((fp, first + at, count))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(tokens) < window:
        return empty
    hashes = gram_hashes(tokens, gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    key = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))
    span, length = window - gram + 1, 1
    while 2 * length <= span:
        key = np.minimum(key[:-length], key[length:])
        length *= 2
    if span > length:
        key = np.minimum(key[: len(key) - (span - length)], key[span - length :])
    place = (low - (key & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    count = np.diff(np.append(first, len(place)))
    return hashes[place[first]], first, count


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def pieces(text: tuple, rule: Rule, levels: list[tuple]):
    """(hash, hash of the content, first window, number of windows) of the pieces of a text (tokens,
    bytes, bytes per token). ``levels`` are pairs of a run length and the cells of its hot anchors:
    only their pieces are cut by the next length, the last one being the rule's."""
    tokens, content, size = text
    fp, first, count = anchors(tokens, rule.window, levels[0][0] if levels else rule.gram)
    if levels:
        hot = np.isin(fp & np.uint64(CELLS - 1), levels[0][1])
        fp, first, count = fp[hot], first[hot], count[hot]
    stops = first + count + rule.window - 1
    parts = [content[a:b] for a, b in zip((first * size).tolist(), (stops * size).tolist(), strict=True)]
    if not levels:
        import xxhash

        return fp, np.array([xxhash.xxh64_intdigest(p) for p in parts], np.uint64), first, count
    whole, places = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = [(whole, whole, places, places)]
    for base, part in zip(first, parts, strict=True):
        fp, ph, start, n = pieces(rule.read(part), rule, levels[1:])
        found.append((fp, ph, start + base, n))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def piece_rows(docs: DataFrame, rule: Rule, levels: list[tuple] = ()) -> DataFrame:
    """All pieces of texts (doc, text), or of their hot pieces (see ``pieces``); in-batch copies are
    already marked as gone."""

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                fp, ph, first, count = pieces(rule.tokens(text), rule, levels)
                parts.append((fp, ph, np.full(len(fp), doc), first, count))
            fp, ph, doc, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            fp, ph = _signed(fp), _signed(ph)
            order = np.lexsort((first, doc, ph, fp))
            fp, ph, doc, first, count = (x[order] for x in (fp, ph, doc, first, count))
            new = np.ones(len(fp), bool)
            new[1:] = (fp[1:] != fp[:-1]) | (ph[1:] != ph[:-1])
            head = np.maximum.accumulate(np.where(new, np.arange(len(fp)), 0))
            gone = doc > doc[head]
            if rule.inside:
                gone |= first > first[head]
            yield pa.RecordBatch.from_arrays(
                [
                    # What is settled needs no meeting: it is dealt by its document.
                    pa.array(np.where(gone, doc, fp)),
                    pa.array(ph),
                    pa.array(doc.astype(np.int64)),
                    pa.array(first.astype(np.int32)),
                    pa.array(count.astype(np.int32)),
                    pa.array(np.where(gone, GONE, PIECE).astype(np.int32)),
                ],
                names=["fp", "ph", "doc", "start", "n", "kind"],
            )

    return docs.select("doc", "text").mapInArrow(run, ROW)


def settled(rows: DataFrame, rule: Rule) -> DataFrame:
    """(fp, doc, start, n, kind): pieces that equal an earlier one (GONE), and those that
    share their anchor with a different piece (PIECE, or HOT where these come to more than
    ``rule.most`` tokens)."""
    copies = Window.partitionBy("kind", "fp", "ph").orderBy("doc", "start")
    anchor = Window.partitionBy("kind", "fp")
    later = F.col("doc") > F.first("doc").over(copies)
    if rule.inside:
        later = later | (F.col("start") > F.first("start").over(copies))
    # One shuffle and one sort serve both windows; their buffers spill.
    marked = rows.repartition("fp").withColumn("later", later | (F.col("kind") == GONE))
    marked = marked.withColumn("differ", F.min("ph").over(anchor) != F.max("ph").over(anchor))
    left = F.when(~F.col("later"), F.col("n") + F.lit(rule.window - 1))
    marked = marked.withColumn("size", F.sum(left).over(anchor))
    hot = (F.col("size") > rule.most) & F.lit(rule.gram < rule.window)
    kind = F.when(F.col("later"), GONE).when(hot, HOT).otherwise(PIECE)
    return marked.where("later OR differ").select("fp", "doc", "start", "n", kind.alias("kind"))


def fetched(found: DataFrame, docs: DataFrame, rule: Rule) -> DataFrame:
    """The pieces of ``found`` with their content, cut out of the texts."""
    wanted = found.groupBy("doc").agg(F.collect_list(F.struct("fp", "start", "n")).alias("pieces"))

    def run(batches: Iterator):
        import pyarrow as pa

        def batch_of(rows):
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                names=["fp", "doc", "start", "n", "content"],
            )

        for batch in batches:
            rows = []
            for doc, text, pieces in zip(
                *(batch.column(c).to_pylist() for c in ("doc", "text", "pieces")), strict=True
            ):
                _, content, size = rule.tokens(text)
                for p in pieces:
                    a, b = p["start"], p["start"] + p["n"] + rule.window - 1
                    rows.append((p["fp"], doc, p["start"], p["n"], bytes(content[a * size : b * size])))
                if len(rows) > 50_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    # All columns go in, so that this join and the last one read one and the same shuffle of texts.
    return docs.join(wanted, "doc").mapInArrow(run, FETCHED)


def repeated_spans(docs: DataFrame, rule: Rule, engine: Callable) -> DataFrame:
    """Spans (doc, a, b) of tokens that lie in windows with an earlier occurrence. ``docs``
    has (doc, doc_id, text); ``engine`` gets the fetched pieces of whole anchors, sorted by anchor and
    document, and yields spans."""
    found = all_settled(docs, rule)
    gone = found.where(F.col("kind") == GONE).select(
        "doc", F.col("start").alias("a"), (F.col("start") + F.col("n") + (rule.window - 1)).alias("b")
    )
    fetch = fetched(found.where(F.col("kind") == PIECE), docs, rule)
    dealt = fetch.repartition("fp").sortWithinPartitions("fp", "doc", "start")
    return gone.union(dealt.mapInArrow(engine, SPANS))


def all_settled(docs: DataFrame, rule: Rule) -> DataFrame:
    """The settled pieces of the rule's run length and, where anchors are hot, of the longer ones up
    to the window."""
    found, levels = [], []
    while True:
        found.append(saved(settled(piece_rows(docs, rule, levels), rule)))
        if rule.gram == rule.window:
            break
        cell = F.col("fp").bitwiseAND(F.lit(CELLS - 1)).alias("cell")
        hot = found[-1].where(F.col("kind") == HOT).select(cell).distinct().collect()
        if not hot:
            break
        levels = [*levels, (rule.gram, np.array([r.cell for r in hot], np.uint64))]
        longer = (rule.gram + rule.window) // 2
        rule = replace(rule, gram=longer if longer - rule.gram > rule.window // 4 else rule.window)
    return reduce(DataFrame.union, found)


def whole_groups(batches: Iterator, bound: int) -> Iterator[list[tuple]]:
    """Lists of (fp, doc, start, content) rows: whole anchors, gathered until they come to
    ``bound`` bytes or more."""
    rows: list[tuple] = []
    size = 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("fp", "doc", "start", "content")]
        for row in zip(*columns, strict=True):
            if rows and row[0] != rows[-1][0] and size >= bound:
                yield rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield rows


def numbered(docs: DataFrame) -> DataFrame:
    """(doc, doc_id, text): ``doc`` orders documents as their ids do. It is the id itself where
    ids are whole numbers that tell texts apart; else rows get numbers in the order of (id,
    nulls last, hash of the text), and repeated rows share one."""
    source = docs.select("doc_id", "text")
    if source.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint"):
        odd = source.select("doc_id", F.xxhash64("text").alias("h")).groupBy("doc_id").agg(
            F.min("h").alias("low"), F.max("h").alias("high")
        )
        if odd.where("doc_id IS NULL OR low <> high").isEmpty():
            # Known not to be null, so that no join adds a filter of its own below its shuffle.
            number = F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long"))
            return source.select(number.alias("doc"), "doc_id", "text")
    keys = source.select("doc_id", F.xxhash64("text").alias("h")).distinct()
    ordered = saved(keys.orderBy(F.col("doc_id").asc_nulls_last(), "h"))
    # Numbers by partition and place follow the sort without bringing rows together.
    ranked = ordered.withColumn("doc", F.monotonically_increasing_id())
    same = source.withColumn("h", F.xxhash64("text"))
    return same.join(
        ranked.withColumnRenamed("doc_id", "r_id"),
        (F.col("r_id").eqNullSafe(F.col("doc_id"))) & (same["h"] == ranked["h"]),
    ).select("doc", "doc_id", "text")


def without_spans(docs: DataFrame, spans: DataFrame, describe: Callable, columns: str) -> DataFrame:
    """``describe(text, merged spans)`` of every row of ``docs`` (doc, doc_id, text): a tuple
    of the values that ``columns`` declares after doc_id."""
    found = spans.groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    joined = docs.join(found, "doc", "left")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator):
        import pyarrow as pa

        for batch in batches:
            rows = [
                describe(text, merged_spans(spans or ()))
                for text, spans in zip(
                    batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True
                )
            ]
            values = list(zip(*rows, strict=True)) or [()] * len(names)
            types = [pa.string() if c.endswith("string") else pa.int64() for c in columns.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(values, types, strict=True))],
                names=["doc_id", *names],
            )

    return joined.mapInArrow(run, schema)


def merged_spans(spans) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans given as dicts with a and b."""
    out: list[list[int]] = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_runs(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Spans of the windows that begin at the given sorted places."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    first = starts[np.concatenate(([0], cut + 1))]
    last = starts[np.concatenate((cut, [len(starts) - 1]))]
    return [(int(a), int(b) + window) for a, b in zip(first, last, strict=True)]
