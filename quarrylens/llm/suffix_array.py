"""Suffix-array dedup: column-wise construction over many texts.

The strings of a block are indexed from their right ends, one column at a time: each round
inserts one symbol of every string still active into the collection's Burrows-Wheeler
transform. Where a string's next suffix belongs follows from the transform alone: it is the
rank, among equal symbols, of the place its last symbol went to. After the last round the
rows stand in suffix order; neighbours are compared for a common prefix of the window's
length, and runs of equal prefixes are the repeated strings.

A collection of 100 TB cannot pass through one such index, and a round per symbol of the
longest text would never end. So texts are first cut into anchored pieces (see ``anchors``):
equal 100-byte strings always meet in one block, a piece is at most ``2 * WINDOW - GRAM``
bytes, which bounds the rounds, and a block is bounded in bytes (pieces of an anchor above
``MOST_BYTES`` are cut again by longer runs), so its columns stay in a task's memory and no
files of their own are needed.

Defined cases: a null text is empty; texts shorter than the window lose nothing; spans never
cross documents; repeated rows (equal id and text) are one document answered twice; of
different texts that share an id the one with the smaller hash counts as earlier, and null
ids come after all others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quarrylens.llm.anchors import (
    Rule,
    numbered,
    repeated_spans,
    whole_groups,
    window_runs,
    without_spans,
)
from quarrylens.llm.common import table

WINDOW = 100
GRAM = 24
# Columns of a block this size stay in a core's own cache.
BLOCK_BYTES = 100_000
MOST_BYTES = 4_000_000


def byte_tokens(text: str | None):
    raw = (text or "").encode("utf-8", "surrogatepass")
    return np.frombuffer(raw, np.uint8).astype(np.uint64), raw, 1


def piece_tokens(content: bytes):
    return np.frombuffer(content, np.uint8).astype(np.uint64), content, 1


def suffix_order(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places (in ``data``) of all suffixes of the strings data[start : start + length], in
    suffix order, built column by column. Strings are given longest first."""
    _, data = np.unique(data, return_inverse=True)
    codes = (data + 1).astype(np.uint8)  # 0 ends a string; UTF-8 leaves room for it
    count = len(starts)
    ends = starts + lengths
    place = np.arange(count)
    transform = codes[ends - 1]
    order = ends.astype(np.int32)
    steps = np.arange(len(data) + count, dtype=np.int32)
    ranks = np.empty(len(steps), np.int32)
    shorter_first = lengths[::-1]
    for column in range(1, int(lengths[0]) + 1):
        active = count - int(np.searchsorted(shorter_first, column, "left"))
        at = ends[:active] - column
        ranked = np.argsort(transform, kind="stable")
        ranks[ranked] = steps[: len(ranked)]
        closed = len(ranked) - np.count_nonzero(transform)
        place = ranks[place[:active]] + (count - closed)
        old = np.ones(len(ranked) + active, bool)
        old[place] = False
        bigger, moved = np.empty(len(old), np.uint8), np.empty(len(old), np.int32)
        bigger[old], moved[old] = transform, order
        before = codes[at - 1]
        before[at == starts[:active]] = 0
        bigger[place], moved[place] = before, at
        transform, order = bigger, moved
    return order


def repeats_in_block(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int]]:
    """(doc, a, b) spans of windows of the pieces that begin earlier elsewhere in the block."""
    rows = sorted(rows, key=lambda r: -len(r[3]))
    data = np.frombuffer(b"".join(r[3] for r in rows), np.uint8)
    lengths = np.array([len(r[3]) for r in rows])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    order = suffix_order(data, starts, lengths)
    piece = np.searchsorted(starts, order, "right") - 1
    whole = (order < len(data)) & (starts[piece] + lengths[piece] - order >= window)
    order, piece = order[whole], piece[whole]
    if len(order) < 2:
        return
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    new = np.ones(len(order), bool)
    for a in range(1, len(order), 65536):
        b = min(len(order), a + 65536)
        new[a:b] = (views[order[a:b]] != views[order[a - 1 : b - 1]]).any(axis=1)
    group = np.cumsum(new)
    doc = np.array([r[1] for r in rows])[piece]
    start = np.array([r[2] for r in rows])[piece] + order - starts[piece]
    by = np.lexsort((start, doc, group))
    group, doc, start = group[by], doc[by], start[by]
    first = np.concatenate(([True], group[1:] != group[:-1]))
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    gone = (doc != doc[head]) | (start != start[head])
    doc, start = doc[gone], start[gone]
    by = np.lexsort((start, doc))
    doc, start = doc[by], start[by]
    cuts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))) if len(doc) else []
    for a, b in zip(cuts, np.append(cuts[1:], len(doc)) if len(doc) else [], strict=True):
        for x, y in window_runs(np.unique(start[a:b]), window):
            yield int(doc[a]), x, y


def block_engine(window: int, block_bytes: int = BLOCK_BYTES):
    def run(batches: Iterator):
        import pyarrow as pa

        for rows in whole_groups(batches, block_bytes):
            spans = list(repeats_in_block(rows, window))
            columns = list(zip(*spans, strict=True)) or [(), (), ()]
            types = [pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc", "a", "b"]
            )

    return run


def repeated_byte_spans(
    docs: DataFrame, window: int = WINDOW, gram: int = GRAM, most: int = MOST_BYTES
) -> DataFrame:
    """Spans of bytes (doc, a, b) of ``docs`` (doc, doc_id, text) that begin earlier somewhere."""
    rule = Rule(byte_tokens, piece_tokens, window, gram, inside=True, most=most)
    return repeated_spans(docs, rule, block_engine(window))


def kept_bytes(text: str | None, spans: list[tuple[int, int]]) -> tuple[int, int, int, str]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    at, kept = 0, hashlib.sha256()
    for a, b in spans:
        kept.update(raw[at:a])
        at = b
    kept.update(raw[at:])
    return len(raw), sum(b - a for a, b in spans), len(spans), kept.hexdigest()


def op6_suffix_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = numbered(table(spark, sf_dir, "documents"))
    spans = repeated_byte_spans(docs)
    columns = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return without_spans(docs, spans, kept_bytes, columns)
