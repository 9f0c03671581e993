"""Packing of documents into sequences by bounded-space online best-fit.

A task encodes its documents and places their pieces as they come. It has a fixed number of open
bins; a bitset holds which amounts of free space occur among them, so the tightest bin a piece
fits into is the lowest set bit from the piece's length on. Where no bin fits and all are open,
the fullest closes first: the lowest set bit of all.

Pieces arrive in the order of the table, longest first within blocks of about a million
characters. What a task still has open at its end is at most ``OPEN`` bins. Their pieces are
packed again by the same rule, longest first, in rounds of ever fewer tasks, until one task has
them all: the pieces of no more than about ``GATHER`` times ``OPEN`` bins meet in a task, and the
whole table ends with one set of open bins instead of one a task. Closed bins are never touched
again.

Only documents longer than a sequence are cut. The first piece takes what whole sequences leave
over, so every other piece is a sequence of its own and never enters a bin.

Defined cases: a null text is empty and packs as its end token; repeated rows are documents of
their own, null ids are kept; an empty table gives no pieces; other columns are not looked at.
A long text is encoded in segments and held as its ids.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import tokens
from quarrylens.llm.common import saved, stored, table

CAPACITY = 2048
# Open bins of a task; tasks whose open bins one task of the next round takes.
OPEN = 512
GATHER = 16
END_ID = 0
# Characters encoded at once.
SEGMENT = 500_000

_PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, open boolean"
)
_MOVES = "own_bin long, own_place long, length long, bin long, place long, open boolean"


class OpenBins:
    """At most ``limit`` bins of ``capacity``; numbers of bins start at ``first``."""

    def __init__(self, first: int, capacity: int, limit: int):
        self.next, self.capacity, self.limit = first, capacity, limit
        self.bits = 0  # bit f: some open bin has f free
        self.by_free: dict[int, list[int]] = {}
        self.held = 0

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        number = stack.pop()
        if not stack:
            self.bits ^= 1 << free
        self.held -= 1
        return number

    def _put(self, number: int, free: int) -> None:
        if free == 0:
            return  # full: closed
        self.by_free.setdefault(free, []).append(number)
        self.bits |= 1 << free
        self.held += 1

    def add(self, length: int) -> tuple[int, int]:
        """(bin, place in it) of an item of ``length``, from 1 to the capacity."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            if self.held == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, number = self.capacity, self.next
            self.next += 1
        self._put(number, free - length)
        return number, self.capacity - free

    def left(self) -> dict[int, int]:
        """Open bin -> what is used of it."""
        return {n: self.capacity - free for free, stack in self.by_free.items() for n in stack}


def cuts(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def _first_bin(round_number: int) -> int:
    """Numbers of a task's bins: round (8 bits), task (27), bin (28)."""
    return (round_number << 55) | (TaskContext.get().partitionId() << 28)


def pieces(docs: DataFrame, byte_file: str, text_col: str, capacity: int) -> DataFrame:
    """Pieces with a bin and a place in it; ``open`` where the bin was open at the task's end."""
    spark = docs.sparkSession
    file = spark.sparkContext.broadcast(tokens.contents(byte_file))

    def run(batches):
        import pyarrow as pa

        model = tokens.ByteBpe(file.value, specials_are_text=False)
        bins = OpenBins(_first_bin(0), capacity, OPEN)
        end = tokens.raw_ids([END_ID])
        waiting: dict[int, list[tuple]] = {}  # open bin -> its pieces
        names = [f.split()[0] for f in _PIECES.split(", ")]
        kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.bool_()]

        def batch_of(rows):
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def encoded(text):
            """The ids as bytes; segments behind the first have their space before them."""
            parts = tokens.segments(text or "", SEGMENT)
            return b"".join([tokens.raw_ids(model.encode(" " + p if k else p)) for k, p in enumerate(parts)]) + end

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for block in _blocks(texts):
                found, done = [], []
                for i in block:
                    raw = encoded(texts[i])
                    for number, (start, length) in enumerate(cuts(len(raw) // 4, capacity)):
                        crc = zlib.crc32(raw[4 * start : 4 * (start + length)])
                        found.append((ids[i], number, start, length, crc))
                # The pieces of a block arrive longest first.
                for row in sorted(found, key=lambda r: -r[3]):
                    bin_number, place = bins.add(row[3])
                    waiting.setdefault(bin_number, []).append((*row, bin_number, place))
                still = bins.left()
                for number in [n for n in waiting if n not in still]:
                    done += [(*row, False) for row in waiting.pop(number)]
                if done:
                    yield batch_of(done)
        rest = [(*row, True) for rows in waiting.values() for row in rows]
        if rest:
            yield batch_of(rest)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, _PIECES)
    return stored(found, "packing-pieces")


def _blocks(texts: list[str | None]):
    """Indices of consecutive texts of about a million characters together."""
    block, held = [], 0
    for i, text in enumerate(texts):
        block.append(i)
        held += len(text or "")
        if held > 1 << 20:
            yield block
            block, held = [], 0
    if block:
        yield block


def gathered(open_pieces: DataFrame, capacity: int) -> DataFrame:
    """(own_bin, own_place, bin, place, ...): where the pieces (own_bin, own_place, length) that
    the tasks left in open bins end up. Each round packs what the round before left open."""
    waiting = saved(open_pieces.withColumn("bin", F.col("own_bin")))
    settled, number, tasks = [], 1, 0
    while tasks != 1:
        tasks = max(1, -(-waiting.select("bin").distinct().count() // (GATHER * OPEN)))

        def run(batches, number=number):
            import pyarrow as pa

            bins = OpenBins(_first_bin(number), capacity, OPEN)
            rows = []
            for batch in batches:
                for own_bin, own_place, length in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                    rows.append((own_bin, own_place, length, *bins.add(length)))
            still = bins.left()
            columns = list(zip(*[(*row, row[3] in still) for row in rows], strict=True)) or [()] * 6
            kinds = [*[pa.int64()] * 5, pa.bool_()]
            names = [f.split()[0] for f in _MOVES.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        dealt = waiting.repartition(tasks, F.xxhash64("bin")) if tasks > 1 else waiting.coalesce(1)
        longest_first = dealt.sortWithinPartitions(F.desc("length"), "own_bin", "own_place")
        packed = saved(longest_first.select("own_bin", "own_place", "length").mapInArrow(run, _MOVES))
        settled.append(packed if tasks == 1 else packed.where("not open"))
        waiting = packed.where("open").select("own_bin", "own_place", "length", "bin")
        number += 1
    return reduce(lambda a, b: a.unionByName(b), settled)


def pack(docs: DataFrame, byte_file: str = tokens.BYTE_BPE, text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    placed = pieces(docs, byte_file, text_col, capacity)
    left = placed.where("open")
    moves = gathered(left.select(F.col("bin").alias("own_bin"), F.col("place").alias("own_place"), "length"), capacity)
    moves = moves.select("own_bin", "own_place", F.col("bin").alias("to"), F.col("place").alias("at"))
    moved = left.join(moves, (F.col("bin") == F.col("own_bin")) & (F.col("place") == F.col("own_place")))
    fixed = ["doc_id", "piece", "start", "length", "ids_crc32"]
    parts = [
        placed.where("not open").select(*fixed, F.col("bin").alias("sequence_id"), F.col("place").alias("offset")),
        moved.select(*fixed, F.col("to").alias("sequence_id"), F.col("at").alias("offset")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
