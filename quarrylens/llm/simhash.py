"""SimHash near-duplicates through Golay-code fuzzy hashing.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Two
fingerprints link when they differ in at most three bits. To find such pairs without
comparing all, the 64 bits are cut into three segments of 23, 23 and 18 bits (the last padded
with zeros to 23). The binary Golay code [23, 12, 7] is perfect: every word lies within three
bits of exactly one code word. A segment's *near* key is that code word; its *wide* keys are
all code words within four bits, six at most. If two segments differ in at most one bit, the
near key of either is a wide key of the other. With at most three errors over three segments,
either some segment is free of errors and another has at most one, or each has exactly one:

* equal segment i + wide keys of segment j, for every ordered pair (i, j);
* (wide, near, near) keys on one side meet (near, wide, wide) keys on the other.

So every linking pair shares a bucket. Only distinct fingerprints take part, buckets are
verified with exact bit counts where they lie, and each bucket gives a spanning forest of its
links, not all its pairs. Components come from the links by star contraction.

Defined cases: no words (or a null text) gives fingerprint zero, which links like any other;
null ids never name a group unless all its ids are null; repeated rows share a fingerprint;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import KEY, LOWER_ASCII, boxed, row_key, saved, table, unboxed
from quarrylens.llm.components import components

SHINGLE = 3
MAX_BITS = 3
# The generator polynomial of the binary Golay code and the code's length.
GENERATOR = 0b101011100011
LENGTH = 23
CUTS = ((0, 23), (23, 23), (46, 18))


# ---- fingerprints ---------------------------------------------------------------------


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of a text over shingles of ``size`` words, repeats included."""
    import xxhash

    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII)
    words = raw.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    stops = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), stops.tolist(), strict=True)
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed long."""
    source = docs.select(*keep, "text")
    kept = [f"{c} {source.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [fingerprint(t, size) for t in batch.column("text").to_pylist()]
            signed = np.array(found, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(signed)], names=[*keep, "fp"]
            )

    return source.mapInArrow(run, ", ".join([*kept, "fp long"]))


# ---- Golay keys -----------------------------------------------------------------------


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and per syndrome the error patterns of up to
    four bits (nearest first, the first one repeated where there are fewer than six)."""
    single = [_remainder(1 << b) for b in range(LENGTH)]
    low = np.array([_remainder(w) for w in range(1 << 12)], np.int64)
    high = np.array([_remainder(w << 12) for w in range(1 << 11)], np.int64)
    patterns: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        for bits in itertools.combinations(range(LENGTH), weight):
            syndrome = error = 0
            for b in bits:
                syndrome ^= single[b]
                error |= 1 << b
            patterns[syndrome].append(error)
    wide = np.array([(p * 6)[:6] if len(p) == 1 else p for p in patterns], np.int64)
    return low, high, wide


def wide_keys(segment: np.ndarray, tables: tuple[np.ndarray, ...]) -> np.ndarray:
    """n x 6 code words (their 12 message bits) within four bits, the nearest one first."""
    low, high, wide = tables
    syndrome = low[segment & 0xFFF] ^ high[segment >> 12]
    return (segment[:, None] ^ wide[syndrome]) >> 11


def bucket_keys(fps: np.ndarray, tables: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, index of the fingerprint) of all buckets of the given unsigned fingerprints."""
    segments = [
        ((fps >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in CUTS
    ]
    codes = [wide_keys(s, tables) for s in segments]
    rows = np.arange(len(fps))
    keys, index = [], []

    def add(kind: int, key: np.ndarray) -> None:
        keys.append((kind << 50 | key).ravel())
        index.append(np.broadcast_to(rows.reshape(-1, *[1] * (key.ndim - 1)), key.shape).ravel())

    pairs = itertools.permutations(range(3), 2)
    for kind, (i, j) in enumerate(pairs):
        add(kind, segments[i][:, None] << 12 | codes[j])
    a, b, c = codes
    add(6, a << 24 | b[:, :1] << 12 | c[:, :1])
    add(6, a[:, :1, None] << 24 | b[:, :, None] << 12 | c[:, None, :])
    keys, index = np.concatenate(keys), np.concatenate(index)
    order = np.lexsort((index, keys))
    keys, index = keys[order], index[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (index[1:] != index[:-1])
    return keys[new], index[new]


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints: breadth first, each one
    compared with those not reached yet, so memory stays linear."""
    left = fps
    links = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            links += [(at, x) for x in left[near]]
            queue += list(left[near])
            left = left[~near]
    return links


def golay_links(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that connect exactly the linking fingerprints of ``distinct`` (fp)."""

    def keyed(batches):
        import pyarrow as pa

        tables = golay_tables()
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                keys, index = bucket_keys(part, tables)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(part[index].view(np.int64))], names=["key", "fp"]
                )

    def linked(batches):
        import pyarrow as pa

        # Rows come sorted by key; a group may run over several batches.
        rest_key = rest_fp = None
        for batch in itertools.chain(batches, [None]):
            if batch is None:
                if rest_key is None:
                    return
                keys, fps, whole = rest_key, rest_fp, True
            else:
                keys = batch.column("key").to_numpy()
                fps = batch.column("fp").to_numpy().view(np.uint64)
                if rest_key is not None:
                    keys, fps = np.concatenate((rest_key, keys)), np.concatenate((rest_fp, fps))
                whole = False
            if not len(keys):
                continue
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            stops = np.append(starts[1:], len(keys))
            if not whole:
                rest_key, rest_fp = keys[starts[-1] :], fps[starts[-1] :]
                starts, stops = starts[:-1], stops[:-1]
            many = stops - starts > 1
            links = []
            two = stops - starts == 2
            first, second = fps[starts[two]], fps[starts[two] + 1]
            near = np.bitwise_count(first ^ second) <= max_bits
            links.append(np.stack((first[near], second[near]), axis=1))
            for a, b in zip(starts[many & ~two], stops[many & ~two], strict=True):
                found = spanning_links(np.unique(fps[a:b]), max_bits)
                if found:
                    links.append(np.array(found, np.uint64))
            pairs = np.unique(np.concatenate(links).astype(np.uint64).reshape(-1, 2), axis=0)
            pairs = pairs[pairs[:, 0] != pairs[:, 1]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(pairs[:, k].copy().view(np.int64)) for k in (0, 1)], names=["u", "v"]
            )

    keys = distinct.mapInArrow(keyed, "key long, fp long")
    return keys.repartition("key").sortWithinPartitions("key").mapInArrow(linked, "u long, v long")


def near_duplicate_groups(
    docs: DataFrame, keep: list[str] = (), max_bits: int = MAX_BITS
) -> DataFrame:
    """(doc_id, fp, component_id and the columns ``keep``): the component is the least document
    id that links of at most ``max_bits`` differing bits reach; ``group`` names it by the least
    fingerprint, also where ids are null."""
    prints = saved(fingerprints(docs, ["doc_id", *keep]))
    return named_groups(prints, lambda fps: golay_links(fps, max_bits), keep)


def named_groups(prints: DataFrame, links: Callable, keep: list[str] = ()) -> DataFrame:
    """Rows of ``prints`` (doc_id, fp and the columns ``keep``) with the groups that the links
    (u, v) make which ``links`` finds among their distinct ``fp``."""
    least = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = saved(components(links(least.select("fp"))))
    joined = least.join(roots, least["fp"] == roots["node"])
    named = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    moved = joined.join(named, "root").select("fp", "root", "component_id")
    names = least.join(moved, "fp", "left").select(
        "fp",
        F.when(F.col("root").isNull(), F.col("least"))
        .otherwise(F.col("component_id"))
        .alias("component_id"),
        F.coalesce("root", "fp").alias("group"),
    )
    # Written first, so that the last join stands alone and a hot fingerprint can be split.
    names = saved(names)
    return prints.join(names, "fp").select("doc_id", *keep, "fp", "component_id", "group")


def representatives(docs: DataFrame, grouped: Callable = near_duplicate_groups) -> DataFrame:
    """One document of each group: the one with the least id (nulls last), whole and once."""
    keyed = boxed(docs, "doc_id", "text")
    keyed = keyed.withColumns(dict(zip(KEY, row_key(F.col("doc_id"), F.col("text")), strict=True)))
    groups = grouped(keyed, KEY)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("first")
    chosen = groups.groupBy("group").agg(first).select(*[f"first.{k}" for k in KEY])
    kept = keyed.join(chosen, KEY, "left_semi").dropDuplicates(KEY)
    return kept.select(unboxed(docs.columns))


def op9_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_groups(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
