"""Near copies by the similarity of their shingle sets.

Two texts link when their SimHash fingerprints link by the Golay keys of ``simhash``, or when the
Jaccard similarity of their sets of five-word shingles is 0.8 or more. A 64-bit fingerprint is too
coarse for all of the latter (such pairs differ in ten bits and more), so further
candidates come from min-wise hashes: ``BANDS`` keys of ``ROWS`` least hashes each. A pair at
similarity s shares a key with probability 1 - (1 - s^6)^40, which is 1 - 5e-6 at 0.8 and more
above. What shares a key is compared by its whole shingle sets, so no link is wrong.

Texts with equal sets are one node. A bucket with a single node is dropped before any set is
moved, buckets with equal members count once, and a bucket gives a spanning forest of its
links. Components come from the links by star contraction.

Defined cases: a text of fewer words than a shingle has one shingle; texts without words are
copies of each other; null ids and repeated rows are handled as in ``simhash``.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm import simhash
from quarrylens.llm.anchors import gram_hashes
from quarrylens.llm.common import KEY, LOWER_ASCII, saved
from quarrylens.llm.components import components

SHINGLE = 5
# Links have 5 * |common| >= 4 * |either|.
SIMILAR = (4, 5)
BANDS, ROWS = 40, 6


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER_ASCII).split()
    if not words:
        return np.zeros(0, np.uint64)
    ids = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(gram_hashes(ids, min(size, len(ids))))


def draws() -> tuple[np.ndarray, np.ndarray]:
    """Masks and odd factors of the min-wise hashes, as columns."""
    import xxhash

    n = BANDS * ROWS
    fixed = [xxhash.xxh64_intdigest(f"draw {k}") for k in range(2 * n)]
    return np.array(fixed[:n], np.uint64)[:, None], np.array(fixed[n:], np.uint64)[:, None] | np.uint64(1)


def band_keys(grams: np.ndarray, masks: np.ndarray, factors: np.ndarray) -> list[int]:
    """The keys of a set of shingles; none for an empty one."""
    import xxhash

    if not len(grams):
        return []
    least = np.full(len(masks), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 1024):
        np.minimum(least, ((grams[at : at + 1024] ^ masks) * factors).min(axis=1), out=least)
    raw = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(raw, np.uint64).view(np.int64).tolist()


def set_prints(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep``, ``fp`` (a hash of the shingle set), ``print`` (the SimHash fingerprint)
    and ``keys``."""
    source = docs.select(*keep, "text")
    kept = [f"{c} {source.schema[c].dataType.simpleString()}" for c in keep]

    def run(batches):
        import pyarrow as pa
        import xxhash

        drawn = draws()
        for batch in batches:
            fps, prints, keys = [], [], []
            for text in batch.column("text").to_pylist():
                grams = shingles(text)
                fps.append(xxhash.xxh64_intdigest(grams.tobytes()))
                prints.append(simhash.fingerprint(text))
                keys.append(band_keys(grams, *drawn))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in keep),
                    pa.array(np.array(fps, np.uint64).view(np.int64)),
                    pa.array(np.array(prints, np.uint64).view(np.int64)),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                names=[*keep, "fp", "print", "keys"],
            )

    return source.mapInArrow(run, ", ".join([*kept, "fp long", "print long", "keys array<bigint>"]))


def spanning_links(fps: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the links among different sets: breadth first, each one compared
    with those not reached yet."""
    some, all_of = SIMILAR
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    grams = np.concatenate(sets)
    sizes = np.array([len(s) for s in sets])
    left = np.ones(len(sets), bool)
    links = []
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue and left.any():
            at = queue.pop()
            fits = left & (all_of * np.minimum(sizes, sizes[at]) >= some * np.maximum(sizes, sizes[at]))
            if not fits.any():
                continue
            inside = fits[owner]
            mine, whose = sets[at], owner[inside]
            place = np.minimum(np.searchsorted(mine, grams[inside]), len(mine) - 1)
            common = np.bincount(whose[mine[place] == grams[inside]], minlength=len(sets))
            near = np.flatnonzero(fits & (all_of * common >= some * (sizes + sizes[at] - common)))
            links += [(fps[at], fps[x]) for x in near]
            queue += near.tolist()
            left[near] = False
        if not left.any():
            break
        # Sets that are reached take no further part.
        if 2 * np.count_nonzero(left[owner]) < len(owner):
            grams, owner = grams[left[owner]], owner[left[owner]]
    return links


def similar_links(docs: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (u, v) of ``fp`` that connect exactly the linking sets that share a key. ``docs``
    has the row key and the text, ``prints`` (row key, fp, keys) of the same rows."""
    one = F.min(F.struct(*KEY)).alias("row")
    distinct = prints.groupBy("fp").agg(F.first("keys").alias("keys"))
    by_key = Window.partitionBy("key")
    buckets = (
        distinct.select("fp", F.explode("keys").alias("key"))
        .repartition("key")
        .withColumn("n", F.count(F.lit(1)).over(by_key))
        .withColumn("bucket", F.expr("bit_xor(xxhash64(fp))").over(by_key))
    )
    members = saved(buckets.where("n > 1").select("bucket", "fp").distinct())
    wanted = members.select("fp").distinct()
    rows = saved(prints.join(wanted, "fp", "left_semi").groupBy("fp").agg(one).select("fp", "row.*"))
    texts = docs.select(*KEY, "text").join(rows, KEY).select("fp", "text")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            grams = [shingles(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("fp"), pa.array(grams, pa.binary())], names=["fp", "grams"]
            )

    def linked(batches):
        import pyarrow as pa

        def batch_of(links):
            pairs = np.array(links, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in (0, 1)], names=["u", "v"])

        rows = (
            row
            for batch in batches
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "fp", "grams")), strict=True)
        )
        links = []
        for _, group in itertools.groupby(rows, key=lambda r: r[0]):
            # A row that repeats whole comes with its text again.
            found = {fp: grams for _, fp, grams in group}
            links += spanning_links(list(found), [np.frombuffer(g, np.uint64) for g in found.values()])
            if len(links) > 20_000:
                yield batch_of(links)
                links = []
        yield batch_of(links)

    sets = saved(texts.mapInArrow(cut, "fp long, grams binary"))
    dealt = members.join(sets, "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.select("bucket", "fp", "grams").mapInArrow(linked, "u long, v long")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Links (u, v) of ``fp`` that connect the sets whose fingerprints (``print``) are equal or reach
    each other by Golay links."""
    pairs = saved(prints.select("fp", "print").distinct())
    roots = saved(components(simhash.golay_links(pairs.select(F.col("print").alias("fp")).distinct())))
    rooted = pairs.join(roots, F.col("print") == F.col("node"), "left").select(
        "fp", F.coalesce("root", "print").alias("root"))
    least = rooted.groupBy("root").agg(F.min("fp").alias("u"))
    return rooted.join(least, "root").select("u", F.col("fp").alias("v")).where("u <> v").distinct()


def similar_groups(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """As ``simhash.near_duplicate_groups``, with the rule of this module; ``docs`` has the row
    key."""
    prints = saved(set_prints(docs, list(dict.fromkeys(["doc_id", *KEY, *keep]))))
    return simhash.named_groups(
        prints.drop("keys", "print"),
        lambda _: fingerprint_links(prints).unionByName(similar_links(docs, prints.drop("print"))),
        keep,
    )


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group: the one with the least id (nulls last), whole and once."""
    return simhash.representatives(docs, similar_groups)
