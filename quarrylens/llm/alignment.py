"""Alignment of two tokenizers by pointer jumping.

Both token streams of a text cover the same bytes. Every token points to its farthest-right
overlapping token: a token of A to the token of B that covers its last byte, a token of B to the
token of A that covers its last byte, or to itself where both end there. Successor doubling
(``next = next[next]`` over a whole block of texts at once) brings every token to the terminal
token of its component in a number of steps logarithmic in the longest chain; the terminal
labels the component, which is the group between two offsets where both streams end a token.

The pairs of ids linked in a document are kept once with their number. Their document counts
over the corpus come from one aggregate. Counts of the ``COMMON`` most frequent pairs go to the
tasks as a broadcast table of that many rows; links of rarer pairs, of which no one is frequent,
are joined by a shuffle. No link is left out.

Defined cases: texts that are null, empty or differ from the joined bytes of either stream have
no tokens: zeros and ''. Repeated rows are documents of their own, null ids are kept, an empty
table gives an empty result, other columns are not looked at. A long text is worked through in
segments of ``SEGMENT`` characters, which end where both streams do.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import tokens
from quarrylens.llm.common import saved, stored, table

# Characters worked on at once; table rows of pair counts broadcast to the tasks.
SEGMENT = 500_000
COMMON = 1 << 17

_ALIGNED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<{code}>, times array<int>"
)
_LOOKED_UP = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "n_best long, count_sum long, rare array<{code}>, rare_times array<int>"
)


def terminals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A and of B the number of the B token that ends its component.

    Streams are given by the byte offsets where their tokens end; both end at the same byte."""
    n_a, n_b = len(ends_a), len(ends_b)
    to_b = np.searchsorted(ends_b, ends_a)
    to_a = np.searchsorted(ends_a, ends_b)
    own = np.arange(n_b) + n_a
    at_cut = ends_a[to_a] == ends_b if n_b else np.zeros(0, bool)
    jump = np.concatenate([to_b + n_a, np.where(at_cut, own, to_a)])
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    return jump[:n_a] - n_a, jump[n_a:] - n_a


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) of all pairs of tokens whose byte ranges overlap: one per stretch between
    neighbouring ends of either stream."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.flatnonzero(np.diff(ends, prepend=-1))]
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Aligner:
    """Both tokenizers with their tables; aligns blocks of texts."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        self.a = tokens.ByteBpe(byte_file, specials_are_text=True)
        self.b = tokens.PieceBpe(piece_file)
        self.a_bytes, self.b_bytes = self.a.token_bytes(), self.b.token_bytes()
        self.a_size = np.array([len(t) for t in self.a_bytes])
        self.b_size = np.array([len(t) for t in self.b_bytes])
        # Decimal ids followed by what comes next in the listing of the groups.
        self.said = [f"{i}{end}".encode() for i in range(self.a.size) for end in ",|"]
        self.said += [f"{i}{end}".encode() for i in range(self.b.size) for end in ",;"]

    def block(self, texts: list[str | None]) -> list[tuple | None]:
        """Per text: (n_a, n_b, n_groups, n_links, listing of the groups, distinct pair codes,
        their numbers), or None where it is empty or the bytes differ."""
        a_raw, b_raw, taken = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            spaced = " " + text
            a, b = self.a.encode(spaced), self.b.encode(text)
            raw = spaced.encode()
            if raw == b"".join([self.a_bytes[t] for t in a]) == b"".join([self.b_bytes[t] for t in b]):
                taken.append(i)
                a_raw.append(tokens.raw_ids(a))
                b_raw.append(tokens.raw_ids(b))
        results: list = [None] * len(texts)
        if not taken:
            return results
        n_a = np.array([len(r) // 4 for r in a_raw])
        n_b = np.array([len(r) // 4 for r in b_raw])
        a = np.frombuffer(b"".join(a_raw), "<u4").astype(np.int64)
        b = np.frombuffer(b"".join(b_raw), "<u4").astype(np.int64)
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])

        label_a, label_b = terminals(ends_a, ends_b)
        last_b = label_b == np.arange(len(b))
        number = np.cumsum(last_b) - 1
        group_a, group_b = number[label_a], number[label_b]
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        last_a = np.diff(group_a, append=len(in_a)) > 0
        listing = np.empty(len(a) + len(b), np.int64)
        listing[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = 2 * a + last_a
        listing[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * self.a.size + 2 * b + last_b
        said = [self.said[i] for i in listing.tolist()]

        link_a, link_b = overlaps(ends_a, ends_b)
        doc_of_a = np.repeat(np.arange(len(taken)), n_a)
        codes = a[link_a] * self.b.size + b[link_b]
        space = self.a.size * self.b.size
        distinct, times = np.unique(doc_of_a[link_a] * space + codes, return_counts=True)
        doc_of_pair, distinct = distinct // space, distinct % space
        borders = np.searchsorted(doc_of_pair, np.arange(len(taken) + 1))
        n_links = np.bincount(doc_of_a[link_a], minlength=len(taken))
        n_groups = np.bincount(np.repeat(np.arange(len(taken)), n_b)[last_b], minlength=len(taken))
        at = 0
        for k, i in enumerate(taken):
            size = int(n_a[k] + n_b[k])
            own = slice(borders[k], borders[k + 1])
            results[i] = (
                int(n_a[k]), int(n_b[k]), int(n_groups[k]), int(n_links[k]),
                b"".join(said[at : at + size])[:-1], distinct[own], times[own],
            )
            at += size
        return results

    def long_text(self, text: str) -> tuple | None:
        """One text in segments: (counts, sha256 of the listing, codes, numbers)."""
        counts = np.zeros(4, np.int64)
        digest = hashlib.sha256()
        codes, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, part in enumerate(tokens.segments(text, SEGMENT)):
            found = self.block([part])[0]
            if found is None:
                return None
            counts += found[:4]
            digest.update((b";" if k else b"") + found[4])
            codes, place = np.unique(np.concatenate([codes, found[5]]), return_inverse=True)
            times = np.bincount(place, np.concatenate([times, found[6]])).astype(np.int64)
        return (*counts.tolist(), digest.hexdigest(), codes, times)

    def texts(self, found: list[str | None]):
        """(first, results) for consecutive texts, in blocks of about ``SEGMENT`` characters."""
        first, block, held = 0, [], 0
        for i, text in enumerate(found):
            if text and len(text) > SEGMENT:
                yield first, [_hashed(r) for r in self.block(block)]
                yield i, [self.long_text(text)]
                first, block, held = i + 1, [], 0
                continue
            block.append(text)
            held += len(text or "")
            if held > SEGMENT:
                yield first, [_hashed(r) for r in self.block(block)]
                first, block, held = i + 1, [], 0
        yield first, [_hashed(r) for r in self.block(block)]


def _hashed(result: tuple | None) -> tuple | None:
    return result and (*result[:4], hashlib.sha256(result[4]).hexdigest(), *result[5:])


def _lists(parts: list[np.ndarray], kind):
    """Arrow list array of the parts."""
    import pyarrow as pa

    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(kind)))


def _code_kind(space: int) -> tuple[str, type]:
    return ("int", np.int32) if space < 1 << 31 else ("long", np.int64)


def align(docs: DataFrame, byte_file: str = tokens.BYTE_BPE, piece_file: str = tokens.PIECE_BPE,
          text_col: str = "text") -> tuple[DataFrame, int]:
    """(one row per document with its alignment, number of ids of B); a pair of ids (a, b) has
    the code a * (ids of B) + b. Written once to the shared folder, since two passes read it."""
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast((tokens.contents(byte_file), tokens.contents(piece_file)))
    sizes = (tokens.ByteBpe(files.value[0], True).size, tokens.PieceBpe(files.value[1]).size)
    sql_kind, kind = _code_kind(sizes[0] * sizes[1])

    def run(batches):
        import pyarrow as pa

        aligner = Aligner(*files.value)
        none = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))
        for batch in batches:
            for first, found in aligner.texts(batch.column(2).to_pylist()):
                if not found:
                    continue
                rows = [r or none for r in found]
                fixed = list(zip(*[r[:5] for r in rows], strict=True))
                arrays = [batch.column(i).slice(first, len(rows)) for i in (0, 1)]
                arrays += [pa.array(c, pa.int64()) for c in fixed[:4]] + [pa.array(fixed[4], pa.string())]
                arrays += [_lists([r[5] for r in rows], kind), _lists([r[6] for r in rows], np.int32)]
                names = [f.split()[0] for f in _ALIGNED.split(", ")]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col)
    )
    return stored(rows.mapInArrow(run, _ALIGNED.format(code=sql_kind)), "alignment"), sizes[1]


def pair_counts(aligned: DataFrame, ids_b: int) -> DataFrame:
    """(pair, docs, best): in how many documents a pair is linked, and whether that is the
    highest count of its id of A."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("docs"))
    counts = saved(counts.withColumn("a", F.floor(F.col("pair") / ids_b)))
    top = counts.groupBy(F.col("a").alias("top_a")).agg(F.max("docs").alias("most"))
    joined = counts.join(top, F.col("a") == F.col("top_a"))
    return joined.select("pair", "docs", (F.col("docs") == F.col("most")).alias("best"))


def with_counts(aligned: DataFrame, counts: DataFrame, common: int = COMMON) -> DataFrame:
    """``aligned`` with ``n_best`` and ``count_sum`` over its links."""
    spark = aligned.sparkSession
    first = counts.orderBy(F.desc("docs"), "pair").limit(common).toPandas().sort_values("pair")
    # A leading row that no pair equals keeps an empty table searchable.
    rows = {"pair": (-1, np.int64), "docs": (0, np.int64), "best": (False, bool)}
    head = spark.sparkContext.broadcast(
        tuple(np.concatenate([[none], first[c].to_numpy(t)]).astype(t) for c, (none, t) in rows.items())
    )
    code = aligned.schema["pairs"].dataType.elementType.simpleString()
    kind = np.int32 if code == "int" else np.int64

    def run(batches):
        import pyarrow as pa

        pairs, docs, best = head.value
        for batch in batches:
            lists, numbers = batch.column(7), batch.column(8)
            codes = lists.flatten().to_numpy()
            times = numbers.flatten().to_numpy().astype(np.int64)
            borders = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            place = np.minimum(np.searchsorted(pairs, codes), len(pairs) - 1)
            hit = pairs[place] == codes
            weight = np.where(hit, times, 0)

            def summed(values):
                total = np.concatenate([[0], np.cumsum(values)])
                return pa.array(total[borders[1:]] - total[borders[:-1]], pa.int64())

            n_best = summed(weight * best[place])
            count_sum = summed(weight * docs[place])
            rare = np.concatenate([[0], np.cumsum(~hit)])[borders].astype(np.int32)
            left = [
                pa.ListArray.from_arrays(pa.array(rare), pa.array(v[~hit].astype(t)))
                for v, t in ((codes, kind), (times, np.int32))
            ]
            arrays = [batch.column(i) for i in range(7)] + [n_best, count_sum, *left]
            names = [f.split()[0] for f in _LOOKED_UP.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    looked = stored(aligned.mapInArrow(run, _LOOKED_UP.format(code=code)), "alignment-counts")
    links = looked.select("row", F.inline(F.arrays_zip("rare", "rare_times")))
    rest = links.join(counts, F.col("rare") == F.col("pair")).groupBy(F.col("row").alias("r")).agg(
        F.sum(F.when(F.col("best"), F.col("rare_times")).otherwise(0)).alias("more_best"),
        F.sum(F.col("rare_times") * F.col("docs")).alias("more_sum"),
    )
    both = looked.drop("rare", "rare_times").join(rest, F.col("row") == F.col("r"), "left")
    return both.withColumns({
        "n_best": F.col("n_best") + F.coalesce("more_best", F.lit(0)),
        "count_sum": F.col("count_sum") + F.coalesce("more_sum", F.lit(0)),
    }).drop("r", "more_best", "more_sum", "row")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned, ids_b = align(table(spark, sf_dir, "documents"))
    found = with_counts(aligned, pair_counts(aligned, ids_b))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
