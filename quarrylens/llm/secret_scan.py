"""Secret scans with corpus-wide ownership frequency.

A map-only scan finds the spans of the base patterns (they always stay) and further
candidates: bare tokens that look like generated keys. Every candidate value is hashed, and
the hashes are counted over the whole corpus by distinct repositories and distinct owners.
A bare token that few owners hold in few repositories looks like a live credential and becomes a
span of kind ``owned``; one that many owners hold, or that fills many repositories of one owner, is
a widely copied example and does not. The census
(one row per value: documents, repositories, owners, verdict) is an output of its own.

Counting goes by (value, owner) first, so a value that a third of all documents share is
added up on the map side before anything moves.

Defined cases: a null text is empty; a null owner or repository counts as one owner or
repository; repeated rows are scanned each; an empty table gives empty results; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm.common import saved, table

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_BARE = re.compile(r"[A-Za-z0-9_-]{20,}", re.ASCII)
KINDS = ["assign", "access", "hex", "owned"]
MAX_OWNERS = 2
MAX_REPOSITORIES = 20

SCAN_SCHEMA = (
    "doc_id {id}, repo string, owner string, "
    "spans array<struct<start:int,rank:int,stop:int>>, "
    "candidates array<struct<value:string,start:int,stop:int,kind:string>>"
)


def generated(token: str) -> bool:
    """Upper and lower case and digits mixed over the token, as generators do."""
    if token.startswith("AKIA"):
        return False
    digits = sum(c.isdigit() for c in token)
    upper = sum("A" <= c <= "Z" for c in token)
    lower = sum("a" <= c <= "z" for c in token)
    return digits >= 3 and upper >= 3 and lower >= 3 and len(set(token)) >= 12


def scan_text(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int, str]]]:
    """Base spans (start, rank of kind, stop) and candidates (value hash, start, stop, kind)."""
    spans, candidates = [], []

    def found(value: str, start: int, stop: int, kind: str) -> None:
        digest = hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()
        candidates.append((digest[:32], start, stop, kind))

    for m in _ASSIGN.finditer(text):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end()))
            found(m[1], m.start(1), m.end(1), "assign")
    for rank, pattern in ((1, _ACCESS), (2, _HEX)):
        for m in pattern.finditer(text):
            spans.append((m.start(), rank, m.end()))
            found(m[0], m.start(), m.end(), KINDS[rank])
    covered = sorted((s, e) for s, _, e in spans)
    at = 0
    for m in _BARE.finditer(text):
        if generated(m[0]):
            while at < len(covered) and covered[at][1] <= m.start():
                at += 1
            if at == len(covered) or covered[at][0] >= m.end():
                found(m[0], m.start(), m.end(), "owned")
    return sorted(spans), candidates


def scan(docs: DataFrame, repo_col: str, owner_col: str) -> DataFrame:
    """One row per document with its base spans and its candidates."""
    source = docs.select(
        "doc_id",
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        "text",
    )

    def run(batches):
        import pyarrow as pa

        names = ["start", "rank", "stop"]
        parts = ["value", "start", "stop", "kind"]
        kinds = pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32())])
        values = pa.struct(
            [("value", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]
        )
        for batch in batches:
            rows = [scan_text(t or "") for t in batch.column("text").to_pylist()]
            spans = [[dict(zip(names, s, strict=True)) for s in r[0]] for r in rows]
            found = [[dict(zip(parts, c, strict=True)) for c in r[1]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("doc_id", "repo", "owner")),
                    pa.array(spans, pa.list_(kinds)),
                    pa.array(found, pa.list_(values)),
                ],
                names=["doc_id", "repo", "owner", "spans", "candidates"],
            )

    id_type = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, SCAN_SCHEMA.format(id=id_type))


def ownership_census(
    scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES
) -> DataFrame:
    """One row per candidate value: occurrences, distinct repositories and owners, verdict."""
    none = F.lit("\u0000null")
    seen = scanned.select(
        F.coalesce("repo", none).alias("repo"),
        F.coalesce("owner", none).alias("owner"),
        F.explode("candidates.value").alias("value"),
    )
    by_place = seen.groupBy("value", "repo", "owner").agg(F.count(F.lit(1)).alias("n"))
    # Two plain counts of distinct keys, each of them map-side combined.
    repos = by_place.groupBy("value", "repo").agg(F.sum("n").alias("n"))
    repos = repos.groupBy("value").agg(
        F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("repositories")
    )
    owners = by_place.groupBy("value", "owner").agg(F.first("value").alias("same"))
    owners = owners.groupBy("value").agg(F.count("same").alias("owners"))
    few = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    return repos.join(owners, "value").withColumn("verdict", F.when(few, "live").otherwise("example"))


def secret_spans(
    docs: DataFrame,
    repo_col: str,
    owner_col: str,
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """One row per document: base spans, all spans (sorted by start, then kind) and the
    number of its candidate values that look live."""
    scanned = saved(scan(docs, repo_col, owner_col)).withColumn(
        "row", F.monotonically_increasing_id()
    )
    census = ownership_census(scanned, max_owners, max_repositories).where("verdict = 'live'").select("value")
    held = scanned.where(F.size("candidates") > 0).select("row", F.explode("candidates").alias("c"))
    live = (
        held.withColumn("value", F.col("c.value"))
        .join(census, "value")
        .groupBy("row")
        .agg(
            F.collect_list(
                F.when(
                    F.col("c.kind") == "owned",
                    F.struct(
                        F.col("c.start").alias("start"),
                        F.lit(3).alias("rank"),
                        F.col("c.stop").alias("stop"),
                    ),
                )
            ).alias("owned"),
            F.countDistinct("value").alias("n_live"),
        )
    )
    none = F.expr("array()").cast("array<struct<start:int,rank:int,stop:int>>")
    return scanned.join(live, "row", "left").select(
        "doc_id",
        F.col("spans").alias("base"),
        F.array_sort(F.concat("spans", F.coalesce("owned", none))).alias("all_spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"),
    )


def _joined(spans):
    kinds = F.lit(KINDS)
    return F.concat_ws(
        ",",
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
    )


def op8_secret_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a repository and its source the owner."""
    found = secret_spans(table(spark, sf_dir, "documents"), repo_col="doc_id", owner_col="source")

    def count(rank: int):
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all_spans")).alias("spans"),
        "n_live",
    )
