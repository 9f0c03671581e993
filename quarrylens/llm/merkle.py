"""Merkle manifest of a table in blocks laid out after van Emde Boas.

Every row is a leaf; the leaves of a source ascend by id and form a tree whose nodes have up to
three children, the roots of the sources form one more. A tree is stored as aligned subtrees
(blocks) of up to ``HEIGHT`` levels of hashing: block k of round r holds the nodes from
k * 3**HEIGHT on and all their ancestors up to the block's root; the roots of one round's blocks
are the leaves of the next, so a tree of any size needs only logarithmically many rounds, and no
task holds more than one block's nodes at a time.

Within a block the nodes lie in van Emde Boas order: the levels are split at half height, the top
half is stored first and then each bottom subtree, both recursively. Only nodes that exist take
room. ``address`` computes places from the shape alone; construction and the retrieval of
siblings use nothing else.

Defined cases: leaves with equal ids are ordered by their hash, a null id comes first; nulls in any
column hash as '-'; repeated rows are leaves each; a tree of one leaf is its own root; an
empty table gives an empty manifest; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarrylens.llm.common import stored, table

FAN = 3
# Levels of hashing in one block: at most 2 187 leaves and 3 280 nodes.
HEIGHT = 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
_DIGEST = 32


# ---------------------------------------------------------------- layout of one block

def up(count, levels: int = 1):
    """Nodes ``levels`` above ``count`` nodes."""
    return -(-count // FAN**levels)


def height_of(leaves: int) -> int:
    """Levels of hashing until one node is left."""
    height = 0
    while leaves > 1:
        leaves = up(leaves)
        height += 1
    return height


@lru_cache(maxsize=4096)
def size(leaves: int, levels: int) -> int:
    """Nodes of a subtree of ``levels`` levels (leaves included) over ``leaves`` leaves."""
    return sum(up(leaves, k) for k in range(levels))


def address(leaves: int, levels: int, level: int, index: np.ndarray) -> np.ndarray:
    """Places of nodes ``index`` of ``level`` (0: the leaves) in van Emde Boas order."""
    if levels == 1:
        return np.zeros(len(index), np.int64)
    low = levels - levels // 2  # levels of the bottom subtrees
    bottoms = up(leaves, low - 1)
    if level >= low:
        return address(up(bottoms), levels - low, level - low, index)
    width = FAN ** (low - 1 - level)  # nodes of this level in a full bottom subtree
    which, within = index // width, index % width
    full = FAN ** (low - 1)
    place = size(up(bottoms), levels - low) + which * size(full, low)
    last = which == bottoms - 1
    for part, held in ((~last, full), (last, leaves - (bottoms - 1) * full)):
        if part.any():
            place[part] += address(held, low, level, within[part])
    return place


def layout(leaves: int, height: int) -> list[np.ndarray]:
    """Per level, leaves first, the places of its nodes."""
    return [address(leaves, height + 1, k, np.arange(up(leaves, k))) for k in range(height + 1)]


def digest(parts) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def build(leaves: list[str], height: int) -> list[str]:
    """The nodes of a block, in the order of the layout."""
    places = layout(len(leaves), height)
    nodes: list[str] = [""] * size(len(leaves), height + 1)
    for place, leaf in zip(places[0].tolist(), leaves, strict=True):
        nodes[place] = leaf
    for below, above in zip(places, places[1:], strict=False):
        below = below.tolist()
        for k, place in enumerate(above.tolist()):
            nodes[place] = digest([nodes[p] for p in below[FAN * k : FAN * k + FAN]])
    return nodes


def siblings(nodes: list[str], places: list[list[int]], leaf: int) -> list[tuple[int, list[str]]]:
    """From a leaf up to the block's root: (place among the run, the run's other digests)."""
    path = []
    for below in places[:-1]:
        first = leaf - leaf % FAN
        path.append((leaf % FAN, [nodes[p] for i, p in enumerate(below[first : first + FAN], first) if i != leaf]))
        leaf //= FAN
    return path


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The root that a leaf and the siblings on its way give."""
    for place, others in path:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def said(path: list[tuple[int, list[str]]]) -> str:
    return "".join(f"{place}{''.join(others)};" for place, others in path)


def heard(text: str) -> list[tuple[int, list[str]]]:
    step = 2 * _DIGEST
    return [(int(p[0]), [p[i : i + step] for i in range(1, len(p), step)]) for p in text.split(";")[:-1]]


def packed(nodes: list[str]) -> bytes:
    return bytes.fromhex("".join(nodes))


def unpacked(raw: bytes) -> list[str]:
    text = raw.hex()
    return [text[i : i + 2 * _DIGEST] for i in range(0, len(text), 2 * _DIGEST)]


# ---------------------------------------------------------------- the trees of a table

def leaf_hash(columns: dict[str, Column]) -> Column:
    """sha256 of the fields, each as '-' or its length in bytes, ':' and its value."""
    parts = []
    for value in columns.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` (from 0) in the order of its tree and ``leaves``, their number.

    One range-partitioned sort, written once; equal rows are spread by a number of their own.
    A row's place is its position in its partition
    plus what the partitions before hold of its tree: a table of at most (partitions + trees)
    rows, so a tree with most of the rows is spread like any other."""
    numbered = rows.withColumn("tie", F.monotonically_increasing_id())
    spread = numbered.repartitionByRange(tree, *order, "tie").sortWithinPartitions(tree, *order, "tie").drop("tie")
    placed = stored(spread.withColumn("at", F.monotonically_increasing_id()), "merkle-rows")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    runs = placed.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held"))
    before = Window.partitionBy(tree).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col(tree).alias("run_tree"), F.col("part").alias("run_part"), "first",
        F.coalesce(F.sum("held").over(before), F.lit(0)).alias("skipped"),
        F.sum("held").over(Window.partitionBy(tree)).alias("leaves"),
    )
    joined = placed.join(runs, (F.col(tree) == F.col("run_tree")) & (F.col("part") == F.col("run_part")))
    return joined.withColumn("place", F.col("at") - F.col("first") + F.col("skipped")).drop(
        "at", "part", "run_tree", "run_part", "first", "skipped")


_BLOCK = "tree string, block long, leaves long, height int, nodes binary, root string, members array<struct<{members}>>"


def blocks_of(nodes: DataFrame, members: dict[str, str]) -> DataFrame:
    """One row per block out of rows (tree, place, leaves, digest, members...): its nodes in
    van Emde Boas order and its members in the order of its leaves."""
    span = FAN**HEIGHT
    held = nodes.groupBy("tree", F.floor(F.col("place") / span).alias("block"), "leaves").agg(
        F.sort_array(F.collect_list(F.struct("place", "digest", *members))).alias("held"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            trees, numbers, counts, lists = (batch.column(i).to_pylist() for i in range(4))
            for i, rows in enumerate(lists):
                # A block below others reaches up to its full height, the last one in a row included.
                height = min(HEIGHT, height_of(counts[i]))
                nodes = build([r["digest"] for r in rows], height)
                inner = [[{m: r[m] for m in members} for r in rows]]
                kind = pa.list_(pa.struct([(m, pa.string() if t == "string" else pa.int64()) for m, t in members.items()]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([trees[i]]), pa.array([numbers[i]], pa.int64()), pa.array([counts[i]], pa.int64()),
                        pa.array([height], pa.int32()), pa.array([packed(nodes)]), pa.array([nodes[0]]),
                        pa.array(inner, kind),
                    ],
                    names=["tree", "block", "leaves", "height", "nodes", "root", "members"],
                )

    schema = _BLOCK.format(members=", ".join(f"{m}: {t}" for m, t in members.items()))
    return stored(held.mapInArrow(run, schema), "merkle-blocks")


def forest(leaves: DataFrame, members: dict[str, str]) -> tuple[list[DataFrame], DataFrame]:
    """(blocks per round, roots (tree, digest)) of ranked rows (tree, place, leaves, digest,
    members...). A round has one block per 3**HEIGHT nodes of a tree; a tree leaves the rounds
    when its last block is built."""
    rounds = [blocks_of(leaves, members)]
    roots = []
    span = FAN**HEIGHT
    while True:
        last = rounds[-1]
        roots.append(last.where(F.col("leaves") <= span).select("tree", F.col("root").alias("digest")))
        higher = last.where(F.col("leaves") > span)
        if not higher.limit(1).take(1):
            break
        next_nodes = higher.select(
            "tree", F.col("block").alias("place"), F.ceil(F.col("leaves") / span).cast("long").alias("leaves"),
            F.col("root").alias("digest"), F.lit("").alias("nothing"))
        rounds.append(blocks_of(next_nodes, {"nothing": "string"}))
    return rounds, reduce(lambda a, b: a.unionByName(b), roots)


_PATHS = "tree string, block long, path string"


def paths_down(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The path from the root of every lowest block up to the root of all: (tree, block, path).

    ``above`` has (tree, path) for the root of each tree."""
    known = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for blocks in reversed(rounds[1:]):
        # Entries of trees that have no block in this round go through as they are.
        known = _with_path(blocks, known, "right").mapInArrow(_leaf_paths, _PATHS)
    return known


def _with_path(blocks: DataFrame, paths: DataFrame, how: str = "inner") -> DataFrame:
    side = paths.select(F.col("tree").alias("path_tree"), F.col("block").alias("path_block"), "path")
    return blocks.join(side, (F.col("tree") == F.col("path_tree")) & (F.col("block") == F.col("path_block")), how)


def _leaf_paths(batches):
    """Per leaf of an inner block: its path in the block followed by the path above."""
    import pyarrow as pa

    wanted = ["path_tree", "path_block", "height", "nodes", "members", "path"]
    for batch in batches:
        for row in batch.select(wanted).to_pylist():
            count, first, paths = 1, row["path_block"], [row["path"]]
            if row["nodes"] is not None:
                nodes, count = unpacked(row["nodes"]), len(row["members"])
                places = [p.tolist() for p in layout(count, row["height"])]
                paths = [said(siblings(nodes, places, i)) + row["path"] for i in range(count)]
                first *= FAN**HEIGHT
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["path_tree"]] * count), pa.array(range(first, first + count), pa.int64()),
                    pa.array(paths),
                ],
                names=["tree", "block", "path"],
            )


_RESULT = (
    "tree string, doc_id long, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def _verdicts(batches):
    """Per document of a lowest block: the hash of its siblings and the root it folds to."""
    import pyarrow as pa

    names = [f.split()[0] for f in _RESULT.split(", ")]
    for batch in batches:
        for row in batch.to_pylist():
            nodes, members, above = unpacked(row["nodes"]), row["members"], heard(row["path"])
            places = [p.tolist() for p in layout(len(members), row["height"])]
            tail = [s for _, others in above for s in others]
            proofs, folded = [], []
            for i, member in enumerate(members):
                path = siblings(nodes, places, i)
                proofs.append(digest([s for _, others in path for s in others] + tail))
                folded.append(fold(member["seen_leaf"], path + above))
            count = len(members)
            columns = [
                pa.array([row["tree"]] * count, pa.string()), pa.array([m["doc_id"] for m in members], pa.int64()),
                pa.array([m["leaf"] for m in members], pa.string()), pa.array([row["subroot"]] * count, pa.string()),
                pa.array([row["top"]] * count, pa.string()), pa.array(proofs, pa.string()),
                pa.array(folded, pa.string()), pa.array([f == row["top"] for f in folded], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)


def manifest(docs: DataFrame, seen: Column | None = None) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(rows with proofs, blocks of the sources by round, blocks of the tree over the sources).

    ``seen`` is the text that is checked against the manifest; its own text by default."""
    columns = {c: F.col(c) for c in FIELDS}
    checked = columns | {"text": F.col("text") if seen is None else seen}
    # null first, then by the bytes of the name
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    leaves = docs.select(
        tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(columns).alias("leaf"),
        leaf_hash(checked).alias("seen_leaf"))
    leaves = ranked(leaves, "tree", ["doc_id", "leaf"]).withColumn("digest", F.col("leaf"))
    rounds, subroots = forest(leaves, {"doc_id": "long", "leaf": "string", "seen_leaf": "string"})
    subroots = stored(subroots, "merkle-subroots")

    ordered = ranked(subroots.select(F.lit("").alias("tree"), "digest", F.col("tree").alias("name")), "tree", ["name"])
    top_rounds, top_root = forest(ordered, {"name": "string"})
    found = top_root.select("digest").first()
    top = F.lit(found and found["digest"]).cast("string").alias("top")
    above = paths_down(top_rounds, top_root.select("tree", F.lit("").alias("path")))
    per_source = _with_path(top_rounds[0], above).mapInArrow(_leaf_paths_of_members, "tree string, path string")
    per_block = paths_down(rounds, per_source)
    side = subroots.select(F.col("tree").alias("root_tree"), F.col("digest").alias("subroot"))
    known = _with_path(rounds[0], per_block).join(side, F.col("tree") == F.col("root_tree"))
    rows = known.select("tree", "height", "nodes", "members", "path", "subroot", top).mapInArrow(_verdicts, _RESULT)
    return rows, rounds, top_rounds


def _leaf_paths_of_members(batches):
    """(name, path) of the members of the lowest blocks of the tree over the sources."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.select(["height", "nodes", "members", "path"]).to_pylist():
            nodes, members = unpacked(row["nodes"]), row["members"]
            places = [p.tolist() for p in layout(len(members), row["height"])]
            paths = [said(siblings(nodes, places, i)) + row["path"] for i in range(len(members))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([m["name"] for m in members]), pa.array(paths)], names=["tree", "path"])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    rows, _, _ = manifest(docs, F.when(tampered, F.replace("text", F.lit("\n"))).otherwise(F.col("text")))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE parts AS (
  SELECT doc_id, source, text,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-')
         || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-')
         || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         encode(doc_id::VARCHAR) AS digits
  FROM documents),
-- one bit of the message a step: crc32 of the decimal id
sums AS (
  SELECT *, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(8 * octet_length(digits)), lambda k: k::BIGINT)),
    lambda c, k: (CASE WHEN xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))
                                   ELSE 0 END) & 1 = 1
                  THEN xor(xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))
                                  ELSE 0 END) >> 1, 3988292384::BIGINT)
                  ELSE xor(c, CASE WHEN k % 8 = 0 THEN ascii(substr(doc_id::VARCHAR, (k // 8 + 1)::INT, 1))
                              ELSE 0 END) >> 1 END)) AS c
  FROM parts),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(c, 4294967295::BIGINT) % 2 = 0
              THEN sha256(head || coalesce(octet_length(encode(replace(text, chr(10), ''))) || ':'
                                           || replace(text, chr(10), ''), '-'))
              ELSE sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) END AS seen
  FROM sums),
ranked AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n,
         row_number() OVER () AS rid
  FROM leaves),
nodes AS (
  SELECT tree, 0 AS lvl, i, leaf AS d, n FROM ranked
  UNION ALL
  SELECT tree, lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM nodes WHERE n > 1 GROUP BY tree, lvl, i // 3),
subroots AS (
  SELECT tree, d, lvl, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS lvl, i, d, n FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3
  FROM tops WHERE n > 1 GROUP BY lvl, i // 3),
runs AS (
  SELECT tree, lvl, i // 3 AS run, list(d ORDER BY i) AS ds FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  -- the tree over the sources goes on above every subroot
  SELECT s.tree, s.lvl + t.lvl, t.i // 3, list(t.d ORDER BY t.i)
  FROM subroots s JOIN tops t ON t.n > 1 AND t.i // 3 = (s.i // (3 ** (t.lvl + 1))::BIGINT)
  GROUP BY s.tree, s.lvl, t.lvl, t.i // 3),
way AS (
  SELECT r.rid, r.tree, 0 AS lvl, r.i, s.lvl AS h, s.i AS place, '' AS proof, r.seen AS d
  FROM ranked r JOIN subroots s USING (tree)
  UNION ALL
  SELECT rid, tree, lvl + 1, j // 3, h, place, proof || array_to_string(list_concat(ds[1 : j % 3], ds[j % 3 + 2 :]), ''),
         sha256(array_to_string(list_concat(list_append(ds[1 : j % 3], d), ds[j % 3 + 2 :]), ''))
  FROM (SELECT w.*, r.ds, CASE WHEN w.lvl = w.h THEN w.place ELSE w.i END AS j
        FROM way w JOIN runs r ON r.tree = w.tree AND r.lvl = w.lvl
                              AND r.run = CASE WHEN w.lvl = w.h THEN w.place ELSE w.i END // 3)),
done AS (SELECT rid, proof, d FROM way QUALIFY row_number() OVER (PARTITION BY rid ORDER BY lvl DESC) = 1),
root AS (SELECT d AS root FROM tops WHERE n = 1)
SELECT r.doc_id, r.leaf, s.d AS subroot, root.root, sha256(w.proof) AS proof_sha256, w.d AS folded_root,
       w.d = root.root AS verified
FROM ranked r JOIN subroots s USING (tree) JOIN done w USING (rid), root
"""
