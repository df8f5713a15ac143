"""Merkle manifest of a dataset: a tree of sha256 digests for each group, a tree over the groups, and for every row the siblings that prove it.

1. A row's leaf is the hash of its columns, each `-` where null, else its UTF-8 byte count, `:` and its value. Only leaves go on, not texts.
2. One distributed sort gives each leaf its place in its group. Aligned blocks of FANOUT ** DEPTH leaves are whole subtrees: their leaves stand in one contiguous matrix of
   64-byte hex digests, which is reshaped by the fanout and hashed a level at a time.
3. The blocks' tops are the leaves of the next round, until each group has one node. The groups' nodes, in the order of their names, make a tree in the same way.
4. Siblings are found by index arithmetic (node i of a level stands in run i // 3 at place i % 3) and handed down from the root, a block at a time.

While more than one node remains in a group, every run of three (the last may have fewer, even one) becomes its hash; a lone leaf is its group's node itself.
Leaves of a group ascend by id, null ids first; equal ids by leaf. Repeated rows are leaves of their own. A null group is one, before all others. Extra columns go into
no leaf. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, stored, table
from folioscope.operators.longform import cut

FANOUT = 3
#: Levels of a block: 729 leaves, 47 kB of digests.
DEPTH = 6


def leaf(values: list[Column]) -> Column:
    """The hash of a row's values."""

    def part(c: Column) -> Column:
        x = c.cast("string")
        return F.when(x.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x))

    return F.sha2(F.concat(*(part(c) for c in values)).cast("binary"), 256)


def parents(level: np.ndarray) -> np.ndarray:
    """The next level of a matrix of hex digests."""
    whole = len(level) // FANOUT * FANOUT
    rows = [r.tobytes() for r in level[:whole].reshape(-1, FANOUT * 64)]
    if whole < len(level):
        rows.append(level[whole:].tobytes())
    out = "".join(hashlib.sha256(r).hexdigest() for r in rows)
    return np.frombuffer(out.encode(), np.uint8).reshape(-1, 64)


def height(n: int) -> int:
    """Levels from n leaves to one node."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def levels(digests: list[str], n: int, depth: int) -> list[np.ndarray]:
    """All levels of a block, its leaves first, of a tree of n leaves."""
    out = [np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)]
    for _ in range(min(depth, height(n))):
        out.append(parents(out[-1]))
    return out


def siblings(tree: list[np.ndarray]) -> list[list[str]]:
    """For each leaf, at each level: what stands left and right of it in its run, in turn."""
    runs = [[level[i : i + FANOUT].tobytes().decode() for i in range(0, len(level), FANOUT)] for level in tree[:-1]]
    out = []
    for i in range(len(tree[0])):
        path = []
        for run in runs:
            r, at = run[i // FANOUT], 64 * (i % FANOUT)
            path += [r[:at], r[at + 64 :]]
            i //= FANOUT
        out.append(path)
    return out


def folded(digest: str, path: list[str]) -> str:
    """The root that a leaf and its siblings lead to."""
    for left, right in zip(path[::2], path[1::2], strict=True):
        digest = hashlib.sha256((left + digest + right).encode()).hexdigest()
    return digest


def _placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df (with `key`) and pos, a row's place in its key's order from 0, and n, how many there are. A key's rows are sorted by many tasks; identical rows take any order."""
    made = cut(df.withColumn("_salt", F.monotonically_increasing_id()).orderBy("key", *order, "_salt").withColumn("_at", F.monotonically_increasing_id()))
    made = made.withColumn("_part", F.shiftright("_at", 33))
    parts = made.groupBy("key", "_part").agg(F.count("*").alias("_k"), F.min("_at").alias("_first"))
    own = Window.partitionBy("key")
    before = F.coalesce(F.sum("_k").over(own.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each key and task of the sort
    parts = parts.select("key", "_part", (before - F.col("_first")).alias("_shift"), F.sum("_k").over(own).alias("n"))
    return made.join(parts, ["key", "_part"]).withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift", "_salt")


def _blocks(df: DataFrame, name: str, more: list[str], depth: int) -> DataFrame:
    """(key, block, n, nodes, top): the nodes of each block (pos, digest and more) in order, and the node they lead to."""
    node = F.struct("pos", "digest", *more)
    rows = df.groupBy("key", F.expr(f"pos div {FANOUT**depth}").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("nodes"))
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, offsets = b.column("nodes").flatten().field("digest").to_pylist(), np.asarray(b.column("nodes").offsets)
            offsets = offsets - offsets[0]
            sizes = b.column("n").to_pylist()
            tops = [levels(digests[x:y], n, depth)[-1].tobytes().decode() for x, y, n in zip(offsets[:-1], offsets[1:], sizes, strict=True)]
            yield b.append_column("top", pa.array(tops, pa.string()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return stored(df.sparkSession, rows.mapInArrow(run, f"{fields}, top string"), name)


def _above(blocks: DataFrame, depth: int) -> DataFrame:
    """(key, block, top, path): for each block, its key's node and the siblings on the way there."""
    nodes = blocks.select("key", F.col("block").alias("pos"), F.expr(f"(n + {FANOUT**depth - 1}) div {FANOUT**depth}").alias("n"), F.col("top").alias("digest"))
    if (blocks.agg(F.max("n")).first()[0] or 0) <= FANOUT**depth:
        return nodes.select("key", F.col("pos").alias("block"), F.col("digest").alias("top"), F.array().cast("array<string>").alias("path"))
    return _paths(_blocks(nodes, "merkle-upper", [], depth), depth).withColumnRenamed("pos", "block")


def _paths(blocks: DataFrame, depth: int) -> DataFrame:
    """(key, pos, top, path) of every node of the blocks."""
    rows = blocks.select("key", "block", "n", "nodes").join(_above(blocks, depth), ["key", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                paths = [x + r["path"] for x in siblings(levels([x["digest"] for x in r["nodes"]], r["n"], depth))]
                columns = [pa.array([r["key"]] * len(paths), pa.string()), pa.array([x["pos"] for x in r["nodes"]], pa.int64()), pa.array([r["top"]] * len(paths), pa.string()), pa.array(paths, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "pos", "top", "path"])

    return rows.mapInArrow(run, "key string, pos long, top string, path array<string>")


def proofs(df: DataFrame, id_col: str, group_col: str, columns: list[str], changed: dict[str, Column] | None = None, with_path: bool = False, depth: int = DEPTH) -> DataFrame:
    """For each row: id, leaf, subroot, root, proof_sha256 (of all siblings up to the root), folded_root, verified and (with_path) the siblings, left and right of each level in turn.
    changed: columns with other values, for which folded_root and verified stand; siblings and the other results stay those of df."""
    spark = df.sparkSession
    arrow_limits(spark)
    key = F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0"))  # a null group is the first
    values = [F.col(c) for c in columns]
    other = [(changed or {}).get(c, F.col(c)) for c in columns]
    leaves = df.select(key.alias("key"), F.col(id_col).alias("id"), leaf(values).alias("digest"), (leaf(other) if changed else F.lit(None).cast("string")).alias("changed"))
    blocks = _blocks(_placed(leaves, ["id", "digest"]), "merkle-leaves", ["changed", "id"], depth)
    above = stored(spark, _above(blocks, depth), "merkle-paths")
    tops = above.where("block = 0").select("key", F.col("top").alias("digest"))
    # the groups are the leaves of one more tree
    groups = _blocks(_placed(tops.select(F.lit("").alias("key"), F.col("key").alias("group"), "digest"), ["group"]), "merkle-groups", ["group"], depth)
    names = groups.select(F.explode("nodes").alias("x")).select("x.pos", F.col("x.group").alias("key"))
    roots = _paths(groups, depth).select("pos", F.col("top").alias("root"), F.col("path").alias("root_path")).join(names, "pos").drop("pos")
    upper = above.join(roots, "key").select("key", "block", F.col("top").alias("subroot"), "root", F.concat("path", "root_path").alias("path"))
    rows = blocks.select("key", "block", "n", "nodes").join(upper, ["key", "block"])
    kind = df.schema[id_col].dataType.simpleString()
    fields = ["leaf string", "subroot string", "root string", "proof_sha256 string", "folded_root string", "verified boolean", *(["path array<string>"] if with_path else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes = b.column("nodes")
            flat, offsets = nodes.flatten(), np.asarray(nodes.offsets) - nodes.offsets[0].as_py()
            digests, altered = flat.field("digest").to_pylist(), flat.field("changed").to_pylist()
            for j, (x, y) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                root, top, n, rest = (b.column(c)[j].as_py() for c in ("root", "subroot", "n", "path"))
                paths = [p + rest for p in siblings(levels(digests[x:y], n, depth))]
                proof = [hashlib.sha256("".join(p).encode()).hexdigest() for p in paths]
                back = [folded(a or d, p) for d, a, p in zip(digests[x:y], altered[x:y], paths, strict=True)]
                made = [digests[x:y], [top] * (y - x), [root] * (y - x), proof, back]
                out = [flat.field("id").slice(x, y - x), *(pa.array(c, pa.string()) for c in made), pa.array([r == root for r in back], pa.bool_())]
                if with_path:
                    out.append(pa.array(paths, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(out, ["id", *(f.split()[0] for f in fields)])

    return rows.mapInArrow(run, f"id {kind}, {', '.join(fields)}").withColumnRenamed("id", id_col)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document, and what the proof says of texts without their line feeds where 2 divides crc32(doc_id)."""
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return proofs(docs, "doc_id", "source", ["doc_id", "source", "lang", "n_chars", "text"], {"text": tampered})


def _part(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"


def oracle() -> str:
    """DuckDB SQL for op11_merkle_manifest; null ids have no crc32 and stay as they are."""
    from folioscope.llm.importance import CRC_TABLE, crc32_sql

    same = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    other = " || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars", "replace(text, chr(10), '')"))
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT t FROM {CRC_TABLE}),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, sha256({same}) AS leaf, CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN sha256({other}) ELSE sha256({same}) END AS other FROM documents, crc),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
up AS (SELECT source, 0 AS lvl, pos, n, leaf AS h FROM p UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
sub AS MATERIALIZED (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos, n, h FROM sub UNION ALL SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 3, n),
runs AS MATERIALIZED (SELECT source, lvl, pos // 3 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM up WHERE n > 1 GROUP BY ALL),
topruns AS MATERIALIZED (SELECT lvl, pos // 3 AS run, string_agg(h, '' ORDER BY pos) AS hs FROM top WHERE n > 1 GROUP BY ALL),
f AS (SELECT r, source, 0 AS lvl, pos, n, other AS h, '' AS proof FROM p UNION ALL
  SELECT r, f.source, f.lvl + 1, pos // 3, (n + 2) // 3, sha256(substr(hs, 1, 64 * (pos % 3)) || h || substr(hs, 64 * (pos % 3) + 65)), proof || substr(hs, 1, 64 * (pos % 3)) || substr(hs, 64 * (pos % 3) + 65)
  FROM f JOIN runs ON f.source IS NOT DISTINCT FROM runs.source AND f.lvl = runs.lvl AND pos // 3 = run WHERE n > 1),
g AS (SELECT r, 0 AS lvl, sub.pos, sub.n, f.h, proof FROM f JOIN sub ON f.source IS NOT DISTINCT FROM sub.source WHERE f.n = 1 UNION ALL
  SELECT r, g.lvl + 1, pos // 3, (n + 2) // 3, sha256(substr(hs, 1, 64 * (pos % 3)) || h || substr(hs, 64 * (pos % 3) + 65)), proof || substr(hs, 1, 64 * (pos % 3)) || substr(hs, 64 * (pos % 3) + 65)
  FROM g JOIN topruns ON g.lvl = topruns.lvl AND pos // 3 = run WHERE n > 1)
SELECT p.doc_id, p.leaf, sub.h AS subroot, top.h AS root, sha256(g.proof) AS proof_sha256, g.h AS folded_root, g.h = top.h AS verified
FROM g JOIN p USING (r) JOIN sub ON p.source IS NOT DISTINCT FROM sub.source, top WHERE g.n = 1 AND top.n = 1
"""


ORACLE = oracle()
