"""Similarity classes of documents by the Jaccard index of their word shingles: a size-aware heavy-light join, exact.

1. Equal sets become one (by a 128-bit digest).
2. A set with more shingles of its own than its prefix is long can have no partner; shingles met once are found by a partitioned count over all documents
   (blobs of 32-bit remainders by hash range, with the places of their documents as steps; a clash of remainders only keeps a set for the later steps).
3. For the others all shingles are counted. A set's prefix are its rarest shingles: similar sets share one shingle of prefixes of length n - ceil(t n) + 1,
   and two of prefixes longer by one. Small sets enumerate the 2-subsets of the longer prefix; large sets go to the inverted lists of single shingles.
   The boundary is the size for which lists and subsets together have the fewest comparisons; sets just below it do both.
4. Short lists (subset buckets too) give candidate pairs, checked by a join. Long ones are cut into blocks by hash; each pair of blocks is a task
   that scans inverted lists over whole sets and returns a spanning forest of its links.
5. Components of the links by repeated minimum with pointer jumping.

Defined results: a null or empty text, or one without words, has no shingles and is linked with nothing (component_id is its own id). Fewer words than k: one
shingle, the whole sequence. Repeated rows: one row each, in one component. Null ids: component_id is null unless
an equal or linked document has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.llm.common import arrow_limits, slices, stored, table
from folioscope.llm.shingles import shingle_sets

#: Longer lists are scanned in blocks.
LIGHT = 64
#: Shingles of the sets in a block, about.
BLOCK_SHINGLES = 64_000
#: Text bytes whose remainders make one blob for each range: from SLICE on few ranges to MOST_SLICE on many.
SLICE = 4 << 20
MOST_SLICE = 16 << 20
#: Input bytes (as Spark estimates them) for each hash range of the count.
RANGE_BYTES = 8 << 20
#: Rows to drop are broadcast up to so many (of two numbers each), else joined by shuffle.
BROADCAST_ROWS = 500_000
#: The boundary is sought among powers of two up to this many 2-subsets of a set.
MOST_SUBSETS = 120


@dataclass(frozen=True)
class Similarity:
    """Shingles of k words; two sets link when den * intersection >= num * union."""

    k: int = 5
    num: int = 80
    den: int = 100

    def reach(self, n):
        """n - ceil(t n), a column: how many shingles of a set a similar one may lack."""
        return F.floor(n.cast("long") * (self.den - self.num) / self.den).cast("int")


def _squeezed(a: np.ndarray) -> bytes:
    """Numbers in as few bytes each as the largest needs, compressed where that can pay; the first byte tells which."""
    top = int(a.max()) if len(a) else 0
    item = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    body = a.astype(f"<u{item}").tobytes()
    return bytes([16 + item]) + zstandard.compress(body, 1) if len(body) > 64 else bytes([item]) + body


def _restored(b: bytes) -> np.ndarray:
    body = zstandard.decompress(b[1:]) if b[0] > 16 else b[1:]
    return np.frombuffer(body, f"<u{b[0] & 15}").astype(np.uint32)


def _cuts(ascending: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin, with the end last."""
    return np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1], [True]])) if len(ascending) else np.zeros(1, np.int64)


def slice_bytes(n_ranges: int) -> int:
    """Text bytes whose remainders make one blob for each range: about 1 KB of text a blob, between SLICE and MOST_SLICE."""
    return min(MOST_SLICE, max(SLICE, n_ranges << 10))


def scan_sets(df: DataFrame, sim: Similarity, n_ranges: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two sorts: one for each document (slice, place, id, key: the text's hash, n, digest) and one for each slice and hash range that it meets (slice, range,
    the remainders there and, as steps, the places of the documents that those met once in the slice, which come first, are of): a few bytes a shingle, however many ranges there are."""
    kind = df.schema[id_col].dataType.simpleString()
    names = ["slice", "place", "id", "key", "n", "digest", "range", "owners", "remainders"]
    id_type = to_arrow_type(df.schema[id_col].dataType)
    most = slice_bytes(n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        held: list[np.ndarray] = []

        def blobs() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            every = np.concatenate(held)
            owner = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in held])
            which = ((every >> np.uint64(32)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int32)
            rest = every.astype(np.uint32)
            # a remainder met twice in this slice is sent once, after the others and without places: a shingle of all documents costs a range a few bytes a slice
            code = which.astype(np.uint64) << np.uint64(32) | rest
            order = np.argsort(code)
            runs = _cuts(code[order])
            begins, size = runs[:-1], np.diff(runs)
            lone, again = np.sort(order[begins[size == 1]]), order[begins[size > 1]]
            lone = lone[np.argsort(which[lone], kind="stable")]  # by range, then document
            found = np.unique(which)
            a, b = (np.searchsorted(which[lone], found, side) for side in ("left", "right"))
            c, d = (np.searchsorted(which[again], found, side) for side in ("left", "right"))
            own, lone, again = owner[lone], rest[lone], rest[again]
            spans = list(zip(found.tolist(), a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True))
            for i in range(0, len(spans), 4096):
                some = spans[i : i + 4096]
                none = lambda t: pa.nulls(len(some), t)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + number] * len(some), pa.int64()), none(pa.int32()), none(id_type), none(pa.int64()), none(pa.int32()), none(pa.binary()), pa.array([r for r, *_ in some], pa.int32()),
                     pa.array([_squeezed(np.diff(own[a:b], prepend=np.uint32(0))) for _, a, b, _, _ in some], pa.binary()), pa.array([lone[a:b].tobytes() + again[c:d].tobytes() for _, a, b, c, d in some], pa.binary())],
                    names,
                )

        n_bytes = 0
        for b in slices(batches):
            sets = shingle_sets(b.column("text"), sim.k)
            m = len(sets)
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
            none = lambda t: pa.nulls(m, t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([pa.array([part + number] * m, pa.int64()), pa.array(range(len(held), len(held) + m), pa.int32()), b.column("id"), b.column("key"), pa.array([len(x) for x in sets], pa.int32()), pa.array(digests, pa.binary()), none(pa.int32()), none(pa.binary()), none(pa.binary())], names)
            held += sets
            n_bytes += b.column("text").nbytes
            if n_bytes >= most:
                yield from blobs()
                held, n_bytes, number = [], 0, number + 1
        yield from blobs()

    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("key", F.xxhash64("text"))
    return rows.mapInArrow(run, f"slice long, place int, id {kind}, key bigint, n int, digest binary, range int, owners binary, remainders binary")


def _once(part: pa.Table) -> pa.Table:
    """For one hash range: the documents, by slice, with remainders met once in all its blobs, and how many of them."""
    owners = [np.cumsum(_restored(x), dtype=np.uint32) for x in part.column("owners").to_pylist()]
    sent = [np.frombuffer(x, np.uint32) for x in part.column("remainders").to_pylist()]
    values = np.concatenate(sent)
    order = np.argsort(values)
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    single = np.zeros(len(values), bool)
    single[order] = ~(np.concatenate([[False], same]) | np.concatenate([same, [False]]))
    out, at = [], 0
    for name, own, here in zip(part.column("slice").to_pylist(), owners, sent, strict=True):
        places = own[single[at : at + len(own)]]  # ascending; those beyond were met twice in the slice
        at += len(here)
        cuts = _cuts(places)
        if len(places):
            out.append((name, _squeezed(np.diff(places[cuts[:-1]], prepend=np.uint32(0))), _squeezed(np.diff(cuts).astype(np.uint32))))
    return pa.table({"slice": pa.array([r[0] for r in out], pa.int64()), "places": pa.array([r[1] for r in out], pa.binary()), "counts": pa.array([r[2] for r in out], pa.binary())})


def _summed(part: pa.Table) -> pa.Table:
    """For one slice: each document's number of shingles met once, where there are any."""
    places = np.concatenate([np.cumsum(_restored(x), dtype=np.uint32) for x in part.column("places").to_pylist()])
    total = np.bincount(places, np.concatenate([_restored(x) for x in part.column("counts").to_pylist()])).astype(np.int64)
    some = np.flatnonzero(total)
    return pa.table({"slice": pa.array([part.column("slice")[0].as_py()] * len(some), pa.int64()), "place": pa.array(some, pa.int32()), "own": pa.array(total[some], pa.int64())})


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links a-b."""
    parent = list(range(n))
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = x, y
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def scan_lists(sets: list[np.ndarray], sim: Similarity) -> tuple[np.ndarray, np.ndarray]:
    """All links among the sets: each set adds up the inverted lists of its shingles."""
    n = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), n)
    order = np.argsort(every, kind="stable")
    ranked, lists = every[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    size = np.diff(np.concatenate([first, [len(ranked)]]))
    code = np.empty(len(every), np.int64)
    code[order] = np.repeat(np.arange(len(first)), size)
    start = np.cumsum(n) - n
    left, right = [], []
    for i in range(len(sets)):
        mine = code[start[i] : start[i] + n[i]]
        mine = mine[size[mine] > 1]
        if not len(mine):
            continue
        lens = size[mine]
        at = np.repeat(first[mine] - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
        shared = np.bincount(lists[at], minlength=len(sets))[i + 1 :]
        hit = np.flatnonzero(sim.den * shared >= sim.num * (n[i] + n[i + 1 :] - shared)) + i + 1
        left.append(np.full(len(hit), i))
        right.append(hit)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(left or none), np.concatenate(right or none)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(v, label) for every vertex of edges (a, b): label is the least vertex of its component. Each round is written to the shared folder."""
    spark = edges.sparkSession
    both = stored(spark, edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), f"{name}-edges")
    labels = stored(spark, both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), name)
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        low = labels.join(near, "v").select("v", "label", F.least("label", "m").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("label").alias("over"))
        new = stored(spark, low.join(jump, "low", "left").select("v", F.least("low", F.coalesce("over", "low")).alias("label"), (F.least("low", F.coalesce("over", "low")) < F.col("label")).alias("moved")), name)
        labels = new.select("v", "label")
        if new.where("moved").isEmpty():
            return labels


def _buckets(sets: DataFrame, sim: Similarity) -> DataFrame:
    """(bucket, digest, n): inverted lists of large sets and 2-subsets of small ones, at least two sets in each, with the bucket's count and shingles."""
    spark = sets.sparkSession
    tokens = stored(spark, sets.select("digest", "n", F.explode("shingles").alias("token")), "jaccard-tokens")
    counts = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    shared = tokens.join(counts, "token")
    # shingles of one set alone come first in a prefix; they take places, but no other set has them
    alone = shared.groupBy("digest").agg(F.count("*").alias("common"))
    ranked = shared.withColumn("rank", F.row_number().over(Window.partitionBy("digest").orderBy("df", "token"))).join(alone, "digest")
    length = sim.reach(F.col("n"))
    prefix = stored(spark, ranked.withColumn("rank", (F.col("rank") + F.col("n") - F.col("common")).cast("int")).where(F.col("rank") <= length + 2).select("digest", "n", "token", "df", "rank"), "jaccard-prefix")
    single = prefix.where(F.col("rank") <= length + 1)
    pairs = prefix.groupBy("digest", "n").agg(F.array_sort(F.collect_list("token")).alias("t"))
    few = F.size("t") * (F.size("t") - 1) / 2 <= MOST_SUBSETS
    subsets = pairs.where(few).select("digest", "n", F.explode(F.expr("flatten(transform(t, (x, i) -> transform(slice(t, i + 2, size(t)), y -> xxhash64(x, y))))")).alias("bucket"))
    lists = single.select("digest", "n", F.col("token").alias("bucket"))
    # comparisons by size class (powers of two) of the sets, were all sets of a class in lists, or in subsets
    size_class = F.floor(F.log2("n")).cast("int")

    def cost(rows: DataFrame, name: str) -> DataFrame:
        per = rows.groupBy("bucket", size_class.alias("c")).agg(F.count("*").alias("b"))
        return per.groupBy("c").agg(F.sum(F.col("b") * (F.col("b") + 1)).cast("double").alias(name))

    dear = pairs.where(~few).select(size_class.alias("c")).groupBy("c").agg(F.lit(math.inf).alias("no"))
    classes = {r["c"]: r for r in cost(lists, "lists").join(cost(subsets, "subsets"), "c", "full").join(dear, "c", "full").collect()}  # 32 rows at most
    boundary, best, sofar = 0, 0.0, 0.0
    for c in sorted(classes):
        r = classes[c]
        sofar += math.inf if r["no"] else (r["subsets"] or 0.0) - (r["lists"] or 0.0)
        if sofar < best:
            boundary, best = 2 ** (c + 1) - 1, sofar
    small = subsets.where(F.col("n") <= boundary).select(F.concat(F.lit("s"), F.col("bucket").cast("string")).alias("bucket"), "digest", "n")
    # a pair of a small and a large set meets in lists: sets down to the least size that is similar to the smallest large one
    reach = math.ceil((boundary + 1) * sim.num / sim.den)
    large = lists.where(F.col("n") >= reach).select(F.concat(F.lit("l"), F.col("bucket").cast("string")).alias("bucket"), "digest", "n")
    return small.union(large)


def link_sets(sets: DataFrame, sim: Similarity) -> DataFrame:
    """Links (a, b) between digests of distinct sets (digest, n, shingles): all links, or within long lists a forest that connects the same sets."""
    spark = sets.sparkSession
    rows = stored(spark, _buckets(sets, sim), "jaccard-buckets")
    stats = rows.groupBy("bucket").agg(F.count("*").alias("many"), F.sum("n").alias("shingles")).where("many > 1")
    known = stored(spark, rows.join(stats, "bucket"), "jaccard-lists")
    light = known.where(F.col("many") <= LIGHT)
    a = light.select("bucket", F.col("digest").alias("a"), F.col("n").alias("na"))
    b = light.select("bucket", F.col("digest").alias("b"), F.col("n").alias("nb"))
    near = (F.col("na") * sim.den >= F.col("nb") * sim.num) & (F.col("nb") * sim.den >= F.col("na") * sim.num)
    pairs = a.join(b, "bucket").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    left = sets.select(F.col("digest").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("digest").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    checked = pairs.join(left, "a").join(right, "b").where(sim.den * both >= sim.num * (F.size("x") + F.size("y") - both)).select("a", "b")

    heavy = known.where(F.col("many") > LIGHT).withColumn("blocks", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int"))
    mine = F.pmod(F.xxhash64("digest", "bucket"), F.col("blocks")).cast("int")
    dealt = heavy.select("bucket", "digest", mine.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    dealt = dealt.select("bucket", "digest", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"))

    def run(part: pa.Table) -> pa.Table:
        ids = part.column("digest").to_pylist()
        flat = [x.values.to_numpy(zero_copy_only=False) for x in part.column("shingles")]
        forest = _forest(*scan_lists(flat, sim), len(ids))
        return pa.table({"a": pa.array([ids[x] for x, _ in forest], pa.binary()), "b": pa.array([ids[y] for _, y in forest], pa.binary())})

    scanned = dealt.join(sets.select("digest", "shingles"), "digest").groupBy("bucket", "p", "q").applyInArrow(run, "a binary, b binary")
    return checked.union(scanned)


def classes(df: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key: xxhash64 of the text, n_shingles, digest, component, component_id) for every row: component names the class, component_id is the least id in it."""
    spark = df.sparkSession
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    n_ranges = min(max(64, estimate // RANGE_BYTES), (1 << 31) - 1)  # numbers of ranges are 32-bit; Spark may know no size
    scanned = stored(spark, scan_sets(df, sim, n_ranges, id_col, text_col), "jaccard-scan")
    docs = scanned.where("range IS NULL").select("slice", "place", "id", "key", "n", "digest")
    once = scanned.where("range IS NOT NULL").select("slice", "range", "owners", "remainders").groupBy("range").applyInArrow(_once, "slice long, places binary, counts binary")
    own = once.groupBy("slice").applyInArrow(_summed, "slice long, place int, own bigint")
    reach = sim.reach(F.col("n"))
    # one text stands for all that have its set
    full = docs.where("n > 0").join(own, ["slice", "place"], "left").where(F.coalesce("own", F.lit(0)) <= reach)
    wanted = stored(spark, full.groupBy("digest").agg(F.min("key").alias("key")).select("key"), "jaccard-wanted")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [x.view(np.int64) for x in shingle_sets(b.column("text"), sim.k)]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else b"" for x in sets]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["digest", "n", "shingles"])

    arrow_limits(spark)
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    chosen = texts.withColumn("key", F.xxhash64("text")).join(wanted, "key", "left_semi")
    made = chosen.select("text").mapInArrow(sets_of, "digest binary, n int, shingles array<bigint>").where("n > 0")
    sets = stored(spark, made.groupBy("digest").agg(F.any_value("n").alias("n"), F.any_value("shingles").alias("shingles")), "jaccard-sets")
    labels = components(link_sets(sets, sim), "jaccard-components")
    named = docs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.count("*").alias("many"))
    # documents alone in their class need no lookup
    groups = named.join(labels.withColumnRenamed("v", "digest"), "digest", "left").where("many > 1 OR label IS NOT NULL").withColumn("component", F.coalesce("label", "digest"))
    groups = stored(spark, groups.select("digest", "component", "least"), "jaccard-groups")
    least = groups.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = stored(spark, groups.join(least, "component").select("digest", "component", "component_id"), "jaccard-lookup")
    out = docs.join(lookup, "digest", "left")
    return out.select(F.col("id").alias(id_col), "key", F.col("n").cast("long").alias("n_shingles"), "digest", F.coalesce("component", "digest").alias("component"), F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(df: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with one row of each class: that of the least id, then of the least text hash. Rows without words all stay."""
    spark = df.sparkSession
    named = classes(df, sim, id_col, text_col).where("component IS NOT NULL").select(F.col(id_col).alias("_id"), F.col("key").alias("_key"), "component")
    rows = stored(spark, named.groupBy("component", "_id", "_key").agg(F.count("*").alias("_n")), "dedup-rows")
    first = rows.groupBy("component").agg(F.min(F.struct("_id", "_key")).alias("first"), F.sum("_n").alias("many"))
    first = stored(spark, first.where("many > 1").select("component", F.col("first._id").alias("_first_id"), F.col("first._key").alias("_first_key")), "dedup-first")
    judged = rows.join(first, "component")
    wins = F.col("_id").eqNullSafe(F.col("_first_id")) & (F.col("_key") == F.col("_first_key"))
    # rows to drop, and winners that stand in the table more than once
    gone = stored(spark, judged.where(~wins | (F.col("_n") > 1)).select("_id", "_key", wins.alias("_again")), "dedup-gone")
    few = F.broadcast if gone.count() <= BROADCAST_ROWS else (lambda x: x)
    # the input's columns go by place, so that none can clash with those made here
    places = [f"_{i}" for i in range(len(df.columns))]
    own, text = places[df.columns.index(id_col)], places[df.columns.index(text_col)]
    keyed = df.toDF(*places).withColumn("_text_key", F.xxhash64(F.col(text).cast("string")))
    same = lambda x: keyed[own].eqNullSafe(x["_id"]) & (keyed["_text_key"] == x["_key"])
    again = gone.where("_again")
    kept = keyed.join(few(gone), same(gone), "left_anti").select(*places)
    once = keyed.join(few(again), same(again), "left_semi").dropDuplicates([own, "_text_key"]).select(*places)
    return kept.union(once).toDF(*df.columns)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Each document's class under 3-word shingles and a Jaccard index of 0.9."""
    return classes(table(spark, sf_dir, "documents"), Similarity(3, 90, 100)).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS o FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN (SELECT doc_id, min(o) AS c FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
"""
