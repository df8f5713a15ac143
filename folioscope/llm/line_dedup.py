"""Line deduplication: two Bloom filters tell which lines may occur twice; only those are sent to be counted exactly, and each repeated one stays in one document.

1. Each task sends partial filters: the 64-bit hashes of its documents' line keys, by the filters' segment they belong to, those met in two documents marked.
   A segment's owner merges them into two bitmaps: a hash whose bits all stand in the once-seen filter when it comes sets them in the twice-seen filter.
   No repeat is missed; a line that shares its bits with others is a false suspect.
2. Lines in the twice-seen filter are suspects: digests of 128 bits go, with map-side combining, to be counted by document. False suspects end here.
3. Keys found in enough documents are dropped everywhere but in the largest id that holds them. Up to BROADCAST_KEYS of them are sent to all tasks, which then drop lines as
   they read the texts again; more are joined to the suspects of each text.

The filters take BITS_PER_BYTE bits for each byte of text, 128 MB each at most (MOST_SEGMENTS, 64 GB of text): beyond it they fill up, more lines are suspects
and are counted, and results stay the same.

A line's key is the line without white space (space, \\t to \\r) at both ends, A-Z in small letters. Documents are told apart by their id: rows of one id count as one document
and keep its lines in each of them. Null ids are one document together, below all others. Null and empty texts are one empty line. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, slices, stored, table

#: Bits of a segment of a filter; all bits of one hash are in one segment.
SEGMENT = 1 << 20
BITS_PER_BYTE = 1 / 64
MOST_SEGMENTS = 1024
#: Hashes that a task gathers before it sends a partial filter.
GATHERED = 1 << 18
#: Confirmed keys (24 bytes and an id each) that are sent to all tasks at most.
BROADCAST_KEYS = 1_000_000


@dataclass(frozen=True)
class Rule:
    """Keys of min_chars code points or more in min_docs documents or more are dropped but for one document."""

    min_chars: int = 40
    min_docs: int = 5


def keys(text: bytes | None, min_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """A text's lines, and the key of each that is long enough."""
    lines = (text or b"").split(b"\n")
    out: list[bytes | None] = []
    for line in lines:
        key = line.strip(b" \t\n\v\f\r").lower()
        n = len(key)
        out.append(key if n >= min_chars and (n >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars) else None)
    return lines, out


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def places(hashes: np.ndarray, n_segments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and two bits in it of each hash; n_segments is a power of two."""
    bits = n_segments.bit_length() - 1
    segment = (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
    low = np.uint64(SEGMENT - 1)
    return segment, (hashes & low).astype(np.int64), ((hashes >> np.uint64(20)) & low).astype(np.int64)


class Pair:
    """The once-seen and the twice-seen filter of one segment."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Hashes without repeats; those met in two documents already are in `again`, too."""
        _, a, b = places(hashes, 1)
        seen = self.once[a] & self.once[b]
        for where, which in ((a, seen), (b, seen)):
            self.twice[where[which]] = True
        _, c, d = places(again, 1)
        self.twice[c] = self.twice[d] = True
        self.once[a] = self.once[b] = True

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def segments_for(n_bytes: int) -> int:
    n = 1
    while n < MOST_SEGMENTS and n * SEGMENT < n_bytes * BITS_PER_BYTE:
        n *= 2
    return n


def _packed(x: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(x).tobytes(), 1)


def _unpacked(x: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(x), np.uint8)).astype(bool)


_PARTIAL = "segment int, salt int, hashes binary, again binary, once binary, twice binary"
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], [x.split()[0] for x in _PARTIAL.split(", ")])


def _partials(rows: DataFrame, n_segments: int, n_salts: int, min_chars: int) -> DataFrame:
    """Partial filters of every task as lists of hashes by segment."""

    def sent(parts: list[np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
        hashes, n = np.unique(np.concatenate(parts), return_counts=True)  # sorted, so a segment's are together
        segment = places(hashes, n_segments)[0]
        cuts = np.flatnonzero(np.diff(segment)) + 1
        for h, k in zip(np.split(hashes, cuts), np.split(n, cuts), strict=True):
            yield _batch([(int(places(h[:1], n_segments)[0][0]), task % n_salts, h.tobytes(), h[k > 1].tobytes(), None, None)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        parts, held = [], 0
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                found = {xxhash.xxh3_64_intdigest(k) for k in keys(text, min_chars)[1] if k is not None}
                parts.append(np.fromiter(found, np.uint64, len(found)))
                held += len(found)
                if held >= GATHERED:
                    yield from sent(parts, task)
                    parts, held = [], 0
        if held:
            yield from sent(parts, task)

    return rows.select("text").mapInArrow(run, _PARTIAL)


def _merged(partials: DataFrame, by: list[str]) -> DataFrame:
    """One row for each key: what its partial filters make together. An owner holds one segment at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pair = None, Pair()
        for b in batches:
            for r in b.to_pylist():
                key = (r["segment"], r["salt"] if "salt" in by else 0)
                if key != at:
                    if at is not None:
                        yield _batch([(*at, None, None, _packed(pair.once), _packed(pair.twice))])
                    at, pair = key, Pair()
                if r["hashes"] is not None:
                    pair.add(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["again"], np.uint64))
                else:
                    pair.merge(_unpacked(r["once"]), _unpacked(r["twice"]))
        if at is not None:
            yield _batch([(*at, None, None, _packed(pair.once), _packed(pair.twice))])

    return partials.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, _PARTIAL)


def twice_filter(df: DataFrame, text_col: str = "text", min_chars: int = Rule.min_chars, n_segments: int | None = None) -> np.ndarray:
    """The twice-seen filter of all line keys, packed, a row a segment: a hash that occurs in two documents is in it. At most 128 MB come to the driver."""
    rows = df.select(F.col(text_col).cast("binary").alias("text"))
    n_segments = n_segments or segments_for(rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)
    arrow_limits(df.sparkSession)
    salts = 1 + n_segments // 64  # of a large input, no owner takes a segment from all tasks
    parts = _partials(rows, n_segments, salts, min_chars)
    if salts > 1:
        parts = _merged(parts, ["segment", "salt"])
    out = np.zeros((n_segments, SEGMENT // 8), np.uint8)
    for r in stored(df.sparkSession, _merged(parts, ["segment"]).select("segment", "twice"), "line-filter").toLocalIterator():
        out[r["segment"]] = np.frombuffer(zlib.decompress(r["twice"]), np.uint8)
    return out


def suspected(found: list[bytes | None], packed: np.ndarray) -> list[int]:
    """Places of keys that the twice-seen filter has."""
    at = [i for i, k in enumerate(found) if k is not None]
    if not at:
        return at
    segment, a, b = places(np.fromiter((xxhash.xxh3_64_intdigest(found[i]) for i in at), np.uint64, len(at)), len(packed))
    hit = [(packed[segment, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 for x in (a, b)]
    return [i for i, x in zip(at, (hit[0] & hit[1]).tolist(), strict=True) if x]


def _suspects(rows: DataFrame, shared, min_chars: int) -> DataFrame:
    """(id, row, digests) of rows (id, row, text) with suspected lines, each once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text in b.column("text").to_pylist():
                found = keys(text, min_chars)[1]
                out.append(list({digest(found[i]) for i in suspected(found, shared.value)}))
            some = pa.array([bool(x) for x in out])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("row"), pa.array(out, pa.list_(pa.binary()))], ["id", "row", "digests"]).filter(some)

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, row string, digests array<binary>")


def repeated_keys(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(digest, n_docs, last) of keys in enough documents. Documents of a key are told apart before they are counted, so a very common line is spread over tasks."""
    each = suspects.select(F.explode("digests").alias("digest"), F.struct("id").alias("doc"))
    n = each.groupBy("digest").agg(F.count_distinct("doc").alias("n_docs"), F.max("doc").alias("last"))
    return n.where(F.col("n_docs") >= min_docs).select("digest", "n_docs", F.col("last.id").alias("last"))


_RESULT = ["n_lines long", "n_dropped long", "kept_sha256 string", "kept string"]
_RESULT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string()]


def _dropping(rows: DataFrame, gone_of, min_chars: int, with_text: bool) -> DataFrame:
    """Rows (id, text and, it may be, gone) without the lines whose digests gone_of(batch) gives for each row's keys."""
    fields = _RESULT if with_text else _RESULT[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            gone_for = gone_of(b)
            out = []
            for i, text in enumerate(b.column("text").to_pylist()):
                lines, found = keys(text, min_chars)
                drop = gone_for(i, found)
                kept = b"\n".join(x for j, x in enumerate(lines) if j not in drop) if drop else text or b""
                out.append((len(lines), len(drop), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace") if with_text else None)[: len(fields)])
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RESULT_TYPES, strict=False)]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", *(x.split()[0] for x in fields)])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, {', '.join(fields)}")


def drop_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule(), with_text: bool = True, n_segments: int | None = None) -> DataFrame:
    """One row for each row: id, n_lines, n_dropped, the sha256 of what is left of the text and (with_text) the text."""
    spark = df.sparkSession
    arrow_limits(spark)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast(twice_filter(df, text_col, rule.min_chars, n_segments))
    plain = rows.withColumn("row", F.lit(None).cast("string"))
    confirmed = stored(spark, repeated_keys(_suspects(plain.select("id", "row", "text"), shared, rule.min_chars), rule.min_docs), "line-keys")
    if confirmed.count() <= BROADCAST_KEYS:
        pairs = confirmed.select("digest", "last").orderBy("digest").toArrow()
        known = np.frombuffer(pairs["digest"].combine_chunks().cast(pa.binary(16)).buffers()[1] or b"", ">u8").reshape(-1, 2)[: len(pairs)]
        keep = spark.sparkContext.broadcast((known[:, 0].astype(np.uint64), known[:, 1].astype(np.uint64), pairs["last"].combine_chunks()))

        def gone_of(b: pa.RecordBatch):
            high, low, last = keep.value
            ids = b.column("id")

            def gone(i: int, found: list[bytes | None]) -> set[int]:
                drop = set()
                for j in suspected(found, shared.value):
                    x = digest(found[j])
                    a, c = int.from_bytes(x[:8], "big"), int.from_bytes(x[8:], "big")
                    k = int(np.searchsorted(high, np.uint64(a)))
                    while k < len(high) and high[k] == a:
                        if low[k] == c and last[k].as_py() != ids[i].as_py():
                            drop.add(j)
                        k += 1
                return drop

            return gone

        return _dropping(rows, gone_of, rule.min_chars, with_text).withColumnRenamed("id", id_col)

    # too many for every task: suspects meet the keys by a join, and each text what it loses
    by_text = rows.withColumn("row", F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("").cast("binary")))).cast("binary")))
    each = _suspects(by_text.select("id", "row", "text"), shared, rule.min_chars).select("id", "row", F.explode("digests").alias("digest"))
    lost = each.join(confirmed, "digest").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy("row").agg(F.collect_set("digest").alias("gone"))

    def gone_of_row(b: pa.RecordBatch):
        lists = b.column("gone")

        def gone(i: int, found: list[bytes | None]) -> set[int]:
            mine = set(lists[i].as_py() or [])
            return {j for j, k in enumerate(found) if k is not None and digest(k) in mine} if mine else set()

        return gone

    return _dropping(by_text.join(lost, "row", "left").select("id", "text", "gone"), gone_of_row, rule.min_chars, with_text).withColumnRenamed("id", id_col)


def op12_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Lines of every document, how many go as repeats, and the hash of what stays."""
    return drop_repeated(table(spark, sf_dir, "documents"), with_text=False)


ORACLE = r"""
WITH l AS (SELECT doc_id, r, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(trim(line, E' \t\n\x0B\f\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
rep AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT coalesce(doc_id::VARCHAR, 'null')) >= 5),
j AS (SELECT k.*, rep.key IS NOT NULL AND k.doc_id IS DISTINCT FROM rep.last AS gone FROM k LEFT JOIN rep USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id
"""
