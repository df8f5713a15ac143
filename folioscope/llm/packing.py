"""Packing documents into sequences by patterns of few lengths, fitted to the histogram of lengths by non-negative least squares.

1. Tokenise; documents longer than a sequence are cut into full pieces, with the rest first.
2. Count the lengths (a histogram of at most `size` numbers is all that the driver gets).
3. Enumerate the patterns of one to three lengths that fill a sequence, fit their repeat counts, round them within what is there,
   and pack what remains by best fit, longest first.
4. The plan gives each length runs of places; a piece's number among the pieces of its length (a running count in its task plus the counts of the
   tasks before) finds its place.

Null and empty texts are one token, the end. Repeated rows are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, slices, stored, table
from folioscope.llm.tokens import default_path, document_ids

SIZE = 1024
#: Full sequences take numbers from here on; packed ones count from 0.
FULL_BASE = 1 << 62


def patterns(size: int) -> np.ndarray:
    """All ways to write size as a sum of one to three lengths, as rows (a >= b >= c, 0 where there are fewer)."""
    b, c = np.meshgrid(np.arange(size + 1), np.arange(size + 1), indexing="ij")
    a = size - b - c
    ok = (a >= b) & (b >= c)
    return np.stack([a[ok], b[ok], c[ok]], 1)


def fit_counts(hist: np.ndarray, rows: np.ndarray, steps: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 with the least weighted squares of (lengths used - histogram), by accelerated projected gradients.
    Longer lengths weigh more: short leftovers are packed easily."""
    size = len(hist) - 1
    weight = np.linspace(0.3, 1.0, size + 1)
    weight[0] = 0
    used = lambda x: np.bincount(rows.ravel(), np.repeat(x, 3), minlength=size + 1)
    # a bound of the largest eigenvalue of A'WA: largest row sum of the absolute Gram matrix, by one product with ones
    ones = used(np.ones(len(rows))) * weight
    bound = ones[rows].sum(1).max()
    # scaled columns make steps per pattern useful
    scale = 1 / np.maximum(ones[rows].sum(1), bound * 1e-6)
    x = np.zeros(len(rows))
    y, t = x, 1.0
    for _ in range(steps):
        g = ((used(y) - hist) * weight)[rows].sum(1)
        new = np.maximum(0, y - scale * g)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan(hist: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences): together they use each length as often as the histogram says. hist[i]: pieces of length i; its last index is the size."""
    left = hist.astype(np.int64).copy()
    size = len(hist) - 1
    out: list[tuple[tuple[int, ...], int]] = []
    if left.sum() == 0:
        return out
    rows = patterns(size)
    x = fit_counts(hist.astype(float), rows)
    for k in np.argsort(-x, kind="stable"):
        if x[k] < 0.5:
            break
        lengths = [v for v in rows[k].tolist() if v]
        need = {v: lengths.count(v) for v in lengths}
        n = min(int(x[k] + 0.5), *(int(left[v]) // m for v, m in need.items()), 1 << 62)
        if n:
            out.append((tuple(lengths), n))
            for v, m in need.items():
                left[v] -= m * n
    # best fit, longest first: groups of equal open sequences by their free room
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            free = next((r for r in range(length, size) if room[r]), None)
            if free is None:
                per = size // length
                whole, rest = divmod(n, per)
                for fill, m in ((per, whole), (rest, 1)):
                    if fill and m:
                        key = (length,) * fill
                        room[size - fill * length][key] = room[size - fill * length].get(key, 0) + m
                n = 0
                continue
            lengths, m = next(iter(room[free].items()))
            fill = min(free // length, n)
            take = min(m, n // fill)
            if take == m:
                del room[free][lengths]
            else:
                room[free][lengths] = m - take
            key = (*lengths, *(length,) * fill)
            room[free - fill * length][key] = room[free - fill * length].get(key, 0) + take
            n -= take * fill
    return out + [(k, m) for groups in room.values() for k, m in groups.items()]


def runs(packed: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """For every length, runs of pieces' numbers: key (length << 40 | first number), sequence of the first, offset. Sorted by key."""
    keys, sequences, offsets = [], [], []
    next_of: dict[int, int] = defaultdict(int)
    base = 0
    for lengths, n in packed:
        at = 0
        for v in lengths:
            keys.append((v << 40) + next_of[v])
            sequences.append(base)
            offsets.append(at)
            next_of[v] += n
            at += v
        base += n
    order = np.argsort(np.array(keys, np.int64)) if keys else np.zeros(0, np.int64)
    return tuple(np.array(x, np.int64)[order] for x in (keys, sequences, offsets))


def tokenised(df: DataFrame, path: str, size: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, crcs of pieces, part, first: length of the first piece if it isn't full, number: among such in its task, full: number of its first full piece)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        met, full = np.zeros(size + 1, np.int64), 0
        for b in slices(batches):
            rows = []
            for text in b.column("text").to_pylist():
                ids = document_ids(text, path)
                first = len(ids) % size
                starts = [0] * bool(first) + list(range(first, len(ids), size))
                rows.append((len(ids), [zlib.crc32(ids[s : (first if s == 0 and first else s + size)].tobytes()) for s in starts], first, int(met[first]), full))
                met[first] += 1
                full += len(ids) // size
            n = b.num_rows
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([part] * n, pa.int32()), *columns], ["id", "part", "n", "crcs", "first", "number", "full"])

    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, part int, n long, crcs array<bigint>, first int, number long, full long")


def pack(df: DataFrame, path: str, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    rows = stored(spark, tokenised(df, path, size, id_col, text_col), "packing-pieces")
    counts = stored(spark, rows.where("first > 0").groupBy("part", "first").agg(F.count("*").alias("n")), "packing-counts")
    hist = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("first").agg(F.sum("n").alias("n")).collect():  # size - 1 rows at most
        hist[r[0]] = r[1]
    keys, sequences, offsets = runs(plan(hist))
    before = Window.partitionBy("first").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    tasks = counts.select("part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, number = (np.asarray(b.column(x)).astype(np.int64) for x in ("first", "number"))
            n, full, part = (np.asarray(b.column(x)).astype(np.int64) for x in ("n", "full", "part"))
            crcs = b.column("crcs")
            pieces = np.diff(np.asarray(crcs.offsets))
            row = np.repeat(np.arange(len(n)), pieces)
            piece = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
            rest = (piece == 0) & (first[row] > 0)
            if len(keys):
                run = np.searchsorted(keys, (first << 40) + number, side="right") - 1
                own = sequences[run] + number - (keys[run] & ((1 << 40) - 1))
                at = np.where(rest, offsets[run][row], 0)
            else:
                own, at = np.zeros(len(n), np.int64), np.zeros(len(row), np.int64)
            nth = piece - (first[row] > 0)
            sequence = np.where(rest, own[row], FULL_BASE + (part[row] << 36) + full[row] + nth)
            start = np.where(rest, 0, first[row] + nth * size)
            length = np.where(rest, first[row], size)
            columns = [b.column("id").take(pa.array(row)), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length)), crcs.flatten(), *(pa.array(x, pa.int64()) for x in (sequence, at))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    found = rows.join(tasks, ["part", "first"], "left")
    found = found.select("id", "part", "n", "crcs", "first", (F.col("number") + F.coalesce("before", F.lit(0))).alias("number"), "full")
    out = found.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)


def op3_pattern_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1024 ids."""
    return pack(table(spark, sf_dir, "documents"), default_path())
