"""Training order on disk: a keyed Feistel permutation gives every sequence a place among all; ranges of places become files of fixed stride.

1. A task's documents (each with its end) are one stream, cut into sequences of `length` ids; its last sequence is padded with the end.
   A sequence's number is its task's number and its place in the task: known at once, so everything is tokenised once.
2. The permutation works on all numbers that tasks can give (TASKS * 2 ** 36), on the least even number of bits that holds them; values beyond walk on
   along their cycle. Its values are spread evenly, so equal ranges of them make files of about equal length.
3. A range's sequences, sorted by value, are written side by side: `length` ids each of 2 bytes (4 if ids don't fit) and nothing else. With the files'
   counts added up, every sequence has a global slot from 0 to N - 1 in the order of its value; slot s is at (s - first slot of its file) * stride.
   The manifest in the folder has the first slots, so a reader can begin at any slot and resume after any.

Files are written under another name and renamed: a task that runs again writes the same bytes. As in any shuffle of rows numbered by task, the input must
deal the same rows in the same order when a task runs again, as scans of files do.
Null and empty texts are one token, the end. Ids are not needed, repeated rows are written each. An empty table gives an empty manifest and no rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, shared_dir, slices, stored, table
from folioscope.llm.shingles import mixed
from folioscope.llm.tokens import END, default_path, document_ids

ROUNDS = 6
#: Tasks that can give numbers, and sequences of each.
TASKS = 1_000_000
TASK_SEQUENCES = 1 << 36
#: Text bytes that a task holds at a time.
SLICE = 8 << 20
#: Input bytes (as Spark estimates them) for a file, at least, and files at most: 100 MB of input each at 100 TB, and a manifest that one task can add up.
FILE_BYTES = 5 << 20
MOST_FILES = 1_000_000


@dataclass(frozen=True)
class Order:
    """A permutation of range(n)."""

    n: int
    key: int = 1

    def slots(self, x: np.ndarray) -> np.ndarray:
        """Slots of sequence numbers."""
        return self._walk(x, range(ROUNDS))

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        """The inverse: sequence numbers at slots."""
        return self._walk(slots, reversed(range(ROUNDS)))

    def _walk(self, x: np.ndarray, rounds) -> np.ndarray:
        rounds = list(rounds)
        x = np.asarray(x).astype(np.uint64)
        out = self._once(x, rounds)
        far = np.flatnonzero(out >= self.n)
        while len(far):
            out[far] = self._once(out[far], rounds)
            far = far[out[far] >= self.n]
        return out.astype(np.int64)

    def _once(self, x: np.ndarray, rounds: list[int]) -> np.ndarray:
        half = np.uint64(max(1, (max(self.n - 1, 1).bit_length() + 1) // 2))
        mask = (np.uint64(1) << half) - np.uint64(1)
        left, right = x >> half, x & mask
        with np.errstate(over="ignore"):
            for r in rounds:
                secret = mixed(np.array([(self.key * ROUNDS + r) & (2**64 - 1)], np.uint64))
                if rounds[0] == 0:
                    left, right = right, left ^ (mixed(right ^ secret) & mask)
                else:
                    left, right = right ^ (mixed(left ^ secret) & mask), left
        return (left << half) | right


def _file(folder: str, k: int) -> str:
    return f"{folder.rstrip('/')}/part-{k:08d}.ids"


def _sequences(batches: Iterator[pa.RecordBatch], path: str, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """The task's sequences (rows of length ids) in runs, with the valid ids of the last row."""
    rest: list[np.ndarray] = []
    for b in slices(batches, most=SLICE):
        ids = np.concatenate([*rest, *(document_ids(x, path) for x in b.column("text").to_pylist())])
        n = len(ids) // length
        rest = [ids[n * length :]]
        if n:
            yield ids[: n * length].reshape(n, length), length
    if rest and len(rest[0]):
        row = np.full((1, length), END, np.uint32)
        row[0, : len(rest[0])] = rest[0]
        yield row, len(rest[0])


def write_order(df: DataFrame, folder: str, path: str, length: int = 1024, n_files: int | None = None, key: int = 1, bytes_each: int = 2, text_col: str = "text") -> DataFrame:
    """Writes the files and the manifest; returns a row for each sequence, as read back: slot, number, file, offset (bytes), n_valid, ids_crc32.
    n_files: about FILE_BYTES of Spark's estimate of the input for each, if not given."""
    spark = df.sparkSession
    arrow_limits(spark, 2000)
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    if n_files is None:
        n_files = min(MOST_FILES, max(1, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // FILE_BYTES))
    order = Order(TASKS * TASK_SEQUENCES, key)
    per_file = -(-order.n // n_files)
    kind = "<u2" if bytes_each == 2 else "<u4"
    stride = length * bytes_each

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        if task >= TASKS:
            raise ValueError(f"more than {TASKS} tasks: their numbers would clash; read with larger partitions")
        at, pack = task * TASK_SEQUENCES, zstandard.ZstdCompressor(level=3)
        for rows, valid in _sequences(batches, path, length):
            if bytes_each == 2 and rows.max() > 0xFFFF:
                raise ValueError("ids don't fit in 2 bytes")
            numbers = np.arange(at, at + len(rows))
            at += len(rows)
            places = order.slots(numbers)
            by = np.argsort(places)
            valids = np.full(len(rows), length, np.int32)
            valids[-1] = valid
            files = places[by] // per_file
            cuts = np.flatnonzero(np.concatenate([[True], files[1:] != files[:-1], [True]]))
            runs = [by[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            parts = [[pack.compress(rows[r].astype(kind).tobytes()) for r in runs], *([x[r].tobytes() for r in runs] for x in (places, numbers, valids))]
            yield pa.RecordBatch.from_arrays([pa.array(files[cuts[:-1]], pa.int64()), *(pa.array(x, pa.binary()) for x in parts)], ["file", "bodies", "places", "numbers", "valids"])

    def write(part: pa.Table) -> pa.Table:
        k = part.column("file")[0].as_py()
        places, numbers = (np.concatenate([np.frombuffer(x, np.int64) for x in part.column(c).to_pylist()]) for c in ("places", "numbers"))
        valids = np.concatenate([np.frombuffer(x, np.int32) for x in part.column("valids").to_pylist()])
        unpack = zstandard.ZstdDecompressor()
        bodies = np.concatenate([np.frombuffer(unpack.decompress(x.as_buffer()), np.uint8).reshape(-1, stride) for x in part.column("bodies")])
        by = np.argsort(places)
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        name = f"{_file(base, k)}.{TaskContext.get().taskAttemptId()}"
        with system.open_output_stream(name) as f:
            for i in range(0, len(by), 256):
                f.write(bodies[by[i : i + 256]].tobytes())
        system.move(name, _file(base, k))
        with system.open_input_stream(_file(base, k)) as f:
            crcs = [zlib.crc32(f.read(stride)) for _ in by]
        n = len(by)
        return pa.table({"file": pa.array([k] * n, pa.int64()), "place": pa.array(range(n), pa.int64()), "number": pa.array(numbers[by], pa.int64()), "n_valid": pa.array(valids[by], pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    dealt = texts.mapInArrow(deal, "file long, bodies binary, places binary, numbers binary, valids binary")
    rows = stored(spark, dealt.groupBy("file").applyInArrow(write, "file long, place long, number long, n_valid long, ids_crc32 long"), "training-order-rows")
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    manifest = rows.groupBy("file").agg(F.count("*").alias("n")).withColumn("first_slot", F.coalesce(F.sum("n").over(before), F.lit(0)))
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    starts = spark.read.schema("file long, n long, first_slot long").parquet(f"{folder}/manifest")
    return rows.join(starts, "file").select((F.col("first_slot") + F.col("place")).alias("slot"), "number", "file", (F.col("place") * stride).alias("offset"), "n_valid", "ids_crc32")


def read_order(folder: str, start: int, length: int = 1024, bytes_each: int = 2) -> Iterator[np.ndarray]:
    """Sequences from slot `start` on, file after file."""
    import pyarrow.dataset as ds

    system, base = fs.FileSystem.from_uri(folder)
    files = sorted((r["first_slot"], r["file"], r["n"]) for r in ds.dataset(f"{base}/manifest", filesystem=system, format="parquet", exclude_invalid_files=True).to_table().to_pylist())
    for first, k, n in files:
        if first + n <= start:
            continue
        with system.open_input_file(_file(base, k)) as f:
            f.seek(max(0, start - first) * length * bytes_each)
            while body := f.read(length * bytes_each):
                yield np.frombuffer(body, "<u2" if bytes_each == 2 else "<u4")


def op7_training_order(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 1024 ids, in training order in files in the shared folder."""
    return write_order(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/training-order-{uuid.uuid4().hex}", default_path())
