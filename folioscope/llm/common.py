"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one step of a Python worker holds at a time (a single longer text is held alone).
SLICE_BYTES = 1 << 20
#: Rows in an Arrow batch between the JVM and a Python worker.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _base(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.gettempdir()}/folioscope-shared"
    return path.rstrip("/")


_scopes: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in what driver and executors share: spark.checkpoint.dir, or (tests on one machine only) a temporary one where it is unset."""
    return "/".join([_base(spark), f"folioscope-{spark.sparkContext.applicationId}", *_scopes[-1:]])


def _removed(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def clear(spark: SparkSession) -> None:
    """Deletes what the operators of this application have written to the shared folder: results must have been written elsewhere by then."""
    _removed(spark, shared_dir(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What operators write inside goes to a folder of its own, which is deleted at the end: for steps whose result is written elsewhere within."""
    _scopes.append(f"scratch-{uuid.uuid4().hex}")
    path = shared_dir(spark)
    try:
        yield
    finally:
        _scopes.pop()
        _removed(spark, path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside are deleted when each has ended: their results are in files of their own."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read again: cuts the lineage, survives the loss of any executor."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps Arrow batches small, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def trim() -> None:
    """Gives freed memory of a Python worker back to the machine: workers live on for later tasks."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `most` bytes of the column, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = [x or 0 for x in pc.binary_length(batch.column(column)).to_pylist()]
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)
    trim()


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(column: str, n: int, remainder: int) -> Column:
    """Whether a row is kept from training; a null id never is."""
    return F.coalesce(crc_mod(column, n) == remainder, F.lit(False))


def sample_ids(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most `most` ids, those with the least hash: a uniform sample that any partitioning gives alike."""
    return df.select(id_col).where(F.col(id_col).isNotNull()).distinct().orderBy(F.xxhash64(id_col), id_col).limit(most)


def whole_rows(df: DataFrame, order: list[str], size: str, most: int, by: str) -> DataFrame:
    """Rows of a training sample whose sizes sum up to `most` at most: the smallest of each class (`by`), then all that still fit, in the order given; one that doesn't fit is
    passed over, not the end. A class whose rows are all larger than what is left for it has none. The order's columns, size and class of each row come to the driver."""
    rows = df.select(*order, size, by).orderBy(*order).collect()
    first: dict = {}
    for i, r in enumerate(rows):
        if r[by] not in first or r[size] < rows[first[r[by]]][size]:
            first[r[by]] = i
    total, taken = 0, []
    lead = sorted(first.values())
    for i in [*lead, *sorted(set(range(len(rows))) - set(lead))]:
        if total + rows[i][size] <= most:
            total += rows[i][size]
            taken.append(tuple(rows[i][c] for c in order))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    return df.join(F.broadcast(df.sparkSession.createDataFrame(taken, kinds)), order, "left_semi")
