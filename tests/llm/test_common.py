import glob
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import common


def test_slices():
    texts = ["a" * n for n in (5, 5, 5, 100, 1, 1)] + [None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(texts)], ["id", "text"])
    parts = list(common.slices(iter([batch, batch.slice(0, 0)]), most=10))
    assert [p.column("id").to_pylist() for p in parts] == [[0, 1], [2], [3], [4, 5, 6, 7]]


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    for i, held, kept in df.select("doc_id", common.held_out("doc_id", 4, 2), common.crc_mod("doc_id", 4) != 2).collect():
        want = i is not None and zlib.crc32(str(i).encode()) % 4 == 2
        assert held == want and kept == (None if i is None else not want)


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    a, b = (sorted(r[0] for r in common.sample_ids(df.repartition(n), "doc_id", 50).collect()) for n in (1, 7))
    assert a == b and len(a) == 50


def test_stored(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = common.stored(spark, spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    assert df.count() == 7 and spark.conf.get(key) == before


def test_scratch_and_clear(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "_base", lambda spark: f"file://{tmp_path}")
    with common.scratch(spark):
        assert common.stored(spark, spark.range(5), "inner").count() == 5
        assert glob.glob(f"{tmp_path}/*/scratch-*/inner-*")
    assert not glob.glob(f"{tmp_path}/*/scratch-*")
    assert common.stored(spark, spark.range(5), "outer").count() == 5
    common.clear(spark)
    assert not glob.glob(f"{tmp_path}/*")


def test_whole_rows(spark):
    df = spark.createDataFrame([(i, i % 3, 10, 0) for i in range(20)], "id long, h long, n long, c int")
    got = sorted((r["h"], r["id"]) for r in common.whole_rows(df, ["h", "id"], "n", 75, "c").collect())
    assert got == sorted((i % 3, i) for i in range(20))[:7]
    sizes = lambda rows, most: sorted(r["id"] for r in common.whole_rows(spark.createDataFrame(rows, "id long, n long, c int"), ["id"], "n", most, "c").collect())
    # a row that is too large first, in the middle, alone
    assert sizes([(0, 200_000, 1), (1, 5, 1), (2, 5, 0)], 100_000) == [1, 2]
    assert sizes([(0, 5, 1), (1, 200_000, 1), (2, 5, 0)], 100_000) == [0, 2]
    assert sizes([(0, 200_000, 1)], 100_000) == [] and sizes([], 5) == []
    # each class has its smallest row, whatever stands before it
    assert sizes([(0, 40, 1), (1, 40, 1), (2, 30, 1), (3, 50, 0)], 90) == [2, 3]
