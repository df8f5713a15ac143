from pyspark.sql import functions as F

from folioscope.streaming import counts


def test_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    got = counts.run_once(counts.windowed(stream, "ts", ["event_type"], "1 day"), "w", "complete")
    want = events.groupBy(F.window("ts", "1 day").alias("w"), "event_type").count().select(F.col("w.start"), F.col("w.end"), "event_type", "count")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_items_and_first_seen(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], "k"), (2, ["a"], "k"), (3, ["a", "a"], "m")], "doc_id int, l array<string>, k string").withColumn("t", F.to_timestamp(F.lit("2024-01-01")))
    df.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert dict(map(tuple, counts.run_once(counts.items(read(), "l"), "i").collect())) == {"a": 3, "b": 1}
    assert counts.run_once(counts.first_seen(read(), "k", "t"), "f", "append").count() == 2
