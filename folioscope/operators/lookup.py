"""Lookups against small reference tables, and gaps against expectations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.longform import long


def per_reference(counts: DataFrame, reference: DataFrame, key: str, value: str, per: float = 1e6, count: str = "n") -> DataFrame:
    """counts with rate = count / value * per; null where the reference lacks the key or has no positive value. reference: a row for each key."""
    r = reference.select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    return counts.join(r, F.lower(F.col(key)) == F.lower("_k"), "left").withColumn("rate", F.when(F.col("_v") > 0, F.col(count) / F.col("_v") * per)).drop("_k", "_v")


def mapped(df: DataFrame, column: str, mapping: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, column): list items replaced by mapping (variant, canonical) where it has them, order kept, repeats dropped."""
    rows = df.select(key, F.posexplode(column).alias("i", "variant")).join(mapping, "variant", "left")
    out = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", F.coalesce("canonical", "variant").alias("x")))).alias("l"))
    return out.select(key, F.array_distinct(F.transform("l", lambda s: s["x"])).alias(column))


def classified(df: DataFrame, column: str, codes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, field, area): distinct fields and areas of a document's codes; codes: (code, field, area)."""
    rows = df.select(key, F.explode(column).alias("code")).join(codes, "code")
    return rows.groupBy(key).agg(F.array_sort(F.collect_set("field")).alias("fields"), F.array_sort(F.collect_set("area")).alias("areas"))


def share_gaps(df: DataFrame, group: str, item: str, min_docs: int = 20, threshold: float = 0.3) -> DataFrame:
    """(group, item, n, share, overall, deviation) of groups whose share of an item's documents is off the overall share by more than the threshold.
    group: a single or list column; item: a list column."""
    kind = df.schema[group].dataType.simpleString()
    g = df.select("doc_id", item, (F.explode(group) if kind.startswith("array") else F.col(group)).alias("group_name")).where("group_name IS NOT NULL")
    size = g.groupBy("group_name").agg(F.countDistinct("doc_id").alias("size")).where(F.col("size") >= min_docs)
    rows = g.select("doc_id", "group_name", F.explode(F.array_distinct(item)).alias("item"))
    cells = rows.groupBy("group_name", "item").agg(F.count("*").alias("n")).join(size, "group_name")
    overall = long(df, item).groupBy("item").agg((F.count("*") / df.select(F.count("*")).scalar()).alias("overall"))
    t = cells.join(overall, "item").withColumn("share", F.col("n") / F.col("size")).withColumn("deviation", F.col("share") / F.col("overall") - 1)
    return t.where(F.abs("deviation") > threshold).select("group_name", "item", "n", "share", "overall", "deviation")


def declines(df: DataFrame, item: str, now: int, recent: int = 3, threshold: float = 0.3) -> DataFrame:
    """(item, peak_year, peak, recent, decline): items whose recent yearly mean lies under the mean around their peak, which is before the recent years."""
    per = long(df, item, ["doc_id", "year"]).groupBy("item", "year").agg(F.count("*").alias("k"))
    top = per.groupBy("item").agg(F.max_by("year", F.struct("k", -F.col("year"))).alias("peak_year"))
    t = per.join(top, "item").groupBy("item", "peak_year").agg(
        (F.sum(F.when(F.abs(F.col("year") - F.col("peak_year")) <= 1, F.col("k"))) / F.sum(F.when(F.abs(F.col("year") - F.col("peak_year")) <= 1, 1))).alias("peak"),
        (F.coalesce(F.sum(F.when(F.col("year") > now - recent, F.col("k"))), F.lit(0)) / recent).alias("recent"),
    )
    return t.withColumn("decline", 1 - F.col("recent") / F.col("peak")).where((F.col("decline") >= threshold) & (F.col("peak_year") <= now - recent))


def reference_diversity(df: DataFrame, refs: str, details: DataFrame, now: int) -> DataFrame:
    """doc_id with number of references found, their sources and fields, normalised entropy of both, and mean age. details: (ref, source, field, year)."""
    rows = df.select("doc_id", F.explode(F.array_distinct(refs)).alias("ref")).join(details, "ref")

    def entropy(column: str, name: str) -> DataFrame:
        k = rows.where(F.col(column).isNotNull()).groupBy("doc_id", column).agg(F.count("*").alias("k"))
        p = F.col("k") / F.sum("k").over(Window.partitionBy("doc_id"))
        out = k.withColumn("p", p).groupBy("doc_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"), F.count("*").alias(f"{name}s"))
        return out.select("doc_id", f"{name}s", F.when(F.col(f"{name}s") > 1, F.col("h") / F.log(f"{name}s")).otherwise(0.0).alias(f"{name}_entropy"))

    base = rows.groupBy("doc_id").agg(F.count("*").alias("references"), F.avg(F.lit(now) - F.col("year")).alias("mean_age"), F.percentile(F.lit(now) - F.col("year"), 0.5).alias("median_age"))
    return base.join(entropy("source", "source"), "doc_id", "left").join(entropy("field", "field"), "doc_id", "left")


def attention(df: DataFrame, weights: dict[str, float]) -> DataFrame:
    """doc_id, score (weighted sum of mention counts), percentile by mean rank of ties. Counts must be given: none are made up."""
    from folioscope.operators.stats import mean_ranks

    total = sum((F.coalesce(F.col(c), F.lit(0)) * w for c, w in weights.items()), F.lit(0.0))
    t = mean_ranks(df.select("doc_id", total.alias("score")), "score", "r")
    return t.select("doc_id", "score", (F.col("r") / df.select(F.count("*")).scalar() * 100).alias("percentile"))


def history(years, counts=None):
    """A map of year to count from JSON text ({"2001": 3}), or from two delimited strings."""
    if counts is None:
        return F.transform_keys(F.from_json(years, "map<string,int>"), lambda k, _: k.cast("int"))
    split = lambda c: F.transform(F.filter(F.split(c, r"\s*[|;,]\s*"), lambda x: x != ""), lambda x: x.try_cast("int"))
    return F.map_from_entries(F.filter(F.arrays_zip(split(years).alias("k"), split(counts).alias("v")), lambda s: s["k"].isNotNull() & s["v"].isNotNull()))
