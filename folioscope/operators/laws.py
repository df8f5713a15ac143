"""Bibliometric laws: Lotka, Bradford, Zipf, Price, Pareto. Input: a frame of items with a count."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.longform import ranked, standings


def lotka(counts: DataFrame, count: str = "n_docs") -> DataFrame:
    """(documents, authors, proportion, cumulative): how many authors have how many documents."""
    by = counts.groupBy(F.col(count).alias("documents")).agg(F.count("*").alias("authors"))
    total = counts.select(F.count("*")).scalar()
    w = Window.orderBy("documents").rowsBetween(Window.unboundedPreceding, 0)  # a row for each number of documents
    return by.withColumn("proportion", F.col("authors") / total).withColumn("cumulative", F.sum("proportion").over(w))


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (exponent = -slope, intercept, r2) of the least squares of ln y on ln x, positive values only."""
    pos = df.where((F.col(x) > 0) & (F.col(y) > 0))
    ln = lambda c: F.log(F.col(c).cast("double"))
    return pos.agg((-F.regr_slope(ln(y), ln(x))).alias("exponent"), F.regr_intercept(ln(y), ln(x)).alias("intercept"), F.regr_r2(ln(y), ln(x)).alias("r2"))


def lotka_fit(counts: DataFrame, count: str = "n_docs") -> DataFrame:
    return log_fit(lotka(counts, count), "documents", "authors")


def _with_mass(counts: DataFrame, count: str, item: str) -> DataFrame:
    """Items with rank and the mass up to and with them: what greater counts hold, and as much for each item of the same count up to this one."""
    out = ranked(counts.select(item, count), count, item)  # written once: what follows reads it, not the counts
    out = out.join(standings(out, count).withColumnRenamed("value", "_value"), F.col(count) == F.col("_value"))
    return out.withColumn("mass", F.col("mass_before") + (F.col("rank") - F.col("before")) * F.col(count)).drop("_value", "k", "before", "mass_before")


def bradford(counts: DataFrame, count: str = "n_docs", item: str = "item") -> DataFrame:
    """Items with their cumulative share of documents and zone 1 to 3 by thirds of it."""
    out = _with_mass(counts, count, item)
    out = out.withColumn("cumulative", F.col("mass") / out.select(F.sum(count)).scalar()).drop("mass")
    return out.withColumn("zone", F.when(F.col("cumulative") <= 0.333, 1).when(F.col("cumulative") <= 0.667, 2).otherwise(3))


def bradford_by_sources(counts: DataFrame, count: str = "n_docs", item: str = "item", zones: int = 3) -> DataFrame:
    """Zones by equal numbers of sources in order of rank."""
    out = ranked(counts.select(item, count), count, item)
    n = out.select(F.count("*")).scalar()
    return out.withColumn("zone", F.least(F.lit(zones), F.floor((F.col("rank") - 1) * zones / n) + 1).cast("int"))


def bradford_by_mass(counts: DataFrame, count: str = "n_docs", item: str = "item", zones: int = 3) -> DataFrame:
    """Zones of equal mass: a source is in the zone where the documents before it stand."""
    out = _with_mass(counts, count, item)
    total = out.select(F.sum(count)).scalar()
    out = out.withColumn("before", F.col("mass") - F.col(count)).drop("mass")
    return out.withColumn("zone", F.least(F.lit(zones), F.floor(F.col("before") * zones / total) + 1).cast("int")).drop("before")


def bradford_fit(zoned: DataFrame) -> DataFrame:
    """Sources and documents of each zone and the multiplier to the zone before."""
    by = zoned.groupBy("zone").agg(F.count("*").alias("sources"), F.sum("n_docs").alias("documents"))
    return by.withColumn("multiplier", F.col("sources") / F.lag("sources").over(Window.orderBy("zone")))


def zipf(counts: DataFrame, count: str = "n_docs", item: str = "item") -> DataFrame:
    """Items with rank and logarithms of rank and frequency."""
    out = ranked(counts.select(item, F.col(count).alias("frequency")), "frequency", item)
    return out.withColumns({"log_rank": F.log(F.col("rank").cast("double")), "log_frequency": F.log(F.col("frequency").cast("double"))})


def zipf_fit(counts: DataFrame, count: str = "n_docs", item: str = "item") -> DataFrame:
    return log_fit(zipf(counts, count, item), "rank", "frequency")


def price(counts: DataFrame, count: str = "n_docs", item: str = "item") -> DataFrame:
    """One row: the elite of int(sqrt(authors)) authors, its share of all documents, and whether that is half or more."""
    top = ranked(counts.select(item, count), count, item)
    elite = F.floor(F.sqrt(top.select(F.count("*")).scalar()))
    out = top.agg(F.count("*").alias("authors"), F.max(elite).cast("long").alias("elite"), (F.sum(F.when(F.col("rank") <= elite, F.col(count)).otherwise(0)) / F.sum(count)).alias("share"))
    return out.withColumn("holds", F.col("share") >= 0.5)


def pareto(counts: DataFrame, count: str = "n_docs", item: str = "item") -> DataFrame:
    """One row: items that make 80 % of the total, and the share of the top fifth of items."""
    t = _with_mass(counts, count, item)
    n, total = t.select(F.count("*")).scalar(), t.select(F.sum(count)).scalar()
    t = t.withColumn("cumulative", F.col("mass") / total)
    return t.agg((F.sum((F.col("cumulative") <= 0.8).cast("long")) + 1).alias("items_for_80"), (F.sum(F.when(F.col("rank") <= F.greatest(F.lit(1), F.floor(n * 0.2)), F.col(count)).otherwise(0)) / F.max(total)).alias("top_fifth_share"))


def lotka_check(counts: DataFrame, count: str = "n_docs") -> dict:
    """Exponent, fit and the greatest distance between the observed and the theoretical distribution (the table has a row for each number of documents)."""
    rows = sorted((r["documents"], r["authors"]) for r in lotka(counts, count).collect())
    fit = lotka_fit(counts, count).first()
    total = sum(a for _, a in rows)
    theory = [x ** -(fit["exponent"] or 0.0) for x, _ in rows]
    seen = expected = far = 0.0
    for (_, a), t in zip(rows, theory, strict=True):
        seen += a / total
        expected += t / math.fsum(theory)
        far = max(far, abs(seen - expected))
    return {"exponent": fit["exponent"], "r2": fit["r2"], "ks": far, "valid": fit["exponent"] is not None and 1.5 <= fit["exponent"] <= 3 and fit["r2"] >= 0.8}
