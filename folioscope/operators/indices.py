"""Citation indices of entities, in one windowed pass and one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLDS = (1, 5, 10, 20, 50, 100, 1000)


def h_indices(rows: DataFrame, entity: str, cites: str = "cited_by", alpha: float = 1.0) -> DataFrame:
    """(entity, h): the most i for which i documents have alpha * i citations or more."""
    place = F.row_number().over(Window.partitionBy(entity).orderBy(F.desc(cites)))
    return rows.select(entity, cites, place.alias("_i")).groupBy(entity).agg(F.sum((F.col(cites) >= alpha * F.col("_i")).cast("long")).alias("h"))


def citation_indices(rows: DataFrame, entity: str, cites: str = "cited_by", year: str | None = None, authors: str | None = None, now: int | None = None) -> DataFrame:
    """All indices of each entity. rows: a row for each entity and document. year (with now) adds ar and m_quotient; authors (a number) adds h_frac."""
    down = Window.partitionBy(entity).orderBy(F.desc(cites), *([F.col(year)] if year else []), *([F.col(authors)] if authors else []))
    run = down.rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(entity).orderBy(cites)
    all_ = Window.partitionBy(entity)
    c, i = F.col("c"), F.col("i")
    cols = [F.col(entity).alias("entity"), F.col(cites).cast("double").alias("c"), F.row_number().over(down).cast("long").alias("i"), F.sum(F.col(cites).cast("double")).over(run).alias("s"), F.row_number().over(up).alias("up"), F.count("*").over(all_).alias("n")]
    if year:
        cols.append(F.col(year).alias("year"))
    if authors:
        cols.append(F.sum(1 / F.col(authors)).over(run).alias("eff"))
    t = rows.select(*cols)
    by = Window.partitionBy("entity")
    t = t.withColumn("h", F.sum((c >= i).cast("long")).over(by))
    if authors:
        # the effective rank counts up to the first failure; a sum of fractions that equals the citations is none, however its rounding falls
        failed = F.max((F.col("eff") - c > 1e-9 * F.greatest(F.lit(1.0), c)).cast("int")).over(Window.partitionBy("entity").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
        t = t.withColumn("frac", F.when(failed == 0, F.col("eff")))
    core = i <= F.col("h")
    most = lambda ok: F.coalesce(F.max(F.when(ok, i)), F.lit(0)).cast("long")
    h = F.col("h")
    agg = [
        F.count("*").alias("n_docs"),
        F.sum("c").alias("citations"),
        F.max("h").alias("h"),
        most(F.col("s") >= i * i).alias("g"),
        most(c >= 10 * i).alias("w"),
        most(c >= i * i).alias("h2_upper"),
        F.coalesce(F.sum(F.when(core, F.least(c, i) / i)), F.lit(0.0)).alias("tapered_h"),
        F.coalesce(F.sum(F.when(core, c)), F.lit(0.0)).alias("core"),
        F.percentile(F.when(core, c), 0.5).alias("m"),
        F.sqrt(F.coalesce(F.sum(F.when(core, c - h)), F.lit(0.0))).alias("e"),
        F.sqrt(F.coalesce(F.max(F.when(F.col("s") >= i, F.col("s"))), F.lit(0.0))).alias("hw"),
        F.sum(F.when((F.col("n") > 1) & (i <= F.greatest(F.lit(1), F.floor(10 * F.log10("n") - 10))), c).otherwise(0.0)).alias("pi_sum"),
        F.sum(F.col("up") * c).alias("weighted"),
        *(F.sum((c >= k).cast("long")).alias(f"c{k}") for k in THRESHOLDS),
    ]
    if year:
        age = F.greatest(F.lit(1), F.lit(now) - F.col("year") + 1)
        agg += [F.sqrt(F.coalesce(F.sum(F.when(core, c / age)), F.lit(0.0))).alias("ar"), (F.lit(now) - F.min("year") + 1).alias("years_active")]
    if authors:
        agg.append(F.coalesce(F.max("frac"), F.lit(0.0)).alias("h_frac"))
    out = t.groupBy("entity").agg(*agg)
    total, n = F.col("citations"), F.col("n_docs")
    out = out.withColumns({
        "hg": F.sqrt(h * F.col("g")),
        "a": F.when(h > 0, F.col("core") / h).otherwise(0.0),
        "r": F.sqrt("core"),
        "h2": F.when(total > 0, h * h / total).otherwise(0.0),
        "m": F.coalesce("m", F.lit(0.0)),
        "q2": F.sqrt(h * F.coalesce("m", F.lit(0.0))),
        "pi": F.col("pi_sum") / 100,
        "v": 100.0 * h / n,
        "h_norm": h / n,
        "profit": F.pow(total * total / n, F.lit(1 / 3)),
        "gini": F.when(total > 0, (2 * F.col("weighted") - (n + 1) * total) / (n * total)).otherwise(0.0),
    }).drop("pi_sum", "weighted", "core")
    if year:
        out = out.withColumn("m_quotient", F.when(F.col("years_active") > 0, h / F.col("years_active")).otherwise(0.0))
    return out.withColumnRenamed("entity", entity)
