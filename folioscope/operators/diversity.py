"""Diversity of counts: Shannon, Simpson, Gini, Rao-Stirling, by any grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.longform import long


def diversity(counts: DataFrame, by: list[str] | None = None, count: str = "n", item: str = "item") -> DataFrame:
    """(by..., richness, total, shannon, evenness, simpson, inverse_simpson, hhi, gini, gini_biased, dominant, dominant_share) of items with counts."""
    by = by or []
    # items of the same count are one row of a histogram, which is all that the measures need
    n = F.col(count).cast("double")
    hist = counts.where(F.col(count).isNotNull()).groupBy(*by, n.alias("_n")).agg(F.count("*").alias("_k"), F.max(item).alias("_item"))
    up = Window.partitionBy(*by).orderBy("_n").rowsBetween(Window.unboundedPreceding, -1)
    t = hist.withColumns({"_below": F.coalesce(F.sum("_k").over(up), F.lit(0)), "_all": F.sum(F.col("_k") * F.col("_n")).over(Window.partitionBy(*by))})
    k, p = F.col("_k"), F.col("_n") / F.col("_all")
    out = t.groupBy(*by).agg(
        F.sum("_k").alias("richness"), F.sum(k * F.col("_n")).alias("total"), (-F.sum(F.when(p > 0, k * p * F.log(p)).otherwise(0.0))).alias("shannon"), F.sum(k * p * p).alias("hhi"),
        F.sum((k * F.col("_below") + k * (k + 1) / 2) * F.col("_n")).alias("_w"), F.max(F.struct(F.col("_n"), F.col("_item"))).alias("_top"),
    )
    r, total = F.col("richness"), F.col("total")
    gini = (2 * F.col("_w") - (r + 1) * total) / (r * total)
    return out.select(
        *by, "richness", "total", "shannon", (F.col("shannon") / F.when(r > 1, F.log(r)).otherwise(1.0)).alias("evenness"), (1 - F.col("hhi")).alias("simpson"), (1 / F.col("hhi")).alias("inverse_simpson"), "hhi",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), gini)).alias("gini"), (2 * F.col("_w") / (r * total) - 1).alias("gini_biased"), F.col("_top._item").alias("dominant"), (F.col("_top._n") / total).alias("dominant_share"),
    )


def entity_diversity(df: DataFrame, column: str, by: list[str] | None = None, top_n: int | None = None) -> DataFrame:
    """Diversity of a list column's items, over the corpus or by columns of the documents (year, group)."""
    by = by or []
    counts = long(df, column, ["doc_id", *by]).groupBy(*by, "item").agg(F.count("*").alias("n"))
    if top_n:
        if by:
            first = Window.partitionBy(*by).orderBy(F.desc("n"), "item")
            counts = counts.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= top_n).drop("_r")
        else:
            counts = counts.orderBy(F.desc("n"), "item").limit(top_n)
    return diversity(counts, by)


def temporal_diversity(df: DataFrame, column: str, at_least: int = 5) -> DataFrame:
    """Diversity by year, of years with at_least documents."""
    enough = df.groupBy("year").count().where(F.col("count") >= at_least).select("year")
    return entity_diversity(df.join(enough, "year", "left_semi"), column, ["year"])


def rao_stirling(counts: DataFrame, distances: DataFrame, by: list[str] | None = None, count: str = "n", item: str = "item") -> DataFrame:
    """(by..., rao): 2 * sum over pairs of p_i p_j d_ij; distances: (a, b, d) with a < b. Only pairs with a distance are joined."""
    by = by or ["_g"]
    t = counts if by != ["_g"] else counts.withColumn("_g", F.lit(1))
    t = t.withColumn("p", F.col(count) / F.sum(count).over(Window.partitionBy(*by)))
    a = t.select(*by, F.col(item).alias("a"), F.col("p").alias("pa"))
    b = t.select(*by, F.col(item).alias("b"), F.col("p").alias("pb"))
    out = a.join(distances, "a").join(b, [*by, "b"]).groupBy(*by).agg((2 * F.sum(F.col("pa") * F.col("pb") * F.col("d"))).alias("rao"))
    return out.drop("_g")


def level(source: str, field: str, refs: str):
    """A label of combined diversity: 0.4 of the sources' and 0.6 of the fields'; fewer than 5 references are very_low."""
    x = 0.4 * F.col(source) + 0.6 * F.col(field)
    return F.when(F.col(refs) < 5, "very_low").when(x < 0.2, "very_low").when(x < 0.4, "low").when(x < 0.6, "medium").when(x < 0.8, "high").otherwise("very_high")
