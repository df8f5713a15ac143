"""Groups of documents as long membership (doc_id, group_name); groups may overlap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.indices import h_indices
from folioscope.operators.longform import long, ranked


def membership(df: DataFrame, column: str) -> DataFrame:
    """(doc_id, group_name) of a single or list column."""
    if df.schema[column].dataType.simpleString().startswith("array"):
        return long(df, column, item="group_name")
    return df.select("doc_id", F.col(column).alias("group_name")).where("group_name IS NOT NULL").distinct()


def by_concepts(df: DataFrame, text: str, concepts: dict[str, str]) -> DataFrame:
    """(doc_id, group_name) of texts that match a concept's pattern, in any case."""
    hits = F.filter(F.array(*(F.when(F.col(text).rlike(f"(?i){p}"), F.lit(name)) for name, p in concepts.items())), lambda x: x.isNotNull())
    return df.select("doc_id", F.explode(hits).alias("group_name"))


def indicator_matrix(members: DataFrame, groups: list[str]) -> DataFrame:
    """doc_id and a 0/1 column for each group named."""
    return members.groupBy("doc_id").agg(*(F.max((F.col("group_name") == g).cast("int")).alias(g) for g in groups))


def intersections(members: DataFrame, ids: bool = False) -> DataFrame:
    """(a, b, n): sizes of groups (a = b) and of their pairs. Pairs are made inside a document's set of groups."""
    sets = members.groupBy("doc_id").agg(F.array_sort(F.collect_set("group_name")).alias("g"))
    g = F.col("g")
    both = F.flatten(F.transform(g, lambda x, i: F.transform(F.slice(g, i + F.lit(1), F.size(g)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    out = sets.select("doc_id", F.explode(both).alias("p")).groupBy("p.a", "p.b")
    return out.agg(F.count("*").alias("n"), *([F.array_sort(F.collect_list("doc_id")).alias("ids")] if ids else []))


def similarity(members: DataFrame) -> DataFrame:
    """(a, b, n, jaccard, overlap) of pairs of groups that share documents."""
    t = intersections(members)
    sizes = t.where("a = b")
    a, b = sizes.select("a", F.col("n").alias("na")), sizes.select("b", F.col("n").alias("nb"))
    n = F.col("n")
    return t.where("a < b").join(a, "a").join(b, "b").select("a", "b", "n", (n / (F.col("na") + F.col("nb") - n)).alias("jaccard"), (n / F.least("na", "nb")).alias("overlap"))


def count_items(df: DataFrame, members: DataFrame, column: str, merge: str = "all") -> DataFrame:
    """(group_name, item, n_docs, share, rank): counts of a list's items in each group; merge 'shared' keeps items found in every group."""
    rows = long(df, column).join(members, "doc_id")
    counts = rows.groupBy("group_name", "item").agg(F.count("*").alias("n_docs"))
    sizes = members.groupBy("group_name").agg(F.count("*").alias("size"))
    if merge == "shared":
        n = members.select(F.countDistinct("group_name")).scalar()
        shared = counts.groupBy("item").agg(F.count("*").alias("k")).where(F.col("k") == n).select("item")
        counts = counts.join(shared, "item", "left_semi")
    place = F.row_number().over(Window.partitionBy("group_name").orderBy(F.desc("n_docs"), "item"))
    return counts.join(sizes, "group_name").select("group_name", "item", "n_docs", (F.col("n_docs") / F.col("size")).alias("share"), place.alias("rank"))


def combined_counts(df: DataFrame, members: DataFrame, column: str) -> DataFrame:
    """(item, total, groups, rank): counts added up over the groups."""
    t = count_items(df, members, column).groupBy("item").agg(F.sum("n_docs").alias("total"), F.count("*").alias("groups"))
    return ranked(t, "total", "item")


def production(df: DataFrame, members: DataFrame) -> DataFrame:
    """(group_name, year, n_docs, cumulative)."""
    t = df.select("doc_id", "year").join(members, "doc_id").groupBy("group_name", "year").agg(F.count("*").alias("n_docs"))
    w = Window.partitionBy("group_name").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return t.withColumn("cumulative", F.sum("n_docs").over(w))


def top_cited(df: DataFrame, members: DataFrame, n: int = 10) -> DataFrame:
    """The n most cited documents of each group."""
    place = F.row_number().over(Window.partitionBy("group_name").orderBy(F.desc("cited_by"), "doc_id"))
    return df.select("doc_id", "year", "cited_by").join(members, "doc_id").withColumn("rank", place).where(F.col("rank") <= n)


def compare_continuous(df: DataFrame, members: DataFrame, value: str) -> DataFrame:
    """(group_name, n, mean, std, median, rest_n, rest_mean): a value inside each group and in the rest. The rest comes from totals, not from a second join."""
    rows = df.select("doc_id", F.col(value).cast("double").alias("x")).where("x IS NOT NULL")
    t = rows.join(members, "doc_id").groupBy("group_name").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.percentile("x", 0.5).alias("median"), F.sum("x").alias("s"))
    total, n = rows.select(F.sum("x")).scalar(), rows.select(F.count("*")).scalar()
    rest = n - F.col("n")
    return t.select("group_name", "n", "mean", "std", "median", rest.alias("rest_n"), F.when(rest > 0, (total - F.col("s")) / rest).alias("rest_mean"))


def profile(df: DataFrame, members: DataFrame) -> DataFrame:
    """One row for each group: documents, authors, sources, citations, h, authors a document, international share, yearly slope over the mean."""
    t = df.join(members, "doc_id")
    base = t.groupBy("group_name").agg(
        F.count("*").alias("documents"), F.countDistinct("source").alias("sources"), F.sum("cited_by").alias("citations"), F.avg("cited_by").alias("mean_citations"),
        F.avg(F.size(F.coalesce("authors", F.array()))).alias("authors_per_document"), F.avg((F.size(F.coalesce("countries", F.array())) > 1).cast("double")).alias("international_share"),
    )
    authors = long(t, "authors", ["group_name"]).groupBy("group_name").agg(F.countDistinct("item").alias("authors"))
    h = h_indices(t.select("group_name", "cited_by"), "group_name")
    by = t.groupBy("group_name", "year").agg(F.count("*").alias("k")).groupBy("group_name").agg((F.regr_slope(F.col("k").cast("double"), F.col("year").cast("double")) / F.avg("k")).alias("growth"))
    return base.join(authors, "group_name", "left").join(h, "group_name").join(by, "group_name")


def associations(df: DataFrame, members: DataFrame, column: str, top_n: int = 50) -> DataFrame:
    """(group_name, item, n, expected, residual, log_ratio): contingency of groups and the top items."""
    rows = long(df, column)
    top = rows.groupBy("item").count().orderBy(F.desc("count"), "item").limit(top_n).select("item")
    cells = rows.join(top, "item", "left_semi").join(members, "doc_id").groupBy("group_name", "item").agg(F.count("*").alias("n"))
    t = cells.withColumns({"_r": F.sum("n").over(Window.partitionBy("group_name")), "_c": F.sum("n").over(Window.partitionBy("item"))})
    e = F.col("_r") * F.col("_c") / cells.select(F.sum("n")).scalar()
    return t.select("group_name", "item", "n", e.alias("expected"), ((F.col("n") - e) / F.sqrt(e)).alias("residual"), F.log2(F.col("n") / e).alias("log_ratio"))


def dataset_similarity(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """(column, shared, either, jaccard) of the value sets of two corpora."""
    out = None
    for c in columns:
        is_list = left.schema[c].dataType.simpleString().startswith("array")
        values = [(x.select(F.explode(c).alias("v")) if is_list else x.select(F.col(c).alias("v")).where("v IS NOT NULL")).distinct() for x in (left, right)]
        tagged = values[0].withColumn("t", F.lit(1)).union(values[1].withColumn("t", F.lit(2))).groupBy("v").agg(F.count("*").alias("k"))
        one = tagged.agg(F.lit(c).alias("column"), F.sum((F.col("k") == 2).cast("long")).alias("shared"), F.count("*").alias("either")).withColumn("jaccard", F.col("shared") / F.col("either"))
        out = one if out is None else out.union(one)
    return out
