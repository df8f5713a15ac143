"""Counts of entities: sources, authors, keywords, n-grams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.longform import as_list, list_column, long, ranked

#: Tokens of text: two word characters or more, in small letters.
TOKEN = r"(?U)\b\w\w+\b"


def tokens(column: str, pattern: str = TOKEN):
    """The words of a text in small letters, in order; null texts have none."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.col(column)), F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def ngrams(words, n_min: int, n_max: int):
    """All runs of n_min to n_max words, joined by a space."""
    def runs(n: int):
        all_ = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) >= n, all_).otherwise(F.array().cast("array<string>"))

    grams = [runs(n) for n in range(n_min, n_max + 1)]
    return F.concat(*grams)


def _shares(counts: DataFrame, df: DataFrame) -> DataFrame:
    """Proportion (of all rows, null ones too), percentage, rank and percent rank."""
    rows = df.select(F.count("*")).scalar()
    n_items = counts.select(F.count("*")).scalar()
    out = ranked(counts, "n_docs", "item").withColumn("proportion", F.col("n_docs") / rows)
    return out.withColumns({"percentage": F.col("proportion") * 100, "percent_rank": F.when(n_items > 1, (n_items - F.col("rank")) / (n_items - 1)).otherwise(F.lit(1.0))})


def count_single(df: DataFrame, column: str) -> DataFrame:
    """item, n_docs, proportion, percentage, rank, percent_rank of a single-valued column; blanks and nulls are no items."""
    item = F.trim(F.col(column).cast("string"))
    return _shares(df.select(item.alias("item")).where("item <> ''").groupBy("item").agg(F.count("*").alias("n_docs")), df)


def count_list(df: DataFrame, column: str, sep: str = "; ", min_length: int = 0) -> DataFrame:
    """The same of a list; n_docs counts occurrences, repeats in a cell too; fractional gives each document weight 1, shared by its distinct items."""
    items = list_column(df, column, sep)
    each = df.select(items.alias("items")).select(F.explode("items").alias("item"), (1 / F.size(F.array_distinct("items"))).alias("share"), "items")
    # a repeated item has the document's share once
    each = each.withColumn("share", F.col("share") / F.size(F.filter("items", lambda x: x == F.col("item"))))
    if min_length:
        each = each.where(F.length(F.col("item").cast("string")) >= min_length)
    return _shares(each.groupBy("item").agg(F.count("*").alias("n_docs"), F.sum("share").alias("fractional")), df)


def count_text(df: DataFrame, column: str, n_min: int = 1, n_max: int = 1, pattern: str = TOKEN) -> DataFrame:
    """n-grams of a text: n_docs (documents that have it) and n_total (occurrences)."""
    grams = df.select(F.monotonically_increasing_id().alias("_row"), tokens(column, pattern).alias("w")).select("_row", F.explode(ngrams(F.col("w"), n_min, n_max)).alias("item"))
    per = grams.groupBy("_row", "item").agg(F.count("*").alias("n"))
    return _shares(per.groupBy("item").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_total")), df)


def count_occurrences(df: DataFrame, column: str, mode: str = "single", **options) -> DataFrame:
    """Counts by mode: single, list or text."""
    return {"single": count_single, "list": count_list, "text": count_text}[mode](df, column, **options)


def indicators(df: DataFrame, column: str, items: list[str], sep: str = "; ", case_sensitive: bool = False) -> DataFrame:
    """doc_id and a 0/1 column for each item of interest."""
    fold = (lambda x: x) if case_sensitive else F.lower
    held = F.transform(list_column(df, column, sep), lambda x: fold(F.trim(x.cast("string"))))
    return df.select("doc_id", *(F.coalesce(F.array_contains(held, i if case_sensitive else i.lower()), F.lit(False)).cast("int").alias(i) for i in items))


def entity_stats(df: DataFrame, column: str, mode: str = "list", top_n: int | None = None, items: list | None = None, exclude: list | None = None) -> DataFrame:
    """Documents, citations, mean citations, first and last year and h-index of each item; only the items given, without those excluded, or the top n."""
    from folioscope.operators.indices import h_indices

    rows = long(df, column, ["doc_id", "year", "cited_by"]) if mode == "list" else df.select("doc_id", "year", "cited_by", F.col(column).alias("item")).where("item IS NOT NULL")
    if items is not None:
        rows = rows.where(F.col("item").isin(items))
    if exclude:
        rows = rows.where(~F.col("item").isin(exclude))
    stats = rows.groupBy("item").agg(F.count("*").alias("n_docs"), F.sum("cited_by").alias("citations"), F.avg("cited_by").alias("mean_citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    if top_n:
        stats = stats.orderBy(F.desc("n_docs"), "item").limit(top_n)
        rows = rows.join(stats.select("item"), "item", "left_semi")
    return stats.join(h_indices(rows, "item"), "item")


def top_cited(df: DataFrame, n: int = 10, per_year: bool = False) -> DataFrame:
    """The n documents with the most citations, or with the most a year (the last year of the data counts as one)."""
    last = df.select(F.max("year")).scalar()
    rate = F.col("cited_by") / (last - F.col("year") + 1)
    out = df.select("doc_id", "year", "source", "cited_by", rate.alias("per_year"))
    return out.orderBy(F.desc("per_year" if per_year else "cited_by"), "doc_id").limit(n)


def production(df: DataFrame) -> DataFrame:
    """Documents, share, citations and their cumulative sums by year."""
    from pyspark.sql import Window

    w = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row for each year
    total = df.select(F.count("*")).scalar()
    by = df.groupBy("year").agg(F.count("*").alias("n_docs"), F.sum("cited_by").alias("citations"))
    return by.select("year", "n_docs", "citations", (F.col("n_docs") / total).alias("share"), F.sum("n_docs").over(w).alias("cumulative_docs"), F.sum("citations").over(w).alias("cumulative_citations"))


def main_info(df: DataFrame) -> DataFrame:
    """(indicator, value): a description of the corpus in one pass."""
    sizes = F.size(F.coalesce("authors", F.array()))
    one = df.agg(
        F.count("*").cast("double").alias("documents"),
        F.min("year").cast("double").alias("first_year"),
        F.max("year").cast("double").alias("last_year"),
        F.countDistinct("source").cast("double").alias("sources"),
        F.sum("cited_by").cast("double").alias("citations"),
        F.avg("cited_by").alias("mean_citations"),
        F.avg(sizes).alias("authors_per_document"),
        F.avg(F.when(sizes > 1, sizes)).alias("collaboration_index"),
        F.sum((sizes == 1).cast("double")).alias("single_author_documents"),
        F.avg((F.size(F.coalesce("countries", F.array())) > 1).cast("double")).alias("international_share"),
    )
    return one.unpivot([], one.columns, "indicator", "value")


def term_years(df: DataFrame, column: str, top_n: int = 20) -> DataFrame:
    """(year, item, n_docs) of the top items."""
    rows = long(df, column, ["doc_id", "year"])
    top = rows.groupBy("item").count().orderBy(F.desc("count"), "item").limit(top_n)
    return rows.join(top.select("item"), "item", "left_semi").groupBy("year", "item").agg(F.count("*").alias("n_docs"))


def split_list(df: DataFrame, column: str, sep: str = "; ") -> DataFrame:
    """The column's delimited strings as arrays."""
    return df.withColumn(column, as_list(column, sep))
