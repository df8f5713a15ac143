"""Bibliographic views of the star-schema tables: an order is a publication, its suppliers are the authors, its parts the references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: List columns of publications: the line's column, and the tables that have it.
LISTS = {"authors": ("s_name", ("supplier",)), "countries": ("country", ("supplier", "nation")), "keywords": ("p_brand", ("part",)), "types": ("p_type", ("part",)), "refs": ("l_partkey", ())}


def publications(spark: SparkSession, sf_dir: str, *lists: str) -> DataFrame:
    """doc_id, year, source, category, ca_country, price, cited_by and the lists named (distinct, sorted); all lists if none is named, none for "base".

    One shuffle of the lines by order; only the tables that the lists need are joined, before it, so only the columns needed move.
    """
    names = [n for n in lists if n in LISTS] if lists else list(LISTS)
    needs = {t for n in names for t in LISTS[n][1]}
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    if "supplier" in needs:
        lines = lines.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    if "nation" in needs:
        lines = lines.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("country")), F.col("s_nationkey") == F.col("k"))
    if "part" in needs:
        lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    found = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("quantity"), *(F.array_sort(F.collect_set(LISTS[n][0])).alias(n) for n in names))
    docs = (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("ca_country")), F.col("c_nationkey") == F.col("n_nationkey"))
        .select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("source"), F.col("o_orderpriority").alias("category"), "ca_country", "o_totalprice")
    )
    return docs.join(found, docs["doc_id"] == found["l_orderkey"], "left").select(
        "doc_id", "year", "source", "category", "ca_country", F.col("o_totalprice").alias("price"), F.coalesce("quantity", F.lit(0)).alias("cited_by"), *names
    )


#: The same views in DuckDB SQL; queries' SQL begins with WITH and these.
PUBS = """
li AS (SELECT l_orderkey, l_partkey, s_name, n_name AS country, p_brand, p_type, l_quantity FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey),
pubs AS (SELECT o_orderkey AS doc_id, year(o_orderdate) AS year, c_mktsegment AS source, o_orderpriority AS category, n_name AS ca_country, o_totalprice AS price, coalesce(q, 0)::BIGINT AS cited_by
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM li GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
authors AS (SELECT DISTINCT l_orderkey AS doc_id, s_name AS item FROM li WHERE l_orderkey IN (SELECT doc_id FROM pubs)),
keywords AS (SELECT DISTINCT l_orderkey AS doc_id, p_brand AS item FROM li WHERE l_orderkey IN (SELECT doc_id FROM pubs)),
types AS (SELECT DISTINCT l_orderkey AS doc_id, p_type AS item FROM li WHERE l_orderkey IN (SELECT doc_id FROM pubs)),
refs AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS item FROM li WHERE l_orderkey IN (SELECT doc_id FROM pubs)),
countries AS (SELECT DISTINCT l_orderkey AS doc_id, country AS item FROM li WHERE l_orderkey IN (SELECT doc_id FROM pubs))
"""


def cites(spark: SparkSession, sf_dir: str, also: Column | None = None) -> DataFrame:
    """Directed edges (citing, cited) between publications: an order cites the customer's previous two orders (by date, then key). also: of orders, comes along for both as citing_also and cited_also."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", *([] if also is None else [also.alias("also")]))
    if also is not None:
        before = F.array(*(F.struct(F.lag("o_orderkey", k).over(w).alias("cited"), F.lag("also", k).over(w).alias("also")) for k in (1, 2)))
        both = orders.select(F.col("o_orderkey").alias("citing"), F.col("also").alias("citing_also"), before.alias("both"))
        return both.select("citing", "citing_also", F.explode("both").alias("x")).select("citing", "x.cited", "citing_also", F.col("x.also").alias("cited_also")).where("cited IS NOT NULL")
    both = orders.select(F.col("o_orderkey").alias("citing"), F.array(*(F.lag("o_orderkey", k).over(w) for k in (1, 2))).alias("both"))
    return both.select("citing", F.explode("both").alias("cited")).where("cited IS NOT NULL")


CITES = """
cites AS (SELECT citing, cited FROM (SELECT o_orderkey AS citing, unnest([lag(o_orderkey, 1) OVER w, lag(o_orderkey, 2) OVER w]) AS cited FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE cited IS NOT NULL)
"""
