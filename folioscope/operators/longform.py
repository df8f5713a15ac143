"""The primitive under most operators: one row for each document and item, and ranks and running sums that need no single partition."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_list(column: Column | str, sep: str = "; ") -> Column:
    """A delimited string as an array: items trimmed, blanks dropped, null kept."""
    c = F.col(column) if isinstance(column, str) else column
    parts = F.split(c, f"\\Q{sep.strip()}\\E")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def list_column(df: DataFrame, column: str, sep: str = "; ") -> Column:
    """The column as an array, split only where it is a string."""
    return as_list(column, sep) if df.schema[column].dataType.simpleString() == "string" else F.col(column)


def long(df: DataFrame, column: str, keep: list[str] | None = None, distinct: bool = True, sep: str = "; ", item: str = "item") -> DataFrame:
    """(keep..., item): a row for each item of the list; items once for each document unless distinct is False."""
    items = list_column(df, column, sep)
    return df.select(*(keep or ["doc_id"]), F.explode(F.array_distinct(items) if distinct else items).alias(item))


def _shared(df: DataFrame) -> str:
    """The folder that driver and executors share; a temporary one where none is set, on one machine only."""
    path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not path and not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path or f"file://{tempfile.gettempdir()}/folioscope-checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(_shared(df))
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: for iterations, as a checkpoint makes its rows twice and keeps all that the planner knows of earlier rounds,
    which grows with each of them; a table's size is known, too."""
    path = f"{_shared(df).rstrip('/')}/folioscope-{df.sparkSession.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], sums: dict[str, Column | str]) -> DataFrame:
    """Adds, for each name, the sum of a column over the rows up to and with this one in the order given (which must leave no ties that matter).
    One distributed sort, written once; each task adds up its own range, and the ranges before it come as one row each."""
    made = df.orderBy(*order).withColumns({f"_x{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(sums.values())})
    made = cut(made.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    parts = made.groupBy("_part").agg(*(F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(sums))))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    offsets = parts.select("_part", *(F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_o{i}") for i in range(len(sums))))
    own = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    out = made.join(offsets, "_part").withColumns({name: F.col(f"_o{i}") + F.sum(f"_x{i}").over(own) for i, name in enumerate(sums)})
    return out.select(*(f"`{c}`" for c in df.columns), *sums)


def ranked(df: DataFrame, value: str, tie: str | list[str], name: str = "rank") -> DataFrame:
    """Adds 1-based places by value (descending) and tie (ascending). A distributed sort: rows of one value are dealt over tasks like any others."""
    ties = [tie] if isinstance(tie, str) else tie
    made = cut(df.orderBy(F.desc(value), *ties).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    parts = made.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task of the sort
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return made.join(offsets, part == F.col("_part")).select(*(f"`{c}`" for c in df.columns), place.alias(name))


def standings(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, k, before, mass_before): for each distinct value of a count, how many rows have it, and rows and mass of the greater ones. Distinct counts are few:
    with a total of T there are at most sqrt(2 T)."""
    by = by or []
    hist = df.groupBy(*by, F.col(value).alias("value")).agg(F.count("*").alias("k"))
    order = Window.partitionBy(*by).orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    return hist.select(*by, "value", "k", F.coalesce(F.sum("k").over(order), F.lit(0)).alias("before"), F.coalesce(F.sum(F.col("k") * F.col("value")).over(order), F.lit(0)).alias("mass_before"))


def average_rank(value: str, within: list[str], descending: bool = False) -> Column:
    """Mean rank of ties among rows of the same group, 1-based."""
    w = Window.partitionBy(*within).orderBy(F.desc(value) if descending else F.col(value))
    ties = Window.partitionBy(*within, value)
    return F.rank().over(w) + (F.count("*").over(ties) - 1) / 2


def pairs(df: DataFrame, column: str, keep: list[str] | None = None, sep: str = "; ") -> DataFrame:
    """(keep..., a, b) for every unordered pair of distinct items of a document, a < b. Pairs are made inside the row: nothing is joined or shuffled."""
    items = F.array_sort(F.array_distinct(list_column(df, column, sep)))
    both = F.flatten(F.transform(items, lambda x, i: F.transform(F.slice(items, i + F.lit(2), F.size(items)), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return df.select(*(keep or ["doc_id"]), F.explode(both).alias("_p")).select(*(keep or ["doc_id"]), "_p.a", "_p.b")
