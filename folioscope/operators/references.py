"""What reference strings say: which documents of the corpus they mean, and which of them a document's own authors wrote."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from folioscope.functions.strings import normal_title, reference_parts
from folioscope.operators.longform import kept, list_column
from folioscope.operators.similarity import EPS, check_bounds, indel_ratios, levenshtein_ratio, ratio_matches

#: Names at the head of a reference that count as its authors.
FIRST_NAMES = 5
#: Authors times references up to which a document is compared in its row.
IN_ROW = 5000


def _bare(x: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", x.lower()) if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def bare_name(names: pd.Series) -> pd.Series:
    """Small letters without accents (null stays null)."""
    return names.map(_bare, na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def bare_names(lists: pd.Series) -> pd.Series:
    """Lists of names as `bare_name` makes them; plain ASCII has no accents."""
    return lists.map(lambda x: [n if n is None else n.lower() if n.isascii() else _bare(n) for n in x], na_action="ignore")


def _cleaned(bare: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s-]", ""), r"\s+", " "))


def name_key(c: Column) -> Column:
    """A bare name's letters, digits, hyphens and single spaces."""
    return _cleaned(bare_name(c))


def reference_names(c: Column) -> Column:
    """The first names in a reference: what stands before its year and its first full stop, split at commas, "and" and "&"; single capitals are initials, not names."""
    head = F.element_at(F.split(F.element_at(F.split(F.trim(c), r"\(\d{4}\)|\b\d{4}\b", 2), 1), r"\.", 2), 1)
    parts = F.transform(F.split(F.regexp_replace(head, r"(?i)\s+and\s+|\s*&\s*", ", "), ","), lambda x: F.trim(x))
    return F.slice(F.filter(parts, lambda x: (F.length(x) > 1) & ~x.rlike(r"^[A-Z]\.?$")), 1, FIRST_NAMES)


def _surname(c: Column) -> Column:
    parts = F.split(c, " ")
    last = F.element_at(parts, -1)
    return F.when(F.length(last) > 2, last).otherwise(F.element_at(parts, 1))


def own_references(docs: DataFrame, authors: str = "authors", references: str = "references", threshold: float = 0.85, measure: str = "indel", sep: str = "; ") -> DataFrame:
    """(doc_id, n_refs, n_self, n_self_refs, rate, self_authors), a row for each document: its references, the names in them that are its own authors', the references
    with such a name, 100 n_self / n_refs to one digit (0 without references), and the authors met, in order. Names are one if surname and first letter are equal or if
    their similarity reaches the threshold. Null or empty lists count as none; a document's id stands once.

    A document of at most IN_ROW authors times references is done in its row. In a larger one names meet by (document, surname, letter) and by (document, segment), so it makes
    no pairs of them; such documents are written to the shared folder first."""
    check_bounds(threshold, measure)
    lists = docs.select("doc_id", list_column(docs, authors, sep).alias("own"), list_column(docs, references, sep).alias("refs"))
    larger = F.coalesce(F.size("own").cast("long") * F.size("refs"), F.lit(0)) > IN_ROW
    rows = _own_in_rows(lists.where(~larger), threshold, measure)
    rest = kept(lists.where(larger))
    out = rows if rest.isEmpty() else rows.union(_own_by_joins(rest, threshold, measure))
    rate = F.when(F.col("n_refs") > 0, F.round(100 * F.col("n_self") / F.col("n_refs"), 1)).otherwise(0.0)
    return out.select("doc_id", "n_refs", "n_self", "n_self_refs", rate.alias("rate"), "self_authors")


def _own_in_rows(lists: DataFrame, threshold: float, measure: str) -> DataFrame:
    """(doc_id, n_refs, n_self, n_self_refs, self_authors) of lists (doc_id, own, refs), nothing joined or shuffled."""
    authors, refs = F.coalesce(F.array_distinct("own"), F.array().cast("array<string>")), F.coalesce(F.filter("refs", lambda x: F.trim(x) != ""), F.array().cast("array<string>"))
    rows = lists.select("doc_id", authors.alias("authors"), refs.alias("refs"))
    found = F.flatten(F.transform("refs", lambda x, i: F.transform(reference_names(x), lambda n: F.struct(i.alias("no"), n.alias("name")))))
    rows = rows.select("doc_id", F.size("refs").cast("long").alias("n_refs"), "authors", found.alias("found")).withColumns({"_a": bare_names("authors"), "_n": bare_names("found.name")})
    parts = lambda n, **more: F.struct(_cleaned(n).alias("name"), *(c.alias(k) for k, c in more.items()))
    own = F.filter(F.zip_with("authors", "_a", lambda x, n: parts(n, author=x)), lambda o: o["name"] != "")
    written = F.filter(F.zip_with("found", "_n", lambda x, n: parts(n, no=x["no"])), lambda w: w["name"] != "")
    rows = rows.select("doc_id", "n_refs", own.alias("own"), written.alias("written"))
    keyed = lambda n: F.struct(n.alias("name"), _surname(n).alias("last"), F.substring(n, 1, 1).alias("first"))
    rows = rows.withColumns({"names": F.transform(F.array_distinct("written.name"), keyed), "people": F.transform(F.array_distinct("own.name"), keyed)})
    if measure == "indel":
        rows = rows.withColumn("near", indel_ratios("names.name", "people.name"))
        near = lambda i, j: F.get(F.get("near", i), j)
    else:
        near = lambda i, j: levenshtein_ratio(F.get("names", i)["name"], F.get("people", j)["name"])

    def pair(n: Column, i: Column, o: Column, j: Column) -> Column:
        return ((n["last"] == o["last"]) & (n["first"] == o["first"])) | (near(i, j) >= threshold - EPS)

    met = F.flatten(F.transform("names", lambda n, i: F.transform(F.filter("people", lambda o, j: pair(n, i, o, j)), lambda o: F.struct(n["name"].alias("n"), o["name"].alias("o")))))
    rows = rows.select("doc_id", "n_refs", "own", "written", met.alias("met"))
    hit = F.filter("written", lambda w: F.array_contains("met.n", w["name"]))
    who = F.transform(F.filter("own", lambda o: F.array_contains("met.o", o["name"])), lambda o: o["author"])
    return rows.select("doc_id", "n_refs", F.size(hit).cast("long").alias("n_self"), F.size(F.array_distinct(F.transform(hit, lambda w: w["no"]))).cast("long").alias("n_self_refs"), F.array_sort(who).alias("self_authors"))


def _own_by_joins(lists: DataFrame, threshold: float, measure: str) -> DataFrame:
    """(doc_id, n_refs, n_self, n_self_refs, self_authors) of lists (doc_id, own, refs) of any length."""
    own = lists.select("doc_id", F.explode(F.array_distinct("own")).alias("author")).withColumn("name", name_key(F.col("author"))).where("name <> ''")
    refs = lists.select("doc_id", F.posexplode("refs").alias("no", "ref")).where(F.trim("ref") != "")
    written = refs.select("doc_id", "no", F.explode(reference_names(F.col("ref"))).alias("name")).withColumn("name", name_key(F.col("name"))).where("name <> ''")
    names = written.select("doc_id", "name").distinct()
    key = lambda df: df.withColumns({"_l": _surname(F.col("name")), "_f": F.substring("name", 1, 1)})
    same = ["doc_id", "_l", "_f"]
    close = ratio_matches(names.withColumn("_key", F.col("name")), own.withColumn("_key", F.col("name")), "_key", "name", threshold, ["doc_id"], measure)
    hit = key(names).join(key(own).select(same), same, "left_semi").select("doc_id", "name").union(close.select("doc_id", "a")).distinct()
    met = key(own).join(key(names).select(same), same, "left_semi").select("doc_id", "author").union(own.join(close.select("doc_id", F.col("b").alias("name")), ["doc_id", "name"], "left_semi").select("doc_id", "author")).distinct()
    n_refs = refs.groupBy("doc_id").agg(F.count("*").alias("n_refs"))
    n_self = written.join(hit, ["doc_id", "name"], "left_semi").groupBy("doc_id", "no").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n_self"), F.count("*").alias("n_self_refs"))
    who = met.groupBy("doc_id").agg(F.array_sort(F.collect_set("author")).alias("self_authors"))
    out = lists.select("doc_id").join(n_refs, "doc_id", "left").join(n_self, "doc_id", "left").join(who, "doc_id", "left")
    return out.select("doc_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_refs", "n_self", "n_self_refs")), F.coalesce("self_authors", F.array().cast("array<string>")).alias("self_authors"))


def linked_references(docs: DataFrame, references: str = "references", threshold: float = 0.9, years: int | None = None, measure: str = "indel", sep: str = "; ", cited: DataFrame | None = None) -> DataFrame:
    """(citing, cited, similarity): the document of the corpus (or of `cited`: doc_id, title, year) that each reference's title is most similar to, at the threshold or
    more; ties go to the least id, and an edge stands once, with its greatest similarity. With years, only where reference and document lie at most that many years
    apart. No document cites itself; titles under 10 letters and references without a title link nothing."""
    there = (docs if cited is None else cited).select("doc_id", normal_title(F.col("title")).alias("t"), "year").where("t IS NOT NULL")
    # of one title and year the two least ids can be cited: the second where the first is the citing document
    there = there.withColumn("i", F.row_number().over(Window.partitionBy("t", "year").orderBy("doc_id"))).where("i <= 2").drop("i")
    refs = docs.select(F.col("doc_id").alias("citing"), F.explode(F.array_distinct(list_column(docs, references, sep))).alias("ref")).where("ref IS NOT NULL")
    # a reference is taken apart and looked up once, however many documents have it: by way of its count, as a filter on parts of the text itself would be moved to all rows
    once = refs.groupBy("ref").agg(F.count("*").alias("_n"))
    parts = once.withColumn("p", reference_parts(F.when(F.col("_n") > 0, F.col("ref")))).select("ref", normal_title(F.col("p.title")).alias("t"), F.col("p.year").alias("y")).where("t IS NOT NULL")
    titles = parts.select("t").distinct().withColumn("k", F.col("t"))
    near = ratio_matches(titles, there.select(F.col("t").alias("k"), "t").distinct(), "k", "t", threshold, None, measure)
    found = parts.join(near.select(F.col("a").alias("t"), F.col("b").alias("_b"), "similarity"), "t").join(there.select(F.col("t").alias("_b"), F.col("doc_id").alias("cited"), F.col("year").alias("_y")), "_b")
    if years is not None:
        found = found.where(F.abs(F.col("y") - F.col("_y")) <= years)
    # of a reference the two best can be cited: the second where the first is the citing document
    found = found.groupBy("ref", "cited").agg(F.max("similarity").alias("similarity")).withColumn("i", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("similarity"), "cited"))).where("i <= 2")
    two = found.groupBy("ref").agg(F.array_sort(F.collect_list(F.struct("i", "cited", "similarity"))).alias("two"))
    best = refs.join(two, "ref").select("citing", F.try_element_at(F.filter("two", lambda m: m["cited"] != F.col("citing")), F.lit(1)).alias("m")).where("m IS NOT NULL")
    return best.groupBy("citing", F.col("m.cited").alias("cited")).agg(F.max("m.similarity").alias("similarity"))
