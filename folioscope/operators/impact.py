"""Citation impact: field normalisation, classes, velocity, trajectories, self-citation, in-corpus citations, disruption, novelty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.strings import normal_title
from folioscope.operators.longform import average_rank, cut, long, pairs
from folioscope.operators.quality import similar_strings


def field_normalized(df: DataFrame, field: str | None = None, method: str = "mean", min_field: int = 5) -> DataFrame:
    """doc_id, expected, fnci, percentile. Expected citations are the mean or median of the field and year; fields smaller than min_field take the year's."""
    mid = (lambda w: F.avg("cited_by").over(w)) if method == "mean" else (lambda w: F.percentile("cited_by", 0.5).over(w))
    year = Window.partitionBy("year")
    expected: Column = mid(year)
    if field:
        own = Window.partitionBy("year", field)
        expected = F.when(F.count("*").over(own) >= min_field, mid(own)).otherwise(expected)
    t = df.withColumn("expected", expected)
    fnci = F.when(F.col("expected") > 0, F.col("cited_by") / F.col("expected")).when(F.col("cited_by") > 0, 2.0).otherwise(0.0)
    rank = average_rank("cited_by", ["year"]) / F.count("*").over(year) * 100
    keep = ["doc_id", "year", *([field] if field else []), "cited_by"]
    return t.select(*keep, F.round("expected", 2).alias("expected"), F.round(fnci, 3).alias("fnci"), F.round(rank, 1).alias("percentile"))


def citation_class(percentile: str = "percentile", fnci: str = "fnci") -> Column:
    p, f = F.col(percentile), F.col(fnci)
    return F.when(p >= 99, "Top 1%").when(p >= 90, "Top 10%").when(p >= 75, "Top 25%").when(f >= 1, "Above average").when(f >= 0.5, "Average").otherwise("Below average")


def citation_summary(df: DataFrame) -> DataFrame:
    """One row: totals, uncited share, h and moments."""
    h = df.groupBy(F.col("cited_by").alias("n")).agg(F.count("*").alias("k"))  # a row for each number of citations
    above = F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    h = h.select(F.least("n", above).alias("x")).agg(F.max("x")).scalar()
    return df.agg(
        F.count("*").alias("documents"), F.sum("cited_by").alias("citations"), F.avg("cited_by").alias("mean"), F.percentile("cited_by", 0.5).alias("median"), F.max("cited_by").alias("max"),
        F.avg((F.col("cited_by") == 0).cast("double")).alias("uncited_share"), F.max(h).alias("h"),
    )


def velocity(df: DataFrame, now: int) -> DataFrame:
    """Citations a year of age (1 at least) and a label by age."""
    age = F.greatest(F.lit(1), F.lit(now) - F.col("year"))
    rate = F.col("cited_by") / age
    fast, normal = F.when(age <= 2, 5).when(age <= 5, 10).otherwise(15), F.when(age <= 2, 1).when(age <= 5, 2).otherwise(3)
    return df.select("doc_id", "year", "cited_by", age.alias("age"), F.round(rate, 4).alias("velocity"), F.when(rate >= fast, "Fast").when(rate >= normal, "Normal").otherwise("Slow").alias("label"))


def trajectories(history: DataFrame, now: int) -> DataFrame:
    """history: doc_id, pub_year, cite_year, n. Total, peak, years to peak, early share (year 0 to 3), late share (from year 5), half-life, recent momentum."""
    w = Window.partitionBy("doc_id").orderBy("cite_year")
    t = history.withColumns({"age": F.col("cite_year") - F.col("pub_year"), "run": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(Window.partitionBy("doc_id"))})
    n = F.col("n")
    part = lambda ok: F.sum(F.when(ok, n).otherwise(0))
    out = t.groupBy("doc_id", "pub_year").agg(
        F.sum("n").alias("total"),
        F.max_by("age", F.struct("n", -F.col("age"))).alias("years_to_peak"),
        F.max("n").alias("peak"),
        (part(F.col("age").between(0, 3)) / F.sum("n")).alias("early_share"),
        (part(F.col("age") >= 5) / F.sum("n")).alias("late_share"),
        F.min(F.when(F.col("run") * 2 >= F.col("all"), F.col("age"))).alias("half_life"),
        (part(F.col("cite_year").between(now - 2, now)) / 3).alias("recent"),
        (part(F.col("cite_year").between(now - 5, now - 3)) / 3).alias("previous"),
    )
    return out.withColumn("momentum", F.col("recent") - F.col("previous"))


def pattern(now: int, total: str = "total") -> Column:
    """A label of a trajectory by ordered rules."""
    age = F.lit(now) - F.col("pub_year")
    return (
        F.when(F.col(total) == 0, "uncited")
        .when(age < 3, "too recent")
        .when((F.col("early_share") < 0.1) & (F.col("years_to_peak") >= 5), "sleeping beauty")
        .when((F.col("early_share") < 0.2) & (F.col("late_share") > 0.5), "delayed")
        .when((F.col("early_share") > 0.7) & (F.col("years_to_peak") <= 2), "flash")
        .when((F.col("late_share") > 0.3) & (F.col("half_life") >= 4), "evergreen")
        .otherwise("normal")
    )


def beauty(history: DataFrame) -> DataFrame:
    """(doc_id, beauty, awakening): sum over years up to the peak of ((line from year 0 to the peak) - n) / max(1, n), and the year farthest below that line.
    history: doc_id, pub_year, cite_year, n, a row for each year of each document."""
    t = history.withColumn("t", F.col("cite_year") - F.col("pub_year"))
    peak = t.groupBy("doc_id").agg(F.max_by("t", F.struct("n", -F.col("t"))).alias("tm"), F.max("n").alias("cm"), F.max(F.when(F.col("t") == 0, F.col("n"))).alias("c0"))
    t = t.join(peak, "doc_id").where((F.col("t") <= F.col("tm")) & (F.col("tm") > 0))
    line = (F.col("cm") - F.coalesce("c0", F.lit(0))) / F.col("tm") * F.col("t") + F.coalesce("c0", F.lit(0))
    gap = F.abs((F.col("cm") - F.coalesce("c0", F.lit(0))) * F.col("t") - F.col("tm") * F.col("n") + F.col("tm") * F.coalesce("c0", F.lit(0)))
    return t.groupBy("doc_id").agg(F.sum((line - F.col("n")) / F.greatest(F.lit(1), F.col("n"))).alias("beauty"), F.max_by("t", F.struct(gap, -F.col("t"))).alias("awakening"))


def self_citations(docs: DataFrame, cites: DataFrame) -> DataFrame:
    """(doc_id, n_cites, n_self): in-corpus citations of each document, and those that share an author with it."""
    own = docs.select(F.col("doc_id").alias("citing"), F.col("authors").alias("mine"))
    other = docs.select(F.col("doc_id").alias("cited"), F.col("authors").alias("theirs"))
    both = cites.join(own, "citing").join(other, "cited")
    shared = F.arrays_overlap(F.coalesce("mine", F.array()), F.coalesce("theirs", F.array()))
    return both.groupBy(F.col("citing").alias("doc_id")).agg(F.count("*").alias("n_cites"), F.sum(F.coalesce(shared, F.lit(False)).cast("long")).alias("n_self"))


def local_citations(cites: DataFrame) -> DataFrame:
    """(doc_id, local): how often the corpus cites each document."""
    return cites.groupBy(F.col("cited").alias("doc_id")).agg(F.count("*").alias("local"))


def storytellers(cites: DataFrame, chosen: DataFrame, at_least: int = 1) -> DataFrame:
    """(doc_id, n): documents that cite at_least of the chosen ones."""
    hits = cites.join(chosen.select(F.col("doc_id").alias("cited")), "cited", "left_semi")
    return hits.groupBy(F.col("citing").alias("doc_id")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def disruption(cites: DataFrame) -> DataFrame:
    """doc_id, n_i (citers that cite none of its references), n_j (that cite some), n_k (documents that cite its references but not it), cd, di.

    Joins of the edge list on the cited document, aggregated by (focal, citer) as soon as they are made.
    """
    e = cites.select("citing", "cited").distinct()
    direct = e.select(F.col("cited").alias("focal"), F.col("citing").alias("other"))
    refs = e.select(F.col("citing").alias("focal"), F.col("cited").alias("ref"))
    through = refs.join(e.select(F.col("cited").alias("ref"), F.col("citing").alias("other")), "ref").where("focal <> other").select("focal", "other").distinct()
    both = direct.withColumn("d", F.lit(1)).join(through.withColumn("t", F.lit(1)), ["focal", "other"], "full")
    n = lambda ok: F.sum(F.when(ok, 1).otherwise(0))
    d, t = F.col("d").isNotNull(), F.col("t").isNotNull()
    out = both.groupBy(F.col("focal").alias("doc_id")).agg(n(d & ~t).alias("n_i"), n(d & t).alias("n_j"), n(~d & t).alias("n_k"))
    cited = (F.col("n_i") + F.col("n_j")) > 0
    diff = F.col("n_i") - F.col("n_j")
    out = out.withColumns({"cd": F.when(cited, diff / (F.col("n_i") + F.col("n_j") + F.col("n_k"))), "di": F.when(cited, diff / (F.col("n_i") + F.col("n_j")))})
    return out.withColumn("label", F.when(F.col("cd") > 0.25, "disruptive").when(F.col("cd") < -0.25, "consolidating").when(cited, "neutral"))


def by_entity(metrics: DataFrame, docs: DataFrame, entity: str, metric: str = "cd", at_least: int = 1) -> DataFrame:
    """Mean, median, deviation, least and most of a metric for each entity of a list or a single column."""
    kind = docs.schema[entity].dataType.simpleString()
    rows = long(docs, entity) if kind.startswith("array") else docs.select("doc_id", F.col(entity).alias("item")).where("item IS NOT NULL")
    out = rows.join(metrics.select("doc_id", metric), "doc_id").where(F.col(metric).isNotNull()).groupBy("item")
    return out.agg(F.count("*").alias("n_docs"), F.avg(metric).alias("mean"), F.percentile(metric, 0.5).alias("median"), F.stddev_samp(metric).alias("std"), F.min(metric).alias("min"), F.max(metric).alias("max")).where(F.col("n_docs") >= at_least)


def pair_novelty(df: DataFrame, column: str) -> DataFrame:
    """doc_id with p90, mean and p10 of -ln(observed / (expected + 1) + 0.01) over its pairs of items; expected: product of the items' shares times the documents."""
    df = cut(df.select("doc_id", column))  # read four times
    rows = long(df, column)
    n = df.select(F.count("*")).scalar()
    count = rows.groupBy("item").agg(F.count("*").alias("k"))
    p = pairs(df, column)
    seen = p.groupBy("a", "b").agg(F.count("*").alias("observed"))
    a = count.select(F.col("item").alias("a"), F.col("k").alias("ka"))
    b = count.select(F.col("item").alias("b"), F.col("k").alias("kb"))
    scored = seen.join(a, "a").join(b, "b").withColumn("score", -F.log(F.col("observed") / (F.col("ka") * F.col("kb") / n + 1) + 0.01))
    each = p.join(scored.select("a", "b", "score"), ["a", "b"])
    return each.groupBy("doc_id").agg(F.percentile("score", 0.9).alias("p90"), F.avg("score").alias("mean"), F.percentile("score", 0.1).alias("p10"))


def keyword_novelty(df: DataFrame, column: str) -> DataFrame:
    """(doc_id, novelty): mean of 1 / frequency over the document's pairs."""
    p = pairs(df, column)
    seen = p.groupBy("a", "b").agg(F.count("*").alias("k"))
    return p.join(seen, ["a", "b"]).groupBy("doc_id").agg(F.avg(1 / F.col("k")).alias("novelty"))


def match_references(df: DataFrame, doi: str = "doi", refs: str = "references") -> DataFrame:
    """(citing, cited) edges: DOIs found in the reference texts that are another document's DOI; of documents with the same DOI the greatest id is meant."""
    from folioscope.functions.strings import normal_doi, reference_dois

    known = df.select(normal_doi(F.col(doi)).alias("d"), "doc_id").where("d IS NOT NULL").groupBy("d").agg(F.max("doc_id").alias("cited"))
    text = F.array_join(refs, "; ") if df.schema[refs].dataType.simpleString().startswith("array") else F.col(refs)
    rows = df.select(F.col("doc_id").alias("citing"), F.explode(reference_dois(text)).alias("d"))
    return rows.join(known, "d").where("citing <> cited").select("citing", "cited").distinct()


def internal_rate(df: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: documents, edges, documents that cite or are cited, and edges a document."""
    touched = edges.select(F.explode(F.array("citing", "cited")).alias("x")).select(F.countDistinct("x")).scalar()
    return df.agg(F.count("*").alias("documents"), F.max(edges.select(F.count("*")).scalar()).alias("edges"), F.max(touched).alias("linked")).withColumn("rate", F.col("edges") / F.col("documents"))


def cited_titles(df: DataFrame, references: str, threshold: float = 0.85) -> DataFrame:
    """(citing, cited): documents whose title, normalised, is that of a reference of another (references: a list of titles) or has a bigram similarity of the threshold or more with it."""
    own = df.select("doc_id", normal_title(F.col("title")).alias("t")).where("t IS NOT NULL")
    refs = df.select("doc_id", F.explode(references).alias("r")).select("doc_id", normal_title(F.col("r")).alias("t")).where("t IS NOT NULL").distinct()
    texts = own.select("t").union(refs.select("t")).distinct()
    near = similar_strings(texts.withColumn("all", F.lit(1)), "t", "t", ["all"], threshold).select("a", "b")
    same = texts.select(F.col("t").alias("a"), F.col("t").alias("b"))
    links = same.union(near).union(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    out = refs.select(F.col("doc_id").alias("citing"), F.col("t").alias("a")).join(links, "a").join(own.select(F.col("doc_id").alias("cited"), F.col("t").alias("b")), "b")
    return out.where("citing <> cited").select("citing", "cited").distinct()


def historiograph(df: DataFrame, edges: DataFrame) -> DataFrame:
    """(citing, cited, citing_year, cited_year, local): the citation graph in layers by year, with how often each cited document is cited in it. Edges to later years are left out."""
    year = df.select("doc_id", "year")
    t = edges.join(year.select(F.col("doc_id").alias("citing"), F.col("year").alias("citing_year")), "citing").join(year.select(F.col("doc_id").alias("cited"), F.col("year").alias("cited_year")), "cited")
    t = t.where("cited_year <= citing_year")
    return t.join(t.groupBy("cited").agg(F.count("*").alias("local")), "cited").select("citing", "cited", "citing_year", "cited_year", "local")


def pattern_from_totals(df: DataFrame, now: int) -> DataFrame:
    """doc_id, pattern, confidence and counts (year -> citations) where only total citations are known: an assumed course of citations over a paper's age, not a
    measured one. Years since publication weigh most after two years and fade by a fifth a year after that; a paper of five years or less follows a fixed course."""
    # fixed values: the weights, the bounds of the classes and their confidence
    early = F.array(*map(F.lit, (0.15, 0.25, 0.25, 0.20, 0.15)))
    c, age = F.col("cited_by"), (F.lit(now) - F.col("year")).cast("int")
    late = F.transform(F.sequence(F.lit(0), F.greatest(age, F.lit(1)) - 1), lambda i: F.greatest(F.lit(0.02), F.when(i <= 2, 0.15 + 0.1 * i).otherwise(0.35 * F.pow(F.lit(0.8), (i - 2).cast("double")))))
    weights = F.when(age <= 5, F.slice(early, F.lit(1), F.greatest(age, F.lit(1)))).otherwise(late)
    t = df.where("year IS NOT NULL").select("doc_id", "year", c.alias("c"), age.alias("age"), weights.alias("w"))
    t = t.withColumn("all", F.aggregate("w", F.lit(0.0), lambda a, x: a + x)).withColumn("part", F.transform("w", lambda x: F.floor(F.col("c") * (x / F.col("all")))))
    # what rounding down leaves goes to the first of the greatest years
    rest = F.col("c") - F.aggregate("part", F.lit(0).cast("long"), lambda a, x: a + x)
    top = F.array_position("part", F.array_max("part"))
    counts = F.transform("part", lambda x, i: x + F.when(i + 1 == top, rest).otherwise(F.lit(0)))
    known = (F.col("c") > 0) & (F.col("age") >= 3)
    rate = F.col("c") / F.col("age")
    evergreen, flash, late_found = (F.col("age") >= 10) & (rate >= 2), (F.col("age") >= 8) & (rate < 0.5), (F.col("age") >= 10) & (F.col("c") > 50)
    pattern = F.when(F.col("c") == 0, "uncited").when(F.col("age") < 3, "too_recent").when(evergreen, "evergreen").when(flash, "flash_in_the_pan").when(late_found, "delayed_recognition").otherwise("normal")
    sure = F.when(F.col("c") == 0, 0.5).when(F.col("age") < 3, 0.3).when(evergreen, 0.4).when(flash, 0.35).when(late_found, 0.3).otherwise(0.5)
    years = F.transform("part", lambda x, i: F.col("year") + i)
    return t.select("doc_id", pattern.alias("pattern"), sure.alias("confidence"), F.when(known, F.map_from_arrays(years, counts)).alias("counts"))
