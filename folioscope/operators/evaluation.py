"""Evaluation of classifiers, term effects, correspondence analysis, topics over time, comparison of entities."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.counting import tokens
from folioscope.operators.longform import kept, running


def cross_validate(df: DataFrame, text: str, label: str, folds: int = 5, vocabulary: int = 1 << 18) -> DataFrame:
    """(fold, n, accuracy, precision, recall, f1) of a logistic regression on TF-IDF; folds by a hash of doc_id."""
    t = df.where(F.col(label).isNotNull()).select("doc_id", tokens(text).alias("words"), F.col(label).cast("double").alias("label")).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(folds)))
    out = None
    for k in range(folds):
        stages = [CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocabulary), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=20, regParam=0.01)]
        p = Pipeline(stages=stages).fit(t.where(F.col("fold") != k)).transform(t.where(F.col("fold") == k))
        hit = lambda a, b: F.sum(((F.col("label") == a) & (F.col("prediction") == b)).cast("double"))
        one = p.agg(F.lit(k).alias("fold"), F.count("*").alias("n"), hit(1, 1).alias("tp"), hit(0, 1).alias("fp"), hit(1, 0).alias("fn"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("accuracy"))
        out = one if out is None else out.union(one)
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return out.select("fold", "n", "accuracy", F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0).alias("precision"), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0).alias("recall"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def term_effects(df: DataFrame, text: str, label: str, top_n: int = 20) -> DataFrame:
    """(term, coefficient, std_error, p) of a binomial model on the presence of the top terms."""
    t = df.where(F.col(label).isNotNull()).select(F.array_distinct(tokens(text, r"\p{L}{3,}")).alias("w"), F.col(label).cast("double").alias("label"))
    n = t.count()
    by = t.select(F.explode("w").alias("term")).groupBy("term").count().where((F.col("count") > 0.05 * n) & (F.col("count") < 0.95 * n))
    terms = [r["term"] for r in by.orderBy(F.desc("count"), "term").limit(top_n).collect()]
    x = t.select("label", array_to_vector(F.array(*(F.array_contains("w", k).cast("double") for k in terms))).alias("features"))
    model = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=25, regParam=0.0).fit(x)
    errors, ps = model.summary.coefficientStandardErrors, model.summary.pValues
    return df.sparkSession.createDataFrame([(k, float(model.coefficients[i]), float(errors[i]), float(ps[i])) for i, k in enumerate(terms)], "term string, coefficient double, std_error double, p double")


def correspondence(cells: DataFrame, row: str, col: str, n: str = "n", axes: int = 2, most: int = 1000) -> DataFrame:
    """(kind, item, coordinates, inertia) of rows and columns of a contingency table of any number of rows and at most `most` columns. Only the columns' products, summed over
    the rows in the engine, come to the driver (most x most numbers, checked first); rows get their coordinates from the columns'. Each axis points to its largest column entry."""
    spark = cells.sparkSession
    t = cells.groupBy(F.col(row).cast("string").alias("r"), F.col(col).cast("string").alias("c")).agg(F.sum(F.col(n).cast("double")).alias("n")).where("n > 0 AND r IS NOT NULL AND c IS NOT NULL")
    sums = t.groupBy("c").agg(F.sum("n").alias("s")).limit(most + 1).collect()
    if len(sums) > most:
        raise ValueError(f"more than {most} columns: take the top items first")
    place = {c: i for i, c in enumerate(sorted(x["c"] for x in sums))}
    shape = "kind string, item string, coordinates array<double>, inertia array<double>"
    if not place:
        return spark.createDataFrame([], shape)
    mass = np.zeros(len(place))
    for x in sums:
        mass[place[x["c"]]] = x["s"]
    total = mass.sum()
    root = np.sqrt(mass / total)
    whole = t.groupBy(F.col("r").alias("_r")).agg(F.sum("n").alias("m"))
    left, right = t.select("r", F.col("c").alias("a"), F.col("n").alias("x")), t.select(F.col("r").alias("r2"), F.col("c").alias("b"), F.col("n").alias("y"))
    products = left.join(whole, F.col("r") == F.col("_r")).join(right, (F.col("r") == F.col("r2")) & (F.col("a") <= F.col("b"))).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y") / F.col("m")).alias("g"))
    g = np.zeros((len(place), len(place)))
    for x in products.collect():  # most * (most + 1) / 2 rows at most
        g[place[x["a"]], place[x["b"]]] = g[place[x["b"]], place[x["a"]]] = x["g"]
    values, v = np.linalg.eigh(g / total / np.outer(root, root) - np.outer(root, root))
    order = np.argsort(-values)
    values, v = np.clip(values[order], 0, None), v[:, order]
    k = min(axes, len(values))
    v = (v * np.sign(v[np.abs(v).argmax(0), np.arange(len(values))]))[:, :k]
    share = [float(x) for x in values[:k] / max(values.sum(), 1e-300)]
    standard, shift = v / root[:, None], root @ v
    inertia = F.array(*(F.lit(x) for x in share))
    columns = spark.createDataFrame([(c, [float(x) for x in standard[i]], [float(x) for x in standard[i] * np.sqrt(values[:k])]) for c, i in place.items()], "_c string, standard array<double>, own array<double>")
    at = [(F.sum(F.col("n") * F.col("standard")[a]) / F.sum("n") - F.lit(float(shift[a]))).alias(f"x{a}") for a in range(k)]
    rows = t.join(F.broadcast(columns), F.col("c") == F.col("_c")).groupBy("r").agg(*at)
    of_rows = rows.select(F.lit("row").alias("kind"), F.col("r").alias("item"), F.array(*(f"x{a}" for a in range(k))).alias("coordinates"), inertia.alias("inertia"))
    return of_rows.union(columns.select(F.lit("column"), "_c", "own", inertia))


def topic_trends(doc_topics: DataFrame, df: DataFrame) -> DataFrame:
    """(topic, year, n, share) of documents by their topic; share of the year's documents with one."""
    t = doc_topics.join(df.select("doc_id", "year"), "doc_id").groupBy("topic", "year").agg(F.count("*").alias("n"))
    return t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("year")))


def topic_coherence(terms: DataFrame, df: DataFrame, text: str, top: int = 10) -> DataFrame:
    """(topic, coherence): mean over pairs of a topic's top terms of ln((documents with both + 1) / documents with the first)."""
    t = terms.select("topic", F.posexplode(F.slice("terms", 1, top)).alias("i", "term"))
    # texts are taken apart once, and only the topics' terms stay; pairs of them are made inside the row
    named = t.select(F.coalesce(F.collect_set("term"), F.array().cast("array<string>"))).scalar()
    docs = kept(df.select("doc_id", F.array_intersect(tokens(text, r"\p{L}{3,}"), named).alias("found")).where(F.size("found") > 0))
    have = docs.select(F.explode("found").alias("term")).groupBy("term").agg(F.count("*").alias("k"))
    two = docs.select(F.col("found").alias("others"), F.explode("found").alias("term")).select("term", F.explode("others").alias("other")).where("term <> other")
    both = two.groupBy("term", "other").agg(F.count("*").alias("b"))
    p = t.join(t.select("topic", F.col("i").alias("j"), F.col("term").alias("other")), "topic").where("i < j").join(both, ["term", "other"], "left").join(have, "term")
    return p.groupBy("topic").agg(F.avg(F.log((F.coalesce("b", F.lit(0)) + 1) / F.col("k"))).alias("coherence"))


def compare_entities(metrics: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """metrics with each column scaled to 0..1 and its descending rank (a row for each entity compared)."""
    change, t = {}, metrics
    for c in columns:
        lo, hi = metrics.select(F.min(c)).scalar(), metrics.select(F.max(c)).scalar()
        change[f"{c}_scaled"] = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)
        # the rank of a value: one more than the entities with a greater one
        hist = running(metrics.groupBy(F.col(c).alias("_v")).agg(F.count("*").alias("_k")), [F.desc("_v")], {"_upto": "_k"})
        t = t.join(hist.select("_v", (F.col("_upto") - F.col("_k") + 1).alias(f"{c}_rank")), F.col(c).eqNullSafe(F.col("_v"))).drop("_v")
    return t.withColumns(change).select(key, *columns, *(x for c in columns for x in (f"{c}_scaled", f"{c}_rank")))


def citation_features(df: DataFrame) -> DataFrame:
    """doc_id with numbers of authors, keywords, references and countries, and what was known before: mean citations of the source's and authors' earlier documents."""
    size = lambda c: F.size(F.coalesce(c, F.array())).cast("double")
    base = df.select("doc_id", "year", "source", "cited_by", *(size(c).alias(f"n_{c}") for c in ("authors", "keywords", "refs", "countries")))
    w = lambda k: Window.partitionBy(k).orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    base = base.withColumn("source_before", F.avg("cited_by").over(w("source")))
    a = df.select("doc_id", "year", "cited_by", F.explode("authors").alias("a")).withColumn("before", F.avg("cited_by").over(w("a"))).groupBy("doc_id").agg(F.avg("before").alias("authors_before"))
    return base.join(a, "doc_id", "left")


def sentiment_by_entity(scores: DataFrame, df: DataFrame, column: str, score: str = "polarity", at_least: int = 5) -> DataFrame:
    """(item, n, mean, std) of a score over documents of each item."""
    kind = df.schema[column].dataType.simpleString()
    t = df.select("doc_id", (F.explode(column) if kind.startswith("array") else F.col(column)).alias("item")).join(scores, "doc_id")
    return t.groupBy("item").agg(F.count("*").alias("n"), F.avg(score).alias("mean"), F.stddev_samp(score).alias("std")).where(F.col("n") >= at_least)


def probability(column: str = "probability"):
    """The second class's probability of a classifier's vector."""
    return vector_to_array(column)[1]
