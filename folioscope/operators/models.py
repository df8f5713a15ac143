"""Topics, clusters, classifiers and recommenders on the engine's own machine learning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import blocks
from folioscope.operators.counting import tokens
from folioscope.operators.longform import cut, kept, long


def topics(df: DataFrame, text: str, k: int = 10, vocabulary: int = 1 << 18, rounds: int = 20, seed: int = 1, share: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(topic, terms) and (doc_id, topic, weight) of latent Dirichlet allocation; topics are numbered from 1, texts without words have none. share: of the texts, that a round learns from."""
    words = kept(df.select("doc_id", tokens(text, r"\p{L}{3,}").alias("words")).where(F.size("words") > 0))  # texts are taken apart once
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(words)
    counted = kept(counter.transform(words).select("doc_id", "features"))  # read in every round
    model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online", subsamplingRate=share).fit(counted)
    terms = df.sparkSession.createDataFrame([(r["topic"] + 1, [counter.vocabulary[i] for i in r["termIndices"]]) for r in model.describeTopics(10).collect()], "topic int, terms array<string>")  # k rows
    dist = model.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("d"))
    return terms, dist.select("doc_id", (F.array_position("d", F.array_max("d"))).cast("int").alias("topic"), F.array_max("d").alias("weight"))


def cluster_texts(df: DataFrame, text: str, k: int = 5, vocabulary: int = 1 << 18, seed: int = 1) -> DataFrame:
    """(doc_id, cluster) by k-means of TF-IDF rows of length 1."""
    words = kept(df.select("doc_id", tokens(text, r"\p{L}{3,}").alias("words")))  # texts are taken apart once
    counted = kept(CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocabulary).fit(words).transform(words).select("doc_id", "tf"))
    stages = [IDF(inputCol="tf", outputCol="idf"), Normalizer(inputCol="idf", outputCol="features"), KMeans(k=k, seed=seed, predictionCol="cluster")]
    return Pipeline(stages=stages).fit(counted).transform(counted).select("doc_id", "cluster")


def cluster_vectors(df: DataFrame, vector: str, ks: list[int], key: str = "vec_id", seed: int = 1) -> DataFrame:
    """(key, cluster, k, silhouette) for the k of the best silhouette."""
    t = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    t = cut(t)  # read for each k
    best = None
    for k in ks:
        out = KMeans(k=k, seed=seed, predictionCol="cluster").fit(t).transform(t)
        s = ClusteringEvaluator(predictionCol="cluster").evaluate(out)
        if best is None or s > best[0]:
            best = (s, k, out)
    return best[2].select(key, "cluster", F.lit(best[1]).alias("k"), F.lit(best[0]).alias("silhouette"))


def components_of(df: DataFrame, vector: str, k: int = 2, key: str = "vec_id") -> DataFrame:
    """(key, coordinates) by principal components."""
    t = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("features"))
    return PCA(k=k, inputCol="features", outputCol="p").fit(t).transform(t).select(key, vector_to_array("p").alias("coordinates"))


def classify_texts(df: DataFrame, text: str, label: str, vocabulary: int = 1 << 18) -> DataFrame:
    """(doc_id, prediction, probability) of a logistic regression on TF-IDF, fitted on rows with a label, applied to all."""
    t = df.select("doc_id", tokens(text).alias("words"), F.col(label).cast("double").alias("label"))
    stages = [CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocabulary), IDF(inputCol="tf", outputCol="features"), LogisticRegression(maxIter=30, regParam=0.01)]
    model = Pipeline(stages=stages).fit(t.where("label IS NOT NULL"))
    return model.transform(t).select("doc_id", "prediction", vector_to_array("probability")[1].alias("probability"))


def predict_citations(df: DataFrame, features: list[str], seed: int = 1) -> DataFrame:
    """(doc_id, cited_by, predicted) of a random forest on numeric columns."""
    t = df.select("doc_id", F.col("cited_by").cast("double").alias("label"), array_to_vector(F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features))).alias("features"))
    model = RandomForestRegressor(numTrees=20, maxDepth=5, seed=seed).fit(t)
    return model.transform(t).select("doc_id", F.col("label").alias("cited_by"), F.col("prediction").alias("predicted"))


def similar_authors(df: DataFrame, top_n: int = 10, exclude_coauthors: bool = True) -> DataFrame:
    """(a, b, cosine, rank): for each author the top_n others by cosine of keyword counts, those of common documents left out.
    Authors are dealt into groups, and a task multiplies the rows of two groups: only the top_n of an author in a group leave it, so no pair of authors is a row before that."""
    t = df.select("doc_id", "authors", "keywords").withColumn("a", F.explode("authors"))
    k = t.select("a", F.explode("keywords").alias("k")).groupBy("a", "k").agg(F.count("*").cast("double").alias("n"))
    k = k.withColumn("n", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("a")))).where("a IS NOT NULL AND k IS NOT NULL")
    rows = kept(k.groupBy("a").agg(F.collect_list(F.struct("k", "n")).alias("x")).select("a", F.col("x.k").alias("ks"), F.col("x.n").alias("ns")))
    n, most = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("ks")), F.lit(0))).first()
    g = max(n // blocks.TASK_ROWS, most // blocks.TASK_ITEMS) + 1
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(g - 1).cast("long")))
    group = lambda c: F.pmod(F.xxhash64(c), F.lit(g)).cast("long")
    none = F.lit(None).cast(rows.schema["a"].dataType).alias("b")
    sent = rows.select(group("a").alias("i"), every.alias("j"), F.lit(0).alias("side"), "a", none, "ks", "ns")
    sent = sent.union(rows.select(every.alias("i"), group("a").alias("j"), F.lit(1), "a", none, "ks", "ns"))
    if exclude_coauthors:
        met = t.select("a", F.explode("authors").alias("b")).where("a <> b").distinct()
        sent = sent.union(met.select(group("a"), group("b"), F.lit(2), "a", "b", F.lit(None).cast(rows.schema["ks"].dataType), F.lit(None).cast("array<double>")))
    kind = rows.schema["a"].dataType.simpleString()
    pairs = sent.repartition(g * g, "i", "j").groupBy("i", "j").applyInArrow(lambda x: _nearest(x, top_n), f"a {kind}, b {kind}, cosine double")
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("cosine", 9)), "b"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= top_n)


def _nearest(t: pa.Table, top_n: int) -> pa.Table:
    """(a, b, cosine): the top_n of side 1 for each row of side 0, of equal ones the least; pairs of side 2 and an author itself are left out."""
    side = t["side"].to_numpy()
    left, right, met = (t.filter(pa.array(side == i)) for i in range(3))
    mine = left["a"].combine_chunks()
    names, (at,) = blocks.coded(right["a"])
    (lk, lr), (rk, rr) = blocks.items(left["ks"]), blocks.items(right["ks"])
    words, (lk, rk) = blocks.coded(lk, rk)
    lv, rv = (blocks.items(x["ns"])[0].to_numpy() for x in (left, right))
    n, top = len(names), min(top_n, len(names))
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    where = lambda x, among: pc.fill_null(pc.index_in(x, value_set=among), -1).to_numpy().astype(np.int64)
    no_a, no_b = np.append(np.arange(len(left)), where(met["a"], mine)), np.append(where(left["a"], names), where(met["b"], names))
    no_a, no_b = no_a[no_b >= 0], no_b[no_b >= 0]
    for first, x in blocks.products((lr, lk, lv), (at[rr], rk, rv), len(left), n, len(words)) if top else ():
        no = (no_a >= first) & (no_a < first + len(x))
        x[no_a[no] - first, no_b[no]] = 0.0
        # nine digits, then the names' order, in one number
        key = np.rint(x * 1e9) * n + np.arange(n - 1, -1, -1)
        key[x <= 0] = -1
        best = np.argpartition(key, n - top, axis=1)[:, n - top :]
        i, j = np.nonzero(np.take_along_axis(key, best, 1) >= 0)
        out.append((i + first, best[i, j], x[i, best[i, j]]))
    a, b, cosine = (np.concatenate(c) for c in zip(*out, strict=True))
    return pa.table({"a": mine.take(pa.array(a)), "b": names.take(pa.array(b)), "cosine": cosine})


def experts(df: DataFrame, topics_: list[str], now: int, min_docs: int = 2) -> DataFrame:
    """(item, matches, documents, citations, recent) of authors with documents on the topics, with min_docs documents in all."""
    t = df.select("doc_id", "year", "cited_by", "keywords", F.explode("authors").alias("item"))
    hit = F.size(F.array_intersect("keywords", F.array(*map(F.lit, topics_)))) > 0
    return t.groupBy("item").agg(F.sum(hit.cast("long")).alias("matches"), F.count("*").alias("documents"), F.sum("cited_by").alias("citations"), F.sum((F.col("year") > now - 3).cast("long")).alias("recent")).where((F.col("matches") > 0) & (F.col("documents") >= min_docs))


def venues(df: DataFrame, topics_: list[str], at_least: int = 3) -> DataFrame:
    """(source, match, mean_citations, score): 0.6 of the share of documents on the topics and 0.4 of the mean citations over the greatest."""
    hit = F.size(F.array_intersect(F.coalesce("keywords", F.array()), F.array(*map(F.lit, topics_)))) > 0
    t = df.groupBy("source").agg(F.avg(hit.cast("double")).alias("match"), F.avg("cited_by").alias("mean_citations"), F.count("*").alias("n")).where(F.col("n") >= at_least)
    return t.withColumn("score", 0.6 * F.col("match") + 0.4 * F.col("mean_citations") / t.select(F.max("mean_citations")).scalar()).drop("n")


def country_profile(df: DataFrame) -> DataFrame:
    """(item, papers, citations, mean_citations, international, h): by country of the authors; international: share of papers with another country."""
    from folioscope.operators.indices import h_indices

    rows = long(df, "countries", ["doc_id", "cited_by", "countries"]).withColumn("i", (F.size("countries") > 1).cast("double"))
    return rows.groupBy("item").agg(F.count("*").alias("papers"), F.sum("cited_by").alias("citations"), F.avg("cited_by").alias("mean_citations"), F.avg("i").alias("international")).join(h_indices(rows, "item"), "item")


def thematic_map(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, centrality, density): weight of links out of a community and mean weight of its links inside (Callon)."""
    c = communities.select("node", "community")
    e = edges.join(c.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("n").alias("w"))
    out = e.where("ca <> cb").select(F.explode(F.array("ca", "cb")).alias("community"), "n").groupBy("community").agg(F.sum("n").alias("centrality"))
    size = c.groupBy("community").agg(F.count("*").alias("size"))
    return size.join(inside, "community", "left").join(out, "community", "left").select("community", "size", F.coalesce("centrality", F.lit(0)).alias("centrality"), (100.0 * F.coalesce("w", F.lit(0)) / F.col("size")).alias("density"))


def sequential_topics(df: DataFrame, text: str, k: int = 5, size: int = 5, vocabulary: int = 1 << 18, rounds: int = 10, seed: int = 1) -> DataFrame:
    """(start, topic, term, weight) of topics fitted in each window of years; one vocabulary for all windows, so topics can be compared."""
    from folioscope.operators.timeseries import windows

    t = windows(df.select("doc_id", "year", text), size).select("doc_id", "start", tokens(text, r"\p{L}{3,}").alias("words")).where(F.size("words") > 0)
    counter = CountVectorizer(inputCol="words", outputCol="features", vocabSize=vocabulary, minDF=2.0).fit(t)
    rows = []
    for start in sorted(r["start"] for r in t.select("start").distinct().collect()):  # a model for each window
        model = LDA(k=k, maxIter=rounds, seed=seed, optimizer="online").fit(counter.transform(t.where(F.col("start") == start)))
        for r in model.describeTopics(20).collect():  # k rows
            rows += [(start, r["topic"] + 1, counter.vocabulary[i], w) for i, w in zip(r["termIndices"], r["termWeights"], strict=True)]
    return df.sparkSession.createDataFrame(rows, "start int, topic int, term string, weight double")


def nmf(weights: DataFrame, k: int = 10, rounds: int = 50, by: str = "start") -> tuple[DataFrame, DataFrame]:
    """(by, doc_id, w0 ... ) and (by, term, h0 ...): non-negative factors of each part's matrix of documents and terms, by multiplicative updates on (by, doc_id, term, weight).
    All parts are fitted at once; a round is two joins and sums, and only the products of k x k factors are shared. The start is drawn by a hash, so results repeat."""
    t = cut(weights.select(by, "doc_id", "term", "weight"))

    def drawn(key: str, name: str) -> DataFrame:
        first = lambda i: ((F.pmod(F.xxhash64(F.lit(f"{name}{i}"), F.col(by), F.col(key)), F.lit(1 << 20)) + 1) / (1 << 20)).alias(f"{name}{i}")
        return t.select(by, key).distinct().select(by, key, *map(first, range(k)))

    def updated(own: DataFrame, key: str, a: str, other: DataFrame, far: str, b: str) -> DataFrame:
        """own * (X other) / (own (other' other))."""
        top = t.join(other, [by, far]).groupBy(by, key).agg(*(F.sum(F.col("weight") * F.col(f"{b}{i}")).alias(f"n{i}") for i in range(k)))
        gram = other.groupBy(by).agg(*(F.sum(F.col(f"{b}{i}") * F.col(f"{b}{j}")).alias(f"g{i}_{j}") for i in range(k) for j in range(i, k)))
        below = lambda i: sum((F.col(f"g{min(i, j)}_{max(i, j)}") * F.col(f"{a}{j}") for j in range(k)), F.lit(1e-12))
        return cut(own.join(top, [by, key]).join(gram, by).select(by, key, *((F.col(f"{a}{i}") * F.col(f"n{i}") / below(i)).alias(f"{a}{i}") for i in range(k))))

    w, h = drawn("doc_id", "w"), drawn("term", "h")
    for _ in range(rounds):
        h = updated(h, "term", "h", w, "doc_id", "w")
        w = updated(w, "doc_id", "w", h, "term", "h")
    return w, h


def sequential_nmf(df: DataFrame, text: str, k: int = 10, size: int = 5, rounds: int = 50, top: int = 20, min_df: int = 2) -> DataFrame:
    """(start, topic, term, weight): the top terms of topics fitted in each window of years, over one TF-IDF for all windows, so topics can be compared (aligned_topics)."""
    from folioscope.operators.text import tfidf
    from folioscope.operators.timeseries import windows

    when = windows(df.select("doc_id", "year"), size).select("doc_id", "start")
    _, h = nmf(tfidf(df, text, min_df).join(when, "doc_id"), k, rounds)
    each = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("topic"), F.col(f"h{i}").alias("weight")) for i in range(k))))
    rows = h.select("start", "term", each.alias("x")).select("start", "x.topic", "term", "x.weight")
    place = F.row_number().over(Window.partitionBy("start", "topic").orderBy(F.desc("weight"), "term"))
    return rows.withColumn("i", place).where(F.col("i") <= top).drop("i")


def aligned_topics(topics_: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(start, topic, next, next_topic, cosine): each topic's most similar one in the next window, at least threshold. topics_: (start, topic, term, weight)."""
    t = topics_.withColumn("weight", F.col("weight") / F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("start", "topic"))))
    starts = t.select("start").distinct().withColumn("next", F.lead("start").over(Window.orderBy("start")))  # a row for each window
    a = t.join(starts, "start")
    b = t.select(F.col("start").alias("next"), F.col("topic").alias("next_topic"), "term", F.col("weight").alias("w"))
    c = a.join(b, ["next", "term"]).groupBy("start", "topic", "next", "next_topic").agg(F.sum(F.col("weight") * F.col("w")).alias("cosine"))
    place = F.row_number().over(Window.partitionBy("start", "topic").orderBy(F.desc("cosine"), "next_topic"))
    return c.withColumn("i", place).where((F.col("i") == 1) & (F.col("cosine") >= threshold)).drop("i")


def semantic_dispersion(weights: DataFrame, members: DataFrame) -> DataFrame:
    """(group_name, n, dispersion): one minus the mean cosine of a group's documents to their mean. weights: (doc_id, term, weight) of length 1."""
    t = weights.join(members, "doc_id")
    n = members.groupBy("group_name").agg(F.count("*").alias("n"))
    # for rows of length 1 the mean cosine to the mean vector m is |m|
    mean = t.groupBy("group_name", "term").agg(F.sum("weight").alias("s")).join(n, "group_name").groupBy("group_name", "n").agg(F.sqrt(F.sum(F.pow(F.col("s") / F.col("n"), F.lit(2)))).alias("m"))
    return mean.select("group_name", "n", (1 - F.col("m")).alias("dispersion"))
