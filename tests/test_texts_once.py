"""Fits over texts take them apart once, not for each step and round."""

import math

import pytest
from pyspark.sql import functions as F

from folioscope.operators import evaluation, models

TEXTS = ["red green blue red", "red green stone", "stone iron copper", "iron copper red iron", "green blue", None, "of", "copper stone iron blue"] * 3


@pytest.fixture
def read(spark):
    """Texts, and how often one was read."""
    n = spark.sparkContext.accumulator(0)

    def seen(x):
        n.add(1)
        return x

    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string").select("doc_id", F.udf(seen, "string")("text").alias("text"))
    return df, n


def test_cluster_texts(read):
    df, n = read
    assert {r["doc_id"] for r in models.cluster_texts(df, "text", 2).collect()} == set(range(len(TEXTS))) and n.value == len(TEXTS)


def test_topics(read):
    df, n = read
    terms, dist = models.topics(df, "text", 2, rounds=3)
    assert dist.count() == sum(len(t or "") > 2 for t in TEXTS)
    # once by the filter and once by the column, where a column of Python is read
    assert terms.count() == 2 and n.value <= 2 * len(TEXTS)


def test_topic_coherence(spark, read):
    df, n = read
    top = {1: ["red", "green", "none"], 2: ["iron", "copper", "red"]}
    terms = spark.createDataFrame(list(top.items()), "topic int, terms array<string>")
    got = {r["topic"]: r["coherence"] for r in evaluation.topic_coherence(terms, df, "text").collect()}
    assert n.value <= 2 * len(TEXTS)
    holds = lambda *w: sum(all(x in (t or "").split() for x in w) for t in TEXTS)
    for topic, words in top.items():
        each = [math.log((holds(a, b) + 1) / holds(a)) for i, a in enumerate(words) for b in words[i + 1 :]]
        assert got[topic] == pytest.approx(sum(each) / len(each))


def test_topic_coherence_of_whole_topics(spark, sf, monkeypatch):
    """The query's topics are the whole fit's, over all texts in each of its rounds, and all ten terms count."""
    from folioscope.plans import registry

    asked, fit = [], models.LDA
    monkeypatch.setattr(models, "LDA", lambda **how: asked.append(how) or fit(**how | {"maxIter": 1}))
    assert registry.QUERIES["topic_coherence"](spark, sf).count() == 10
    assert [(a["k"], a["maxIter"], a["subsamplingRate"]) for a in asked] == [(10, 20, 1.0)]
    words = ["red", "green", "blue", "stone", "iron", "copper"]
    df = spark.createDataFrame([(0, " ".join(words)), (1, "red green blue stone iron")], "doc_id int, text string")
    got = evaluation.topic_coherence(spark.createDataFrame([(1, words)], "topic int, terms array<string>"), df, "text").first()["coherence"]
    assert got == pytest.approx((10 * math.log(3 / 2) + 5 * math.log(2 / 2)) / 15)
