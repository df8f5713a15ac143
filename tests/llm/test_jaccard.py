import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm import jaccard
from folioscope.llm.jaccard import Similarity
from tests.llm.conftest import prose


def plain_classes(texts, sim):
    """Component (least index) and set size of each text, by comparing all pairs."""
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for t in texts:
        w = (t or "").translate(low).encode().split()
        sets.append({tuple(w[i : i + sim.k]) for i in range(len(w) - sim.k + 1)} if len(w) >= sim.k else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and sim.den * len(sets[i] & sets[j]) >= sim.num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [(find(i), len(s)) for i, s in enumerate(sets)]


def corpus(seed, n=160):
    """Families of texts with edits from none to many, short ones, and a line that many share."""
    rng = random.Random(seed)
    texts = []
    while len(texts) < n:
        words = prose(rng, rng.choice([1, 3, 8, 12, 15, 30, 60, 120]), [f"w{k}" for k in range(60)]).split()
        if rng.random() < 0.4:
            words += "a very common line that stands in many texts of this table".split()
        for _ in range(rng.choice([1, 1, 2, 6, 14])):
            own = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                own[rng.randrange(len(own))] = f"e{rng.randrange(1000)}"
            texts.append(" ".join(own))
    return texts[:n]


def classes_of(spark, texts, sim):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in jaccard.classes(df, sim).collect()}


@pytest.mark.parametrize("sim", [Similarity(3, 90, 100), Similarity(5, 80, 100)])
def test_against_all_pairs(spark, sim):
    texts = corpus(1)
    assert classes_of(spark, texts, sim) == dict(enumerate(plain_classes(texts, sim)))


@pytest.mark.parametrize("light,block,subsets", [(1, 60, 120), (1, 10**6, 0), (3, 200, 10)])
def test_paths_agree(spark, monkeypatch, light, block, subsets):
    """Long lists in blocks, one block, no subsets: the same classes."""
    monkeypatch.setattr(jaccard, "LIGHT", light)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(jaccard, "MOST_SUBSETS", subsets)
    texts, sim = corpus(7), Similarity(3, 85, 100)
    assert classes_of(spark, texts, sim) == dict(enumerate(plain_classes(texts, sim)))


def test_scan_lists():
    import numpy as np

    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(20) for _ in range(rng.randrange(1, 15))])) for _ in range(40)]
    sim = Similarity(3, 60, 100)
    a, b = jaccard.scan_lists(sets, sim)
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    plain = {(i, j) for j in range(40) for i in range(j) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))}
    assert got == plain


def test_odd_rows(spark, odd, empty):
    rows = jaccard.classes(odd, Similarity(3, 90, 100)).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for i in (0, 1, 2) for r in by[i])
    assert by[3][0]["n_shingles"] == 1 and by[8][0]["n_shingles"] == 1
    assert by[6][0]["component_id"] == 5 and sorted(r["component_id"] for r in by[5]) == [5, 5, 5]
    assert {r["component_id"] for r in by[None]} == {5, None}
    assert jaccard.classes(empty).collect() == []


def test_deduplicated(spark, odd, empty):
    out = jaccard.deduplicated(odd, Similarity(3, 90, 100))
    assert out.columns == odd.columns
    texts = [r["text"] for r in out.collect()]
    words = [t for t in texts if t and t.split()]
    assert len(words) == len(set(words)) and texts.count(None) == 2 and "" in texts
    assert jaccard.deduplicated(empty).collect() == []
    texts = corpus(11, 120)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sim = Similarity()
    want = {c for c, n in plain_classes(texts, sim)}
    assert {r["doc_id"] for r in jaccard.deduplicated(df, sim).collect()} == want


def test_chain_of_links(spark):
    """A component whose ends are far apart."""
    base = [f"t{k}" for k in range(400)]
    texts = [" ".join(base[i * 6 : i * 6 + 150]) for i in range(30)]
    sim = Similarity(3, 90, 100)
    assert {c for c, _ in classes_of(spark, texts, sim).values()} == {0}


def test_scan_is_linear(spark, sf):
    """The met-once count sends a few bytes a shingle, however many ranges there are."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    sizes = {}
    for n in (64, 6400):
        rows = jaccard.scan_sets(docs, Similarity(), n, "doc_id", "text").where("range IS NOT NULL").selectExpr("sum(length(owners) + length(remainders) + 16) AS n", "sum(length(remainders)) / 4 AS shingles").first()
        sizes[n] = rows["n"] / rows["shingles"]
    assert sizes[64] < 6 and sizes[6400] < 8, sizes


def test_shingle_of_all_documents(spark):
    """A line that all documents share isn't sent once a document: no range is larger than the others."""
    largest = {}
    for n in (2000, 8000):
        df = spark.range(n).selectExpr("id AS doc_id", "concat('one line of many words that they all share ', array_join(transform(sequence(1, 12), i -> hash(id, i)), ' ')) AS text")
        by = jaccard.scan_sets(df.coalesce(1), Similarity(), 64, "doc_id", "text").where("range IS NOT NULL").groupBy("range").agg(F.sum(F.expr("length(owners) + length(remainders)")).alias("n"))
        r = by.agg(F.max("n").alias("most"), F.median("n").alias("middle")).first()
        largest[n] = r["most"] / r["middle"]
    assert max(largest.values()) < 1.5, largest
    texts = ["one line of many words that they all share"] * 3 + [f"one line of many words that they all share {i} {i} {i + 1}" for i in range(40)]
    for sim in (Similarity(3, 60, 100), Similarity()):
        assert classes_of(spark, texts, sim) == dict(enumerate(plain_classes(texts, sim)))
