"""Products of rows between groups of rows."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from folioscope.operators import blocks, models, quality


@pytest.fixture
def small_tasks(monkeypatch):
    """Several groups, few items as a matrix, few rows at a time."""
    for name, n in {"TASK_ROWS": 12, "WHOLE_ITEMS": 3, "PRODUCTS": 40}.items():
        monkeypatch.setattr(blocks, name, n)


def test_products(small_tasks):
    """As the matrices' product, a few rows at a time, by the matrix of frequent items and by lists; also without rows."""
    rng = np.random.default_rng(4)
    a, b = (np.where(rng.random((n, 20)) < 0.2, rng.integers(1, 9, (n, 20)), 0).astype(float) for n in (17, 13))
    sparse = lambda m: (*np.nonzero(m), m[np.nonzero(m)])
    parts = list(blocks.products(sparse(a), sparse(b), 17, 13, 20))
    assert len(parts) > 3 and [f for f, _ in parts] == list(range(0, 17, 3)) and np.array_equal(np.vstack([x for _, x in parts]), a @ b.T)
    assert list(blocks.products(sparse(a[:0]), sparse(b), 0, 13, 20)) == []
    assert all((x == 0).all() for _, x in blocks.products(sparse(0 * a), sparse(b), 17, 13, 20))


@pytest.mark.parametrize("exclude", [False, True])
def test_similar_authors(spark, small_tasks, exclude):
    """As all pairs; equal rows (ties by name), rare keywords, nulls; nothing is joined, so no pair of authors that share a keyword is a row."""
    rng = random.Random(3)
    docs = [(i, [f"s{rng.randrange(25)}" for _ in range(rng.randrange(4))], [f"k{min(rng.randrange(30), rng.randrange(30))}" for _ in range(rng.randrange(4))]) for i in range(60)]
    docs += [(100 + i, [f"t{i}"], ["k1", "k2"]) for i in range(8)] + [(200, None, ["k1"]), (201, ["u"], None), (202, ["u", None], ["k1", None])]
    count, met = defaultdict(Counter), set()
    for _, names, words in docs:
        for a in names or []:
            count[a].update(words or [])
            met |= {(a, b) for b in names}
    size = {a: math.sqrt(sum(x * x for x in c.values())) for a, c in count.items()}
    want = {}
    for a in count:
        near = []
        for b in count:
            cosine = sum(x / size[a] * count[b][k] / size[b] for k, x in count[a].items() if k is not None and k in count[b])
            if a is not None and b is not None and a != b and cosine > 0 and not (exclude and (a, b) in met):
                near.append((-round(cosine, 9), b))
        want |= {(a, r): (b, -c) for r, (c, b) in enumerate(sorted(near)[:4], 1)}
    got = models.similar_authors(spark.createDataFrame(docs, "doc_id int, authors array<string>, keywords array<string>").repartition(3), 4, exclude)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["a"], r["rank"]): (r["b"], pytest.approx(r["cosine"], abs=1e-9)) for r in got.collect()} == want


@pytest.mark.parametrize("within", [["y"], []])
def test_similar_strings_that_meet_often(spark, small_tasks, monkeypatch, within):
    """As all pairs, by tasks of two groups: pairs that share a rare bigram are never rows. Copies, one letter, null groups."""
    monkeypatch.setattr(quality, "MOST_MEETINGS", 0)
    rng = random.Random(5)
    rows = [(i, i % 2, "".join(rng.choice("abc") for _ in range(rng.randrange(1, 12)))) for i in range(90)] + [(900, 0, None), (901, 1, ""), (902, None, "abcabc"), (903, 0, "ab"), (904, 0, "ab")]
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)} or {t}
    least, want = {}, {}
    for i, y, t in rows:
        if t and (y is not None or not within):
            least.setdefault((y if within else 0, t), i)
    for ((y, t), i), ((z, u), j) in combinations(least.items(), 2):
        share = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
        if y == z and share >= 0.6:
            want[i, j] = share
    want |= {(first, i): 1.0 for i, y, t in rows if (first := least.get((y if within else 0, t), i)) != i}
    out = quality.similar_strings(spark.createDataFrame(rows, "k int, y int, t string"), "k", "t", within, 0.6)
    assert {(r["a"], r["b"]): r["similarity"] for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2  # copies, and the number of parts
