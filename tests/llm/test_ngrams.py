import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ngram_model
from folioscope.llm.elias_fano import EliasFano, Trie, quantised, restored
from tests.llm.conftest import prose


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 2**40), (50, 60), (500, 2**20), (2000, 2**45), (300, 3), (20_000, 2**30), (30_000, 40)])
def test_elias_fano(n, top):
    rng = np.random.default_rng(n)
    v = np.sort(rng.integers(0, top, n)).astype(np.uint64)
    ef, _ = EliasFano.read(np.frombuffer(b"".join(EliasFano.of(v).parts()), np.uint8), 0)
    assert (ef.get(np.arange(n)) == v).all()
    x = np.concatenate([rng.integers(0, top + 2, 500).astype(np.uint64), v, v + np.uint64(1)])
    for y in (x, np.sort(x)):
        place, hit = ef.search(y)
        assert (place == np.searchsorted(v, y)).all() and (hit == np.isin(y, v)).all()
    assert sum(x.nbytes for x in ef.index()) <= 2 * len(ef.high) + 16  # no expanded level
    if n > 400:
        assert len(b"".join(EliasFano.of(v).parts())) * 8 < n * (4 + max(1, math.log2(top / n))) + 800


def test_trie(tmp_path):
    rng = np.random.default_rng(2)
    pairs = np.unique(rng.integers(0, 40, 3000).astype(np.uint64) << np.uint64(32) | rng.integers(0, 2**32, 3000).astype(np.uint64))
    c, w = pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)
    p = -rng.random(len(pairs)) * 8
    path = tmp_path / "t"
    path.write_bytes(Trie.of(c, w, p, -np.arange(len(np.unique(c))) / 10).to_bytes())
    trie = Trie.open(np.memmap(path, np.uint8, "r"))
    codes, weights = trie.find(c, w)
    assert (codes == quantised(p)).all() and (weights > 0).all()
    assert np.abs(np.log10(restored(codes)) - p).max() <= 12 / 254 / 2 + 1e-9
    miss = np.array([x for x in rng.integers(0, 2**32, 500).astype(np.uint64) if x not in set(w.tolist())])
    assert not trie.find(np.full(len(miss), 3, np.uint64), miss)[0].any()
    assert not trie.find(np.full(5, 999, np.uint64), w[:5])[0].any()
    empty = Trie.open(np.frombuffer(Trie.of(c[:0], w[:0], p[:0], p[:0]).to_bytes(), np.uint8))
    assert not empty.find(c, w)[0].any()


def plain(rows, train, mu, nu):
    toks = {i: (t or "").encode().lower().split() + [b"\n end"] for i, t in rows}
    c, b, ctx, t = Counter(), Counter(), Counter(), Counter()
    for i, w in toks.items():
        if i in train:
            c.update(w)
            b.update(zip([b"\n begin", *w[:-1]], w, strict=True))
            ctx.update([b"\n begin", *w[:-1]])
            t.update(zip([b"\n begin", *w], w, w[1:], strict=False))
    n, v = sum(c.values()), len(c)
    p = lambda x: (c[x] + 0.5) / (n + 0.5 * (v + 1))
    out = {}
    for i, w in toks.items():
        base = sum(math.log10(p(x)) for x in w)
        model, seen = 0.0, [b"\n begin", *w]
        for k, x in enumerate(w):
            q = (b[seen[k], x] + mu * p(x)) / (ctx[seen[k]] + mu)
            if k and b[seen[k - 1], seen[k]]:
                q = (t[seen[k - 1], seen[k], x] + nu * q) / (b[seen[k - 1], seen[k]] + nu)
            model += math.log10(q)
        out[i] = (len(w), sum(c[x] > 0 for x in w), n, base, model)
    return out


@pytest.mark.parametrize("mu,nu", [(3.0, 2.0), (1000.0, 30.0)])
def test_against_plain(spark, monkeypatch, mu, nu):
    monkeypatch.setattr(ngram_model, "SLICE", 20_000)
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(0, 120)) if i % 17 else [None, "", "The THE the"][i % 3]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).cache()
    df.count()
    out = ngram_model.score(df, F.col("doc_id") % 5 != 1, F.col("doc_id") % 5 == 1, mu=mu, nu=nu).collect()
    want = plain(rows, {i for i, _ in rows if i % 5 != 1}, mu, nu)
    assert len(out) == len(rows)
    for r in out:
        n, known, total, base, model = want[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n, known, total, r["doc_id"] % 5 == 1)
        assert abs(r["base_score"] - base) < 1e-6
        assert abs(r["score"] - model) <= n * (2 * 12 / 254 / 2 + 1e-6)


def test_odd_rows(odd, empty):
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    out = ngram_model.score(odd, crc != 1, crc == 1).collect()
    assert len(out) == odd.count()
    assert all(r["n_tokens"] == 1 for r in out if r["doc_id"] in (0, 1, 2)) and all(r["score"] <= 0 for r in out)
    assert not any(r["held_out"] for r in out if r["doc_id"] is None)
    assert ngram_model.score(empty, crc != 1, crc == 1).collect() == []
    none = ngram_model.score(odd, F.lit(False), crc == 1).collect()
    assert {r["train_tokens"] for r in none} == {0} and all(math.isfinite(r["score"]) for r in none)
