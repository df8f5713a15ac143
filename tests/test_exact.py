"""Operators against plain versions: ranks and sums over hot values, similar strings, centralities, paging."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import cooccurrence as co
from folioscope.operators import communities, diversity, impact, laws, longform, models, network, quality, stats, timeseries
from folioscope.sources import api


@pytest.fixture(scope="module")
def counts(spark):
    """Most items occur once."""
    rng = random.Random(1)
    rows = [(f"i{k:05d}", 1 if rng.random() < 0.8 else rng.randrange(1, 40)) for k in range(5000)]
    return spark.createDataFrame(rows, "item string, n_docs long").repartition(5).cache(), rows


def test_ranks(counts):
    df, rows = counts
    want = {item: i for i, (item, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}
    assert {r["item"]: r["rank"] for r in longform.ranked(df, "n_docs", "item").collect()} == want
    assert longform.ranked(df.limit(0), "n_docs", "item").collect() == []


def test_running(counts):
    df, rows = counts
    got = {r["item"]: (r["n"], r["m"]) for r in longform.running(df, [F.desc("n_docs"), F.col("item")], {"n": F.lit(1), "m": "n_docs"}).collect()}
    total = 0
    for i, (item, k) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += k
        assert got[item] == (i, total)


def test_no_window_over_items(counts):
    """A task of the sort sees a part of the items, although most have the same count; windows without a partition see a row for each task or each count."""
    df, rows = counts
    spark = df.sparkSession
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = longform.cut(df.orderBy(F.desc("n_docs"), "item").withColumn("p", F.spark_partition_id()))
        assert max(r["count"] for r in made.groupBy("p").count().collect()) < 0.5 * len(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_bradford_and_diversity(counts):
    df, rows = counts
    total, mass = sum(n for _, n in rows), 0
    zones = {r["item"]: (r["cumulative"], r["zone"]) for r in laws.bradford(df).collect()}
    for item, n in sorted(rows, key=lambda r: (-r[1], r[0])):
        mass += n
        assert zones[item][0] == pytest.approx(mass / total)
    x = np.sort(np.array([n for _, n in rows], float))
    p = x / x.sum()
    r = diversity.diversity(df.withColumnRenamed("n_docs", "n")).first()
    assert r["shannon"] == pytest.approx(-(p * np.log(p)).sum()) and r["hhi"] == pytest.approx((p * p).sum()) and r["richness"] == len(x)
    assert r["gini"] == pytest.approx((2 * (np.arange(1, len(x) + 1) * x).sum() - (len(x) + 1) * x.sum()) / (len(x) * x.sum()))


def test_mean_ranks(spark):
    rng = random.Random(2)
    x = [rng.randrange(50) for _ in range(400)]
    got = sorted((r["x"], r["r"]) for r in stats.mean_ranks(spark.createDataFrame([(v,) for v in x], "x int"), "x", "r").collect())
    order = sorted(x)
    assert got == sorted((v, order.index(v) + (order.count(v) + 1) / 2) for v in x)


def grams(t):
    return {t[i : i + 2] for i in range(len(t) - 1)} or {t}


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_similar_strings(spark, threshold):
    rng = random.Random(3)
    texts = []
    for _ in range(60):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "x"]) for _ in range(rng.randrange(1, 6))]
        for _ in range(rng.choice([1, 2, 3])):
            t = list(" ".join(words))
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = rng.choice("abcde")
            texts.append("".join(t))
    rows = [(i, i % 2, t) for i, t in enumerate(texts)] + [(900, 0, None), (901, 1, "")]
    got = {(r["a"], r["b"]): r["similarity"] for r in quality.similar_strings(spark.createDataFrame(rows, "k int, y int, t string"), "k", "t", ["y"], threshold).collect()}
    first = {}
    for i, y, t in rows:
        if t:
            first.setdefault((y, t), i)
    want = {}
    for (y, t), i in first.items():
        for (z, u), j in first.items():
            s = len(grams(t) & grams(u)) / len(grams(t) | grams(u))
            if y == z and i < j and s >= threshold:
                want[i, j] = s
    want |= {(first[y, t], i): 1.0 for i, y, t in rows if t and first[y, t] != i}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_author_variants(spark):
    rows = [("Doe, Jane M.", 5, None), ("Doe, J.", 3, None), ("Jane Doe", 1, None), ("Doe, John", 2, "o1"), ("Zed, Q.", 1, "o1"), ("Roe, Rick", 2, None), ("Roee, Rick", 1, None), ("Poe, Pat", 1, None)]
    got = {r["name"]: r["canonical"] for r in quality.author_variants(spark.createDataFrame(rows, "name string, n int, orcid string"), 0.6, "orcid").collect()}
    assert got["Doe, J."] == got["Doe, Jane M."] == got["Jane Doe"] == got["Zed, Q."] == "Doe, Jane M."
    assert got["Roee, Rick"] == "Roe, Rick" and got["Poe, Pat"] == "Poe, Pat"


def test_cited_titles(spark):
    df = spark.createDataFrame([(1, "A study of stars and of their dust", None), (2, "Bread, butter and other food", ["A Study of Stars and of Their Dust.", "Unknown things of old"]), (3, "Other matter", ["Bread butter and other foods", "Other matter"])], "doc_id int, title string, refs array<string>")
    assert sorted(map(tuple, impact.cited_titles(df, "refs").collect())) == [(2, 1), (3, 2)]


def test_centralities(spark):
    rng = random.Random(4)
    names = [f"n{k}" for k in range(12)]
    pairs = sorted({tuple(sorted(rng.sample(names, 2))) for _ in range(22)})
    edges = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, n int")
    got = {r["node"]: r for r in network.centralities(edges).collect()}
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in {x for p in pairs for x in p}}
    nodes = sorted(near)
    m = np.array([[float(v in near[u]) for v in nodes] for u in nodes])
    values, vectors = np.linalg.eigh(m)
    top = np.abs(vectors[:, values.argmax()])

    def shortest(s, t):
        paths, found = [[s]], []
        while paths and not found:
            paths = [[*p, v] for p in paths for v in near[p[-1]] if v not in p]
            found = [p for p in paths if p[-1] == t]
        return found

    between = Counter()
    for i, s in enumerate(nodes):
        for t in nodes[i + 1 :]:
            ways = shortest(s, t)
            for p in ways:
                for v in p[1:-1]:
                    between[v] += 1 / len(ways)
    scale = 2 / ((len(nodes) - 1) * (len(nodes) - 2))
    for v, x in zip(nodes, top, strict=True):
        assert got[v]["degree"] == len(near[v]) and got[v]["betweenness"] == pytest.approx(between[v] * scale) and got[v]["eigenvector"] == pytest.approx(x, abs=1e-4)


def test_client_retries_and_limits():
    calls = Counter()

    def transport(path, parameters):
        calls[parameters["cursor"]] += 1
        if calls[parameters["cursor"]] == 1:
            raise OSError("not now")
        at = 0 if parameters["cursor"] == "*" else int(parameters["cursor"])
        return {"meta": {"next_cursor": str(at + 3) if at < 6 else None}, "results": [{"id": i} for i in range(at, min(at + 3, 8))]}

    client = api.Client(transport, pause=0.0)
    assert [r["id"] for r in client.records("works", {"year": 2001})] == list(range(8))
    assert len(list(client.records("works", {}, limit=4))) == 4
    with pytest.raises(OSError):
        list(api.Client(lambda p, q: (_ for _ in ()).throw(OSError("down")), retries=1, pause=0.0).records("works", {}))
    row = api.work_row({})
    assert row["id"] is None and row["authors"] == [] and row["abstract"] is None


def test_enriched(spark):
    def transport(path, parameters):
        dois = parameters["filter"].split(":", 1)[1].split("|")
        return {"results": [{"id": f"w/W{d[-1]}", "doi": f"https://doi.org/{d}"} for d in dois if d != "10.1/3"]}

    df = spark.createDataFrame([(1, "10.1/1"), (2, "10.1/2"), (3, "10.1/3"), (4, None)], "n int, doi string")
    got = {r["n"]: r["found"] and r["found"]["id"] for r in api.enriched(df, api.Client(transport), "doi").collect()}
    assert got == {1: "W1", 2: "W2", 3: None, 4: None}


@pytest.mark.parametrize("at_least", [1, 2, 3])
@pytest.mark.parametrize("hot", [0, 3])
def test_coupling(spark, monkeypatch, at_least, hot):
    """With and without items that nearly all documents have: both ways give the same pairs."""
    monkeypatch.setattr(co, "POPULAR", 20)
    rng = random.Random(5)
    docs = {i: sorted({f"i{rng.randrange(25)}" for _ in range(rng.randrange(0, 5))} | {f"hot{k}" for k in range(hot) if rng.random() < 0.9}) for i in range(80)}
    df = spark.createDataFrame(list(docs.items()), "doc_id int, refs array<string>")
    got = {(r["a"], r["b"]): r["n"] for r in co.coupling(df, "refs", at_least).collect()}
    want = {(i, j): n for i in docs for j in docs if i < j and (n := len(set(docs[i]) & set(docs[j]))) >= at_least}
    assert got == want


@pytest.mark.parametrize("at_least", [2, 3])
def test_coupling_meets_on_pairs(spark, at_least):
    """Short lists meet on two items at once, so no join is on one item of many documents; with long lists they meet on single ones. The pairs are the same."""
    rng = random.Random(6)
    docs = {i: [f"i{k}" for k in sorted(rng.sample(range(12), rng.randrange(0, 5)))] for i in range(120)} | {900: None, 901: ["i1", None, "i1", "i2", "i3"]}
    sets = {i: set(x or []) - {None} for i, x in docs.items()}
    df = spark.createDataFrame(list(docs.items()), "doc_id int, refs array<string>")
    out = co.coupling(df, "refs", at_least)
    assert {(r["a"], r["b"]): r["n"] for r in out.collect()} == {(i, j): n for i in sets for j in sets if i < j and (n := len(sets[i] & sets[j])) >= at_least}
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert any(x.count("=") == 2 for x in joins)
    long_lists = spark.createDataFrame([(1, [f"i{k}" for k in range(50)]), (2, [f"i{k}" for k in range(3, 60)])], "doc_id int, refs array<string>")
    assert [tuple(r) for r in co.coupling(long_lists, "refs", at_least).collect()] == [(1, 2, 47)]


def test_nmf(spark):
    """The factors of two matrices at once, against the same updates in numpy from the same start."""
    rng = random.Random(8)
    rows = [(y, f"d{y}{d}", f"t{x}", rng.random() + 0.1) for y in (1, 2) for d in range(7) for x in range(9) if rng.random() < 0.5]
    df = spark.createDataFrame(rows, "start int, doc_id string, term string, weight double")
    for rounds in (1, 4):
        w, h = models.nmf(df, 2, rounds)
        w, h = ({(r["start"], r[1]): (r[2], r[3]) for r in t.collect()} for t in (w, h))
        for y in (1, 2):
            docs, terms = sorted({r[1] for r in rows if r[0] == y}), sorted({r[2] for r in rows if r[0] == y})
            x = np.zeros((len(docs), len(terms)))
            for a, d, t, v in rows:
                if a == y:
                    x[docs.index(d), terms.index(t)] = v
            first = lambda names, letter: np.array([tuple(spark.range(1).select(*(((F.pmod(F.xxhash64(F.lit(f"{letter}{i}"), F.lit(y), F.lit(v)), F.lit(1 << 20)) + 1) / (1 << 20)) for i in range(2))).first()) for v in names])  # noqa: B023, E731
            a, b = first(docs, "w"), first(terms, "h")
            before = np.linalg.norm(x - a @ b.T)
            for _ in range(rounds):
                b = b * (x.T @ a) / (b @ (a.T @ a) + 1e-12)
                a = a * (x @ b) / (a @ (b.T @ b) + 1e-12)
            assert np.linalg.norm(x - a @ b.T) < before
            assert np.allclose([w[y, d] for d in docs], a) and np.allclose([h[y, t] for t in terms], b)


def test_bursts(spark):
    """The cheapest of all sequences of states, tried one by one; an item of every document too."""
    import itertools
    import math

    rng = random.Random(10)
    docs, n = [], 0
    for year in range(2000, 2007):
        for _ in range(12):
            items = {f"i{k}" for k in range(6) if rng.random() < (0.7 if year in (2003, 2004) and k < 3 else 0.15)} | {"all"}
            docs.append((n, year, sorted(items)))
            n += 1
    got = sorted((r["item"], r["start"], r["stop"], round(r["weight"], 6)) for r in timeseries.bursts(spark.createDataFrame(docs, "doc_id int, year int, k array<string>"), "k", 2.0, 0.5).collect())
    years, want = list(range(2000, 2007)), []
    d = [sum(y == x for _, y, _ in docs) for x in years]
    for item in sorted({i for _, _, k in docs for i in k}):
        r = [sum(y == x and item in k for _, y, k in docs) for x in years]
        p = [min(0.9999, sum(r) / sum(d))]
        p.append(min(0.9999, 2 * p[0]))
        cost = [[-(r[t] * math.log(q) + (d[t] - r[t]) * math.log(1 - q)) for t in range(7)] for q in p]
        up = 0.5 * math.log(8)
        total = lambda states: sum(cost[x][t] for t, x in enumerate(states)) + up * sum(b > a for a, b in zip((0, *states), states))  # noqa: B023
        best = min(itertools.product((0, 1), repeat=7), key=total)
        for _, run in itertools.groupby(enumerate(best), key=lambda x: x[1]):
            run = list(run)
            if run[0][1]:
                want.append((item, years[run[0][0]], years[run[-1][0]], round(sum(cost[0][t] - cost[1][t] for t, _ in run), 6)))
    assert got == want and len(want) >= 3


def test_greedy_modularity():
    """Each merge is the best of all linked pairs, by modularity computed anew."""
    rng = random.Random(11)
    for _ in range(20):
        names = [f"n{k}" for k in range(9)]
        edges = [(a, b, rng.randrange(1, 4) + rng.random()) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < (0.8 if (i < 4) == (int(b[1]) < 4) else 0.15)]
        nodes = sorted({x for e in edges for x in e[:2]})
        m = sum(w for _, _, w in edges)

        def q(parts):
            own = {v: i for i, p in enumerate(parts) for v in p}
            inside = sum(w for a, b, w in edges if own[a] == own[b]) / m  # noqa: B023
            degree = [sum(w * ((a in p) + (b in p)) for a, b, w in edges) / (2 * m) for p in parts]  # noqa: B023
            return inside - sum(x * x for x in degree)

        parts = [{v} for v in nodes]
        while True:
            linked = [(i, j) for i in range(len(parts)) for j in range(i + 1, len(parts)) if any((a in parts[i] and b in parts[j]) or (a in parts[j] and b in parts[i]) for a, b, _ in edges)]
            tried = [(q([p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] | parts[j]]), i, j) for i, j in linked]
            if not tried or max(tried)[0] <= q(parts) + 1e-12:
                break
            _, i, j = max(tried)
            parts = [p for k, p in enumerate(parts) if k not in (i, j)] + [parts[i] | parts[j]]
        got = communities.greedy_modularity(edges)
        assert sorted(sorted(p) for p in parts) == sorted(sorted(v for v in got if got[v] == c) for c in set(got.values()))
