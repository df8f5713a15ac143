"""Graph operators in frames against plain versions: components of cycles, routes, communities, shortest paths."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from folioscope.operators import blocks, communities, graph, network


def reach(pairs):
    out = defaultdict(set)
    for a, b in pairs:
        out[a].add(b)
    seen = {}
    for v in {x for p in pairs for x in p}:
        seen[v], todo = {v}, [v]
        while todo:
            for w in out[todo.pop()] - seen[v]:
                seen[v].add(w)
                todo.append(w)
    return seen


def test_strong_components(spark):
    rng = random.Random(2)
    pairs = {(rng.randrange(40), rng.randrange(40)) for _ in range(60)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(5, 100), (103, 200), (300, 300)}
    seen = reach(pairs)
    want = {v: min(w for w in seen[v] if v in seen[w]) for v in seen}
    e = spark.createDataFrame([*pairs, (None, 3)], "src long, dst long").repartition(3)
    assert {r["node"]: r["component"] for r in network.strong_components(e).collect()} == want and len(set(want.values())) < len(want)
    got = {(r["src"], r["dst"]): r["n"] for r in network.condensed(e).collect()}
    count = defaultdict(int)
    for a, b in pairs:
        if want[a] != want[b]:
            count[want[a], want[b]] += 1
    assert got == dict(count)
    assert network.strong_components(e.limit(0)).collect() == []


def test_key_routes(spark):
    rng = random.Random(6)
    w = {(a, b): float(rng.randrange(1, 4)) for a, b in combinations(range(9), 2) if rng.random() < 0.5}
    e = spark.createDataFrame([(a, b, x) for (a, b), x in w.items()], "src long, dst long, spc double")
    for threshold, top in ((0.1, 6), (0.6, 3)):
        strong = {k: x for k, x in w.items() if x >= threshold * max(w.values())}
        starts, ends = {a for a, _ in strong} - {b for _, b in strong}, {b for _, b in strong} - {a for a, _ in strong}
        todo, found = [([a, b], x) for (a, b), x in strong.items() if a in starts], []
        while todo:
            path, x = todo.pop()
            if path[-1] in ends and len(path) > 2:
                found.append((-x, path))
            todo += [([*path, b], x + y) for (a, b), y in strong.items() if a == path[-1]]
        want = [(p, -x) for x, p in sorted(found)[:top]]
        assert [(r["route"], r["weight"]) for r in sorted(network.key_routes(e, threshold, top).collect())] == want


def modularity(pairs, member):
    m, degree, inside = sum(w for *_, w in pairs), defaultdict(float), 0.0
    for a, b, w in pairs:
        degree[member[a]] += w
        degree[member[b]] += w
        inside += w * (member[a] == member[b])
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_modularity_communities(spark):
    """Not below the greedy version that holds the whole graph, whatever the partitions; planted groups are found."""
    rng = random.Random(8)
    planted = [(a, b, 1.0) for a, b in combinations(range(40), 2) if rng.random() < (0.6 if a // 10 == b // 10 else 0.03)]
    loose = [(a, b, float(rng.randrange(1, 4))) for a, b in combinations(range(30), 2) if rng.random() < 0.15]
    for pairs in (planted, loose):
        df = spark.createDataFrame(pairs, "a long, b long, n double")
        got = {r["node"]: r["community"] for r in network.modularity_communities(df).collect()}
        assert got == {r["node"]: r["community"] for r in network.modularity_communities(df.repartition(5)).collect()}
        assert all(got[c] == c and c <= v for v, c in got.items())
        assert modularity(pairs, got) >= modularity(pairs, communities.louvain(pairs)) - 1e-3
        if pairs is planted:
            assert {frozenset(v for v in got if got[v] == c) for c in got.values()} == {frozenset(range(g, g + 10)) for g in range(0, 40, 10)}
    assert network.modularity_communities(df.limit(0)).collect() == []


def test_paths(spark):
    """Two components, a loop and a hub."""
    pairs = [(1, 2), (2, 3), (3, 4), (4, 5), (5, 1), (5, 6), (6, 6)] + [(10, k) for k in range(11, 16)] + [(15, 16)]
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, n int").repartition(3)
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    dist = {}
    for s in near:
        dist[s], todo = {s: 0}, [s]
        for v in todo:
            for w in sorted(near[v] - set(dist[s])):
                dist[s][w] = dist[s][v] + 1
                todo.append(w)
    want = {}
    for s in near:
        c = want.setdefault(min(dist[s]), {"far": [], "all": []})
        c["far"].append(max(dist[s].values()))
        c["all"] += [d for d in dist[s].values() if d]
    got = {r["component"]: (r["nodes"], r["diameter"], r["radius"], pytest.approx(r["mean_path"])) for r in network.path_stats(e).collect()}
    assert got == {k: (len(c["far"]), max(c["far"]), min(c["far"]), sum(c["all"]) / len(c["all"])) for k, c in want.items()}
    close = {s: (len(d) - 1) ** 2 / sum(d.values()) / (len(near) - 1) for s, d in dist.items()}
    exact = {r["node"]: r["closeness"] for r in network.path_centralities(e).collect()}
    assert exact == pytest.approx(close)
    near_enough = {r["node"]: r for r in network.hop_closeness(e).collect()}
    assert all(near_enough[s]["closeness"] == pytest.approx(close[s], rel=0.03) and near_enough[s]["reached"] == len(dist[s]) and near_enough[s]["eccentricity"] == max(dist[s].values()) for s in near)
    some = network.path_centralities(e, spark.createDataFrame([(1,), (10,)], "node long")).collect()
    assert {r["node"] for r in some if r["closeness"] is not None} == {1, 10} and len(some) == len(near)
    assert network.path_stats(e.limit(0)).collect() == [] and network.path_centralities(e.limit(0)).collect() == []


def test_followed(spark):
    pointers = spark.createDataFrame([(i, i + 1 if i < 20 else None) for i in range(21)], "key long, next long")
    starts = spark.createDataFrame([(1, 0), (2, 17), (3, 20)], "route int, key long")
    rows = graph.followed(pointers, starts).collect()
    assert sorted((r["route"], r["step"], r["key"]) for r in rows) == [(1, i, i) for i in range(21)] + [(2, i, 17 + i) for i in range(4)] + [(3, 0, 20)]
    with pytest.raises(ValueError, match="cycle"):
        graph.followed(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "key long, next long"), starts)


def test_weights_of_cycles(spark):
    """One cycle as one node: weights, their shares and the path go through it."""
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("c", "e"), ("x", "c")], "src string, dst string")
    for method, scale in (("spc", 1), ("splc", 1 / 4), ("spnp", 1 / 4)):
        got = {(r["src"], r["dst"]): r["spc"] for r in network.condensed_weights(e, method).collect()}
        assert got == {("a", "b"): 2 * scale, ("x", "b"): 2 * scale, ("b", "d"): 2 * scale, ("b", "e"): 2 * scale}
    with pytest.raises(ValueError):
        network.condensed_weights(e, "other")
    path = graph.main_path(network.condensed_weights(e))
    assert [r["node"] for r in path.orderBy(F.col("place")).collect()] == ["x", "b", "e"]


def test_communities_in_tasks(spark, monkeypatch):
    """Components that fit a task take no rounds, loops and several components included, with a modularity as good as by rounds of frames; larger ones go by these."""
    rng = random.Random(6)
    pairs = [(100 * g + a, 100 * g + b, float(rng.randrange(1, 4))) for g in range(3) for a, b in combinations(range(24), 2) if rng.random() < (0.6 if a // 8 == b // 8 else 0.05)] + [(3, 3, 2.0), (900, 900, 1.0)]
    df = spark.createDataFrame(pairs, "a long, b long, n double")
    want = {r["node"]: r["community"] for r in network._communities(network._adjacency(df), 2 * sum(w for *_, w in pairs), 1.0, 1e-5).collect()}
    monkeypatch.setattr(network, "_moved", lambda *_: pytest.fail("a round of frames"))
    got = {r["node"]: r["community"] for r in network.modularity_communities(df).collect()}
    assert got.keys() == want.keys() and all(got[c] == c and c <= v for v, c in got.items())
    assert modularity(pairs, got) >= max(modularity(pairs, want), modularity(pairs, communities.louvain(pairs))) - 1e-3
    monkeypatch.undo()
    monkeypatch.setattr(blocks, "TASK_EDGES", 80)
    assert {r["node"]: r["community"] for r in network.modularity_communities(df).collect()}.keys() == want.keys()
