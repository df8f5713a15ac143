"""Components taken whole in tasks: the same rows as by rounds of frames, and no round for each level."""

import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.operators import blocks, communities, graph, network


def jobs(spark, run):
    """What run gives, and how many jobs that took."""
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


@pytest.fixture(scope="module")
def cyclic(spark):
    rng = random.Random(5)
    pairs = [(k * 100 + a, k * 100 + b) for k in range(4) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(18))]
    return spark.createDataFrame([*pairs, (3, None)], "src long, dst long").repartition(3)


@pytest.fixture(scope="module")
def acyclic(spark):
    rng = random.Random(7)
    pairs = {(k * 100 + a, k * 100 + b) for k in range(4) for a, b in (sorted(rng.sample(range(9), 2)) for _ in range(14))}
    return spark.createDataFrame([(str(a), str(b)) for a, b in sorted(pairs)], "src string, dst string").repartition(3)


def test_few_jobs_for_long_ways(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "src long, dst long")
    rows, n = jobs(spark, lambda: graph.traversal_weights(chain).collect())
    assert len(rows) == 60 and {r["spc"] for r in rows} == {1.0}
    assert n < 40  # by rounds each level took several
    ring = chain.union(spark.createDataFrame([(60, 0)], "src long, dst long"))
    rows, n = jobs(spark, lambda: network.strong_components(ring).collect())
    assert {r["component"] for r in rows} == {0} and n < 40


def both_ways(monkeypatch, run):
    monkeypatch.setattr(blocks, "TASK_EDGES", 500_000)
    here = run()
    monkeypatch.setattr(blocks, "TASK_EDGES", 11)
    assert here and run() == here


def rows(df):
    return sorted(df.collect(), key=str)


def test_same_by_rounds_with_cycles(monkeypatch, cyclic):
    both_ways(monkeypatch, lambda: rows(network.condensed(cyclic)) + rows(network.strong_components(cyclic)))


def test_same_by_rounds_without_cycles(monkeypatch, acyclic):
    def run():
        w = graph.traversal_weights(acyclic)
        return rows(w) + rows(graph.main_path(w))

    both_ways(monkeypatch, run)


def test_cycle_raises(spark):
    with pytest.raises(Exception, match="cycle"):
        graph.traversal_weights(spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")).collect()


def test_components_over_partitions(spark):
    pairs = [(i, i + 1) for i in range(40) if i % 10 != 9] + [(90, None), (None, None), (7, 7)]
    random.Random(1).shuffle(pairs)
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, n int").repartition(5)
    got = {r["node"]: r["component"] for r in graph.components(e).collect()}
    assert got == {**{i: i // 10 * 10 for i in range(40)}, 90: 90}


def test_hops_same_by_rounds(spark, monkeypatch):
    rng = random.Random(9)
    pairs = {(k * 100 + a, k * 100 + b) for k in range(3) for a, b in (sorted(rng.sample(range(8), 2)) for _ in range(11))}
    e = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a long, b long, n int").repartition(3)

    def run():
        return [[round(x, 9) if isinstance(x, float) else x for x in r] for f in (network.path_centralities, network.path_stats, network.hop_closeness) for r in rows(f(e))]

    here, n = jobs(spark, run)
    assert n < 120
    monkeypatch.setattr(blocks, "TASK_PAIRS", 300)
    assert run() == here


def test_few_jobs_for_far_nodes(spark):
    chain = spark.createDataFrame([(i, i + 1, 1) for i in range(60)], "a long, b long, n int")
    got, n = jobs(spark, lambda: network.path_stats(chain).collect())
    assert [tuple(r)[:4] for r in got] == [(0, 61, 60, 30)] and n < 40


def test_triangles_without_pairs_of_edges(spark, monkeypatch):
    from itertools import combinations

    rng = random.Random(3)
    pairs = [p for p in combinations(range(60), 2) if rng.random() < 0.6]
    near = {frozenset(p) for p in pairs}
    want = dict.fromkeys(range(60), 0)
    for three in combinations(range(60), 3):
        if all(frozenset(p) in near for p in combinations(three, 2)):
            for v in three:
                want[v] += 1
    monkeypatch.setattr(blocks, "GROUP_EDGES", 300)
    monkeypatch.setattr(blocks, "STEP", 1000)
    assert blocks.groups(len(pairs)) > 4
    e = spark.createDataFrame([(f"n{a}", f"n{b}", 1) for a, b in pairs], "a string, b string, n int")
    assert {int(r["node"][1:]): r["triangles"] for r in graph.triangles(e).collect()} == want


def test_pagerank_rounds_are_not_made_again(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (1, 3)], "src long, dst long")
    out = graph.pagerank(e, 6)
    ranks = {r["node"]: r["rank"] for r in out.collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks[3] > ranks[2] > ranks[1]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()  # the last round is read, not joined anew
    assert graph.pagerank(e.limit(0), 2).collect() == []


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_communities_of_no_weight():
    """Nodes whose edges weigh nothing stay alone, and it ends."""
    assert blocks.communities(np.array([0, 1]), np.array([1, 2]), np.zeros(2), 3, 0.0, 1.0, 1e-5).tolist() == [0, 1, 2]
    assert blocks.communities(np.array([0, 1, 3]), np.array([1, 2, 4]), np.array([1.0, 1.0, 0.0]), 5, 4.0, 1.0, 1e-5).tolist() == [0, 0, 0, 3, 4]


@pytest.fixture
def apart(spark):
    """Partitions stay as many as there are, however small."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["hop_closeness", "path_stats", "strong_components", "condensed_citations", "cyclic_weights_by_path", "cyclic_weights_by_pair"])
def test_customers_stay_together(spark, sf, monkeypatch, apart, name):
    """A customer's edges come in one partition, so that components are found there, without rounds over all edges."""
    from folioscope.plans import registry

    monkeypatch.setattr(graph, "_least_reachable", lambda *_: pytest.fail("a round of frames"))
    assert registry.QUERIES[name](spark, sf).count() > 0


def test_equal_edges_count_once(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 2), (3, 4), (3, 4), (2, 4)], "src long, dst long").repartition(3)
    for most in (500_000, 2):
        monkeypatch.setattr(blocks, "TASK_EDGES", most)
        assert rows(network.condensed(e, once=True)) == [(1, 2, 1), (2, 4, 2)]
        assert rows(network.condensed(e)) == [(1, 2, 2), (2, 4, 3)]
    both = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (2, 3, 1), (3, 3, 1), (2, 3, 1)], "a long, b long, n int").repartition(3)
    for most in (4_000_000, 8):
        monkeypatch.setattr(blocks, "TASK_PAIRS", most)
        assert [tuple(r) for r in network.path_stats(both).collect()] == [(1, 3, 2, 1, 4 / 3)]
        assert [(r["node"], r["reached"], r["eccentricity"]) for r in rows(network.hop_closeness(both))] == [(1, 3, 2), (2, 3, 1), (3, 3, 2)]


def test_answers_of_odd_orders(spark, tmp_path):
    """Citations and answers where keys repeat with other priorities, or priorities and customers are null."""
    from folioscope.plans import networks

    orders = [(1, 5, "2020-01-01", "a"), (2, 5, "2020-01-02", "a"), (3, 5, "2020-01-03", "b"), (3, 6, "2020-01-03", "a"), (4, 6, "2020-01-04", "a"), (5, None, "2020-01-01", None), (6, None, "2020-01-02", None), (7, 5, "2020-01-05", "a"), (7, 5, "2020-01-05", "a"), (None, 6, "2020-01-06", "a"), (8, 6, "2020-01-07", "a")]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    cites = {(r["src"], r["dst"]) for r in networks._cites(spark, str(tmp_path)).collect()}
    kinds = {}
    for key, _, _, kind in orders:
        kinds.setdefault(key, set()).update({kind} - {None})
    want = cites | {(b, a) for a, b in cites if a and b and kinds[a] & kinds[b]}
    got = {(r["src"], r["dst"]) for r in networks._mutual(spark, str(tmp_path)).collect()}
    assert (2, 3) in want and (5, 6) not in want
    assert {x for x in got if None not in x} == {x for x in want if None not in x}


def test_coded_structs(spark):
    """Structs as nodes: sorted by their fields, nulls first, also within structs; components and windows take them."""
    rows = [{"start": s, "node": n} for s, n in ((2, "a"), (1, "b"), (None, "b"), (2, "a"), (1, None), (1, "a"))] + [None]
    kind = pa.struct([("start", pa.int32()), ("node", pa.string())])
    values, (one, two) = blocks.coded(pa.chunked_array([pa.array(rows[:3], kind)]), pa.chunked_array([pa.array(rows[3:5], kind), pa.array(rows[5:], kind)]))
    want = [None, {"start": None, "node": "b"}, {"start": 1, "node": None}, {"start": 1, "node": "a"}, {"start": 1, "node": "b"}, {"start": 2, "node": "a"}]
    assert values.to_pylist() == want and [want[i] for i in [*one, *two]] == rows
    deep = pa.array([{"key": r} for r in rows], pa.struct([("key", kind)]))
    assert blocks.coded(pa.chunked_array([deep]))[0].to_pylist() == [{"key": r} for r in want]
    assert len(blocks.coded(pa.chunked_array([deep[:0]]))[0]) == 0
    edges = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "c", 1), (2, "a", "b", 1), (2, "c", "d", 1), (1, "a", "c", 1)], "start int, a string, b string, n long")
    got = {r["start"]: (r["nodes"], r["edges"], r["components"], r["largest"], r["clustering"]) for r in communities.window_metrics(edges).collect()}
    assert got == {1: (3, 3, 1, 3, 1.0), 2: (4, 2, 2, 2, 0.0)}


def test_pagerank_settles(spark, monkeypatch):
    """As many rounds of all nodes; in tasks and by rounds of frames, with and without cycles, equal edges once."""
    rng = random.Random(6)
    pairs = [(rng.randrange(20) + c, rng.randrange(20) + c) for c in (0, 100) for _ in range(50)] + [(200, 201), (201, 202), (200, 201)]
    nodes = sorted({x for p in pairs for x in p})
    out = {v: {b for a, b in pairs if a == v} for v in nodes}
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(400):
        loose = sum(want[v] for v in nodes if not out[v])
        new = dict.fromkeys(nodes, (0.15 + 0.85 * loose) / len(nodes))
        for v in nodes:
            for u in out[v]:
                new[u] += 0.85 * want[v] / len(out[v])
        want = new
    e = spark.createDataFrame(pairs, "src long, dst long")
    for most in (blocks.TASK_EDGES, 10):
        monkeypatch.setattr(blocks, "TASK_EDGES", most)
        got = {r["node"]: r["rank"] for r in graph.pagerank(e).collect()}
        assert got == {v: pytest.approx(x, rel=1e-7) for v, x in want.items()}
    assert graph.pagerank(e.limit(0)).collect() == []


@pytest.mark.parametrize("most", [7, 16, 8192])
def test_dense_triangles_go_packed(spark, monkeypatch, most):
    """As all threes of nodes; groups of bits or, with too few nodes to a group, rows; loops and edges in both directions."""
    from itertools import combinations

    rng = random.Random(8)
    pairs = [p for p in combinations(range(50), 2) if rng.random() < 0.5]
    near = {frozenset(p) for p in pairs}
    want = dict.fromkeys(range(50), 0)
    for three in combinations(range(50), 3):
        if all(frozenset(p) in near for p in combinations(three, 2)):
            for v in three:
                want[v] += 1
    monkeypatch.setattr(blocks, "GROUP_EDGES", 300)
    monkeypatch.setattr(blocks, "GROUP_NODES", most)
    monkeypatch.setattr(blocks, "CHUNK", 100)
    turned = [(b, a) for a, b in pairs[:30]] + [(3, 3)]
    out = graph.triangles(spark.createDataFrame([(f"n{a}", f"n{b}", 1) for a, b in pairs + turned], "a string, b string, n int"))
    assert {int(r["node"][1:]): r["triangles"] for r in out.collect()} == want
    assert ("packed" in out._jdf.queryExecution().optimizedPlan().toString()) == (most > 7)
