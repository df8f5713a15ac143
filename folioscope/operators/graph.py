"""Graphs as edge frames. Iterations write their state to the session's checkpoint folder every round."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import blocks
from folioscope.operators.longform import cut, kept, ranked


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge (a, b, n) in both directions."""
    return edges.select("a", "b", "n").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return undirected(edges).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("degree"), F.sum("n").alias("strength"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean and greatest degree."""
    d = degrees(edges)
    n, m = F.count("*"), F.sum("degree") / 2
    return d.agg(n.alias("nodes"), m.cast("long").alias("edges"), F.when(n > 1, 2 * m / (n * (n - 1))).otherwise(0.0).alias("density"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Each partition first joins what its own edges join; only where a node is met under several roots, these go through rounds."""
    e = edges.select(F.coalesce("a", "b").alias("a"), F.coalesce("b", "a").alias("b")).where("a IS NOT NULL")
    found = kept(blocks.joined(e))
    low = kept(found.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    split = low.where("least <> most")
    if split.isEmpty():
        return low.select("node", F.col("least").alias("component"))
    links = found.join(split.select("node", "least"), "node").where("root <> least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct()
    over = _least_reachable(links).select(F.col("node").alias("least"), "component")
    return kept(low.join(over, "least", "left").select("node", F.coalesce("component", "least").alias("component")))


def _least_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) by rounds: labels go to neighbours, then to what has the label's own."""
    edges = kept(edges)
    both = kept(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = kept(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        low = label.join(near, "node").select("node", "component", F.least("component", "m").alias("low"))
        jump = label.select(F.col("node").alias("low"), F.col("component").alias("over"))
        new = kept(low.join(jump, "low", "left").select("node", F.least("low", F.coalesce("over", "low")).alias("new"), "component"))
        label = new.select("node", F.col("new").alias("component"))
        if new.where("new <> component").isEmpty():
            return label


def component_blocks(edges: DataFrame, local, schema: str, whole, pairs: bool = False, once: bool = False) -> DataFrame:
    """blocks.in_blocks of (src, dst and more), which are written once; components are those without direction, and found in one step where a component's edges lie in one partition."""
    e = kept(edges.where("src IS NOT NULL AND dst IS NOT NULL"))
    return blocks.in_blocks(e, components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))), local, schema, whole, pairs, once)


def pagerank(edges: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-10) -> DataFrame:
    """(node, rank) of directed edges (src, dst), settled; ranks of nodes without links out are shared by all. Sums to 1. rounds: the state after exactly so many instead.
    What all nodes get is the same for each, so settled ranks are in proportion to what walks bring that start once at each node and go on by the damping: components share only
    their sum, and one that fits a task is done there. A walk is followed until what goes on is less than the tolerance's share of all."""
    if rounds is not None:
        return _ranks_after(edges, rounds, damping)
    kind = edges.schema["src"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, (s, d) = blocks.coded(t["src"], t["dst"])
        return pa.table({"node": values, "met": blocks.walks(*blocks.distinct(s, d, len(values))[:2], len(values), damping, tolerance)})

    met = kept(component_blocks(edges.select("src", "dst"), local, f"node {kind}, met double", lambda e: _walks(e, damping, tolerance)))
    return met.select("node", (F.col("met") / F.lit(met.agg(F.sum("met")).first()[0])).alias("rank"))


def _walks(edges: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """(node, met) by rounds: the walks that come to each node, one starting at each."""
    e = edges.select("src", "dst").distinct()
    e = kept(e.join(e.groupBy("src").agg(F.count("*").alias("k")), "src"))
    state = kept(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.lit(1.0).alias("on"), F.lit(1.0).alias("met")))
    while True:
        on, met = state.agg(F.sum("on"), F.sum("met")).first()
        if not on or on <= tolerance * met:
            return state.select("node", "met")
        got = e.join(state.where("on > 0").select(F.col("node").alias("src"), "on"), "src").groupBy(F.col("dst").alias("node")).agg((damping * F.sum(F.col("on") / F.col("k"))).alias("got"))
        got = state.join(got, "node", "left").select("node", F.coalesce("got", F.lit(0.0)).alias("on"), "met")
        state = kept(got.withColumn("met", F.col("met") + F.col("on")))


def _ranks_after(edges: DataFrame, rounds: int, damping: float) -> DataFrame:
    e = kept(edges.select("src", "dst").distinct())
    out = e.groupBy("src").agg(F.count("*").alias("k"))
    e = kept(e.join(out, "src"))
    # a node's links out stay with it, so that a round joins once and what is loose is a sum
    nodes = kept(e.select(F.col("src").alias("node"), "k").union(e.select("dst", F.lit(0))).groupBy("node").agg(F.max("k").alias("k")))
    n = nodes.count()
    rank = nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    for _ in range(rounds):
        sent = e.select("src", "dst").join(rank.select(F.col("node").alias("src"), (F.col("rank") / F.nullif("k", F.lit(0))).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        loose = rank.where("k = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("x")).first()["x"]
        rank = kept(rank.select("node", "k").join(sent, "node", "left").select("node", "k", ((1 - damping) / max(n, 1) + damping * (F.coalesce("got", F.lit(0.0)) + loose / max(n, 1))).alias("rank")))
    return rank.select("node", "rank")


def eigenvector(edges: DataFrame, weighted: bool = False, tolerance: float = 1e-6, most_rounds: int = 1000, rounds: int | None = None) -> DataFrame:
    """(node, eigenvector) of length 1: power iteration on the adjacency matrix plus the identity (which keeps two-sided graphs from swinging), until the summed change is
    below tolerance times the nodes; raises if that takes more than most_rounds. rounds: exactly so many instead."""
    e = cut(undirected(edges).select("a", "b", (F.col("n").cast("double") if weighted else F.lit(1.0)).alias("w")))
    x = cut(e.select(F.col("a").alias("node")).distinct())
    n = x.count()
    x = x.withColumn("x", F.lit(1.0 / max(n, 1)))
    for i in range(rounds if rounds is not None else most_rounds):
        got = e.join(x.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))
        step = x.join(got, "node").select("node", F.col("x").alias("old"), (F.col("x") + F.col("y")).alias("y"))
        new = cut(step.withColumn("x", F.col("y") / F.sqrt(step.select(F.sum(F.col("y") * F.col("y"))).scalar())))
        x = new.select("node", "x")
        if rounds is None and (n == 0 or new.agg(F.sum(F.abs(F.col("x") - F.col("old")))).first()[0] < n * tolerance):
            break
    else:
        if rounds is None:
            raise ValueError(f"not settled after {most_rounds} rounds")
    return x.withColumnRenamed("x", "eigenvector")


def label_propagation(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(node, community): each node takes the label of the most weight among its neighbours, the least of ties. Deterministic, synchronous."""
    both = cut(undirected(edges))
    label = cut(both.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("n").alias("w"))
        own = label.select("node", "community", F.lit(0.5).alias("w"))  # keeps pairs from swapping labels for ever
        votes = votes.union(own).groupBy("node", "community").agg(F.sum("w").alias("w"))
        first = Window.partitionBy("node").orderBy(F.desc("w"), "community")
        new = cut(votes.withColumn("i", F.row_number().over(first)).where("i = 1").select("node", "community"))
        changed = not new.join(label, ["node", "community"], "left_anti").isEmpty()
        label = new
        if not changed:
            break
    return label


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: Newman's modularity of the communities."""
    c = communities.select("node", "community")
    e = edges.join(c.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(c.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    total = edges.select(F.sum("n")).scalar()
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("n").alias("w"))
    weight = degrees(edges).join(c, "node").groupBy("community").agg(F.sum("strength").alias("d"))
    return weight.join(inside, "community", "left").agg(F.sum(F.coalesce("w", F.lit(0)) / total - F.pow(F.col("d") / (2 * total), F.lit(2))).alias("modularity"))


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles, clustering). Nodes are dealt into groups, and a task counts the triangles of three groups from the edges between them: an edge goes to as many tasks as there are
    groups, so no pair of edges is ever a row. Groups grow with the root of the edges, so a task's edges don't grow. Where nodes have many edges, these go packed, many to a row."""
    edges = kept(edges.select("a", "b"))
    m = edges.count()
    d = kept(edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree")))
    n = d.count()
    p, few = max(4 if m > 10_000 else 1, -(-n // blocks.GROUP_NODES), int(np.ceil(np.sqrt(m / blocks.GROUP_EDGES)))), n <= blocks.SENT_NODES
    ids = kept(ranked(d, "degree", "node", "id").select("node", (F.col("id") - 1).alias("id")))
    ends = [ids.select(F.col("node").alias(c), F.col("id").alias(f"_{c}")) for c in ("a", "b")]
    e = edges.where("a <> b").join(F.broadcast(ends[0]) if few else ends[0], "a").join(F.broadcast(ends[1]) if few else ends[1], "b").select(F.least("_a", "_b").alias("s"), F.greatest("_a", "_b").alias("t"))
    per = _dense_triangles(e, n, p) if p <= blocks.groups(m) else _sparse_triangles(e.distinct(), blocks.groups(m))
    per = per.groupBy("id").agg(F.sum("k").alias("triangles")).join(ids, "id").select("node", "triangles")
    k = F.col("degree")
    return d.join(per, "node", "left").select("node", F.coalesce("triangles", F.lit(0)).alias("triangles"), F.when(k > 1, 2 * F.coalesce("triangles", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("clustering"))


def _three(*groups: str):
    return F.array_sort(F.array(*groups)).alias("three")


def _sparse_triangles(e: DataFrame, p: int) -> DataFrame:
    """(id, k) of distinct edges (s, t): a row for each edge and task."""
    sent = e.withColumns({"i": F.col("s") % p, "j": F.col("t") % p}).withColumn("third", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(p - 1).cast("long")))).select("s", "t", _three("i", "j", "third"))

    def count(t: pa.Table) -> pa.Table:
        nodes, (s, u) = blocks.coded(t["s"], t["t"])
        k = blocks.triangles(s, u, nodes.to_numpy() % p, np.array(t["three"][0].as_py()))
        return pa.table({"id": nodes, "k": k}).filter(pa.array(k > 0))

    return sent.groupBy("three").applyInArrow(count, "id long, k long")


def _dense_triangles(e: DataFrame, n: int, p: int) -> DataFrame:
    """(id, k) of edges (s, t) between nodes 0 to n - 1, which may be there several times: a task has its nodes' neighbours in a group as bits."""
    width = -(-n // p)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s, t in blocks.chunks(batches, "s", "t"):
            i, j, x = zip(*blocks.packed(s, t, p, width), strict=True)
            yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "packed": pa.array(x, pa.binary())})

    def count(t: pa.Table) -> pa.Table:
        node, k = blocks.dense_triangles(zip(t["i"].to_numpy(), t["j"].to_numpy(), t["packed"], strict=True), t["three"][0].as_py(), p, width)
        return pa.table({"id": node, "k": k})

    sent = e.mapInArrow(pack, "i int, j int, packed binary").withColumn("third", F.explode(F.sequence(F.lit(0), F.lit(p - 1)))).select("i", "j", "packed", _three("i", "j", "third"))
    return sent.groupBy("three").applyInArrow(count, "id long, k long")


def in_order(edges: DataFrame, first, sent, merged) -> DataFrame:
    """(node, value) of an acyclic graph (src, dst and more), a round for each level: a node's value is final, and sent on, when all nodes before it have sent theirs.
    first: the value of sources; sent: aggregate of `value` and the edge's columns by dst, or a function that makes (node, k, got) of such rows, k being their number;
    merged: of `value` (null at first) and `got`. Raises on a cycle."""
    e = kept(edges.where("src IS NOT NULL AND dst IS NOT NULL"))
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    need = nodes.join(e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("need")), "node", "left").select("node", F.coalesce("need", F.lit(0)).alias("need"))
    state = kept(need.select("node", "need", F.when(F.col("need") == 0, first).alias("value"), (F.col("need") == 0).alias("fresh")))
    while not state.where("fresh").isEmpty():
        rows = e.join(state.where("fresh").select(F.col("node").alias("src"), "value"), "src")
        new = sent(rows) if callable(sent) else rows.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k"), sent.alias("got"))
        left = F.col("need") - F.coalesce("k", F.lit(0))
        value = F.when(F.col("k").isNull(), F.col("value")).otherwise(merged)
        state = kept(state.join(new, "node", "left").select("node", left.alias("need"), value.alias("value"), ((F.col("need") > 0) & (left == 0)).alias("fresh")))
    if not state.where("need > 0").isEmpty():
        raise ValueError("the graph has a cycle")
    return state.select("node", "value")


def followed(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """(route, step, key): the keys that each start (route, key) leads to along pointers (key, next; null at an end), from step 0 on. By doubling: the table of 2^i steps at once is made
    of that of half as many, so a way of L keys takes log2 L rounds. Raises where pointers run in a circle."""
    jump = cut(pointers.where("next IS NOT NULL").select("key", "next"))
    most, jumps = jump.count(), []
    while not jump.isEmpty():
        if 2 ** len(jumps) > most:
            raise ValueError("the graph has a cycle")
        jumps.append(jump)
        jump = cut(jump.join(jump.select(F.col("key").alias("next"), F.col("next").alias("over")), "next").select("key", F.col("over").alias("next")))
    path = starts.select("route", F.lit(0).alias("step"), "key")
    for i in range(len(jumps) - 1, -1, -1):
        path = path.union(path.join(jumps[i], "key").select("route", F.col("step") + 2**i, F.col("next").alias("key")))
    return path


def path_counts(edges: DataFrame, source: bool = True) -> DataFrame:
    """(node, paths): paths from the sources of an acyclic graph (src, dst) to each node, or from each node to the sinks."""
    e = edges.select("src", "dst").distinct()
    if not source:
        e = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return in_order(e, F.lit(1.0), F.sum("value"), F.coalesce("value", F.lit(0.0)) + F.col("got")).withColumnRenamed("value", "paths")


def traversal_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, spc): search path counts of an acyclic graph, paths into src times paths out of dst."""
    kind = edges.schema["src"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, (s, d) = blocks.coded(t["src"], t["dst"])
        return weighed(values, *blocks.distinct(s, d, len(values))[:2])

    return component_blocks(edges.select("src", "dst"), local, f"src {kind}, dst {kind}, spc double", _traversal_rounds)


def weighed(values: pa.Array, s: np.ndarray, d: np.ndarray) -> pa.Table:
    """(src, dst, spc) of a block's distinct edges."""
    n = len(values)
    spc = blocks.paths(s, d, n)[s] * blocks.paths(d, s, n)[d]
    return pa.table({"src": values.take(pa.array(s)), "dst": values.take(pa.array(d)), "spc": spc})


def _traversal_rounds(edges: DataFrame) -> DataFrame:
    into = path_counts(edges).select(F.col("node").alias("src"), F.col("paths").alias("p"))
    out = path_counts(edges, source=False).select(F.col("node").alias("dst"), F.col("paths").alias("q"))
    return edges.select("src", "dst").distinct().join(into, "src").join(out, "dst").select("src", "dst", (F.col("p") * F.col("q")).alias("spc"))


def main_path(weights: DataFrame) -> DataFrame:
    """(place, node) of the path of the greatest summed weight in an acyclic graph (src, dst, spc); ties go to the greater nodes."""
    e = kept(weights.select("src", "dst", F.col("spc").cast("double").alias("spc")))
    kind = e.schema["src"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, (s, d) = blocks.coded(t["src"], t["dst"])
        score, before = blocks.best_ways(s, d, t["spc"].to_numpy(), len(values))
        return pa.table({"node": values, "score": score, "prev": values.take(pa.array(before, mask=before < 0))})

    def rounds(e: DataFrame) -> DataFrame:
        start = F.struct(F.lit(0.0).alias("score"), F.lit(None).cast(kind).alias("prev"))
        step = F.max(F.struct((F.col("value.score") + F.col("spc")).alias("score"), F.col("src").alias("prev")))
        return in_order(e, start, step, F.greatest("value", "got")).select("node", "value.score", "value.prev")

    best = kept(component_blocks(e, local, f"node {kind}, score double, prev {kind}", rounds))
    last = kept(best.orderBy(F.desc("score"), F.desc("node")).limit(1).select(F.lit(1).alias("route"), F.col("node").alias("key")))
    path = kept(followed(_around(best.select(F.col("node").alias("key"), F.col("prev").alias("next")), last), last))
    return path.select((path.select(F.max("step")).scalar() - F.col("step") + 1).cast("int").alias("place"), F.col("key").alias("node"))


def _around(pointers: DataFrame, starts: DataFrame) -> DataFrame:
    """The pointers (key, next) of the components that hold starts."""
    part = components(pointers.select(F.col("key").alias("a"), F.col("next").alias("b"))).withColumnRenamed("node", "key")
    near = part.join(part.join(F.broadcast(starts.select("key")), "key").select("component"), "component", "left_semi")
    return kept(pointers.join(near.select("key"), "key", "left_semi"))


def greedy_path(weights: DataFrame, forward: bool = True) -> DataFrame:
    """(place, node): from the heaviest edge out of a source always along the heaviest edge on (backward: from the heaviest edge into a sink, back).
    Ties go to the greater node. Raises on a cycle."""
    near, far = ("src", "dst") if forward else ("dst", "src")
    e = kept(weights.select(F.col(near).alias("near"), F.col(far).alias("far"), "spc"))
    ends = e.join(e.select(F.col("far").alias("near")).distinct(), "near", "left_anti")
    # the heaviest edge out of the start's node is the start
    start = kept(ends.orderBy(F.desc("spc"), F.desc("near"), F.desc("far")).limit(1).select(F.lit(1).alias("route"), F.col("near").alias("key")))
    best = kept(e.groupBy(F.col("near").alias("key")).agg(F.max(F.struct("spc", "far")).alias("x")).select("key", F.col("x.far").alias("next")))
    path = kept(followed(_around(best, start), start))
    place = F.col("step") + 1 if forward else path.select(F.max("step")).scalar() - F.col("step") + 1
    return path.select(place.cast("int").alias("place"), F.col("key").alias("node"))
