"""Graphs of any size as frames: strong components and condensation, best routes, communities by modularity, shortest paths. Every round is joins and aggregates
whose result is written to the shared folder; nothing but a few totals comes to the driver."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import blocks
from folioscope.operators.graph import component_blocks, components, degrees, eigenvector, followed, in_order, traversal_weights, undirected, weighed
from folioscope.operators.longform import kept


def _trimmed(e: DataFrame) -> DataFrame:
    """Edges whose start is entered and whose end is left by some edge, again while that drops a fifth of them: much of what no cycle leads to or comes from falls away."""
    n = e.count()
    while True:
        e = kept(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, n = n, e.count()
        if n == 0 or n > 0.8 * before:
            return e


def _colours(e: DataFrame) -> DataFrame:
    """(node, f, b): the least node from which a node can be reached, and the least that it reaches, itself included in both."""
    label = kept(e.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("f"), F.col("node").alias("b")))
    while True:
        down = e.join(label.select(F.col("node").alias("src"), "f"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("f").alias("gf"))
        up = e.join(label.select(F.col("node").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("b").alias("gb"))
        low = label.join(down, "node", "left").join(up, "node", "left").select("node", F.col("f").alias("f0"), F.col("b").alias("b0"), F.least("f", "gf").alias("lf"), F.least("b", "gb").alias("lb"))
        # what reaches a node's colour reaches the node, and likewise downwards
        over = [label.select(F.col("node").alias(f"l{c}"), F.col(c).alias(f"o{c}")) for c in ("f", "b")]
        new = kept(low.join(over[0], "lf").join(over[1], "lb").select("node", F.least("lf", "of").alias("f"), F.least("lb", "ob").alias("b"), "f0", "b0"))
        label = new.select("node", "f", "b")
        if new.where("f <> f0 OR b <> b0").isEmpty():
            return label


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node on a common cycle; a node on none is its own. edges: (src, dst). Components without direction that fit a task are taken there, others by rounds."""
    kind = edges.schema["src"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, (s, d) = blocks.coded(t["src"], t["dst"])
        return pa.table({"node": values, "component": values.take(pa.array(blocks.strong(s, d, len(values))))})

    return component_blocks(edges.select("src", "dst"), local, f"node {kind}, component {kind}", _strong_rounds)


def _strong_rounds(edges: DataFrame) -> DataFrame:
    """Rounds of trimming and of colouring forwards and backwards at once: where
    both colours are one node, it reaches them and they reach it, so they are its component; edges between different colours are on no cycle."""
    all_edges = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    nodes = all_edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    e = kept(all_edges.where("src <> dst").distinct())
    found = None
    while not (e := _trimmed(e)).isEmpty():
        colour = _colours(e)
        met = colour.where("f = b").select("node", F.col("f").alias("component"))
        found = met if found is None else found.union(met)
        rest = colour.where("f <> b")
        ends = [rest.select(F.col("node").alias(c), F.struct("f", "b").alias(f"_{c}")) for c in ("src", "dst")]
        e = kept(e.join(ends[0], "src").join(ends[1], "dst").where("_src = _dst").select("src", "dst"))
    if found is None:
        return nodes.withColumn("component", F.col("node"))
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def _condensed_block(t: pa.Table) -> tuple:
    """A block's nodes, and the edges between its strong components with their numbers."""
    values, (s, d) = blocks.coded(t["src"], t["dst"])
    part = blocks.strong(s, d, len(values))
    s, d = part[s], part[d]
    return values, *blocks.distinct(s[s != d], d[s != d], len(values))


def condensed(edges: DataFrame, once: bool = False) -> DataFrame:
    """(src, dst, n): the acyclic graph of the strong components, and how many edges each of its edges stands for. once: equal edges count as one."""
    kind = edges.schema["src"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, s, d, n = _condensed_block(t)
        return pa.table({"src": values.take(pa.array(s)), "dst": values.take(pa.array(d)), "n": n})

    return component_blocks(edges.select("src", "dst"), local, f"src {kind}, dst {kind}, n long", _condensed_rounds, once=once)


def _condensed_rounds(edges: DataFrame) -> DataFrame:
    part = kept(_strong_rounds(edges))
    ends = [part.select(F.col("node").alias(c), F.col("component").alias(f"_{c}")) for c in ("src", "dst")]
    e = edges.select("src", "dst").join(ends[0], "src").join(ends[1], "dst").where("_src <> _dst")
    return e.groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.count("*").alias("n"))


def condensed_weights(edges: DataFrame, method: str = "spc") -> DataFrame:
    """(src, dst, spc): traversal weights of a graph that may have cycles, between its strong components, each under its least node.
    method: spc, the paths from a source to a sink through an edge; splc, their share of all such paths; spnp, spc for each pair of a source and a sink."""
    kind = edges.schema["src"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, s, d, _ = _condensed_block(t)
        return weighed(values, s, d)

    w = kept(component_blocks(edges.select("src", "dst"), local, f"src {kind}, dst {kind}, spc double", lambda e: traversal_weights(_condensed_rounds(e))))
    if method == "spc":
        return w
    starts = w.join(w.select(F.col("dst").alias("src")).distinct(), "src", "left_anti")
    if method == "splc":
        return w.withColumn("spc", F.col("spc") / starts.select(F.sum("spc")).scalar())
    if method != "spnp":
        raise ValueError(f"no such weight: {method}")
    sinks = w.join(w.select(F.col("src").alias("dst")).distinct(), "dst", "left_anti")
    return w.withColumn("spc", F.col("spc") / (starts.select(F.count_distinct("src")).scalar() * sinks.select(F.count_distinct("dst")).scalar()))


def key_routes(weights: DataFrame, threshold: float = 0.5, top: int = 5) -> DataFrame:
    """(place, route, weight): the `top` heaviest source to sink paths of three nodes or more along edges of at least threshold times the greatest weight; of equal ones
    those with the lesser nodes. From the sinks on each node keeps its `top` best ways (weight, next node, place of the way there); the best are then followed."""
    strong = kept(weights.where(F.col("spc") >= threshold * weights.select(F.max("spc")).scalar()).select("src", "dst", F.col("spc").cast("double").alias("spc")))
    kind = strong.schema["src"].dataType.simpleString()
    ways = f"array<struct<o:double,next:{kind},j:int>>"
    inner = strong.select(F.col("dst").alias("src")).distinct().withColumn("inner", F.lit(True))
    back = strong.join(inner, "src", "left").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "spc", F.coalesce("inner", F.lit(False)).alias("inner"))

    def sent(rows: DataFrame) -> DataFrame:
        each = rows.select(F.col("dst").alias("node"), "spc", "inner", F.col("src").alias("next"), F.posexplode("value").alias("j", "x"))
        each = each.where("inner OR x.next IS NOT NULL").select("node", (F.col("x.o") - F.col("spc")).alias("o"), "next", "j")
        best = F.row_number().over(Window.partitionBy("node").orderBy("o", "next", "j"))
        each = each.withColumn("i", best).where(F.col("i") <= top).groupBy("node").agg(F.collect_list(F.struct("o", "next", "j")).cast(ways).alias("got"))
        return rows.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("k")).join(each, "node", "left")

    none = F.array().cast(ways)
    first = F.expr(f"cast(array(struct(0.0D AS o, cast(NULL AS {kind}) AS next, 0 AS j)) AS {ways})")
    merged = F.slice(F.array_sort(F.concat(F.coalesce("value", none), F.coalesce("got", none))), 1, top)
    state = kept(in_order(back, first, sent, merged))
    each = state.select("node", F.posexplode("value").alias("j", "x"))
    pointers = each.select(F.struct("node", "j").alias("key"), F.when(F.col("x.next").isNotNull(), F.struct(F.col("x.next").alias("node"), F.col("x.j").alias("j"))).alias("next"))
    sources = each.join(inner.select(F.col("src").alias("node")), "node", "left_anti").join(strong.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    place = F.row_number().over(Window.orderBy("x.o", "node", "j"))  # top rows
    starts = sources.orderBy("x.o", "node", "j").limit(top).select(place.alias("route"), F.struct("node", "j").alias("key"), (-F.col("x.o")).alias("weight"))
    starts = kept(starts)
    steps = followed(pointers, starts.select("route", "key")).groupBy("route").agg(F.array_sort(F.collect_list(F.struct("step", F.col("key.node").alias("node")))).alias("steps"))
    return starts.join(steps, "route").select(F.col("route").alias("place"), F.col("steps.node").alias("route"), "weight")


def _adjacency(edges: DataFrame) -> DataFrame:
    """(a, b, w) in both directions; a loop once, with twice its weight."""
    w = edges.select("a", "b", F.col("n").cast("double").alias("w"))
    turned = w.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "w")
    return w.withColumn("w", F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w"))).union(turned).groupBy("a", "b").agg(F.sum("w").alias("w"))


def _moved(adj: DataFrame, label: DataFrame, total: float, resolution: float, tolerance: float) -> tuple[DataFrame, float]:
    """The best (node, community) met, and its modularity, when nodes go to the neighbouring community of the greatest gain. Half of the nodes, another half each round, may go at once,
    so that neighbours don't change places for ever; ends where no node gains or three rounds brought nothing."""
    degree = adj.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    links = adj.where("a <> b")
    loops = adj.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("w"))), F.lit(0.0))).first()[0]
    label = kept(label.join(degree, "node").select("node", "community", "k"))
    best, stalled = (label, float("-inf")), 0
    for r in count():
        mass = label.groupBy("community").agg(F.sum("k").alias("tot"))
        near = links.join(label.select(F.col("node").alias("b"), "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("w").alias("w"))
        own = label.join(mass, "community").select("node", F.col("community").alias("own"), "k", (F.col("tot") - F.col("k")).alias("others"))
        here = F.col("community") == F.col("own")
        gain = F.col("w") - resolution * F.col("k") * (F.col("tot") - F.when(here, F.col("k")).otherwise(0.0)) / total
        choice = near.join(mass, "community").join(own, "node").groupBy("node").agg(F.min(F.struct((-gain).alias("loss"), "community")).alias("x"), F.coalesce(F.max(F.when(here, F.col("w"))), F.lit(0.0)).alias("inside"))
        step = own.join(choice, "node", "left").select("node", "own", "k", F.coalesce("inside", F.lit(0.0)).alias("inside"), F.col("x.community").alias("to"), (-F.col("x.loss") - (F.coalesce("inside", F.lit(0.0)) - resolution * F.col("k") * F.col("others") / total)).alias("more"))
        step = kept(step)
        gains = F.col("more") > 1e-9 * total
        inside, movers = step.agg(F.sum("inside"), F.count(F.when(gains, 1))).first()
        q = ((inside or 0.0) + loops) / total - resolution * (mass.agg(F.sum(F.pow(F.col("tot") / total, F.lit(2)))).first()[0])
        best, stalled = ((label, q), 0) if q > best[1] + tolerance else (best, stalled + 1)
        if not movers or stalled >= 3:
            return best[0].select("node", "community"), best[1]
        turn = F.xxhash64(F.col("node").cast("string"), F.lit(r)) % 2 == 0
        label = step.select("node", F.when(gains & turn, F.col("to")).otherwise(F.col("own")).alias("community"), "k")
    raise AssertionError


def modularity_communities(edges: DataFrame, resolution: float = 1.0, tolerance: float = 1e-5) -> DataFrame:
    """(node, community) by local moves and merging (a, b, n), each community under its least node. Levels: nodes move, communities become the nodes of the next graph; when that gains
    nothing more, single nodes may move once more in the whole graph, and all begins anew while that helps. Deterministic, whatever the partitions.
    Components only share the total weight, so one that fits a task is done there, node after node; larger ones go by rounds of frames."""
    whole = kept(_adjacency(edges.where("a IS NOT NULL AND b IS NOT NULL")))
    total = whole.agg(F.sum("w")).first()[0]
    kind = whole.schema["a"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        nodes, (s, d) = blocks.coded(t["src"], t["dst"])
        return pa.table({"node": nodes, "community": nodes.take(pa.array(blocks.communities(s, d, t["w"].to_numpy(), len(nodes), total, resolution, tolerance)))})

    def rounds(e: DataFrame) -> DataFrame:
        one = e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "w")
        return _communities(kept(one.union(one.where("a <> b").select("b", "a", "w"))), total, resolution, tolerance)

    return component_blocks(whole.where("a <= b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), local, f"node {kind}, community {kind}", rounds)


def _communities(whole: DataFrame, total: float, resolution: float, tolerance: float) -> DataFrame:
    """modularity_communities by rounds; whole: (a, b, w) in both directions."""
    member = kept(whole.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node")))

    def merged(adj: DataFrame, label: DataFrame) -> DataFrame:
        ends = [label.select(F.col("node").alias(c), F.col("community").alias(f"_{c}")) for c in ("a", "b")]
        return kept(adj.join(ends[0], "a").join(ends[1], "b").groupBy(F.col("_a").alias("a"), F.col("_b").alias("b")).agg(F.sum("w").alias("w")))

    adj, q, at_nodes = whole, float("-inf"), True
    while True:
        start = member if at_nodes else adj.select(F.col("a").alias("node")).distinct().withColumn("community", F.col("node"))
        label, new = _moved(adj, start, total, resolution, tolerance)
        better = new > q + tolerance
        if not better and at_nodes:
            break
        if better:
            q = new
            if not at_nodes:
                label = member.join(label.select(F.col("node").alias("community"), F.col("community").alias("to")), "community").select("node", F.col("to").alias("community"))
            member = kept(label)
            adj = merged(whole, member)
        at_nodes = not better  # nothing gained by merging: single nodes may move again
        if at_nodes:
            adj = whole
    least = member.groupBy("community").agg(F.min("node").alias("least"))
    return member.join(least, "community").select("node", F.col("least").alias("community"))


def hop_levels(near: DataFrame, sources: DataFrame) -> list[DataFrame]:
    """(s, v, paths) by distance: from each source all nodes at that distance and the number of shortest paths there. near: (a, b) in both directions; sources: (node)."""
    levels = [kept(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))]
    while True:
        step = levels[-1].join(near.select(F.col("a").alias("v"), F.col("b").alias("w")), "v").groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths"))
        for known in levels[-2:]:  # without directions, neighbours are at most one step nearer
            step = step.join(known.select("s", "v"), ["s", "v"], "left_anti")
        step = kept(step)
        if step.isEmpty():
            return levels
        levels.append(step)


def _near(edges: DataFrame) -> DataFrame:
    return kept(undirected(edges).where("a <> b").select("a", "b").distinct())


def _unturned(edges: DataFrame) -> DataFrame:
    """(src, dst) of edges (a, b) without direction, the lesser node first, no loops. Equal ones stay, so nothing moves before components are known."""
    return edges.where("a <> b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def _hop_blocks(edges: DataFrame) -> DataFrame:
    """(component, node, reached, total, far, between) of edges (a, b): the others a node reaches, their summed and greatest distance, its dependencies. Components
    that fit a task are taken there, of others the levels are frames."""
    kind = edges.schema["a"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, (s, d, part) = blocks.coded(t["src"], t["dst"], t["component"])
        reached, total, far, between = blocks.hops(np.append(s, d), np.append(d, s), len(values))
        of = np.empty(len(values), np.int64)
        of[s], of[d] = part, part
        return pa.table({"component": values.take(pa.array(of)), "node": values, "reached": reached, "total": total, "far": far, "between": between})

    def whole(e: DataFrame) -> DataFrame:
        e = _near(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("n")))
        part = components(e)
        levels = hop_levels(e, part.select("node"))
        between, each = _dependencies(e, levels), None
        for d, level in enumerate(levels[1:], 1):
            t = level.groupBy("s").agg(F.count("*").alias("k"), F.lit(d).alias("d"))
            each = t if each is None else each.union(t)
        node = each.groupBy(F.col("s").alias("node")).agg(F.sum("k").alias("reached"), F.sum(F.col("k") * F.col("d")).alias("total"), F.max("d").cast("long").alias("far"))
        return part.join(node, "node").join(between, "node").select("component", "node", "reached", "total", "far", "between")

    schema = f"component {kind}, node {kind}, reached long, total long, far long, between double"
    return component_blocks(_unturned(edges), local, schema, whole, pairs=True, once=True)


def _dependencies(near: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """(node, between) of levels of shortest paths: dependencies added up from the farthest level back."""
    depend, between = None, None
    for d in range(len(levels) - 1, 0, -1):
        here = levels[d].withColumn("dep", F.lit(0.0)) if depend is None else levels[d].join(depend, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("x", F.lit(0.0))).alias("dep"))
        here = kept(here)
        part = here.select("v", "dep")
        between = part if between is None else between.union(part)
        # joined to the level before, where it counts; neighbours of the same or the next level drop out there
        depend = here.join(near.select(F.col("a").alias("v"), F.col("b").alias("u")), "v").groupBy("s", F.col("u").alias("v")).agg(F.sum((1 + F.col("dep")) / F.col("paths")).alias("x"))
    return between.groupBy(F.col("v").alias("node")).agg(F.sum("dep").alias("between"))


def path_centralities(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(node, betweenness, closeness) from shortest paths out of all nodes at once, dependencies added up from the farthest level back. sources: (node) to start from only some:
    betweenness is then scaled up, an estimate, and closeness null for the others."""
    if sources is None:
        hops = kept(_hop_blocks(edges))
        n = hops.count()
        scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return hops.select("node", (F.col("between") * scale).alias("betweenness"), (F.col("reached") / F.col("total") * F.col("reached") / (n - 1)).alias("closeness"))
    near = _near(edges)
    nodes = kept(near.select(F.col("a").alias("node")).distinct())
    n = nodes.count()
    starts = kept(nodes.join(sources.select("node").distinct(), "node", "left_semi"))
    levels = hop_levels(near, starts)
    if len(levels) == 1:
        return nodes.select("node", F.lit(0.0).alias("betweenness"), F.lit(0.0).alias("closeness"))
    far = None
    for d, level in enumerate(levels[1:], 1):
        t = level.groupBy("s").agg(F.count("*").alias("k"), F.lit(d).alias("d"))
        far = t if far is None else far.union(t)
    share = n / max(starts.count(), 1)
    scale = share / ((n - 1) * (n - 2)) if n > 2 else share
    between = _dependencies(near, levels).select("node", (F.col("between") * scale).alias("betweenness"))
    close = far.groupBy(F.col("s").alias("node")).agg((F.sum("k") / F.sum(F.col("k") * F.col("d")) * F.sum("k") / (n - 1)).alias("closeness"))
    return nodes.join(between, "node", "left").join(close, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"), "closeness")


def centralities(edges: DataFrame) -> DataFrame:
    """(node, degree, betweenness, closeness, eigenvector) of a graph of any size; work grows with nodes x edges, so of large ones take path_centralities from some sources, or hop_closeness."""
    return degrees(edges).select("node", "degree").join(path_centralities(edges), "node").join(eigenvector(edges), "node")


def path_stats(edges: DataFrame) -> DataFrame:
    """(component, nodes, diameter, radius, mean_path) of each component under its least node: the greatest and the least eccentricity and the mean distance of two nodes."""
    hops = _hop_blocks(edges)
    return hops.groupBy("component").agg(F.count("*").alias("nodes"), F.max("far").cast("int").alias("diameter"), F.min("far").cast("int").alias("radius"), (F.sum("total") / F.sum("reached")).alias("mean_path"))


def hop_closeness(edges: DataFrame, lg_k: int = 12) -> DataFrame:
    """(node, reached, closeness, eccentricity): counted in components that fit a task, in larger ones estimated: each node's ball of radius r is a sketch that is joined with its neighbours' balls to make that of r + 1, so work is edges x
    diameter. The relative error of a ball's size is 1.04 / sqrt(2 ** lg_k), 1.6 % at 12; balls that grow by less than that look full, so eccentricity can fall short."""
    kind = edges.schema["a"].dataType.simpleString()

    def local(t: pa.Table) -> pa.Table:
        values, (s, d) = blocks.coded(t["src"], t["dst"])
        reached, total, far, _ = blocks.hops(np.append(s, d), np.append(d, s), len(values), False)
        return pa.table({"node": values, "size": reached + 1, "far": total, "ecc": far})

    def balls(e: DataFrame) -> DataFrame:
        return _balls(_near(e.select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(1).alias("n"))), lg_k)

    ball = kept(component_blocks(_unturned(edges), local, f"node {kind}, size long, far long, ecc long", balls, pairs=True, once=True))
    n, k = ball.count(), F.col("size") - 1
    return ball.select("node", F.col("size").alias("reached"), F.when(F.col("far") > 0, k / F.col("far") * k / (n - 1)).otherwise(0.0).alias("closeness"), F.col("ecc").cast("int").alias("eccentricity"))


def _balls(near: DataFrame, lg_k: int) -> DataFrame:
    """(node, size, far, ecc) by sketches."""
    nodes = near.select(F.col("a").alias("node")).distinct()
    with_self = kept(near.union(nodes.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    ball = kept(nodes.select("node", F.col("node").cast("string").alias("x")).groupBy("node").agg(F.hll_sketch_agg("x", F.lit(lg_k)).alias("ball")).withColumns({"size": F.lit(1).cast("long"), "far": F.lit(0).cast("long"), "ecc": F.lit(0)}))
    for r in count(1):
        grown = with_self.join(ball.select(F.col("node").alias("b"), "ball"), "b").groupBy(F.col("a").alias("node")).agg(F.hll_union_agg("ball").alias("ball"))
        more = F.greatest(F.hll_sketch_estimate("new") - F.col("size"), F.lit(0))
        step = ball.drop("ball").join(grown.withColumnRenamed("ball", "new"), "node").withColumn("more", more)
        ball = kept(step.select("node", F.col("new").alias("ball"), (F.col("size") + F.col("more")).alias("size"), (F.col("far") + r * F.col("more")).alias("far"), F.when(F.col("more") > 0, r).otherwise(F.col("ecc")).alias("ecc")))
        if ball.where(F.col("ecc") == r).isEmpty():
            break
    return ball.select("node", "size", "far", F.col("ecc").cast("long").alias("ecc"))
