"""Small components of a graph, many to a task: components are labelled by joins and aggregates, dealt over blocks by one shuffle, and a block's arrays take all levels at once.
A component too large for that goes to the caller's way by rounds of frames."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators.longform import kept

#: A component's most edges in a block, or their square (in both directions) where pairs of nodes are made; a block has about as much in all, and never more than twice of it by one component.
TASK_EDGES = 500_000
TASK_PAIRS = 4_000_000
#: Rows on each side of a task's products, and their items.
TASK_ROWS = 10_000
TASK_ITEMS = 2_000_000
#: Items of most products that a task multiplies as a whole matrix, the others go by their lists; and the products it holds at once.
WHOLE_ITEMS = 512
PRODUCTS = 4_000_000
#: Edges that are put together at once before they leave their partition.
CHUNK = 1_000_000


def coded(*columns: pa.ChunkedArray) -> tuple[pa.Array, list[np.ndarray]]:
    """The sorted distinct values of columns of one type, and the places of each column's values among them. Structs go by their fields, nulls first."""
    every = pa.chunked_array([x for c in columns for x in c.chunks], columns[0].type).combine_chunks()
    if isinstance(every, pa.ChunkedArray):
        every = every.combine_chunks() if every.num_chunks != 1 else every.chunk(0)
    values, place = _struct_coded(every) if pa.types.is_struct(every.type) else _plain_coded(every)
    return values, np.split(place, np.cumsum([len(c) for c in columns])[:-1])


def _plain_coded(every: pa.Array) -> tuple[pa.Array, np.ndarray]:
    every = every.dictionary_encode()
    order = np.argsort(every.dictionary.to_numpy(zero_copy_only=False), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return every.dictionary.take(pa.array(order)), place[every.indices.to_numpy()]


def _struct_coded(every: pa.StructArray) -> tuple[pa.Array, np.ndarray]:
    """A struct is null, or the places of its fields' values one after another, 0 for a null."""
    place = np.array(every.is_valid()).astype(np.int64)
    for field in every.flatten():
        known = np.array(field.is_valid(), bool)
        kept = field.filter(pa.array(known))
        k = np.zeros(len(field), np.int64)
        values, at = _struct_coded(kept) if pa.types.is_struct(kept.type) else _plain_coded(kept)
        k[known] = at + 1
        # ranks stay below the rows, so the product can't overflow
        place = np.unique(place * (len(values) + 1) + k, return_inverse=True)[1]
    _, first, place = np.unique(place, return_index=True, return_inverse=True)
    return every.take(pa.array(first)), place


def lowest(s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """The least node joined with each of n nodes by edges without direction."""
    label = np.arange(n)
    while True:
        low, new = np.minimum(label[s], label[t]), label.copy()
        for at in (s, t, label[s], label[t]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joined(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that the edges (a, b) of one partition join it with; a node has a row for each partition and chunk that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            values, (s, u) = coded(t["a"], t["b"])
            yield from pa.table({"node": values, "root": values.take(pa.array(lowest(s, u, len(values))))}).to_batches()

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + len(batch)
            if n >= CHUNK:
                yield from labelled(held)
                held, n = [], 0
        if n:
            yield from labelled(held)

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").mapInArrow(run, f"node {kind}, root {kind}")


def in_blocks(edges: DataFrame, part: DataFrame, local: Callable[[pa.Table], pa.Table], schema: str, whole: Callable[[DataFrame], DataFrame], pairs: bool = False, once: bool = False) -> DataFrame:
    """local over tables of the edges (src, dst and more, with component) of whole components, several to a table; whole over the edges of components that are too large.
    part: (node, component) of all nodes; edges are read twice. pairs: local makes pairs of a component's nodes, edges go both ways and stand once. once: equal edges become one, where the join
    by their start has them together."""
    tagged = edges.join(part.select(F.col("node").alias("src"), "component"), "src")
    tagged = kept(tagged.distinct() if once else tagged)
    k = F.col("k").cast("double")
    cost, most = (4 * k * k, TASK_PAIRS) if pairs else (k, TASK_EDGES)
    sizes = kept(tagged.groupBy("component").agg(F.count("*").alias("k")).withColumn("cost", cost))
    total, greatest = sizes.agg(F.sum("cost"), F.max("cost")).first()
    large = greatest is not None and greatest > most
    small = tagged.join(sizes.where(F.col("cost") > most), "component", "left_anti") if large else tagged
    n = int((total or 0) // most) * (2 if pairs else 4) + 1
    out = small.groupBy(F.pmod(F.xxhash64("component"), F.lit(n)).alias("block")).applyInArrow(local, schema)
    if not large:
        return out
    return out.union(whole(tagged.join(sizes.where(F.col("cost") > most), "component", "left_semi").select(*edges.columns)).select(*out.columns))


def strong(s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """The least node on a common cycle with each of n nodes, itself if there is none: trimming, then colours forwards and backwards, until no edge is left."""
    out = np.arange(n)
    s, t = s[s != t], t[s != t]
    while len(s):
        on = (np.bincount(t, minlength=n) > 0)[s] & (np.bincount(s, minlength=n) > 0)[t]
        if not on.all():
            s, t = s[on], t[on]
            continue
        f, b = np.arange(n), np.arange(n)
        while True:
            f2, b2 = f.copy(), b.copy()
            np.minimum.at(f2, t, f[s])
            np.minimum.at(b2, s, b[t])
            f2, b2 = f2[f2], b2[b2]
            if (f2 == f).all() and (b2 == b).all():
                break
            f, b = f2, b2
        met = f == b
        out[met & (out == np.arange(n))] = f[met & (out == np.arange(n))]
        on = (f[s] == f[t]) & (b[s] == b[t]) & ~met[s]
        s, t = s[on], t[on]
    return out


def distinct(s: np.ndarray, t: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct edges and how often each is there."""
    key, k = np.unique(s * n + t, return_counts=True)
    return key // max(n, 1), key % max(n, 1), k


def levels(s: np.ndarray, t: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """The places of the edges out of each level of an acyclic graph, level after level: all edges into a node come before those out of it."""
    left, at = np.bincount(t, minlength=n), np.argsort(s, kind="stable")
    start = np.searchsorted(s[at], np.arange(n + 1))
    fresh, done = np.flatnonzero(left == 0), 0
    while len(fresh):
        done += len(fresh)
        out = at[spread(start[fresh], start[fresh + 1])]
        yield out
        np.subtract.at(left, t[out], 1)
        fresh = np.unique(t[out][left[t[out]] == 0])
    if done < n:
        raise ValueError("the graph has a cycle")


def spread(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all ranges from start to before end, one range after the other."""
    k = end - start
    return np.arange(k.sum()) + np.repeat(start - np.cumsum(k) + k, k)


def paths(s: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    """Paths from the sources to each node."""
    out = np.where(np.bincount(t, minlength=n) == 0, 1.0, 0.0)
    for e in levels(s, t, n):
        np.add.at(out, t[e], out[s[e]])
    return out


def walks(s: np.ndarray, t: np.ndarray, n: int, damping: float, tolerance: float) -> np.ndarray:
    """The walks that come to each node, one starting at each; a node shares out what it gets times the damping. s, t: distinct edges."""
    on, met = np.ones(n), np.ones(n)
    share = damping / np.maximum(np.bincount(s, minlength=n), 1)
    while on.sum() > tolerance * met.sum():
        on = np.bincount(t, (on * share)[s], n)
        met += on
    return met


def best_ways(s: np.ndarray, t: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The greatest summed weight of a way to each node, and the node before it (-1 for sources), the greatest of ties."""
    score, before = np.where(np.bincount(t, minlength=n) == 0, 0.0, -np.inf), np.full(n, -1)
    for e in levels(s, t, n):
        here = score[s[e]] + w[e]
        # a node's ways may come from several levels: a better one replaces what was kept, an equal one if its node is greater
        old = score[t[e]]
        np.maximum.at(score, t[e], here)
        before[t[e][score[t[e]] > old]] = -1
        same = here == score[t[e]]
        np.maximum.at(before, t[e][same], s[e][same])
    return score, before


def hops(a: np.ndarray, b: np.ndarray, n: int, shares: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node: how many others it reaches, their summed and greatest distance, and what it adds to shortest paths between others (if shares). a, b: edges in both directions, once each."""
    order = np.argsort(a, kind="stable")
    b, start = b[order], np.searchsorted(a[order], np.arange(n + 1))
    node = np.arange(n)
    reached, total, far, between = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)

    def sent(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(v)), start[v + 1] - start[v]), b[spread(start[v], start[v + 1])]

    def found(key: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, key), len(known) - 1)
        return at, known[at] == key

    known = [(node * n + node, np.ones(n))] if n else []
    while known:
        key, ways = known[-1]
        row, to = sent(key % n)
        new, ways = key[row] // n * n + to, ways[row]
        for level in known[-2:]:  # without directions, neighbours are at most one step nearer
            fresh = ~found(new, level[0])[1]
            new, ways = new[fresh], ways[fresh]
        if not len(new):
            break
        key, at = np.unique(new, return_inverse=True)
        d = len(known)
        k = np.bincount(key // n, minlength=n)
        reached, total, far = reached + k, total + d * k, np.where(k > 0, d, far)
        known.append((key, np.bincount(at, ways)))
    x = None
    for d in range(len(known) - 1 if shares else 0, 0, -1):
        key, ways = known[d]
        dep = np.zeros(len(key)) if x is None else ways * x
        between += np.bincount(key % n, dep, minlength=n)
        row, to = sent(key % n)
        at, hit = found(key[row] // n * n + to, known[d - 1][0])
        x = np.bincount(at[hit], ((1 + dep) / ways)[row[hit]], minlength=len(known[d - 1][0]))
    return reached, total, far, between


#: Edges between three groups of nodes that a task counts triangles in, and pairs of edges it looks at together.
GROUP_EDGES = 1_000_000
STEP = 4_000_000
#: Nodes of a group whose neighbours are bits, words of these that are looked at together, and nodes whose numbers are sent to all tasks.
GROUP_NODES = 8192
WORDS = 1 << 15
SENT_NODES = 500_000


def groups(edges: int) -> int:
    """Groups of nodes by which three groups have about GROUP_EDGES edges; four at least where there is work to share."""
    return max(4 if edges > 10_000 else 1, int(np.ceil(np.sqrt(6 * edges / GROUP_EDGES))))


def triangles(s: np.ndarray, t: np.ndarray, group: np.ndarray, three: np.ndarray) -> np.ndarray:
    """For each node, the triangles it is in whose nodes' groups are the three. Edges go from lower to higher degree, so hubs make few pairs."""
    n = len(group)
    rank = np.argsort(np.argsort(np.bincount(s, minlength=n) + np.bincount(t, minlength=n), kind="stable"))
    node = np.argsort(rank)
    code = np.sort(np.minimum(rank[s], rank[t]) * n + np.maximum(rank[s], rank[t]))
    a, b = code // n, code % n
    end, out = np.searchsorted(a, a, "right"), np.zeros(n, np.int64)
    done = np.concatenate([[0], np.cumsum(end - np.arange(len(code)) - 1)])
    at = 0
    while at < len(code):
        to = max(at + 1, int(np.searchsorted(done, done[at] + STEP, "right")) - 1)
        first = np.arange(at, to)
        x = np.repeat(first, end[at:to] - first - 1)
        y = spread(first + 1, end[at:to])
        want = b[x] * n + b[y]
        hit = code[np.minimum(np.searchsorted(code, want), len(code) - 1)] == want
        found = np.stack([node[a[x[hit]]], node[b[x[hit]]], node[b[y[hit]]]])
        found = found[:, (np.sort(group[found], axis=0) == three[:, None]).all(axis=0)]
        out += np.bincount(found.ravel(), minlength=n)
        at = to
    return out


def chunks(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[list[np.ndarray]]:
    """The columns of CHUNK rows or a little more at once."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + len(batch)
        if n >= CHUNK:
            yield [np.concatenate([b[c].to_numpy() for b in held]) for c in columns]
            held, n = [], 0
    if n:
        yield [np.concatenate([b[c].to_numpy() for b in held]) for c in columns]


def _once(code: np.ndarray) -> np.ndarray:
    """Sorted, each once; np.unique hashes, which takes far longer here."""
    code = np.sort(code)
    return code[np.append(True, code[1:] != code[:-1])] if len(code) else code


def packed(s: np.ndarray, t: np.ndarray, p: int, width: int) -> Iterator[tuple[int, int, bytes]]:
    """(i, j, edges) for each two groups i <= j that edges join: the distinct edges' codes among width x width in order, as compressed steps. A node's group is its remainder."""
    turn = (s % p > t % p) | ((s % p == t % p) & (s > t))
    s, t = np.where(turn, t, s), np.where(turn, s, t)
    code = _once(((s % p * p + t % p) * width + s // p) * width + t // p)
    pair, code = code // width**2, code % width**2
    for part in np.split(np.arange(len(code)), np.flatnonzero(np.diff(pair)) + 1):
        i, j = divmod(int(pair[part[0]]), p)
        yield i, j, zlib.compress(np.diff(code[part], prepend=0).astype(np.uint32).tobytes(), 1)


def _bits(row: np.ndarray, to: np.ndarray, width: int) -> np.ndarray:
    """Each row's nodes as bits."""
    order = np.argsort(row, kind="stable")
    row, to = row[order], to[order]
    wide = -(-width // 64) * 64
    out = np.zeros((width, wide // 8), np.uint8)
    step = max(1, STEP // wide)
    for first in range(0, width, step):
        some = slice(*np.searchsorted(row, (first, first + step)))
        there = np.zeros((min(step, width - first), wide), bool)
        there[row[some] - first, to[some]] = True
        out[first : first + step] = np.packbits(there, axis=1)
    return out.view(np.uint64)


def dense_triangles(sent: Iterable[tuple[int, int, pa.BinaryScalar]], three: list[int], p: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, triangles of theirs whose nodes' groups are the three): for each edge the neighbours that both ends have in the third group."""
    codes: dict = {}
    for i, j, x in sent:
        codes.setdefault((int(i), int(j)), []).append(np.cumsum(np.frombuffer(zlib.decompress(x.as_py()), np.uint32), dtype=np.int64))
    edges = {g: np.divmod(_once(np.concatenate(c)), width) for g, c in codes.items()}
    near: dict = {}

    def bits(g: int, r: int) -> np.ndarray | None:
        if (g, r) not in near:
            a, b = edges.get((min(g, r), max(g, r)), (None, None))
            if a is None:
                return None
            if g == r:
                a, b = np.append(a, b), np.append(b, a)
            near[g, r] = _bits(a, b, width) if g <= r else _bits(b, a, width)
        return near[g, r]

    x, y, z = three
    total = {g: np.zeros(width, np.int64) for g in three}
    for g, h, r in {(x, y, z), (y, z, x), (x, z, y)}:
        if (g, h) not in edges or (left := bits(g, r)) is None or (right := bits(h, r)) is None:
            continue
        a, b = edges[g, h]
        step = max(1, WORDS // left.shape[1])
        for first in range(0, len(a), step):
            u, v = a[first : first + step], b[first : first + step]
            k = np.bitwise_count(left[u] & right[v]).sum(1, dtype=np.int64)
            total[g] += np.bincount(u, k, width).astype(np.int64)
            total[h] += np.bincount(v, k, width).astype(np.int64)
    node = np.concatenate([np.arange(width) * p + g for g in total])
    # a node's triangle is met by two of its edges
    k = np.concatenate(list(total.values())) // 2
    return node[k > 0], k[k > 0]


def items(column: pa.ChunkedArray) -> tuple[pa.ChunkedArray, np.ndarray]:
    """The items of a column of lists, and the place of each one's list."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks() if lists.num_chunks != 1 else lists.chunk(0)
    return pa.chunked_array([lists.flatten()]), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def products(left: tuple[np.ndarray, np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray, np.ndarray], n_left: int, n_right: int, n_items: int) -> Iterator[tuple[int, np.ndarray]]:
    """The products of all rows of two sparse matrices, (row, item, value) each, some rows of the left one at a time: the first one's place and their products with all of the right one."""
    (lr, li, lv), (rr, ri, rv) = left, right
    both = np.bincount(li, minlength=n_items).astype(float) * np.bincount(ri, minlength=n_items)
    often = np.argsort(-both, kind="stable")[:WHOLE_ITEMS]
    often = often[both[often] > 0]
    place = np.full(n_items, -1)
    place[often] = np.arange(len(often))
    on = place[ri] >= 0
    b = np.zeros((len(often), n_right))
    b[place[ri[on]], rr[on]] = rv[on]
    at = np.argsort(ri, kind="stable")
    begin = np.searchsorted(ri[at], np.arange(n_items + 1))
    order = np.lexsort((li, lr))
    lr, li, lv = lr[order], li[order], lv[order]
    step = max(1, PRODUCTS // max(n_right, 1))
    for first in range(0, n_left, step):
        few = slice(*np.searchsorted(lr, (first, first + step)))
        row, item, value = lr[few] - first, li[few], lv[few]
        on = place[item] >= 0
        a = np.zeros((min(step, n_left - first), len(often)))
        a[row[on], place[item[on]]] = value[on]
        out = a @ b
        rare = ~on & (both[item] > 0)
        row, item, value = row[rare], item[rare], value[rare]
        by = np.argsort(item, kind="stable")
        row, item, value = row[by], item[by], value[by]
        ends = np.append(np.flatnonzero(np.diff(item, prepend=-1)), len(item))
        for h, end in zip(ends[:-1], ends[1:], strict=True):
            theirs = at[begin[item[h]] : begin[item[h] + 1]]
            out[np.ix_(row[h:end], rr[theirs])] += np.outer(value[h:end], rv[theirs])
        yield first, out


def communities(s: np.ndarray, t: np.ndarray, w: np.ndarray, n: int, total: float, resolution: float, tolerance: float) -> np.ndarray:
    """The least node of each node's community. Edges stand once, loops with twice their weight; total is both directions' weight of the whole graph, of which these may be a part.
    Nodes move one after another, communities become the nodes of the next graph; when merging gains nothing more single nodes move again, until that gains no more than the tolerance (as a share of these edges)."""
    order = np.lexsort((t, s))
    s, t, w = s[order], t[order], w[order].astype(float)
    tolerance *= np.where(s == t, w, 2 * w).sum() / total
    own = np.arange(n)
    while True:
        own, first = _moves(s, t, w, own, n, total, resolution)
        while True:
            names, member = np.unique(own, return_inverse=True)
            k = len(names)
            key = np.minimum(member[s], member[t]) * k + np.maximum(member[s], member[t])
            pair, place = np.unique(key, return_inverse=True)
            # an edge within a community is a loop of it, in both directions
            weight = np.bincount(place, np.where((member[s] == member[t]) & (s != t), 2 * w, w))
            to, gain = _moves(pair // k, pair % k, weight, np.arange(k), k, total, resolution)
            own = to[member]
            if not gain:
                break
            first += gain
        if not first > tolerance:  # weights of 0 alone have no modularity
            least = np.full(n, n)
            np.minimum.at(least, own, np.arange(n))
            return least[own]


def _moves(s: np.ndarray, t: np.ndarray, w: np.ndarray, own: np.ndarray, n: int, total: float, resolution: float) -> tuple[np.ndarray, float]:
    """Communities when each node in turn has gone to its neighbours' community of the greatest gain, as long as one gains, and by how much modularity has grown."""
    degree = np.bincount(s, w, n) + np.bincount(t, np.where(s == t, 0.0, w), n)
    apart = s != t
    a, b, x = np.append(s[apart], t[apart]), np.append(t[apart], s[apart]), np.append(w[apart], w[apart])
    at = np.argsort(a, kind="stable")
    b, x = b[at], x[at]
    ends = np.searchsorted(a[at], np.arange(n + 1)).tolist()
    own, mass = own.copy(), np.bincount(own, degree, n)
    grown, waiting = 0.0, np.ones(n, bool)
    while waiting.any():
        for v in np.flatnonzero(waiting).tolist():
            if not waiting[v]:
                continue
            waiting[v] = False
            near = b[ends[v] : ends[v + 1]]
            if not len(near):
                continue
            here, k = own[v], degree[v]
            mass[here] -= k
            at, place = np.unique(own[near], return_inverse=True)
            gain = np.bincount(place, x[ends[v] : ends[v + 1]]) - resolution * mass[at] * k / total
            stay = np.searchsorted(at, here)
            now = gain[stay] if stay < len(at) and at[stay] == here else -resolution * mass[here] * k / total
            best = int(np.argmax(gain))
            if gain[best] > now + 1e-9 * k:
                grown += 2 * (gain[best] - now) / total
                own[v] = here = at[best]
                waiting[near[own[near] != here]] = True
            mass[here] += k
    return own, grown
