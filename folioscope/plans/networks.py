"""Queries: graphs with cycles, communities of whole graphs, shortest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators import graph, network
from folioscope.plans.registry import query
from folioscope.sources.adapters import CITES, cites


def _cites(s, d) -> DataFrame:
    return cites(s, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst"))


def _mutual(s, d) -> DataFrame:
    """Citations, and an answer to each between orders of one priority: a graph with cycles. Priorities come along with the orders, so that a customer's edges stay in one partition, as
    components want them; an edge may stand more than once."""
    kinds = F.collect_set("o_orderpriority").over(Window.partitionBy("o_orderkey"))
    c = cites(s, d, kinds).select(F.struct(F.col("citing").alias("src"), F.col("cited").alias("dst")).alias("c"), F.struct(F.col("cited").alias("src"), F.col("citing").alias("dst")).alias("back"), F.arrays_overlap("citing_also", "cited_also").alias("same"))
    return c.select(F.explode(F.when(F.col("same"), F.array("c", "back")).otherwise(F.array("c"))).alias("e")).select("e.src", "e.dst")


_GRAPH = f"""WITH RECURSIVE {CITES}, g AS (SELECT citing AS src, cited AS dst FROM cites UNION SELECT cited, citing FROM cites JOIN orders x ON x.o_orderkey = citing JOIN orders y ON y.o_orderkey = cited AND x.o_orderpriority = y.o_orderpriority),
reach AS (SELECT src, dst FROM g UNION SELECT r.src, g.dst FROM reach r JOIN g ON g.src = r.dst), v AS (SELECT src AS node FROM g UNION SELECT dst FROM g),
ring AS (SELECT a.src AS node, min(a.dst) AS low FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src), scc AS MATERIALIZED (SELECT node, coalesce(least(node, low), node) AS component FROM v LEFT JOIN ring USING (node)),
cg AS MATERIALIZED (SELECT x.component AS src, y.component AS dst, count(*)::BIGINT AS n FROM g JOIN scc x ON x.node = g.src JOIN scc y ON y.node = g.dst WHERE x.component <> y.component GROUP BY ALL)"""
_WEIGHTS = """, p AS (SELECT src AS node, 0 AS len, 1.0::DOUBLE AS c FROM (SELECT src FROM {0} EXCEPT SELECT dst FROM {0}) UNION ALL SELECT dst, len + 1, sum(c) FROM p JOIN {0} ON src = node GROUP BY dst, len),
q AS (SELECT dst AS node, 0 AS len, 1.0::DOUBLE AS c FROM (SELECT dst FROM {0} EXCEPT SELECT src FROM {0}) UNION ALL SELECT src, len + 1, sum(c) FROM q JOIN {0} ON dst = node GROUP BY src, len),
spc AS MATERIALIZED (SELECT src, dst, a.c * b.c AS spc FROM {0} JOIN (SELECT node, sum(c) AS c FROM p GROUP BY node) a ON a.node = src JOIN (SELECT node, sum(c) AS c FROM q GROUP BY node) b ON b.node = dst)"""
_CYCLIC = _GRAPH + _WEIGHTS.format("cg")
_PLAIN = f"WITH RECURSIVE {CITES}, e AS (SELECT DISTINCT citing AS src, cited AS dst FROM cites)" + _WEIGHTS.format("e")
query("strong_components", lambda s, d: network.strong_components(_mutual(s, d)), _GRAPH + " SELECT * FROM scc")
query("condensed_citations", lambda s, d: network.condensed(_mutual(s, d), once=True), _GRAPH + " SELECT * FROM cg")
query("cyclic_weights", lambda s, d: network.condensed_weights(_mutual(s, d)), _CYCLIC + " SELECT * FROM spc", "spc")
query("cyclic_weights_by_path", lambda s, d: network.condensed_weights(_mutual(s, d), "splc").withColumn("spc", F.col("spc") * 1e6), _CYCLIC + " SELECT src, dst, 1e6 * spc / (SELECT sum(spc) FROM spc WHERE src NOT IN (SELECT dst FROM spc)) AS spc FROM spc", "spc")
query("cyclic_weights_by_pair", lambda s, d: network.condensed_weights(_mutual(s, d), "spnp").withColumn("spc", F.col("spc") * 1e6), _CYCLIC + " SELECT src, dst, 1e6 * spc / ((SELECT count(DISTINCT src) FROM spc WHERE src NOT IN (SELECT dst FROM spc)) * (SELECT count(DISTINCT dst) FROM spc WHERE dst NOT IN (SELECT src FROM spc)))::DOUBLE AS spc FROM spc", "spc")
_PATH = """, m AS (SELECT src AS node, 0 AS len, 0.0::DOUBLE AS s FROM (SELECT src FROM spc EXCEPT SELECT dst FROM spc) UNION ALL SELECT dst, len + 1, max(s + spc) FROM m JOIN spc ON src = node GROUP BY dst, len),
score AS (SELECT node, max(s) AS s FROM m GROUP BY node), prev AS (SELECT dst AS node, max(src) AS prev FROM spc JOIN score a ON a.node = src JOIN score b ON b.node = dst AND a.s + spc = b.s GROUP BY dst),
path AS (SELECT node, 0 AS step FROM (SELECT node FROM score ORDER BY s DESC, node DESC LIMIT 1) UNION ALL SELECT prev, step + 1 FROM path JOIN prev USING (node)) SELECT ((SELECT max(step) FROM path) - step + 1)::BIGINT AS place, node FROM path"""
query("cyclic_main_path", lambda s, d: graph.main_path(network.condensed_weights(_mutual(s, d))), _CYCLIC + _PATH)
_ROUTES = """, strong AS (SELECT * FROM spc WHERE spc >= {0} * (SELECT max(spc) FROM spc)), r AS (SELECT dst AS tip, [src, dst] AS route, spc AS w FROM strong WHERE src NOT IN (SELECT dst FROM strong) UNION ALL SELECT dst, list_append(route, dst), w + spc FROM r JOIN strong ON src = tip),
best AS (SELECT row_number() OVER (ORDER BY w DESC, route) AS place, route, w FROM r WHERE tip NOT IN (SELECT src FROM strong) AND len(route) >= 3) SELECT place::BIGINT AS place, array_to_string(route, ',') AS route, w AS weight FROM best WHERE place <= {1}"""
query("key_routes", lambda s, d: network.key_routes(graph.traversal_weights(_cites(s, d))).withColumn("route", F.array_join("route", ",")), _PLAIN + _ROUTES.format(0.5, 5), "weight")
query("cyclic_key_routes", lambda s, d: network.key_routes(network.condensed_weights(_mutual(s, d)), 0.2, 10).withColumn("route", F.array_join("route", ",")), _CYCLIC + _ROUTES.format(0.2, 10), "weight")


def _links(s, d) -> DataFrame:
    """Citations without direction; an edge may stand more than once."""
    return cites(s, d).select(F.least("citing", "cited").alias("a"), F.greatest("citing", "cited").alias("b"), F.lit(1).alias("n"))


_HOPS = f"""WITH RECURSIVE {CITES}, u AS (SELECT citing AS a, cited AS b FROM cites UNION SELECT cited, citing FROM cites),
t(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT a, a, 0 FROM u UNION SELECT t.s, u.b, min(t.d + 1) FROM t JOIN u ON u.a = t.v LEFT JOIN recurring.t AS r ON r.s = t.s AND r.v = u.b WHERE r.d IS NULL GROUP BY t.s, u.b),
h AS (SELECT s, min(v) AS component, max(d) AS far, sum(d) AS total, count(*) - 1 AS k FROM t GROUP BY s)"""
query("path_stats", lambda s, d: network.path_stats(_links(s, d)), _HOPS + " SELECT component, count(*)::BIGINT AS nodes, max(far)::BIGINT AS diameter, min(far)::BIGINT AS radius, sum(total) / sum(k)::DOUBLE AS mean_path FROM h GROUP BY component", "mean_path")
query("closeness", lambda s, d: network.path_centralities(_links(s, d)).select("node", (F.col("closeness") * 1e6).alias("closeness")), _HOPS + " SELECT s AS node, 1e6 * k / total * k / ((SELECT count(*) FROM h) - 1)::DOUBLE AS closeness FROM h", "closeness")
query("path_centralities", lambda s, d: network.path_centralities(_links(s, d)))
query("hop_closeness", lambda s, d: network.hop_closeness(_links(s, d)))
