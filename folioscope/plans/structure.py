"""Queries: networks, citations, novelty."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import communities, evaluation, graph, impact, lookup, models, network, stats, text
from folioscope.operators import cooccurrence as co
from folioscope.operators import timeseries as ts
from folioscope.plans import lexicons
from folioscope.plans.registry import query
from folioscope.sources.adapters import CITES, PUBS, cites, publications, table

P = publications


def _pairs_sql(items: str) -> str:
    return f"p AS (SELECT x.item AS a, y.item AS b, count(*)::BIGINT AS n FROM {items} x JOIN {items} y ON x.doc_id = y.doc_id AND x.item < y.item GROUP BY ALL)"


for _name, _c in (("keyword_cooccurrence", "keywords"), ("coauthorship", "authors"), ("country_collaboration", "countries"), ("type_cooccurrence", "types")):
    query(_name, lambda s, d, c=_c: co.cooccurrence(P(s, d, c), c), f"WITH {PUBS}, {_pairs_sql(_c)} SELECT * FROM p")
query("cocitation", lambda s, d: co.cooccurrence(P(s, d, "refs"), "refs", min_count=2), f"WITH {PUBS}, {_pairs_sql('refs')} SELECT * FROM p WHERE n >= 2")
query("keyword_cooccurrence_top", lambda s, d: co.cooccurrence(P(s, d, "keywords"), "keywords", top_n=10), f"WITH {PUBS}, t AS (SELECT item FROM keywords GROUP BY item ORDER BY count(*) DESC, item LIMIT 10), k AS (SELECT * FROM keywords WHERE item IN (SELECT item FROM t)), {_pairs_sql('k')} SELECT * FROM p")
query("normalised_cooccurrence", lambda s, d: co.normalised(co.cooccurrence(P(s, d, "keywords"), "keywords"), co.margins(P(s, d, "keywords"), "keywords")), f"WITH {PUBS}, {_pairs_sql('keywords')}, m AS (SELECT item, count(*) AS k FROM keywords GROUP BY item) SELECT a, b, n, n / sqrt(x.k * y.k) AS association, n / least(x.k, y.k)::DOUBLE AS inclusion, n / (x.k + y.k - n)::DOUBLE AS jaccard, n * n / (x.k * y.k)::DOUBLE AS equivalence FROM p JOIN m x ON x.item = a JOIN m y ON y.item = b", "association inclusion jaccard equivalence")
query("country_links", lambda s, d: co.country_links(P(s, d, "countries")), f"WITH {PUBS}, {_pairs_sql('countries')}, m AS (SELECT item, count(*) AS k FROM countries GROUP BY item) SELECT a, b, n, n / (x.k + y.k - n)::DOUBLE AS jaccard FROM p JOIN m x ON x.item = a JOIN m y ON y.item = b", "jaccard")
query("bibliographic_coupling", lambda s, d: co.coupling(P(s, d, "refs"), "refs", 2), f"WITH {PUBS} SELECT x.doc_id AS a, y.doc_id AS b, count(*)::BIGINT AS n FROM refs x JOIN refs y ON x.item = y.item AND x.doc_id < y.doc_id GROUP BY ALL HAVING count(*) >= 2")
query("relate_concepts", lambda s, d: co.between(P(s, d, "keywords", "types").where("keywords IS NOT NULL"), "keywords", "types"), f"WITH {PUBS} SELECT x.item AS a, y.item AS b, count(*)::BIGINT AS n FROM keywords x JOIN types y USING (doc_id) GROUP BY ALL")
query("research_gaps", lambda s, d: co.expected_gaps(P(s, d, "refs"), "refs", 20, 0.5, 5, 100), f"WITH {PUBS}, m AS (SELECT item, count(*) AS k FROM refs GROUP BY item HAVING count(*) >= 20 ORDER BY k DESC, item LIMIT 100), {_pairs_sql('refs')}, e AS (SELECT x.item AS a, y.item AS b, coalesce(n, 0)::BIGINT AS n, x.k * y.k / (SELECT count(*) FROM pubs)::DOUBLE AS expected FROM m x JOIN m y ON x.item < y.item LEFT JOIN p ON p.a = x.item AND p.b = y.item) SELECT *, (expected - n) / expected AS gap FROM e WHERE expected > 1 AND (expected - n) / expected > 0.5 AND n < 5", "expected gap")


def _edges(s, d):
    return co.cooccurrence(P(s, d, "keywords"), "keywords")


_E = f"WITH {PUBS}, {_pairs_sql('keywords')}, u AS (SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p), dg AS (SELECT a AS node, count(*)::BIGINT AS degree, sum(n)::BIGINT AS strength FROM u GROUP BY a)"
query("degrees", lambda s, d: graph.degrees(_edges(s, d)), _E + " SELECT * FROM dg")
query("graph_stats", lambda s, d: graph.graph_stats(_edges(s, d)), _E + " SELECT count(*)::BIGINT AS nodes, (sum(degree) / 2)::BIGINT AS edges, sum(degree) / (count(*) * (count(*) - 1))::DOUBLE AS density, avg(degree) AS mean_degree, max(degree)::BIGINT AS max_degree FROM dg", "density mean_degree")


def _authors(s, d):
    """The whole co-authorship graph."""
    return co.cooccurrence(P(s, d, "authors"), "authors")


_S = f"WITH RECURSIVE {PUBS}, {_pairs_sql('authors')}, s AS (SELECT * FROM p), u AS (SELECT a, b FROM s UNION SELECT b, a FROM s)"
query("graph_components", lambda s, d: graph.components(_authors(s, d)), _S + ", r AS (SELECT a AS node, a AS o FROM u UNION SELECT r.node, u.b FROM r JOIN u ON r.o = u.a) SELECT node, min(o) AS component FROM r GROUP BY node")
query("clustering_coefficients", lambda s, d: graph.triangles(_authors(s, d)), _S + ", t AS (SELECT x.a AS node, count(*) AS t FROM u x JOIN u y ON x.a = y.a AND x.b < y.b JOIN u z ON z.a = x.b AND z.b = y.b GROUP BY x.a), k AS (SELECT a AS node, count(*) AS k FROM u GROUP BY a) SELECT node, coalesce(t, 0)::BIGINT AS triangles, CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1))::DOUBLE ELSE 0 END AS clustering FROM k LEFT JOIN t USING (node)", "clustering")
_LP = _E + ", c0 AS (SELECT node, node AS community FROM dg)" + "".join(
    f", c{i} AS (SELECT node, arg_min(community, (-w, community)) AS community FROM (SELECT node, community, sum(w) AS w FROM (SELECT u.a AS node, c.community, u.n::DOUBLE AS w FROM u JOIN c{i - 1} c ON c.node = u.b UNION ALL SELECT node, community, 0.5 FROM c{i - 1}) GROUP BY ALL) GROUP BY node)" for i in range(1, 11)
)
query("communities", lambda s, d: graph.label_propagation(_edges(s, d)), _LP + " SELECT * FROM c10")
_halves = lambda s, d: graph.degrees(_edges(s, d)).select("node", (F.length("node") % 2).alias("community"))
query("modularity", lambda s, d: graph.modularity(_edges(s, d), _halves(s, d)), _E + ", c AS (SELECT node, length(node) % 2 AS c, strength FROM dg), t AS (SELECT sum(n)::DOUBLE AS t FROM p), w AS (SELECT x.c, sum(n) AS w FROM p JOIN c x ON x.node = a JOIN c y ON y.node = b WHERE x.c = y.c GROUP BY x.c), g AS (SELECT c, sum(strength) AS d FROM c GROUP BY c) SELECT sum(coalesce(w, 0) / t - pow(d / (2 * t), 2)) AS modularity FROM g LEFT JOIN w USING (c), t", "modularity")
query("thematic_map", lambda s, d: models.thematic_map(_edges(s, d), _halves(s, d)), _E + ", c AS (SELECT node, length(node) % 2 AS c FROM dg), e AS (SELECT x.c AS ca, y.c AS cb, n FROM p JOIN c x ON x.node = a JOIN c y ON y.node = b), i AS (SELECT ca AS c, sum(n) AS w FROM e WHERE ca = cb GROUP BY ca), o AS (SELECT c, sum(n) AS w FROM (SELECT ca AS c, n FROM e WHERE ca <> cb UNION ALL SELECT cb, n FROM e WHERE ca <> cb) GROUP BY c), z AS (SELECT c, count(*)::BIGINT AS size FROM c GROUP BY c) SELECT z.c AS community, size, coalesce(o.w, 0)::BIGINT AS centrality, 100.0 * coalesce(i.w, 0) / size::DOUBLE AS density FROM z LEFT JOIN i USING (c) LEFT JOIN o USING (c)", "density")
# citations go back in time, so walks along them end
_PRANK = f"WITH RECURSIVE {CITES}, e AS (SELECT DISTINCT citing AS src, cited AS dst FROM cites), o AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS k FROM e), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), w AS (SELECT node, 1.0::DOUBLE AS x FROM v UNION ALL SELECT dst, 0.85::DOUBLE * sum(x / k) FROM w JOIN o ON o.src = w.node GROUP BY dst)"
query("pagerank", lambda s, d: graph.pagerank(cites(s, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst"))).select("node", (F.col("rank") * 1e6).alias("rank")), _PRANK + " SELECT node, sum(x) / sum(sum(x)) OVER () * 1e6 AS rank FROM w GROUP BY node", "rank")
query("local_citations", lambda s, d: impact.local_citations(cites(s, d)), f"WITH {CITES} SELECT cited AS doc_id, count(*)::BIGINT AS local FROM cites GROUP BY cited")
query("self_citations", lambda s, d: impact.self_citations(P(s, d, "authors"), cites(s, d)), f"WITH {PUBS}, {CITES}, sh AS (SELECT DISTINCT citing, cited FROM cites JOIN authors x ON x.doc_id = citing JOIN authors y ON y.doc_id = cited AND x.item = y.item) SELECT citing AS doc_id, count(*)::BIGINT AS n_cites, count(sh.citing)::BIGINT AS n_self FROM cites LEFT JOIN sh USING (citing, cited) GROUP BY citing")
query("storytellers", lambda s, d: impact.storytellers(cites(s, d), P(s, d, "base").where("cited_by >= 150"), 1), f"WITH {PUBS}, {CITES} SELECT citing AS doc_id, count(*)::BIGINT AS n FROM cites WHERE cited IN (SELECT doc_id FROM pubs WHERE cited_by >= 150) GROUP BY citing")
_D = f"""{CITES}, e AS (SELECT DISTINCT citing, cited FROM cites), di AS (SELECT cited AS f, citing AS o FROM e), th AS (SELECT DISTINCT r.citing AS f, e.citing AS o FROM e r JOIN e ON r.cited = e.cited WHERE r.citing <> e.citing),
x AS (SELECT coalesce(di.f, th.f) AS f, di.o IS NOT NULL AS d, th.o IS NOT NULL AS t FROM di FULL JOIN th ON di.f = th.f AND di.o = th.o), n AS (SELECT f AS doc_id, sum((d AND NOT t)::INT)::BIGINT AS n_i, sum((d AND t)::INT)::BIGINT AS n_j, sum((t AND NOT d)::INT)::BIGINT AS n_k FROM x GROUP BY f),
dr AS (SELECT *, CASE WHEN n_i + n_j > 0 THEN (n_i - n_j) / (n_i + n_j + n_k)::DOUBLE END AS cd, CASE WHEN n_i + n_j > 0 THEN (n_i - n_j) / (n_i + n_j)::DOUBLE END AS di FROM n)"""
query("disruption", lambda s, d: impact.disruption(cites(s, d)), f"WITH {_D} SELECT *, CASE WHEN cd > 0.25 THEN 'disruptive' WHEN cd < -0.25 THEN 'consolidating' WHEN n_i + n_j > 0 THEN 'neutral' END AS label FROM dr", "cd di")
for _name, _c in (("authors", "authors"), ("countries", "countries")):
    query(f"disruption_by_{_name}", lambda s, d, c=_c: impact.by_entity(impact.disruption(cites(s, d)), P(s, d, c, "base"), c), f"WITH {PUBS}, {_D} SELECT item, count(*)::BIGINT AS n_docs, avg(cd) AS mean, quantile_cont(cd, 0.5) AS median, stddev_samp(cd) AS std, min(cd) AS min, max(cd) AS max FROM {_c} JOIN dr USING (doc_id) WHERE cd IS NOT NULL GROUP BY item", "mean median std min max")
for _name, _c in (("sources", "source"), ("years", "year")):
    query(f"disruption_by_{_name}", lambda s, d, c=_c: impact.by_entity(impact.disruption(cites(s, d)), P(s, d, c, "base"), c), f"WITH {PUBS}, {_D} SELECT {_c}{'::BIGINT' if _c == 'year' else ''} AS item, count(*)::BIGINT AS n_docs, avg(cd) AS mean, quantile_cont(cd, 0.5) AS median, stddev_samp(cd) AS std, min(cd) AS min, max(cd) AS max FROM pubs JOIN dr USING (doc_id) WHERE cd IS NOT NULL GROUP BY 1", "mean median std min max")
query("pair_novelty", lambda s, d: impact.pair_novelty(P(s, d, "keywords"), "keywords"), f"WITH {PUBS}, {_pairs_sql('keywords')}, m AS (SELECT item, count(*) AS k FROM keywords GROUP BY item), sc AS (SELECT a, b, -ln(n / (x.k * y.k / (SELECT count(*) FROM pubs)::DOUBLE + 1) + 0.01) AS s FROM p JOIN m x ON x.item = a JOIN m y ON y.item = b), e AS (SELECT x.doc_id, s FROM keywords x JOIN keywords y ON x.doc_id = y.doc_id AND x.item < y.item JOIN sc ON sc.a = x.item AND sc.b = y.item) SELECT doc_id, quantile_cont(s, 0.9) AS p90, avg(s) AS mean, quantile_cont(s, 0.1) AS p10 FROM e GROUP BY doc_id", "p90 mean p10")
query("keyword_novelty", lambda s, d: impact.keyword_novelty(P(s, d, "keywords"), "keywords"), f"WITH {PUBS}, {_pairs_sql('keywords')} SELECT x.doc_id, avg(1.0::DOUBLE / n) AS novelty FROM keywords x JOIN keywords y ON x.doc_id = y.doc_id AND x.item < y.item JOIN p ON p.a = x.item AND p.b = y.item GROUP BY x.doc_id", "novelty")
query("temporal_network", lambda s, d: ts.windows(P(s, d, "keywords"), 3).where("keywords IS NOT NULL").transform(lambda t: co.pairs(t, "keywords", ["start"])).groupBy("start", "a", "b").agg(F.count("*").alias("n")), f"WITH {PUBS} SELECT (lo + (year - lo) // 3 * 3)::BIGINT AS start, x.item AS a, y.item AS b, count(*)::BIGINT AS n FROM keywords x JOIN keywords y ON x.doc_id = y.doc_id AND x.item < y.item JOIN pubs ON pubs.doc_id = x.doc_id, (SELECT min(year) AS lo FROM pubs) GROUP BY ALL")
# an order cites the two before it, so paths from the last order of a customer, and to the first, count up like Fibonacci numbers
_SPC = f"""WITH RECURSIVE {CITES}, pos AS (SELECT o_orderkey AS k, o_custkey AS c, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
fib AS (SELECT 1 AS i, 1.0::DOUBLE AS f, 1.0::DOUBLE AS g UNION ALL SELECT i + 1, g, f + g FROM fib WHERE i < (SELECT max(n) FROM pos)),
spc AS (SELECT citing AS src, cited AS dst, a.f * b.f AS spc FROM cites JOIN pos x ON x.k = citing JOIN pos y ON y.k = cited JOIN fib a ON a.i = x.n - x.i + 1 JOIN fib b ON b.i = y.i)"""
query("traversal_weights", lambda s, d: graph.traversal_weights(cites(s, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst"))), _SPC + " SELECT * FROM spc", "spc")
_BEST = """, t AS (SELECT c, n AS i, n, 0.0::DOUBLE AS s, [k] AS p, NULL::DOUBLE AS s2, NULL::BIGINT[] AS p2 FROM pos WHERE i = n UNION ALL
  SELECT c, i - 1, n, CASE WHEN b THEN y ELSE x END, list_append(CASE WHEN b THEN p2 ELSE p END, k), s, p FROM (SELECT t.c, t.i, t.n, t.s, t.p, t.p2, pos.k, s + e.spc AS x, s2 + h.spc AS y,
    coalesce(s2 + h.spc > s + e.spc OR (s2 + h.spc = s + e.spc AND p2[-1] > p[-1]), false) AS b
    FROM t JOIN pos ON pos.c = t.c AND pos.i = t.i - 1 JOIN spc e ON e.src = t.p[-1] AND e.dst = pos.k LEFT JOIN spc h ON h.src = t.p2[-1] AND h.dst = pos.k)),
  w AS (SELECT p FROM t ORDER BY s DESC, p[-1] DESC LIMIT 1) SELECT generate_subscripts(p, 1)::BIGINT AS place, unnest(p) AS node FROM w"""
query("main_path", lambda s, d: graph.main_path(graph.traversal_weights(cites(s, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst")))), _SPC + _BEST)


def _windows(s, d):
    return ts.windows(P(s, d, "keywords"), 3).where("keywords IS NOT NULL").transform(lambda t: co.pairs(t, "keywords", ["start"])).groupBy("start", "a", "b").agg(F.count("*").alias("n"))


_WN = f"WITH {PUBS}, w AS (SELECT (lo + (year - lo) // 3 * 3)::BIGINT AS start, x.item AS a, y.item AS b, count(*)::BIGINT AS n FROM keywords x JOIN keywords y ON x.doc_id = y.doc_id AND x.item < y.item JOIN pubs ON pubs.doc_id = x.doc_id, (SELECT min(year) AS lo FROM pubs) GROUP BY ALL), d AS (SELECT start, node, count(*)::BIGINT AS k FROM (SELECT start, a AS node FROM w UNION ALL SELECT start, b FROM w) GROUP BY ALL)"
query("window_metrics", lambda s, d: communities.window_metrics(_windows(s, d)), _WN.replace("WITH ", "WITH RECURSIVE ", 1) + """, u AS (SELECT start, a, b FROM w UNION ALL SELECT start, b, a FROM w), r AS (SELECT DISTINCT start, a AS node, a AS o FROM u UNION SELECT r.start, r.node, u.b FROM r JOIN u ON u.start = r.start AND r.o = u.a),
c AS (SELECT start, c, count(*) AS k FROM (SELECT start, node, min(o) AS c FROM r GROUP BY ALL) GROUP BY ALL), cc AS (SELECT start, count(*)::BIGINT AS components, max(k)::BIGINT AS largest FROM c GROUP BY start),
t AS (SELECT x.start, x.a AS node, count(*) AS t FROM u x JOIN u y ON x.start = y.start AND x.a = y.a AND x.b < y.b JOIN u z ON z.start = x.start AND z.a = x.b AND z.b = y.b GROUP BY ALL), cl AS (SELECT d.start, avg(CASE WHEN k > 1 THEN 2 * coalesce(t, 0) / (k * (k - 1))::DOUBLE ELSE 0 END) AS clustering FROM d LEFT JOIN t ON t.start = d.start AND t.node = d.node GROUP BY d.start),
b AS (SELECT start, count(*)::BIGINT AS nodes, (sum(k) / 2)::BIGINT AS edges, CASE WHEN count(*) > 1 THEN sum(k) / (count(*) * (count(*) - 1))::DOUBLE ELSE 0 END AS density, avg(k) AS mean_degree, max(k)::BIGINT AS max_degree FROM d GROUP BY start)
SELECT *, largest / nodes::DOUBLE AS largest_share FROM b JOIN cl USING (start) JOIN cc USING (start)""", "density mean_degree clustering largest_share")
query("edge_persistence", lambda s, d: communities.edge_persistence(_windows(s, d)), _WN + ' SELECT a, b, min(start) AS "first", max(start) AS "last", count(DISTINCT start)::BIGINT AS windows, sum(n)::BIGINT AS weight FROM w GROUP BY a, b')
query("node_activity", lambda s, d: communities.node_activity(_windows(s, d)), _WN + ' SELECT node, min(start) AS "first", max(start) AS "last", count(*)::BIGINT AS windows, sum(k)::BIGINT AS degree FROM d GROUP BY node')
query("louvain", lambda s, d: network.modularity_communities(_authors(s, d)))
def _grouped(s, d, start, by):
    """Keywords of a window, put together by a remainder of their names' numbers."""
    t = _windows(s, d).where(F.col("start") == start).select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return t.select("node", (F.substring_index("node", "#", -1).cast("long") % by).alias("community"))


_GRP = "SELECT DISTINCT node, split_part(node, '#', 2)::BIGINT % {1} AS c FROM (SELECT start, a AS node FROM w UNION ALL SELECT start, b FROM w) WHERE start = {0}"
_EVO = _WN + f", o AS ({_GRP.format(1995, 5)}), n AS ({_GRP.format(1998, 10)}), so AS (SELECT c, count(*) AS k FROM o GROUP BY c), sn AS (SELECT c, count(*) AS k FROM n GROUP BY c), h AS (SELECT o.c AS o, n.c AS n, count(*) AS s FROM o JOIN n USING (node) GROUP BY ALL)"
query("matched_communities", lambda s, d: communities.matched(_grouped(s, d, 1995, 5), _grouped(s, d, 1998, 10), 0.2), _EVO + ", j AS (SELECT o, n, s, s / (so.k + sn.k - s)::DOUBLE AS j FROM h JOIN so ON so.c = o JOIN sn ON sn.c = n), f AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY j DESC, n) AS i FROM j) SELECT o AS \"old\", n AS \"new\", s AS shared, j AS jaccard FROM f WHERE i = 1 AND j >= 0.2", "jaccard")
query("split_communities", lambda s, d: communities.splits(_grouped(s, d, 1995, 5), _grouped(s, d, 1998, 10)).select("old", F.array_join("parts", ",").alias("parts")), _EVO + " SELECT o AS \"old\", string_agg(n::VARCHAR, ',' ORDER BY n) AS parts FROM h JOIN so ON so.c = o WHERE s >= 0.3 * so.k GROUP BY o HAVING count(*) > 1")
query("group_evolution", lambda s, d: communities.evolution(_grouped(s, d, 1995, 5), _grouped(s, d, 1998, 10), 0.2), _EVO + """, j AS (SELECT o, n, s / (so.k + sn.k - s)::DOUBLE AS j FROM h JOIN so ON so.c = o JOIN sn ON sn.c = n), f AS (SELECT o, n FROM (SELECT *, row_number() OVER (PARTITION BY o ORDER BY j DESC, n) AS i FROM j) WHERE i = 1 AND j >= 0.2),
t AS (SELECT a.c AS o, b.c AS n, a.k AS ko, b.k AS kn, count(a.c) OVER (PARTITION BY b.c) AS many FROM so a LEFT JOIN f ON f.o = a.c FULL JOIN sn b ON b.c = f.n)
SELECT o AS "old", n AS "new", CASE WHEN o IS NULL THEN 'birth' WHEN n IS NULL THEN 'death' WHEN many > 1 THEN 'merge' WHEN kn / ko > 1.5 THEN 'growth' WHEN kn / ko < 0.67 THEN 'shrinkage' ELSE 'stable' END AS event FROM t""")
query("community_evolution", lambda s, d: communities.evolution(*(graph.components(_windows(s, d).where(F.col("start") == y).select("a", "b", "n")).withColumnRenamed("component", "community") for y in (1995, 1998))))

# lookups, gaps, evaluation ------------------------------------------------------------------------------------------


def _codes(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("code"), F.col("p_type").alias("field"), F.col("p_brand").alias("area"))


query("classified", lambda s, d: lookup.classified(P(s, d, "refs").where("refs IS NOT NULL"), "refs", _codes(s, d)).select("doc_id", F.size("fields").alias("fields"), F.size("areas").alias("areas")), f"WITH {PUBS}, t AS (SELECT doc_id, count(*)::BIGINT AS fields FROM types GROUP BY doc_id), k AS (SELECT doc_id, count(*)::BIGINT AS areas FROM keywords GROUP BY doc_id) SELECT * FROM t JOIN k USING (doc_id)")
query("per_reference", lambda s, d: lookup.per_reference(P(s, d, "base").groupBy(F.col("ca_country").alias("country")).agg(F.count("*").alias("n")), table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("country")).agg(F.count("*").alias("people")), "country", "people"), f"WITH {PUBS}, c AS (SELECT ca_country AS country, count(*)::BIGINT AS n FROM pubs GROUP BY 1), r AS (SELECT n_name AS country, count(*) AS p FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT country, n, n / p::DOUBLE * 1e6 AS rate FROM c LEFT JOIN r USING (country)", "rate")
query("share_gaps", lambda s, d: lookup.share_gaps(P(s, d).where("types IS NOT NULL"), "countries", "keywords", 20, 0.05), f"WITH {PUBS}, z AS (SELECT item AS group_name, count(*) AS size FROM countries GROUP BY item HAVING count(*) >= 20), o AS (SELECT item, count(*) / (SELECT count(DISTINCT doc_id) FROM types)::DOUBLE AS overall FROM keywords GROUP BY item), c AS (SELECT x.item AS group_name, k.item, count(*)::BIGINT AS n FROM countries x JOIN keywords k USING (doc_id) GROUP BY ALL), t AS (SELECT group_name, item, n, n / size::DOUBLE AS share, overall, n / size::DOUBLE / overall - 1 AS deviation FROM c JOIN z USING (group_name) JOIN o USING (item)) SELECT * FROM t WHERE abs(deviation) > 0.05", "share overall deviation")
query("declines", lambda s, d: lookup.declines(P(s, d, "refs"), "refs", 2001, 2, 0.3), f"WITH {PUBS}, k AS (SELECT item, year, count(*) AS k FROM refs JOIN pubs USING (doc_id) GROUP BY ALL), p AS (SELECT item, arg_max(year, k * 10000 - year) AS py FROM k GROUP BY item), t AS (SELECT item, py::BIGINT AS peak_year, sum(CASE WHEN abs(year - py) <= 1 THEN k END) / sum(CASE WHEN abs(year - py) <= 1 THEN 1 END)::DOUBLE AS peak, coalesce(sum(CASE WHEN year > 1999 THEN k END), 0) / 2.0::DOUBLE AS recent FROM k JOIN p USING (item) GROUP BY item, py) SELECT *, 1 - recent / peak AS decline FROM t WHERE 1 - recent / peak >= 0.3 AND peak_year <= 1999", "peak recent decline")


def _details(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("source"), F.col("p_type").alias("field"), (1950 + F.col("p_size")).alias("year"))


_EN = lambda c: f"(SELECT doc_id, count(*)::BIGINT AS {c}s, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS {c}_entropy FROM (SELECT doc_id, {c}, count(*) / sum(count(*)) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM r GROUP BY doc_id, {c}) GROUP BY doc_id)"
query("reference_diversity", lambda s, d: lookup.reference_diversity(P(s, d, "refs"), "refs", _details(s, d), 2001), f"WITH {PUBS}, r AS (SELECT doc_id, p_brand AS source, p_type AS field, 1950 + p_size AS year FROM refs JOIN part ON item = p_partkey) SELECT * FROM (SELECT doc_id, count(*)::BIGINT AS \"references\", avg(2001 - year) AS mean_age, quantile_cont((2001 - year)::DOUBLE, 0.5) AS median_age FROM r GROUP BY doc_id) JOIN {_EN('source')} USING (doc_id) JOIN {_EN('field')} USING (doc_id)", "mean_age median_age source_entropy field_entropy")
query("attention", lambda s, d: lookup.attention(table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.sum("l_quantity").alias("mentions"), F.count("*").alias("news")), {"mentions": 0.5, "news": 3.0}), "WITH t AS (SELECT l_orderkey AS doc_id, sum(l_quantity) * 0.5::DOUBLE + count(*) * 3 AS score FROM lineitem GROUP BY 1) SELECT doc_id, score, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE) / (SELECT count(*) FROM t) * 100 AS percentile FROM t", "score percentile")
query("compare_entities", lambda s, d: evaluation.compare_entities(P(s, d, "base").groupBy("category").agg(F.count("*").alias("documents"), F.avg("cited_by").alias("mean")), "category", ["documents", "mean"]), f"WITH {PUBS}, t AS (SELECT category, count(*)::BIGINT AS documents, avg(cited_by) AS mean FROM pubs GROUP BY category) SELECT category, documents, mean, (documents - (SELECT min(documents) FROM t)) / ((SELECT max(documents) FROM t) - (SELECT min(documents) FROM t))::DOUBLE AS documents_scaled, rank() OVER (ORDER BY documents DESC) AS documents_rank, (mean - (SELECT min(mean) FROM t)) / ((SELECT max(mean) FROM t) - (SELECT min(mean) FROM t)) AS mean_scaled, rank() OVER (ORDER BY mean DESC) AS mean_rank FROM t", "mean documents_scaled mean_scaled")
query("citation_features", lambda s, d: evaluation.citation_features(P(s, d)), f"WITH {PUBS}, s AS (SELECT doc_id, year, source, cited_by, source_before FROM pubs LEFT JOIN (SELECT source, year, sum(t) OVER w / sum(k) OVER w AS source_before FROM (SELECT source, year, sum(cited_by)::DOUBLE AS t, count(*) AS k FROM pubs GROUP BY source, year) WINDOW w AS (PARTITION BY source ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) USING (source, year)), n(doc_id) AS (SELECT doc_id FROM pubs), a AS (SELECT doc_id, avg(b) AS authors_before FROM (SELECT doc_id, b FROM authors JOIN pubs USING (doc_id) LEFT JOIN (SELECT item, year, sum(t) OVER w / sum(k) OVER w AS b FROM (SELECT item, year, sum(cited_by)::DOUBLE AS t, count(*) AS k FROM authors JOIN pubs USING (doc_id) GROUP BY item, year) WINDOW w AS (PARTITION BY item ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) USING (item, year)) GROUP BY doc_id), " + ", ".join(f"n{c} AS (SELECT doc_id, count(*) AS k FROM {c} GROUP BY doc_id)" for c in ("authors", "keywords", "refs", "countries")) + " SELECT s.doc_id, s.year::BIGINT AS year, s.source, s.cited_by, " + ", ".join(f"coalesce(n{c}.k, 0)::DOUBLE AS n_{c}" for c in ("authors", "keywords", "refs", "countries")) + ", source_before, authors_before FROM s LEFT JOIN a USING (doc_id) " + " ".join(f"LEFT JOIN n{c} USING (doc_id)" for c in ("authors", "keywords", "refs", "countries")), "n_authors n_keywords n_refs n_countries source_before authors_before")
query("jarque_bera", lambda s, d: stats.jarque_bera(P(s, d, "base"), "price", "category"), f"WITH {PUBS}, t AS (SELECT category, price - avg(price) OVER (PARTITION BY category) AS d FROM pubs) SELECT category, count(*)::BIGINT AS n, count(*) / 6.0::DOUBLE * (pow(avg(d * d * d) / pow(avg(d * d), 1.5), 2) + pow(avg(d * d * d * d) / pow(avg(d * d), 2) - 3, 2) / 4) AS statistic FROM t GROUP BY category", "statistic")
query("ks_normal", lambda s, d: stats.ks_normal(P(s, d, "base"), "cited_by"), f"""WITH {PUBS}, o AS (SELECT count(*)::BIGINT AS n, avg(cited_by) AS m, stddev_samp(cited_by) AS s FROM pubs), h AS (SELECT cited_by::DOUBLE AS x, count(*) AS k FROM pubs GROUP BY 1),
c AS (SELECT (x - m) / s / sqrt(2) AS z, sum(k) OVER (ORDER BY x) / n::DOUBLE AS hi, (sum(k) OVER (ORDER BY x) - k) / n::DOUBLE AS lo FROM h, o), u AS (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(z)) AS u FROM c),
e AS (SELECT hi, lo, 0.5 * (1 + sign(z) * (1 - ((((1.061405429::DOUBLE * u - 1.453152027::DOUBLE) * u + 1.421413741::DOUBLE) * u - 0.284496736::DOUBLE) * u + 0.254829592::DOUBLE) * u * exp(-z * z))) AS f FROM u)
SELECT max(n) AS n, max(m) AS mean, max(s) AS sd, max(greatest(abs(hi - f), abs(lo - f))) AS distance FROM e, o""", "mean sd distance")
query("matching_sentences", lambda s, d: text.matching_sentences(table(s, d, "documents"), "text", "idiot|moron|clown").select("doc_id", "place"), r"""WITH m AS (SELECT doc_id, regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+', '\1' || chr(1), 'g') AS t FROM documents), s AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS place FROM (SELECT doc_id, list_filter(string_split(t, chr(1)), lambda y: trim(y) <> '') AS p FROM m)) SELECT doc_id, place::BIGINT AS place FROM s WHERE regexp_matches(x, '(?i)idiot|moron|clown')""")
query("text_entities", lambda s, d: text.entities(table(s, d, "documents"), "text", {"year": r"(?:19|20)[0-9]{2}", "capitals": r"[A-Z]{2,6}"}), r"SELECT doc_id, kind, value, count(*)::BIGINT AS n FROM (SELECT doc_id, 'year' AS kind, unnest(regexp_extract_all(text, '(?:19|20)[0-9]{2}')) AS value FROM documents UNION ALL SELECT doc_id, 'capitals', unnest(regexp_extract_all(text, '[A-Z]{2,6}')) FROM documents) GROUP BY ALL")
query("correspondence", lambda s, d: evaluation.correspondence(co.between(P(s, d, "keywords", "types").where("keywords IS NOT NULL"), "keywords", "types"), "a", "b"))
query("term_effects", lambda s, d: evaluation.term_effects(table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "toxic"), "doc_id"), "text", "toxic", 5).select("term", "coefficient"))
query("cross_validation", lambda s, d: evaluation.cross_validate(table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id"), "text", "quality", 3))
query("topic_coherence", lambda s, d: evaluation.topic_coherence(models.topics(table(s, d, "documents"), "text", share=1.0)[0], table(s, d, "documents"), "text"))
_SBE = f"""WITH w AS (SELECT source, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Pc}}]{{2,}}') AS w FROM documents), k AS (SELECT source, len(list_filter(w, lambda x: x IN {tuple(lexicons.POSITIVE)})) AS p, len(list_filter(w, lambda x: x IN {tuple(lexicons.NEGATIVE)})) AS m FROM w)
SELECT source AS item, count(*)::BIGINT AS n, avg(v) AS mean, stddev_samp(v) AS std FROM (SELECT source, CASE WHEN p + m > 0 THEN (p - m) / (p + m)::DOUBLE ELSE 0.0 END AS v FROM k) GROUP BY source HAVING count(*) >= 5"""
_docs = lambda s, d: table(s, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
query("sentiment_by_entity", lambda s, d: evaluation.sentiment_by_entity(text.sentiment(_docs(s, d), "text", lexicons.POSITIVE, lexicons.NEGATIVE, lexicons.HEDGES), table(s, d, "documents"), "source"), _SBE, "mean std")
_GREEDY = """, g AS ((SELECT 1 AS step, src, dst FROM spc WHERE src NOT IN (SELECT dst FROM spc) ORDER BY spc DESC, src DESC, dst DESC LIMIT 1) UNION ALL
  SELECT step + 1, n.src, n.dst FROM g JOIN (SELECT src, max_by(dst, (spc, dst)) AS dst FROM spc GROUP BY src) n ON n.src = g.dst)
SELECT 1::BIGINT AS place, src AS node FROM g WHERE step = 1 UNION ALL SELECT step + 1, dst FROM g"""
query("forward_path", lambda s, d: graph.greedy_path(graph.traversal_weights(cites(s, d).select(F.col("citing").alias("src"), F.col("cited").alias("dst")))), _SPC + _GREEDY)
query("fit_shapes", lambda s, d: stats.fit_shapes(P(s, d, "base"), "cited_by").select("family", "aic"))


def _conversation_years(s, d):
    """Conversations in ten made-up years."""
    return table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), (2000 + F.col("conv_id") % 10).cast("int").alias("year"), "text", "role")


query("sequential_topics", lambda s, d: models.aligned_topics(models.sequential_topics(_conversation_years(s, d), "text", 3, 5, rounds=3)))
query("semantic_dispersion", lambda s, d: models.semantic_dispersion(text.tfidf(_conversation_years(s, d), "text", 5), _conversation_years(s, d).select("doc_id", F.col("role").alias("group_name"))), r"""WITH w AS (SELECT conv_id * 100 + turn AS doc_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')) AS term FROM conversations), k AS (SELECT doc_id, role, term, count(*) AS k FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM k GROUP BY term HAVING count(*) >= 5),
x AS (SELECT doc_id, role, term, k * (ln((1 + (SELECT count(*) FROM conversations)) / (1 + df)::DOUBLE) + 1) AS w FROM k JOIN f USING (term)), t AS (SELECT role, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM x), n AS (SELECT role, count(*)::BIGINT AS n FROM conversations GROUP BY role), m AS (SELECT role, term, sum(weight) AS s FROM t GROUP BY ALL) SELECT role AS group_name, n, 1 - sqrt(sum(pow(s / n, 2))) AS dispersion FROM m JOIN n USING (role) GROUP BY role, n""", "dispersion")
query("alexander_govern", lambda s, d: stats.alexander_govern(P(s, d, "base"), "price", "category"), f"""WITH {PUBS}, g AS (SELECT count(*) AS n, avg(price) AS m, var_samp(price) / count(*) AS v FROM pubs GROUP BY category), w AS (SELECT sum(m / v) / sum(1 / v) AS mean FROM g),
t AS (SELECT n - 1 AS nu, n - 1.5::DOUBLE AS a, (m - mean) / sqrt(v) AS t FROM g, w), c AS (SELECT 48 * a * a AS b, sqrt(a * ln(1 + t * t / nu)) AS c FROM t), z AS (SELECT c + (pow(c, 3) + 3 * c) / b - (4 * pow(c, 7) + 33 * pow(c, 5) + 240 * pow(c, 3) + 855 * c) / (10 * b * b + 8 * b * pow(c, 4) + 1000 * b) AS z FROM c)
SELECT sum(z * z) AS statistic, (count(*) - 1)::BIGINT AS dof FROM z""", "statistic")

_EIG = _E + ", x0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM dg) AS x FROM dg)" + "".join(f", y{i} AS (SELECT v.node, any_value(v.x) + sum(n * o.x) AS y FROM x{i - 1} v JOIN u ON u.a = v.node JOIN x{i - 1} o ON o.node = u.b GROUP BY v.node), x{i} AS (SELECT node, y / sqrt((SELECT sum(y * y) FROM y{i})) AS x FROM y{i})" for i in range(1, 7))
query("eigenvector", lambda s, d: graph.eigenvector(_edges(s, d), weighted=True, rounds=6), _EIG + " SELECT node, x AS eigenvector FROM x6", "eigenvector")
query("centralities", lambda s, d: network.centralities(_edges(s, d)))
query("historiograph", lambda s, d: impact.historiograph(P(s, d, "base"), cites(s, d)), f"WITH {PUBS}, {CITES}, h AS (SELECT citing, cited, x.year::BIGINT AS citing_year, y.year::BIGINT AS cited_year FROM cites JOIN pubs x ON x.doc_id = citing JOIN pubs y ON y.doc_id = cited WHERE y.year <= x.year) SELECT *, (count(*) OVER (PARTITION BY cited))::BIGINT AS local FROM h")
query("pattern_from_totals", lambda s, d: impact.pattern_from_totals(P(s, d, "base"), 2003).select("doc_id", "pattern", "confidence", F.array_join(F.map_values("counts"), ",").alias("counts")), f"""WITH {PUBS}, t AS (SELECT doc_id, cited_by AS c, (2003 - year)::INT AS age FROM pubs),
w AS (SELECT *, CASE WHEN age <= 5 THEN list_slice([0.15::DOUBLE, 0.25, 0.25, 0.2, 0.15], 1, age) ELSE list_transform(range(age), lambda i: greatest(0.02::DOUBLE, CASE WHEN i <= 2 THEN 0.15::DOUBLE + 0.1::DOUBLE * i ELSE 0.35::DOUBLE * pow(0.8::DOUBLE, i - 2) END)) END AS w FROM t),
p AS (SELECT *, list_transform(w, lambda x: floor(c * (x / list_sum(w)))::BIGINT) AS p FROM w), q AS (SELECT *, list_transform(range(1, len(p) + 1), lambda i: p[i] + CASE WHEN i = list_position(p, list_max(p)) THEN c - list_sum(p) ELSE 0 END) AS q FROM p)
SELECT doc_id, CASE WHEN c = 0 THEN 'uncited' WHEN age < 3 THEN 'too_recent' WHEN age >= 10 AND c / age >= 2 THEN 'evergreen' WHEN age >= 8 AND c / age < 0.5 THEN 'flash_in_the_pan' WHEN age >= 10 AND c > 50 THEN 'delayed_recognition' ELSE 'normal' END AS pattern,
CASE WHEN c = 0 THEN 0.5 WHEN age < 3 THEN 0.3 WHEN age >= 10 AND c / age >= 2 THEN 0.4 WHEN age >= 8 AND c / age < 0.5 THEN 0.35 WHEN age >= 10 AND c > 50 THEN 0.3 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN c > 0 AND age >= 3 THEN array_to_string(q, ',') END AS counts FROM q""", "confidence")
query("embedding_drift", lambda s, d: text.embedding_drift(_conversation_years(s, d), "text", ["the", "que", "der", "and"], 5, 20, 5, 10, 50))
query("sequential_nmf", lambda s, d: models.sequential_nmf(_conversation_years(s, d), "text", 3, 5, 5, 10))
query("greedy_modularity", lambda s, d: communities.greedy_frame(_edges(s, d)))
