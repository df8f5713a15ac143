"""Queries: counts, indices, laws, groups, diversity, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import counting, diversity, groups, indices, laws, models, quality, stats
from folioscope.operators.longform import long
from folioscope.plans.registry import query
from folioscope.sources.adapters import PUBS, publications, table

P = publications
LISTS = ("authors", "keywords", "types", "countries", "refs")

# counts -------------------------------------------------------------------------------------------------------------


def _count_sql(items: str, fractional: bool) -> str:
    return f"""WITH {PUBS}, items AS ({items}), c AS (SELECT item, count(*)::BIGINT AS n_docs{", sum(share) AS fractional" if fractional else ""} FROM items GROUP BY item)
SELECT item, n_docs, {"fractional, " if fractional else ""}row_number() OVER (ORDER BY n_docs DESC, item) AS rank, n_docs / (SELECT count(*) FROM pubs)::DOUBLE AS proportion, 100 * n_docs / (SELECT count(*) FROM pubs)::DOUBLE AS percentage,
CASE WHEN (SELECT count(*) FROM c) > 1 THEN ((SELECT count(*) FROM c) - row_number() OVER (ORDER BY n_docs DESC, item)) / ((SELECT count(*) FROM c) - 1)::DOUBLE ELSE 1.0 END AS percent_rank FROM c"""


for _c in LISTS:
    query(
        f"count_{_c}", lambda s, d, c=_c: counting.count_list(P(s, d, c), c),
        _count_sql(f"SELECT item, 1.0::DOUBLE / count(*) OVER (PARTITION BY doc_id) AS share FROM {_c}", True), "fractional proportion percentage percent_rank",
    )
for _name, _c in (("sources", "source"), ("document_types", "category"), ("ca_countries", "ca_country")):
    query(f"count_{_name}", lambda s, d, c=_c: counting.count_single(P(s, d, "base"), c), _count_sql(f"SELECT {_c} AS item FROM pubs WHERE trim({_c}) <> ''", False), "proportion percentage percent_rank")

_DOC = "documents"
_GRAMS = r"""g AS (SELECT r, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END)) AS item FROM (SELECT row_number() OVER () AS r, regexp_extract_all(lower(coalesce(p_name, '')), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}') AS w FROM part))"""
query(
    "count_ngrams_title", lambda s, d: counting.count_text(table(s, d, "part"), "p_name", 1, 2),
    f"""WITH {_GRAMS}, c AS (SELECT item, count(DISTINCT r)::BIGINT AS n_docs, count(*)::BIGINT AS n_total FROM g GROUP BY item)
SELECT item, n_docs, n_total, row_number() OVER (ORDER BY n_docs DESC, item) AS rank, n_docs / (SELECT count(*) FROM part)::DOUBLE AS proportion, 100 * n_docs / (SELECT count(*) FROM part)::DOUBLE AS percentage,
((SELECT count(*) FROM c) - row_number() OVER (ORDER BY n_docs DESC, item)) / ((SELECT count(*) FROM c) - 1)::DOUBLE AS percent_rank FROM c""",
    "proportion percentage percent_rank",
)
query(
    "entity_stats_authors", lambda s, d: counting.entity_stats(P(s, d, "authors"), "authors"),
    f"""WITH {PUBS}, t AS (SELECT item, cited_by, year, row_number() OVER (PARTITION BY item ORDER BY cited_by DESC) AS i FROM authors JOIN pubs USING (doc_id))
SELECT item, count(*)::BIGINT AS n_docs, sum(cited_by)::BIGINT AS citations, avg(cited_by) AS mean_citations, min(year)::BIGINT AS first_year, max(year)::BIGINT AS last_year, sum((cited_by >= i)::INT)::BIGINT AS h FROM t GROUP BY item""",
    "mean_citations",
)
query(
    "entity_stats_sources", lambda s, d: counting.entity_stats(P(s, d, "base"), "source", "single"),
    f"""WITH {PUBS}, t AS (SELECT source AS item, cited_by, year, row_number() OVER (PARTITION BY source ORDER BY cited_by DESC) AS i FROM pubs)
SELECT item, count(*)::BIGINT AS n_docs, sum(cited_by)::BIGINT AS citations, avg(cited_by) AS mean_citations, min(year)::BIGINT AS first_year, max(year)::BIGINT AS last_year, sum((cited_by >= i)::INT)::BIGINT AS h FROM t GROUP BY item""",
    "mean_citations",
)
query("indicators_keywords", lambda s, d: counting.indicators(P(s, d, "keywords").where("keywords IS NOT NULL"), "keywords", ["Brand#1", "Brand#2"]), f"""WITH {PUBS} SELECT doc_id, max((item = 'Brand#1')::INT)::BIGINT AS "Brand#1", max((item = 'Brand#2')::INT)::BIGINT AS "Brand#2" FROM keywords GROUP BY doc_id""")
query("top_cited", lambda s, d: counting.top_cited(P(s, d, "base"), 10), f"WITH {PUBS} SELECT doc_id, year::BIGINT AS year, source, cited_by, cited_by / ((SELECT max(year) FROM pubs) - year + 1)::DOUBLE AS per_year FROM pubs ORDER BY cited_by DESC, doc_id LIMIT 10", "per_year")
query("top_cited_per_year", lambda s, d: counting.top_cited(P(s, d, "base"), 10, True), f"WITH {PUBS} SELECT doc_id, year::BIGINT AS year, source, cited_by, cited_by / ((SELECT max(year) FROM pubs) - year + 1)::DOUBLE AS per_year FROM pubs ORDER BY per_year DESC, doc_id LIMIT 10", "per_year")
query(
    "production", lambda s, d: counting.production(P(s, d, "base")),
    f"""WITH {PUBS}, y AS (SELECT year::BIGINT AS year, count(*)::BIGINT AS n_docs, sum(cited_by)::BIGINT AS citations FROM pubs GROUP BY year)
SELECT year, n_docs, citations, n_docs / (SELECT count(*) FROM pubs)::DOUBLE AS share, (sum(n_docs) OVER (ORDER BY year))::BIGINT AS cumulative_docs, (sum(citations) OVER (ORDER BY year))::BIGINT AS cumulative_citations FROM y""",
    "share",
)
query(
    "main_info", lambda s, d: counting.main_info(P(s, d)),
    f"""WITH {PUBS}, a AS (SELECT doc_id, count(*) AS k FROM authors GROUP BY doc_id), c AS (SELECT doc_id, count(*) AS k FROM countries GROUP BY doc_id),
t AS (SELECT p.*, coalesce(a.k, 0) AS na, coalesce(c.k, 0) AS nc FROM pubs p LEFT JOIN a USING (doc_id) LEFT JOIN c USING (doc_id)),
o AS (SELECT count(*)::DOUBLE AS documents, min(year)::DOUBLE AS first_year, max(year)::DOUBLE AS last_year, count(DISTINCT source)::DOUBLE AS sources, sum(cited_by)::DOUBLE AS citations, avg(cited_by)::DOUBLE AS mean_citations, avg(na)::DOUBLE AS authors_per_document,
avg(CASE WHEN na > 1 THEN na END)::DOUBLE AS collaboration_index, sum((na = 1)::INT)::DOUBLE AS single_author_documents, avg((nc > 1)::INT)::DOUBLE AS international_share FROM t)
UNPIVOT o ON COLUMNS(*) INTO NAME indicator VALUE value""",
    "value",
)
query(
    "term_years_keywords", lambda s, d: counting.term_years(P(s, d, "keywords"), "keywords", 10),
    f"""WITH {PUBS}, t AS (SELECT item FROM keywords GROUP BY item ORDER BY count(*) DESC, item LIMIT 10) SELECT year::BIGINT AS year, item, count(*)::BIGINT AS n_docs FROM keywords JOIN pubs USING (doc_id) WHERE item IN (SELECT item FROM t) GROUP BY ALL""",
)

# indices ------------------------------------------------------------------------------------------------------------

_INDEX_SQL = f"""WITH {PUBS}, k AS (SELECT doc_id, count(*) AS na FROM authors GROUP BY doc_id),
t0 AS (SELECT a.item AS entity, p.cited_by::DOUBLE AS c, p.year, k.na, p.doc_id FROM authors a JOIN pubs p USING (doc_id) JOIN k USING (doc_id)),
t1 AS (SELECT *, row_number() OVER w AS i, sum(c) OVER (w ROWS UNBOUNDED PRECEDING) AS s, sum(1.0::DOUBLE / na) OVER (w ROWS UNBOUNDED PRECEDING) AS eff, row_number() OVER (PARTITION BY entity ORDER BY c) AS up, count(*) OVER (PARTITION BY entity) AS n FROM t0 WINDOW w AS (PARTITION BY entity ORDER BY c DESC, year, na)),
t2 AS (SELECT *, sum((c >= i)::INT) OVER (PARTITION BY entity) AS h, max((eff > c)::INT) OVER (PARTITION BY entity ORDER BY i) AS failed FROM t1),
a AS (SELECT entity, count(*) AS n, sum(c) AS total, max(h) AS h, coalesce(max(CASE WHEN s >= i * i THEN i END), 0) AS g, coalesce(max(CASE WHEN c >= 10 * i THEN i END), 0) AS w, coalesce(max(CASE WHEN c >= i * i THEN i END), 0) AS h2u,
  coalesce(sum(CASE WHEN i <= h THEN least(c, i) / i END), 0) AS tap, coalesce(sum(CASE WHEN i <= h THEN c END), 0) AS core, coalesce(quantile_cont(CASE WHEN i <= h THEN c END, 0.5), 0) AS m, sqrt(coalesce(sum(CASE WHEN i <= h THEN c - h END), 0)) AS e,
  sqrt(coalesce(max(CASE WHEN s >= i THEN s END), 0)) AS hw, sum(CASE WHEN n > 1 AND i <= greatest(1, floor(10 * log10(n) - 10)) THEN c ELSE 0 END) AS pis, sum(up * c) AS wsum, max(CASE WHEN failed = 0 THEN eff END) AS hf,
  sqrt(coalesce(sum(CASE WHEN i <= h THEN c / greatest(1, 2002 - year + 1) END), 0)) AS ar, 2002 - min(year) + 1 AS active,
  {", ".join(f"sum((c >= {k})::INT)::BIGINT AS c{k}" for k in indices.THRESHOLDS)} FROM t2 GROUP BY entity)
SELECT entity AS item, n::BIGINT AS n_docs, total AS citations, h::BIGINT AS h, g::BIGINT AS g, w::BIGINT AS w, h2u::BIGINT AS h2_upper, tap::DOUBLE AS tapered_h, m::DOUBLE AS m, e, hw, {", ".join(f"c{k}" for k in indices.THRESHOLDS)}, ar, active::BIGINT AS years_active, coalesce(hf, 0.0) AS h_frac,
sqrt(h * g) AS hg, CASE WHEN h > 0 THEN core / h ELSE 0 END::DOUBLE AS a, sqrt(core) AS r, CASE WHEN total > 0 THEN h * h / total ELSE 0 END::DOUBLE AS h2, sqrt(h * m) AS q2, pis / 100 AS pi, (100.0::DOUBLE * h / n) AS v, h::DOUBLE / n AS h_norm, pow(total * total / n, 1.0::DOUBLE / 3) AS profit,
CASE WHEN total > 0 THEN (2 * wsum - (n + 1) * total) / (n * total) ELSE 0 END::DOUBLE AS gini, CASE WHEN active > 0 THEN h::DOUBLE / active ELSE 0 END AS m_quotient FROM a"""


def _author_rows(s, d):
    return P(s, d, "authors").where("authors IS NOT NULL").select("doc_id", "year", "cited_by", F.size("authors").alias("n_authors"), F.explode("authors").alias("item"))


query("citation_indices_authors", lambda s, d: indices.citation_indices(_author_rows(s, d), "item", year="year", authors="n_authors", now=2002), _INDEX_SQL, "citations tapered_h m e hw ar h_frac hg a r h2 q2 pi v h_norm profit gini m_quotient")
query("h_index_sources", lambda s, d: indices.h_indices(P(s, d, "base"), "source"), f"WITH {PUBS}, t AS (SELECT source, cited_by, row_number() OVER (PARTITION BY source ORDER BY cited_by DESC) AS i FROM pubs) SELECT source, sum((cited_by >= i)::INT)::BIGINT AS h FROM t GROUP BY source")

# laws ---------------------------------------------------------------------------------------------------------------


def _authors(s, d):
    return long(P(s, d, "authors"), "authors").groupBy("item").agg(F.count("*").alias("n_docs"))


_AC = f"WITH {PUBS}, c AS (SELECT item, count(*)::BIGINT AS n_docs FROM authors GROUP BY item)"
_ACR = _AC + ", t AS (SELECT item, n_docs, row_number() OVER (ORDER BY n_docs DESC, item) AS rank FROM c)"
query("lotka_distribution", lambda s, d: laws.lotka(_authors(s, d)), _AC + " SELECT n_docs AS documents, count(*)::BIGINT AS authors, count(*) / (SELECT count(*) FROM c)::DOUBLE AS proportion, sum(count(*) / (SELECT count(*) FROM c)::DOUBLE) OVER (ORDER BY n_docs) AS cumulative FROM c GROUP BY n_docs", "proportion cumulative")
query("lotka_fit", lambda s, d: laws.lotka_fit(_authors(s, d)), _AC + ", l AS (SELECT ln(n_docs) AS x, ln(count(*)) AS y FROM c GROUP BY n_docs) SELECT -regr_slope(y, x) AS exponent, regr_intercept(y, x) AS intercept, regr_r2(y, x) AS r2 FROM l", "exponent intercept r2")
query("bradford_zones", lambda s, d: laws.bradford(_authors(s, d)), _ACR + ", u AS (SELECT *, sum(n_docs) OVER (ORDER BY rank) / (SELECT sum(n_docs) FROM c)::DOUBLE AS cumulative FROM t) SELECT *, CASE WHEN cumulative <= 0.333 THEN 1 WHEN cumulative <= 0.667 THEN 2 ELSE 3 END::BIGINT AS zone FROM u", "cumulative")
query("bradford_zones_by_sources", lambda s, d: laws.bradford_by_sources(_authors(s, d)), _ACR + " SELECT *, least(3, floor((rank - 1) * 3 / (SELECT count(*) FROM c)::DOUBLE) + 1)::BIGINT AS zone FROM t")
query("bradford_zones_by_mass", lambda s, d: laws.bradford_by_mass(_authors(s, d)), _ACR + ", u AS (SELECT *, coalesce(sum(n_docs) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t) SELECT item, n_docs, rank, least(3, floor(b * 3 / (SELECT sum(n_docs) FROM c)::DOUBLE) + 1)::BIGINT AS zone FROM u")
query("bradford_fit", lambda s, d: laws.bradford_fit(laws.bradford_by_mass(_authors(s, d))), _ACR + ", u AS (SELECT *, coalesce(sum(n_docs) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t), z AS (SELECT least(3, floor(b * 3 / (SELECT sum(n_docs) FROM c)::DOUBLE) + 1)::BIGINT AS zone, count(*)::BIGINT AS sources, sum(n_docs)::BIGINT AS documents FROM u GROUP BY 1) SELECT *, sources / lag(sources) OVER (ORDER BY zone)::DOUBLE AS multiplier FROM z", "multiplier")
query("zipf_distribution", lambda s, d: laws.zipf(_authors(s, d)), _ACR + " SELECT item, n_docs AS frequency, rank, ln(rank) AS log_rank, ln(n_docs) AS log_frequency FROM t", "log_rank log_frequency")
query("zipf_fit", lambda s, d: laws.zipf_fit(_authors(s, d)), _ACR + " SELECT -regr_slope(ln(n_docs), ln(rank)) AS exponent, regr_intercept(ln(n_docs), ln(rank)) AS intercept, regr_r2(ln(n_docs), ln(rank)) AS r2 FROM t", "exponent intercept r2")
query("price_law", lambda s, d: laws.price(_authors(s, d)), _ACR + ", e AS (SELECT floor(sqrt(count(*))) AS e, count(*) AS n FROM c) SELECT any_value(n)::BIGINT AS authors, any_value(e)::BIGINT AS elite, sum(CASE WHEN rank <= e THEN n_docs ELSE 0 END) / sum(n_docs)::DOUBLE AS share, sum(CASE WHEN rank <= e THEN n_docs ELSE 0 END) / sum(n_docs)::DOUBLE >= 0.5 AS holds FROM t, e", "share")
query("pareto", lambda s, d: laws.pareto(_authors(s, d)), _ACR + ", u AS (SELECT *, sum(n_docs) OVER (ORDER BY rank) / (SELECT sum(n_docs) FROM c)::DOUBLE AS cum FROM t) SELECT (sum((cum <= 0.8)::INT) + 1)::BIGINT AS items_for_80, sum(CASE WHEN rank <= greatest(1, floor((SELECT count(*) FROM c) * 0.2)) THEN n_docs ELSE 0 END) / sum(n_docs)::DOUBLE AS top_fifth_share FROM u", "top_fifth_share")

# groups -------------------------------------------------------------------------------------------------------------


def _members(s, d):
    return groups.membership(P(s, d, "countries"), "countries")


_M = f"WITH {PUBS}, m AS (SELECT doc_id, item AS g FROM countries)"
query("group_membership", lambda s, d: _members(s, d), _M + " SELECT doc_id, g AS group_name FROM m")
query("group_matrix", lambda s, d: groups.indicator_matrix(_members(s, d), ["NATION_0", "NATION_1"]), _M + " SELECT doc_id, max((g = 'NATION_0')::INT)::BIGINT AS NATION_0, max((g = 'NATION_1')::INT)::BIGINT AS NATION_1 FROM m GROUP BY doc_id")
query("group_intersections", lambda s, d: groups.intersections(_members(s, d)), _M + " SELECT x.g AS a, y.g AS b, count(*)::BIGINT AS n FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.g <= y.g GROUP BY ALL")
query("group_similarity", lambda s, d: groups.similarity(_members(s, d)), _M + ", k AS (SELECT g, count(*) AS k FROM m GROUP BY g), p AS (SELECT x.g AS a, y.g AS b, count(*)::BIGINT AS n FROM m x JOIN m y ON x.doc_id = y.doc_id AND x.g < y.g GROUP BY ALL) SELECT a, b, n, n / (ka.k + kb.k - n)::DOUBLE AS jaccard, n / least(ka.k, kb.k)::DOUBLE AS overlap FROM p JOIN k ka ON ka.g = a JOIN k kb ON kb.g = b", "jaccard overlap")
_GC = _M + ", c AS (SELECT g AS group_name, k.item, count(*)::BIGINT AS n_docs FROM m JOIN keywords k USING (doc_id) GROUP BY ALL), z AS (SELECT g AS group_name, count(*) AS size FROM m GROUP BY g)"
query("group_count_keywords", lambda s, d: groups.count_items(P(s, d, "keywords"), _members(s, d), "keywords"), _GC + " SELECT group_name, item, n_docs, n_docs / size::DOUBLE AS share, row_number() OVER (PARTITION BY group_name ORDER BY n_docs DESC, item) AS rank FROM c JOIN z USING (group_name)", "share")
query("group_count_keywords_shared", lambda s, d: groups.count_items(P(s, d, "keywords"), _members(s, d), "keywords", "shared"), _GC + ", k AS (SELECT item FROM c GROUP BY item HAVING count(*) = (SELECT count(DISTINCT g) FROM m)) SELECT group_name, item, n_docs, n_docs / size::DOUBLE AS share, row_number() OVER (PARTITION BY group_name ORDER BY n_docs DESC, item) AS rank FROM c JOIN z USING (group_name) WHERE item IN (SELECT item FROM k)", "share")
query("group_combined_keywords", lambda s, d: groups.combined_counts(P(s, d, "keywords"), _members(s, d), "keywords"), _GC + " SELECT item, sum(n_docs)::BIGINT AS total, count(*)::BIGINT AS groups, row_number() OVER (ORDER BY sum(n_docs) DESC, item) AS rank FROM c GROUP BY item")
query("group_production", lambda s, d: groups.production(P(s, d, "base"), _members(s, d)), _M + ", t AS (SELECT g AS group_name, year::BIGINT AS year, count(*)::BIGINT AS n_docs FROM m JOIN pubs USING (doc_id) GROUP BY ALL) SELECT *, (sum(n_docs) OVER (PARTITION BY group_name ORDER BY year))::BIGINT AS cumulative FROM t")
query("group_top_cited", lambda s, d: groups.top_cited(P(s, d, "base"), _members(s, d), 3), _M + ", t AS (SELECT doc_id, year::BIGINT AS year, cited_by, g AS group_name, row_number() OVER (PARTITION BY g ORDER BY cited_by DESC, doc_id) AS rank FROM m JOIN pubs USING (doc_id)) SELECT * FROM t WHERE rank <= 3")
query("group_compare_continuous", lambda s, d: groups.compare_continuous(P(s, d, "base"), _members(s, d), "price"), _M + ", t AS (SELECT g AS group_name, price AS x FROM m JOIN pubs USING (doc_id)), n AS (SELECT count(*) AS n, sum(price) AS s FROM pubs) SELECT group_name, count(*)::BIGINT AS n, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x, 0.5) AS median, (any_value(n.n) - count(*))::BIGINT AS rest_n, (any_value(n.s) - sum(x)) / (any_value(n.n) - count(*)) AS rest_mean FROM t, n GROUP BY group_name", "mean std median rest_mean")
query(
    "group_profile", lambda s, d: groups.profile(P(s, d), groups.membership(P(s, d, "base"), "category")),
    f"""WITH {PUBS}, m AS (SELECT doc_id, category AS g FROM pubs), na AS (SELECT doc_id, count(*) AS k FROM authors GROUP BY doc_id), nc AS (SELECT doc_id, count(*) AS k FROM countries GROUP BY doc_id),
t AS (SELECT g, p.*, coalesce(na.k, 0) AS na, coalesce(nc.k, 0) AS nc, row_number() OVER (PARTITION BY g ORDER BY cited_by DESC) AS i FROM m JOIN pubs p USING (doc_id) LEFT JOIN na USING (doc_id) LEFT JOIN nc USING (doc_id)),
a AS (SELECT g, count(DISTINCT item)::BIGINT AS authors FROM m JOIN authors USING (doc_id) GROUP BY g), y AS (SELECT g, year, count(*) AS k FROM m JOIN pubs USING (doc_id) GROUP BY ALL), gr AS (SELECT g, regr_slope(k, year) / avg(k) AS growth FROM y GROUP BY g)
SELECT g AS group_name, count(*)::BIGINT AS documents, count(DISTINCT source)::BIGINT AS sources, sum(cited_by)::BIGINT AS citations, avg(cited_by) AS mean_citations, avg(na) AS authors_per_document, avg((nc > 1)::INT) AS international_share, any_value(authors) AS authors, sum((cited_by >= i)::INT)::BIGINT AS h, any_value(growth) AS growth
FROM t JOIN a USING (g) JOIN gr USING (g) GROUP BY g""",
    "mean_citations authors_per_document international_share growth",
)
query(
    "group_associations", lambda s, d: groups.associations(P(s, d, "keywords"), groups.membership(P(s, d, "base"), "category"), "keywords", 10),
    f"""WITH {PUBS}, t AS (SELECT item FROM keywords GROUP BY item ORDER BY count(*) DESC, item LIMIT 10), c AS (SELECT category AS group_name, item, count(*)::BIGINT AS n FROM keywords JOIN pubs USING (doc_id) WHERE item IN (SELECT item FROM t) GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY group_name) * sum(n) OVER (PARTITION BY item) / (SELECT sum(n) FROM c)::DOUBLE AS expected FROM c) SELECT *, (n - expected) / sqrt(expected) AS residual, log2(n / expected) AS log_ratio FROM e""",
    "expected residual log_ratio",
)
query(
    "dataset_similarity", lambda s, d: groups.dataset_similarity(P(s, d).where("year <= 1997"), P(s, d).where("year > 1997"), ["authors", "keywords", "source"]),
    f"""WITH {PUBS}, v AS (SELECT 'authors' AS c, item::VARCHAR AS v, year <= 1997 AS o FROM authors JOIN pubs USING (doc_id) UNION ALL SELECT 'keywords', item, year <= 1997 FROM keywords JOIN pubs USING (doc_id) UNION ALL SELECT 'source', source, year <= 1997 FROM pubs),
k AS (SELECT c, v, count(DISTINCT o) AS k FROM v GROUP BY ALL) SELECT c AS "column", sum((k = 2)::INT)::BIGINT AS shared, count(*)::BIGINT AS either, sum((k = 2)::INT) / count(*)::DOUBLE AS jaccard FROM k GROUP BY c""",
    "jaccard",
)

# diversity ----------------------------------------------------------------------------------------------------------


def _div_sql(by: str, counts: str) -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""{counts}, t AS (SELECT {b}item, n::DOUBLE AS n, row_number() OVER ({part} ORDER BY n, item) AS i, sum(n) OVER ({part})::DOUBLE AS s FROM k)
SELECT {b}count(*)::BIGINT AS richness, sum(n) AS total, -sum(n / s * ln(n / s)) AS shannon, -sum(n / s * ln(n / s)) / CASE WHEN count(*) > 1 THEN ln(count(*)) ELSE 1 END AS evenness, 1 - sum(n / s * n / s) AS simpson, 1 / sum(n / s * n / s) AS inverse_simpson, sum(n / s * n / s) AS hhi,
greatest(0, least(1, (2 * sum(i * n) - (count(*) + 1) * sum(n)) / (count(*) * sum(n)))) AS gini, 2 * sum(i * n) / (count(*) * sum(n)) - 1 AS gini_biased, arg_max(item, i) AS dominant, max(n) / any_value(s) AS dominant_share FROM t {f"GROUP BY {by}" if by else ""}"""


_DIV = "total shannon evenness simpson inverse_simpson hhi gini gini_biased dominant_share"
query("diversity_keywords", lambda s, d: diversity.entity_diversity(P(s, d, "keywords"), "keywords"), _div_sql("", f"WITH {PUBS}, k AS (SELECT item, count(*) AS n FROM keywords GROUP BY item)"), _DIV)
query("diversity_by_year", lambda s, d: diversity.temporal_diversity(P(s, d, "authors"), "authors"), _div_sql("year", f"WITH {PUBS}, k AS (SELECT year::BIGINT AS year, item, count(*) AS n FROM authors JOIN pubs USING (doc_id) WHERE year IN (SELECT year FROM pubs GROUP BY year HAVING count(*) >= 5) GROUP BY ALL)"), _DIV)
query("diversity_by_group", lambda s, d: diversity.entity_diversity(P(s, d, "countries"), "countries", ["category"]), _div_sql("category", f"WITH {PUBS}, k AS (SELECT category, item, count(*) AS n FROM countries JOIN pubs USING (doc_id) GROUP BY ALL)"), _DIV)


def _rao(s, d):
    counts = long(P(s, d, "types"), "types", ["doc_id", "source"]).groupBy("source", "item").agg(F.count("*").alias("n"))
    names = counts.select("item").distinct()
    distances = names.select(F.col("item").alias("a")).join(names.select(F.col("item").alias("b")), F.col("a") < F.col("b")).withColumn("d", F.lit(1.0))
    return diversity.rao_stirling(counts, distances, ["source"])


query("rao_stirling", _rao, f"WITH {PUBS}, k AS (SELECT source, item, count(*) AS n FROM types JOIN pubs USING (doc_id) GROUP BY ALL), t AS (SELECT source, item, n / sum(n) OVER (PARTITION BY source)::DOUBLE AS p FROM k) SELECT x.source, 2 * sum(x.p * y.p) AS rao FROM t x JOIN t y ON x.source = y.source AND x.item < y.item GROUP BY x.source", "rao")

# statistics ---------------------------------------------------------------------------------------------------------

_MOM = "(SELECT avg(price) AS m FROM pubs) AS mm"
query(
    "descriptives", lambda s, d: stats.descriptives(P(s, d, "base"), "price", "category"),
    f"""WITH {PUBS}, t AS (SELECT category, price AS x, price - avg(price) OVER (PARTITION BY category) AS d FROM pubs) SELECT category, count(*)::BIGINT AS n, avg(x) AS mean, stddev_samp(x) AS sd, stddev_samp(x) / sqrt(count(*)) AS se, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, min(x) AS min, max(x) AS max,
avg(d * d * d) / pow(avg(d * d), 1.5) AS skewness, avg(d * d * d * d) / (avg(d * d) * avg(d * d)) - 3 AS kurtosis FROM t GROUP BY category""",
    "mean sd se median q1 q3 min max skewness kurtosis",
)
_X = f"""WITH {PUBS}, c AS (SELECT category AS "row", source AS "col", count(*)::BIGINT AS n FROM pubs GROUP BY ALL), e AS (SELECT *, sum(n) OVER (PARTITION BY "row") AS r, sum(n) OVER (PARTITION BY "col") AS k, (SELECT sum(n) FROM c)::DOUBLE AS t FROM c)"""
query("crosstab", lambda s, d: stats.crosstab(P(s, d, "base"), "category", "source"), _X + """ SELECT "row", "col", n, r * k / t AS expected, (n - r * k / t) / sqrt(r * k / t) AS residual, n / r::DOUBLE AS row_share, n / k::DOUBLE AS col_share, n / t AS total_share FROM e""", "expected residual row_share col_share total_share")
query("crosstab_margins", lambda s, d: stats.crosstab_margins(P(s, d, "base"), "category", "source"), f"""WITH {PUBS} SELECT coalesce(category, 'Total') AS "row", coalesce(source, 'Total') AS "col", count(*)::BIGINT AS n FROM pubs GROUP BY CUBE (category, source)""")
query("chi_square", lambda s, d: stats.chi_square(P(s, d, "base"), "category", "source"), _X + """, q AS (SELECT sum(n)::BIGINT AS n, sum(n * n / (r * k / t)) - sum(n) AS chi2, count(DISTINCT "row") AS nr, count(DISTINCT "col") AS nk FROM e) SELECT n, chi2, ((nr - 1) * (nk - 1))::BIGINT AS dof, sqrt(chi2 / (n * (least(nr, nk) - 1))) AS cramers_v, sqrt(chi2 / (chi2 + n)) AS contingency FROM q""", "chi2 cramers_v contingency")
query("correlation_pearson", lambda s, d: stats.correlations(P(s, d, "base"), ["price", "cited_by", "year"]), f"WITH {PUBS} SELECT 'price' AS a, 'cited_by' AS b, corr(price, cited_by) AS r, count(*)::BIGINT AS n FROM pubs UNION ALL SELECT 'price', 'year', corr(price, year), count(*) FROM pubs UNION ALL SELECT 'cited_by', 'year', corr(cited_by, year), count(*) FROM pubs", "r")
query("correlation_spearman", lambda s, d: stats.correlations(P(s, d, "base"), ["price", "cited_by"], "spearman"), f"WITH {PUBS}, t AS (SELECT rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY cited_by) + (count(*) OVER (PARTITION BY cited_by) - 1) / 2.0::DOUBLE AS y FROM pubs) SELECT 'price' AS a, 'cited_by' AS b, corr(x, y) AS r, count(*)::BIGINT AS n FROM t", "r")
query("kendall_tau", lambda s, d: stats.kendall(P(s, d, "authors").select("year", F.size(F.coalesce("authors", F.array())).alias("k")), "year", "k"), f"""WITH {PUBS}, a AS (SELECT doc_id, count(*) AS k FROM authors GROUP BY doc_id), t AS (SELECT year AS x, coalesce(a.k, 0) AS y, count(*)::DOUBLE AS k FROM pubs LEFT JOIN a USING (doc_id) GROUP BY ALL),
s AS (SELECT sum(sign(q.y - p.y) * p.k * q.k) AS s FROM t p JOIN t q ON p.x < q.x), n AS (SELECT sum(k) AS n FROM t), tx AS (SELECT sum(v * (v - 1) / 2) AS u FROM (SELECT sum(k) AS v FROM t GROUP BY x)), ty AS (SELECT sum(v * (v - 1) / 2) AS u FROM (SELECT sum(k) AS v FROM t GROUP BY y))
SELECT s / sqrt((n * (n - 1) / 2 - tx.u) * (n * (n - 1) / 2 - ty.u)) AS tau_b, n::BIGINT AS n FROM s, n, tx, ty""", "tau_b")
_AN = "a AS (SELECT count(*) AS n, avg(x) AS m, var_samp(x) AS v FROM t GROUP BY g), b AS (SELECT sum(n) AS n, count(*) AS k, sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n) AS b, sum((n - 1) * v) AS w FROM a) SELECT (b / (k - 1)) / (w / (n - k)) AS f, (k - 1)::BIGINT AS df_between, (n - k)::BIGINT AS df_within, b / (b + w) AS eta_squared FROM b"
query("anova", lambda s, d: stats.anova(P(s, d, "base"), "price", "category"), f"WITH {PUBS}, t AS (SELECT category AS g, price AS x FROM pubs), {_AN}", "f eta_squared")
query("levene", lambda s, d: stats.levene(P(s, d, "base"), "price", "category"), f"WITH {PUBS}, md AS (SELECT category AS g, quantile_cont(price, 0.5) AS m FROM pubs GROUP BY category), t AS (SELECT g, abs(price - m) AS x FROM pubs JOIN md ON g = category), {_AN}", "f eta_squared")
query("kruskal_wallis", lambda s, d: stats.kruskal(P(s, d, "base"), "cited_by", "category"), f"WITH {PUBS}, t AS (SELECT category AS g, cited_by AS x, rank() OVER (ORDER BY cited_by) + (count(*) OVER (PARTITION BY cited_by) - 1) / 2.0::DOUBLE AS r FROM pubs), u AS (SELECT sum(pow(k, 3) - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM t GROUP BY x)), s AS (SELECT count(*)::DOUBLE AS k, sum(r) AS s FROM t GROUP BY g), n AS (SELECT count(*)::DOUBLE AS n FROM t), h AS (SELECT (12 / (any_value(n) * (any_value(n) + 1)) * sum(s * s / k) - 3 * (any_value(n) + 1)) / (1 - any_value(u.t) / (pow(any_value(n), 3) - any_value(n))) AS h, count(*) AS k, any_value(n) AS n FROM s, n, u) SELECT h, k::BIGINT AS k, n::BIGINT AS n, greatest(0, (h - k + 1) / (n - k)) AS epsilon_squared FROM h", "h epsilon_squared")
query("mann_whitney", lambda s, d: stats.mann_whitney(P(s, d, "base"), "cited_by", "source", "BUILDING", "MACHINERY"), f"""WITH {PUBS}, t AS (SELECT source AS g, cited_by AS x, rank() OVER (ORDER BY cited_by) + (count(*) OVER (PARTITION BY cited_by) - 1) / 2.0::DOUBLE AS r FROM pubs WHERE source IN ('BUILDING', 'MACHINERY')), u AS (SELECT sum(pow(k, 3) - k) AS t FROM (SELECT count(*)::DOUBLE AS k FROM t GROUP BY x)),
q AS (SELECT sum((g = 'BUILDING')::INT)::DOUBLE AS n1, sum((g = 'MACHINERY')::INT)::DOUBLE AS n2, sum(CASE WHEN g = 'BUILDING' THEN r END) AS s FROM t), w AS (SELECT *, s - n1 * (n1 + 1) / 2 AS u0, n1 + n2 AS n FROM q)
SELECT n1, n2, u0 AS u, (u0 - n1 * n2 / 2) / sqrt(n1 * n2 / 12 * (n + 1 - u.t / (n * (n - 1)))) AS z, abs(1 - 2 * u0 / (n1 * n2)) AS rank_biserial FROM w, u""", "n1 n2 u z rank_biserial")
_PT = f"WITH {PUBS}, g AS (SELECT category AS g, count(*) AS n, avg(price) AS m, var_samp(price) AS v FROM pubs GROUP BY category), p AS (SELECT a.g AS a, b.g AS b, a.m - b.m AS d, a.n AS n1, b.n AS n2, a.v AS v1, b.v AS v2, ((a.n - 1) * a.v + (b.n - 1) * b.v) / (a.n + b.n - 2) AS sp FROM g a JOIN g b ON a.g < b.g)"
query("pairwise_t", lambda s, d: stats.pairwise_t(P(s, d, "base"), "price", "category"), _PT + " SELECT a, b, d / sqrt(sp * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n2)) AS t, (n1 + n2 - 2)::DOUBLE AS dof, abs(d) / sqrt(sp) AS cohens_d FROM p", "t dof cohens_d")
query("pairwise_welch", lambda s, d: stats.pairwise_t(P(s, d, "base"), "price", "category", False), _PT + " SELECT a, b, d / sqrt(v1 / n1 + v2 / n2) AS t, pow(v1 / n1 + v2 / n2, 2) / (v1 * v1 / (n1 * n1 * (n1 - 1)::DOUBLE) + v2 * v2 / (n2 * n2 * (n2 - 1)::DOUBLE)) AS dof, abs(d) / sqrt(sp) AS cohens_d FROM p", "t dof cohens_d")


def _year_counts(s, d, ok):
    return P(s, d, "base").where(ok).groupBy(F.col("ca_country").alias("category")).agg(F.count("*").alias("n"))


_REP = f"WITH {PUBS}, t AS (SELECT o.category, o.n AS o, r.n AS r FROM (SELECT ca_country AS category, count(*) AS n FROM pubs WHERE year >= 1999 GROUP BY 1) o JOIN (SELECT ca_country AS category, count(*) AS n FROM pubs WHERE year < 1999 GROUP BY 1) r USING (category))"
query("representation", lambda s, d: stats.representation(_year_counts(s, d, "year >= 1999"), _year_counts(s, d, "year < 1999")), _REP + ", u AS (SELECT category, o AS n, 100 * o / (SELECT sum(o) FROM t)::DOUBLE AS share, 100 * r / (SELECT sum(r) FROM t)::DOUBLE AS reference_share FROM t) SELECT *, share - reference_share AS difference, (share - reference_share) / reference_share * 100 AS relative, CASE WHEN share - reference_share > 1 THEN 'over' WHEN share - reference_share < -1 THEN 'under' ELSE 'proportional' END AS \"class\" FROM u", "share reference_share difference relative")
query("goodness_of_fit", lambda s, d: stats.goodness_of_fit(_year_counts(s, d, "year >= 1999"), _year_counts(s, d, "year < 1999")), _REP + ", u AS (SELECT o, r * (SELECT sum(o) FROM t) / (SELECT sum(r) FROM t)::DOUBLE AS e FROM t) SELECT sum((o - e) * (o - e) / e) AS chi2, (count(*) - 1)::BIGINT AS dof, avg((e < 5)::INT) AS small_share FROM u", "chi2 small_share")
query("collaboration", lambda s, d: stats.collaboration(P(s, d, "authors")), f"WITH {PUBS}, a AS (SELECT doc_id, count(*) AS k FROM authors GROUP BY doc_id) SELECT count(*)::BIGINT AS documents, avg(k) AS index, avg((k > 1)::INT) AS degree, 1 - avg(1.0::DOUBLE / k) AS coefficient FROM a", "index degree coefficient")
query("team_sizes", lambda s, d: stats.team_sizes(P(s, d, "authors")), f"WITH {PUBS}, a AS (SELECT doc_id, count(*) AS k FROM authors GROUP BY doc_id) SELECT k::BIGINT AS authors, count(*)::BIGINT AS documents, count(*) / (SELECT count(*) FROM a)::DOUBLE AS share FROM a GROUP BY k", "share")
query(
    "fit_distributions", lambda s, d: stats.fit_distributions(P(s, d, "base"), "cited_by").drop("parameters"),
    f"""WITH {PUBS}, x AS (SELECT cited_by::DOUBLE AS x FROM pubs WHERE cited_by > 0), s AS (SELECT count(*) AS n, sum(x) AS s, sum(ln(x)) AS l, var_pop(ln(x)) AS vl, avg(x) AS m, min(x) AS lo FROM x),
f AS (SELECT 'lognormal' AS family, -l - n / 2.0::DOUBLE * (ln(2 * pi() * vl) + 1) AS ll, 2 AS k, n FROM s UNION ALL SELECT 'exponential', -n * ln(m) - n, 1, n FROM s UNION ALL SELECT 'power', n * ln(n / (l - n * ln(lo)) / lo) - (1 + n / (l - n * ln(lo))) * (l - n * ln(lo)), 1, n FROM s UNION ALL SELECT 'geometric', n * ln(1 / m) + (s - n) * ln(1 - 1 / m), 1, n FROM s)
SELECT family, ll AS log_likelihood, 2 * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic FROM f""",
    "log_likelihood aic bic",
)
query("bootstrap_mean", lambda s, d: stats.bootstrap(P(s, d, "base"), "price", 200))

# quality ------------------------------------------------------------------------------------------------------------

query("duplicates_by_text", lambda s, d: quality.duplicate_groups(table(s, d, "documents"), F.md5(F.lower("text"))).select("key", "n", "least"), "SELECT md5(lower(text)) AS key, count(*)::BIGINT AS n, min(doc_id) AS least FROM documents GROUP BY 1 HAVING count(*) > 1")
query("flag_duplicates", lambda s, d: quality.flag_duplicates(table(s, d, "documents").select("doc_id", "text"), F.md5(F.lower("text"))).select("doc_id", "n_same", "is_duplicate"), "SELECT doc_id, (count(*) OVER (PARTITION BY md5(lower(text))))::BIGINT AS n_same, doc_id > min(doc_id) OVER (PARTITION BY md5(lower(text))) AS is_duplicate FROM documents")
query("remove_duplicates", lambda s, d: quality.remove_duplicates(table(s, d, "documents"), F.md5(F.lower("text"))).select("doc_id"), "SELECT min(doc_id) AS doc_id FROM documents GROUP BY md5(lower(text))")
query("missing_values", lambda s, d: quality.missing(table(s, d, "part").select("p_name", "p_brand", "p_size")).drop("distinct"), "SELECT 'p_name' AS \"column\", sum((p_name IS NULL)::INT)::BIGINT AS missing, sum((trim(p_name) = '')::INT)::BIGINT AS empty, sum((p_name IS NULL OR trim(p_name) = '')::INT) / count(*)::DOUBLE AS share FROM part UNION ALL SELECT 'p_brand', sum((p_brand IS NULL)::INT), sum((trim(p_brand) = '')::INT), sum((p_brand IS NULL OR trim(p_brand) = '')::INT) / count(*)::DOUBLE FROM part UNION ALL SELECT 'p_size', sum((p_size IS NULL)::INT), 0, sum((p_size IS NULL)::INT) / count(*)::DOUBLE FROM part", "share")
query("validate", lambda s, d: quality.validate(P(s, d, "base")), f"WITH {PUBS} SELECT count(*)::BIGINT AS documents, (count(doc_id) - count(DISTINCT doc_id))::BIGINT AS duplicate_ids, sum((year IS NULL)::INT)::BIGINT AS missing_years, sum((NOT year BETWEEN 1900 AND 2100)::INT)::BIGINT AS odd_years, sum((cited_by < 0)::INT)::BIGINT AS negative_citations, count(*) > 0 AND count(doc_id) = count(DISTINCT doc_id) AS valid FROM pubs")
query("quality_score", lambda s, d: quality.quality_score(P(s, d), {"doc_id": 2.0, "source": 1.0, "authors": 1.0}), f"WITH {PUBS} SELECT 100 * (2.0::DOUBLE + 1.0 + (SELECT count(DISTINCT doc_id) FROM authors) / count(*)::DOUBLE) / 4 AS score FROM pubs", "score")
query("country_profile", lambda s, d: models.country_profile(P(s, d, "countries")), f"WITH {PUBS}, k AS (SELECT doc_id, count(*) AS k FROM countries GROUP BY doc_id), t AS (SELECT item, cited_by, (k > 1)::INT AS i, row_number() OVER (PARTITION BY item ORDER BY cited_by DESC) AS r FROM countries JOIN pubs USING (doc_id) JOIN k USING (doc_id)) SELECT item, count(*)::BIGINT AS papers, sum(cited_by)::BIGINT AS citations, avg(cited_by) AS mean_citations, avg(i) AS international, sum((cited_by >= r)::INT)::BIGINT AS h FROM t GROUP BY item", "mean_citations international")
query("experts", lambda s, d: models.experts(P(s, d, "authors", "keywords"), ["Brand#1", "Brand#2"], 2001), f"WITH {PUBS}, hit AS (SELECT DISTINCT doc_id FROM keywords WHERE item IN ('Brand#1', 'Brand#2')), t AS (SELECT item, cited_by, year, (doc_id IN (SELECT doc_id FROM hit))::INT AS m FROM authors JOIN pubs USING (doc_id)) SELECT item, sum(m)::BIGINT AS matches, count(*)::BIGINT AS documents, sum(cited_by)::BIGINT AS citations, sum((year > 1998)::INT)::BIGINT AS recent FROM t GROUP BY item HAVING sum(m) > 0 AND count(*) >= 2")
query("venues", lambda s, d: models.venues(P(s, d, "keywords"), ["Brand#1"]), f"WITH {PUBS}, hit AS (SELECT DISTINCT doc_id FROM keywords WHERE item = 'Brand#1'), t AS (SELECT source, avg((doc_id IN (SELECT doc_id FROM hit))::INT) AS match, avg(cited_by) AS mean_citations FROM pubs GROUP BY source HAVING count(*) >= 3) SELECT source, match, mean_citations, 0.6 * match + 0.4 * mean_citations / (SELECT max(mean_citations) FROM t) AS score FROM t", "match mean_citations score")
query("similar_authors", lambda s, d: models.similar_authors(P(s, d, "authors", "keywords").where("authors IS NOT NULL AND keywords IS NOT NULL"), 5, False).select("a", "b", "cosine", "rank"), f"""WITH {PUBS}, k0 AS (SELECT a.item AS a, k.item AS k, count(*)::DOUBLE AS n FROM authors a JOIN keywords k USING (doc_id) GROUP BY ALL), k1 AS (SELECT a, k, n / sqrt(sum(n * n) OVER (PARTITION BY a)) AS n FROM k0), p AS (SELECT x.a AS a, y.a AS b, sum(x.n * y.n) AS cosine FROM k1 x JOIN k1 y ON x.k = y.k AND x.a <> y.a GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS rank FROM p) SELECT * FROM r WHERE rank <= 5""", "cosine")
