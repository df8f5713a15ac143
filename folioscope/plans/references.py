"""Queries: similar strings by edits, references of the corpus, authors who cite themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import cooccurrence, references, similarity
from folioscope.plans.registry import query
from folioscope.sources.adapters import PUBS, publications, table

_RATIO = "1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE"


def _parts(s, d) -> DataFrame:
    return table(s, d, "part").select("p_partkey", "p_type", F.concat_ws(" ", "p_name", "p_brand").alias("name"))


query("similar_part_names", lambda s, d: similarity.ratio_pairs(_parts(s, d), "p_partkey", "name", 0.85, ["p_type"], "levenshtein"), f"""
WITH p AS (SELECT p_partkey AS k, p_type AS g, p_name || ' ' || p_brand AS t FROM part), u AS (SELECT g, t, min(k) AS k FROM p GROUP BY ALL),
m AS (SELECT x.k AS a, y.k AS b, {_RATIO.format("x.t", "y.t")} AS similarity FROM u x JOIN u y ON x.g = y.g AND x.k < y.k)
SELECT * FROM m WHERE similarity >= 0.85 - 1e-9 UNION ALL SELECT u.k, p.k, 1.0::DOUBLE FROM p JOIN u ON u.g = p.g AND u.t = p.t WHERE p.k <> u.k""", "similarity")
query("indel_part_names", lambda s, d: similarity.ratio_pairs(_parts(s, d), "p_partkey", "name", 0.85, ["p_type"]))


def _lines(s, d) -> DataFrame:
    part = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size", F.lower(F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#", ""), F.lit("size"), "p_size")).alias("title"))
    return table(s, d, "lineitem").select("l_orderkey", "l_partkey").join(part, "l_partkey")


def _linked(s, d) -> DataFrame:
    """Orders cite the parts of their lines, with a letter of each title lost."""
    at = 2 + F.col("l_orderkey") % 5
    lines = _lines(s, d).withColumn("lost", F.concat(F.expr("substring(title, 1, int(1 + l_orderkey % 5))"), F.expr("substring(title, int(3 + l_orderkey % 5))")))
    docs = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(F.concat(F.lit("Doe, J. ("), 1900 + F.col("p_size"), F.lit("). "), "lost", F.lit(". Journal "), at)).alias("references"))
    cited = table(s, d, "part").select(F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_type", F.translate("p_brand", "#", ""), F.lit("size"), "p_size").alias("title"), (1900 + F.col("p_size")).alias("year"))
    return references.linked_references(docs, threshold=0.95, years=1, measure="levenshtein", cited=cited)


query("linked_references", _linked, f"""
WITH p AS (SELECT p_partkey AS k, p_size AS y, lower(p_name || ' ' || p_type || ' ' || replace(p_brand, '#', '') || ' size ' || p_size) AS t FROM part),
r AS (SELECT DISTINCT l_orderkey AS citing, y, t[:1 + l_orderkey % 5] || t[3 + l_orderkey % 5:] AS raw FROM lineitem JOIN p ON k = l_partkey), n AS (SELECT citing, y, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM r),
u AS (SELECT DISTINCT t FROM n), v AS (SELECT DISTINCT t FROM p), m AS MATERIALIZED (SELECT u.t, v.t AS title, {_RATIO.format("u.t", "v.t")} AS similarity FROM u JOIN v ON abs(length(u.t) - length(v.t)) <= 3 AND {_RATIO.format("u.t", "v.t")} >= 0.95 - 1e-9),
b AS (SELECT citing, raw, n.y, arg_min((p.k, similarity), (-similarity, p.k)) AS x FROM n JOIN m USING (t) JOIN p ON p.t = m.title WHERE citing <> p.k AND abs(n.y - p.y) <= 1 GROUP BY ALL)
SELECT citing, x[1] AS cited, max(x[2]) AS similarity FROM b GROUP BY ALL""", "similarity")


def _own(s, d) -> DataFrame:
    """Orders, written by parts with an even key; references to all parts of the order, some with another vowel."""
    lines = _lines(s, d)
    name = F.when(F.col("l_partkey") % 3 == 0, F.translate("p_name", "i", "é")).otherwise(F.col("p_name"))
    found = lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.array_join(F.collect_set(F.when(F.col("l_partkey") % 2 == 0, F.col("p_name"))), "; ").alias("authors"), F.array_join(F.collect_list(F.concat(name, F.lit(", X. (1999). Part "), "l_partkey")), "; ").alias("references")
    )
    docs = table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id")).join(found, "doc_id", "left")
    out = references.own_references(docs, measure="levenshtein")
    return out.withColumn("self_authors", F.array_join("self_authors", "; "))


query("own_references", _own, f"""
WITH l AS (SELECT l_orderkey AS d, l_partkey AS k, p_name AS n, CASE WHEN l_partkey % 3 = 0 THEN replace(p_name, 'i', 'e') ELSE p_name END AS r FROM lineitem JOIN part ON p_partkey = l_partkey),
a AS (SELECT DISTINCT d, n FROM l WHERE k % 2 = 0), w AS (SELECT DISTINCT d, r FROM l),
h AS (SELECT w.d, w.r, a.n FROM w JOIN a ON a.d = w.d AND ((split_part(w.r, ' ', -1) = split_part(a.n, ' ', -1) AND w.r[1] = a.n[1]) OR {_RATIO.format("w.r", "a.n")} >= 0.85 - 1e-9)),
s AS (SELECT d, string_agg(DISTINCT n, '; ' ORDER BY n) AS self_authors FROM h GROUP BY d), c AS (SELECT d, count(*) AS n_refs, count(*) FILTER (EXISTS (SELECT 1 FROM h WHERE h.d = l.d AND h.r = l.r)) AS n_self FROM l GROUP BY d)
SELECT o_orderkey AS doc_id, coalesce(n_refs, 0)::BIGINT AS n_refs, coalesce(n_self, 0)::BIGINT AS n_self, coalesce(n_self, 0)::BIGINT AS n_self_refs, coalesce(round(100 * n_self / n_refs, 1), 0.0)::DOUBLE AS rate, coalesce(self_authors, '') AS self_authors
FROM orders LEFT JOIN c ON c.d = o_orderkey LEFT JOIN s ON s.d = o_orderkey""", "rate")


def _gaps(s, d) -> DataFrame:
    """Combinations of brands; brands of one first digit are expected together more often."""
    brands = table(s, d, "part").select(F.col("p_brand").alias("a")).distinct()
    near = brands.join(brands.withColumnRenamed("a", "b"), F.substring("a", 7, 1) == F.substring("b", 7, 1)).where("a < b").select("a", "b", F.lit(0.9).alias("prior"))
    return cooccurrence.combination_gaps(publications(s, d, "keywords"), "keywords", prior=near).withColumn("items", F.array_join("items", "|"))


query("combination_gaps", _gaps, f"""
WITH {PUBS}, t AS (SELECT count(*)::DOUBLE AS total FROM pubs), m AS (SELECT item, count(*) AS k FROM keywords GROUP BY item),
q AS (SELECT [a.item, b.item] AS s, a.k * b.k / total AS e FROM m a JOIN m b ON a.item < b.item, t UNION ALL SELECT [a.item, b.item, c.item], a.k * b.k / total * c.k / total FROM m a JOIN m b ON a.item < b.item JOIN m c ON b.item < c.item, t),
o AS (SELECT [a.item, b.item] AS s, count(*) AS n FROM keywords a JOIN keywords b ON a.doc_id = b.doc_id AND a.item < b.item GROUP BY ALL
  UNION ALL SELECT [a.item, b.item, c.item], count(*) FROM keywords a JOIN keywords b ON a.doc_id = b.doc_id AND a.item < b.item JOIN keywords c ON c.doc_id = a.doc_id AND b.item < c.item GROUP BY ALL),
x AS (SELECT s, coalesce(n, 0)::BIGINT AS n, e * (1 + CASE len(s) WHEN 2 THEN CASE WHEN s[1][7] = s[2][7] THEN 0.9 ELSE 0.3 END
  ELSE (CASE WHEN s[1][7] = s[2][7] THEN 0.9 ELSE 0.3 END + CASE WHEN s[1][7] = s[3][7] THEN 0.9 ELSE 0.3 END + CASE WHEN s[2][7] = s[3][7] THEN 0.9 ELSE 0.3 END) / 3.0::DOUBLE END) AS expected FROM q LEFT JOIN o USING (s))
SELECT array_to_string(s, '|') AS items, n, expected::DOUBLE AS expected, (expected / greatest(n, 1))::DOUBLE AS gap FROM x WHERE expected >= 5 - 1e-9 AND expected / greatest(n, 1) >= 2 - 1e-9""", "expected gap")
