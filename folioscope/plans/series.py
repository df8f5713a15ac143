"""Queries: impact, time series, windows, text."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import strings
from folioscope.operators import impact, models, text
from folioscope.operators import timeseries as ts
from folioscope.operators.counting import count_text
from folioscope.operators.indices import h_indices
from folioscope.operators.longform import as_list
from folioscope.plans import lexicons
from folioscope.plans.registry import query
from folioscope.sources.adapters import PUBS, publications, table

P = publications

# impact -------------------------------------------------------------------------------------------------------------

_F = f"""WITH {PUBS}, e AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY year, source) >= 5 THEN avg(cited_by) OVER (PARTITION BY year, source) ELSE avg(cited_by) OVER (PARTITION BY year) END AS x,
(rank() OVER (PARTITION BY year ORDER BY cited_by) + (count(*) OVER (PARTITION BY year, cited_by) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY year) * 100 AS pr FROM pubs),
f AS (SELECT doc_id, year::BIGINT AS year, source, cited_by, round(x, 2) AS expected, round(CASE WHEN x > 0 THEN cited_by / x WHEN cited_by > 0 THEN 2 ELSE 0 END, 3) AS fnci, round(pr, 1) AS percentile FROM e)"""


def _fnci(s, d):
    return impact.field_normalized(P(s, d, "base"), "source")


query("field_normalized_citations", _fnci, _F + " SELECT * FROM f", "expected fnci percentile")
query("citation_classes", lambda s, d: _fnci(s, d).select("doc_id", impact.citation_class().alias("label")), _F + " SELECT doc_id, CASE WHEN percentile >= 99 THEN 'Top 1%' WHEN percentile >= 90 THEN 'Top 10%' WHEN percentile >= 75 THEN 'Top 25%' WHEN fnci >= 1 THEN 'Above average' WHEN fnci >= 0.5 THEN 'Average' ELSE 'Below average' END AS label FROM f")
query("citation_summary", lambda s, d: impact.citation_summary(P(s, d, "base")), f"WITH {PUBS}, r AS (SELECT cited_by, row_number() OVER (ORDER BY cited_by DESC) AS i FROM pubs) SELECT count(*)::BIGINT AS documents, sum(cited_by)::BIGINT AS citations, avg(cited_by) AS mean, quantile_cont(cited_by::DOUBLE, 0.5) AS median, max(cited_by)::BIGINT AS max, avg((cited_by = 0)::INT) AS uncited_share, sum((cited_by >= i)::INT)::BIGINT AS h FROM r", "mean median uncited_share")
query("citation_velocity", lambda s, d: impact.velocity(P(s, d, "base"), 2002), f"WITH {PUBS}, t AS (SELECT doc_id, year::BIGINT AS year, cited_by, greatest(1, 2002 - year)::BIGINT AS age FROM pubs) SELECT *, round(cited_by / age::DOUBLE, 4) AS velocity, CASE WHEN cited_by / age::DOUBLE >= CASE WHEN age <= 2 THEN 5 WHEN age <= 5 THEN 10 ELSE 15 END THEN 'Fast' WHEN cited_by / age::DOUBLE >= CASE WHEN age <= 2 THEN 1 WHEN age <= 5 THEN 2 ELSE 3 END THEN 'Normal' ELSE 'Slow' END AS label FROM t", "velocity")


def _history(s, d):
    """A customer's orders by year as the citation history of its first year."""
    o = table(s, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.year("o_orderdate").alias("cite_year")).groupBy("doc_id", "cite_year").agg(F.count("*").alias("n"))
    first = o.groupBy("doc_id").agg(F.min("cite_year").alias("pub_year"))
    return o.join(first, "doc_id")


_H = "h0 AS (SELECT o_custkey AS doc_id, year(o_orderdate) AS cite_year, count(*) AS n FROM orders GROUP BY ALL), h AS (SELECT *, min(cite_year) OVER (PARTITION BY doc_id) AS pub_year FROM h0)"
_TR = f"""WITH {_H}, t AS (SELECT *, cite_year - pub_year AS age, sum(n) OVER (PARTITION BY doc_id ORDER BY cite_year) AS run, sum(n) OVER (PARTITION BY doc_id) AS al FROM h),
tr AS (SELECT doc_id, pub_year::BIGINT AS pub_year, sum(n)::BIGINT AS total, arg_max(age, n * 1000 - age)::BIGINT AS years_to_peak, max(n)::BIGINT AS peak, sum(CASE WHEN age BETWEEN 0 AND 3 THEN n ELSE 0 END) / sum(n)::DOUBLE AS early_share, sum(CASE WHEN age >= 5 THEN n ELSE 0 END) / sum(n)::DOUBLE AS late_share,
min(CASE WHEN run * 2 >= al THEN age END)::BIGINT AS half_life, sum(CASE WHEN cite_year BETWEEN 1999 AND 2001 THEN n ELSE 0 END) / 3.0::DOUBLE AS recent, sum(CASE WHEN cite_year BETWEEN 1996 AND 1998 THEN n ELSE 0 END) / 3.0::DOUBLE AS previous FROM t GROUP BY doc_id, pub_year)"""
query("citation_trajectories", lambda s, d: impact.trajectories(_history(s, d), 2001), _TR + " SELECT *, recent - previous AS momentum FROM tr", "early_share late_share recent previous momentum")
query("citation_patterns", lambda s, d: impact.trajectories(_history(s, d), 2001).select("doc_id", impact.pattern(2001).alias("label")), _TR + " SELECT doc_id, CASE WHEN total = 0 THEN 'uncited' WHEN 2001 - pub_year < 3 THEN 'too recent' WHEN early_share < 0.1 AND years_to_peak >= 5 THEN 'sleeping beauty' WHEN early_share < 0.2 AND late_share > 0.5 THEN 'delayed' WHEN early_share > 0.7 AND years_to_peak <= 2 THEN 'flash' WHEN late_share > 0.3 AND half_life >= 4 THEN 'evergreen' ELSE 'normal' END AS label FROM tr")
query("sleeping_beauties", lambda s, d: impact.beauty(_history(s, d)).drop("awakening"), f"""WITH {_H}, t AS (SELECT doc_id, cite_year - pub_year AS t, n FROM h), p AS (SELECT doc_id, arg_max(t, n * 1000 - t) AS tm, max(n) AS cm, coalesce(max(CASE WHEN t = 0 THEN n END), 0) AS c0 FROM t GROUP BY doc_id)
SELECT doc_id, sum(((cm - c0) / tm::DOUBLE * t + c0 - n) / greatest(1, n)) AS beauty FROM t JOIN p USING (doc_id) WHERE t <= tm AND tm > 0 GROUP BY doc_id""", "beauty")

# time series --------------------------------------------------------------------------------------------------------

_T = f"""WITH {PUBS}, c AS (SELECT year, count(*) AS n FROM pubs GROUP BY year), y AS (SELECT unnest(range((SELECT min(year) FROM pubs), (SELECT max(year) FROM pubs) + 1)) AS year), s AS (SELECT y.year::BIGINT AS year, coalesce(n, 0)::BIGINT AS count FROM y LEFT JOIN c USING (year)),
tr AS (SELECT year, count, (sum(count) OVER w)::BIGINT AS cumulative, CASE WHEN lag(count) OVER w > 0 THEN (count - lag(count) OVER w) / (lag(count) OVER w)::DOUBLE * 100 END AS growth FROM s WINDOW w AS (ORDER BY year))"""


def _trend(s, d):
    return ts.trend(P(s, d, "base"))


query("publication_trend", _trend, _T + " SELECT * FROM tr", "growth")
query("citation_evolution", lambda s, d: ts.citation_evolution(P(s, d, "base")), f"WITH {PUBS} SELECT year::BIGINT AS year, count(*)::BIGINT AS n_docs, sum(cited_by)::BIGINT AS citations, avg(cited_by) AS mean, quantile_cont(cited_by::DOUBLE, 0.5) AS median, max(cited_by)::BIGINT AS max FROM pubs GROUP BY year", "mean median")
query("growth_rates", lambda s, d: ts.growth_rates(_trend(s, d)), _T + ", g AS (SELECT year, count, (count - lag(count) OVER w) / greatest(lag(count) OVER w, 1)::DOUBLE * 100 AS yoy, CASE WHEN row_number() OVER w >= 3 THEN avg(count) OVER (ORDER BY year ROWS 2 PRECEDING) END AS mean3 FROM tr WINDOW w AS (ORDER BY year)) SELECT *, CASE WHEN lag(mean3) OVER (ORDER BY year) > 0 THEN (mean3 - lag(mean3) OVER (ORDER BY year)) / lag(mean3) OVER (ORDER BY year) * 100 END AS mean3_growth FROM g", "yoy mean3 mean3_growth")
query("cagr", lambda s, d: ts.cagr(_trend(s, d)), _T + " SELECT min(year) AS a, max(year) AS b, (pow(arg_max(count, year) / arg_min(count, year)::DOUBLE, 1.0::DOUBLE / (max(year) - min(year))) - 1) * 100 AS cagr FROM tr", "cagr")
query("forecast_linear", lambda s, d: ts.forecast(_trend(s, d), 5), _T + ", f AS (SELECT regr_slope(count, year) AS b, regr_intercept(count, year) AS a, sqrt(greatest(0, (regr_syy(count, year) - regr_slope(count, year) * regr_sxy(count, year)) / count(*))) AS sd, max(year) AS l FROM tr), o AS (SELECT a, b, sd, unnest(range(l + 1, l + 6)) AS year FROM f) SELECT year::BIGINT AS year, greatest(0, a + b * year) AS predicted, greatest(0, a + b * year - 1.96 * sd) AS low, greatest(0, a + b * year + 1.96 * sd) AS high FROM o", "predicted low high")
query("doubling_time", lambda s, d: ts.doubling_time(_trend(s, d)), _T + ", u AS (SELECT year, cumulative, lag(cumulative) OVER w AS p, lag(year) OVER w AS py, first(cumulative) OVER w AS f, first(year) OVER w AS y0 FROM tr WINDOW w AS (ORDER BY year)) SELECT arg_min(py + (2 * f - p) / (cumulative - p)::DOUBLE * (year - py) - y0, year) AS doubling_time FROM u WHERE cumulative >= 2 * f AND p IS NOT NULL", "doubling_time")
query("half_life", lambda s, d: ts.half_life(P(s, d, "base"), 2002), f"WITH {PUBS}, b AS (SELECT 2002 - year AS age, sum(cited_by) AS c FROM pubs GROUP BY 1), r AS (SELECT age, sum(c) OVER (ORDER BY age) AS run FROM b) SELECT min(age)::BIGINT AS half_life FROM r WHERE run * 2 >= (SELECT sum(c) FROM b)")
query("trend_changes", lambda s, d: ts.changes(_trend(s, d), 1.0), _T + ", ch AS (SELECT year, count - lag(count) OVER (ORDER BY year) AS change FROM tr), z AS (SELECT year, change::BIGINT AS change, (change - (SELECT avg(change) FROM ch)) / (SELECT stddev_pop(change) FROM ch) AS z FROM ch WHERE change IS NOT NULL) SELECT *, CASE WHEN z > 0 THEN 'increase' ELSE 'decrease' END AS direction FROM z WHERE abs(z) > 1.0", "z")
query("windows_fixed", lambda s, d: ts.windows(P(s, d, "base"), 3).groupBy("start", "stop").agg(F.count("*").alias("n_docs"), F.sum("cited_by").alias("citations")), f"WITH {PUBS}, t AS (SELECT *, (SELECT min(year) FROM pubs) AS lo, (SELECT max(year) FROM pubs) AS hi FROM pubs) SELECT (lo + (year - lo) // 3 * 3)::BIGINT AS start, least(lo + (year - lo) // 3 * 3 + 2, hi)::BIGINT AS stop, count(*)::BIGINT AS n_docs, sum(cited_by)::BIGINT AS citations FROM t GROUP BY 1, 2")
query("windows_sliding", lambda s, d: ts.windows(P(s, d, "base"), 3, "sliding").groupBy("start", "stop").agg(F.count("*").alias("n_docs")), f"WITH {PUBS}, w AS (SELECT unnest(range((SELECT min(year) FROM pubs), (SELECT max(year) FROM pubs) - 1)) AS start) SELECT start::BIGINT AS start, (start + 2)::BIGINT AS stop, count(*)::BIGINT AS n_docs FROM w JOIN pubs ON year BETWEEN start AND start + 2 GROUP BY start")


def _yearly(s, d):
    return P(s, d, "base").groupBy("year").agg(F.avg("cited_by").alias("value"))


query("mann_kendall", lambda s, d: ts.mann_kendall(_yearly(s, d)), f"WITH {PUBS}, y AS (SELECT year, avg(cited_by) AS v FROM pubs GROUP BY year), p AS (SELECT sum(sign(b.v - a.v)) AS s, quantile_cont((b.v - a.v) / (b.year - a.year), 0.5) AS slope FROM y a JOIN y b ON a.year < b.year), n AS (SELECT count(*)::DOUBLE AS n FROM y), t AS (SELECT sum(k * (k - 1) * (2 * k + 5)) AS t FROM (SELECT count(*) AS k FROM y GROUP BY v)), q AS (SELECT s, slope, n, (n * (n - 1) * (2 * n + 5) - t) / 18 AS variance FROM p, n, t) SELECT s::DOUBLE AS s, variance, CASE WHEN s > 0 THEN (s - 1) / sqrt(variance) WHEN s < 0 THEN (s + 1) / sqrt(variance) ELSE 0 END AS z, s / (n * (n - 1) / 2) AS tau, slope FROM q", "s variance z tau slope")
query("hot_topics", lambda s, d: ts.item_slopes(P(s, d, "keywords"), "keywords", 5, 2001), f"WITH {PUBS}, k AS (SELECT item, year, count(*) AS k FROM keywords JOIN pubs USING (doc_id) WHERE year BETWEEN 1997 AND 2001 GROUP BY ALL), a AS (SELECT item, sum(k)::BIGINT AS total, sum((year - 1997) * k) AS sxy, coalesce(sum(CASE WHEN year = 2001 THEN k END), 0)::BIGINT AS recent FROM k GROUP BY item) SELECT item, total, total / 5.0::DOUBLE AS mean, (5 * sxy - 10 * total) / 50.0::DOUBLE AS slope, recent, (5 * sxy - 10 * total) / 50.0::DOUBLE / (total / 5.0::DOUBLE + 1) AS score FROM a", "mean slope score")
query("spectrogram", lambda s, d: ts.spectrogram(table(s, d, "lineitem").select(F.year("l_shipdate").alias("year"))), "WITH c AS (SELECT year(l_shipdate) AS year, count(*) AS n FROM lineitem GROUP BY 1), y AS (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) FROM c) + 1)) AS year), t AS (SELECT y.year::BIGINT AS year, coalesce(n, 0)::BIGINT AS n FROM y LEFT JOIN c USING (year)) SELECT year, n, n - quantile_cont(n::DOUBLE, 0.5) OVER (ORDER BY year ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS deviation FROM t", "deviation")
query("growth_models", lambda s, d: ts.growth_models(_trend(s, d)).select("model", "r2", "best"))
query("life_cycle", lambda s, d: ts.life_cycle(_trend(s, d)))
query("bursts", lambda s, d: ts.bursts(P(s, d, "refs"), "refs", 2.0, 0.2))

# text ---------------------------------------------------------------------------------------------------------------

GOALS = {"goal_1": "the AND (was OR is)", "goal_2": "{of the} OR ing*", "goal_3": "and AND NOTAWORD", "goal_4": "de OR der"}
VIEWS = {"english": ["goal_1", "goal_2", "goal_3"], "other": ["goal_4"]}


def _goals(s, d):
    return text.goals(table(s, d, "documents").select("doc_id", "text"), "text", GOALS, VIEWS)


def _word(pattern: str) -> str:
    """A whole word in SQL, with letters of all scripts as word characters."""
    return rf"regexp_matches(text, '(?i)(^|[^\p{{L}}\p{{N}}_]){pattern}($|[^\p{{L}}\p{{N}}_])')"


_G = rf"""WITH g0 AS (SELECT doc_id, ({_word("the")} AND ({_word("was")} OR {_word("is")}))::INT::BIGINT AS goal_1, ({_word(r"of\s+the")} OR {_word(r"ing[\p{L}\p{N}_]*")})::INT::BIGINT AS goal_2,
({_word("and")} AND {_word("NOTAWORD")})::INT::BIGINT AS goal_3, ({_word("de")} OR {_word("der")})::INT::BIGINT AS goal_4 FROM documents), g AS (SELECT *, greatest(goal_1, goal_2, goal_3) AS perspective_english, goal_4 AS perspective_other, greatest(goal_1, goal_2, goal_3, goal_4) AS any_goal FROM g0)"""
query("goal_flags", lambda s, d: _goals(s, d).drop("text"), _G + " SELECT * FROM g")
query("goal_cooccurrence", lambda s, d: _goals(s, d).select(F.explode(F.expr("filter(flatten(transform(array('goal_1','goal_2','goal_3','goal_4'), x -> transform(array('goal_1','goal_2','goal_3','goal_4'), y -> if(x < y AND element_at(map('goal_1', goal_1, 'goal_2', goal_2, 'goal_3', goal_3, 'goal_4', goal_4), x) = 1 AND element_at(map('goal_1', goal_1, 'goal_2', goal_2, 'goal_3', goal_3, 'goal_4', goal_4), y) = 1, struct(x AS a, y AS b), NULL)))), z -> z IS NOT NULL)")).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n")), _G + ", u AS (SELECT doc_id, name, v FROM g UNPIVOT (v FOR name IN (goal_1, goal_2, goal_3, goal_4)) WHERE v = 1) SELECT x.name AS a, y.name AS b, count(*)::BIGINT AS n FROM u x JOIN u y ON x.doc_id = y.doc_id AND x.name < y.name GROUP BY ALL")
query("bridge_scores", lambda s, d: _goals(s, d).select("doc_id", text.bridge_score(list(GOALS), VIEWS).alias("score")), _G + ", p AS (SELECT *, goal_1 + goal_2 + goal_3 + goal_4 AS n, list_filter([CASE WHEN goal_1 = 1 THEN 0 END, CASE WHEN goal_2 = 1 THEN 1 END, CASE WHEN goal_3 = 1 THEN 2 END, CASE WHEN goal_4 = 1 THEN 3 END], lambda x: x IS NOT NULL) AS l FROM g) SELECT doc_id, 0.3 * least(n / 5.0::DOUBLE, 1) + 0.4 * (perspective_english + perspective_other) / 2 + 0.3 * CASE WHEN n > 1 THEN (list_max(l) - list_min(l)) / 3.0::DOUBLE ELSE 0 END AS score FROM p", "score")
_TOK = r"w AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}') AS w FROM documents)"
_ASC = r"[a-z]{2,}"
query("term_counts", lambda s, d: text.term_counts(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "role", "text"), "text", ["role"]), r"WITH w AS (SELECT conv_id AS doc_id, role, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')) AS term FROM conversations) SELECT role, term, count(*)::BIGINT AS tf, count(DISTINCT doc_id)::BIGINT AS df FROM w GROUP BY ALL")
_TF = r"""WITH w AS (SELECT conv_id * 100 + turn AS doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')) AS term FROM conversations), k AS (SELECT doc_id, term, count(*) AS k FROM w GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM k GROUP BY term HAVING count(*) >= 5),
x AS (SELECT doc_id, term, k * (ln((1 + (SELECT count(*) FROM conversations)) / (1 + df)::DOUBLE) + 1) AS w FROM k JOIN f USING (term)), t AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM x)"""


def _tfidf(s, d):
    c = table(s, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text")
    return text.tfidf(c, "text", min_df=5)


query("tfidf_terms", lambda s, d: text.tfidf_terms(_tfidf(s, d)), _TF + " SELECT term, sum(weight) AS total, count(*)::BIGINT AS df, avg(weight) AS mean FROM t GROUP BY term", "total mean")
query("cosine_search", lambda s, d: text.cosine_to(_tfidf(s, d), {"the": 1.0, "thing": 2.0}), _TF + " SELECT doc_id, sum(weight * CASE term WHEN 'the' THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END) / sqrt(5.0::DOUBLE) AS cosine FROM t WHERE term IN ('the', 'thing') GROUP BY doc_id", "cosine")


def _profiles(s, d):
    """Context profiles of one word in two halves of the conversations."""
    c = table(s, d, "conversations").select("conv_id", "text", (F.col("conv_id") % 2).alias("half"))
    return [text.context_profile(c.where(F.col("half") == h), "text", "tion", 3) for h in (0, 1)]


_PR = r"""WITH w AS (SELECT row_number() OVER () AS r, conv_id % 2 AS half, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}') AS w FROM conversations), p AS (SELECT r, half, unnest(w) AS term, generate_subscripts(w, 1) AS i FROM w),
n AS (SELECT a.half, b.term FROM p a JOIN p b ON a.r = b.r AND abs(a.i - b.i) <= 3 WHERE contains(a.term, 'tion') AND NOT contains(b.term, 'tion')), c AS (SELECT half, term, count(*)::BIGINT AS n FROM n GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY half)::DOUBLE AS share FROM c),
j AS (SELECT coalesce(a.term, b.term) AS term, coalesce(a.share, 0.0)::DOUBLE AS o, coalesce(b.share, 0.0)::DOUBLE AS n FROM (SELECT * FROM s WHERE half = 0) a FULL JOIN (SELECT * FROM s WHERE half = 1) b ON a.term = b.term)"""
query("context_profile", lambda s, d: _profiles(s, d)[0], _PR + " SELECT term, n, share FROM s WHERE half = 0", "share")
query("conceptual_drift", lambda s, d: text.drift(*_profiles(s, d)), _PR + " SELECT sqrt(greatest(0, sum(CASE WHEN o > 0 THEN o * log2(o / ((o + n) / 2)) ELSE 0 END + CASE WHEN n > 0 THEN n * log2(n / ((o + n) / 2)) ELSE 0 END) / 2)) AS jensen_shannon, 1 - sum(o * n) / sqrt(sum(o * o) * sum(n * n)) AS cosine, 1 - sum((o > 0 AND n > 0)::INT) / count(*)::DOUBLE AS jaccard FROM j", "jensen_shannon cosine jaccard")
query("emerging_terms", lambda s, d: text.emerging(*_profiles(s, d)), _PR + ", e AS (SELECT term, o AS old_share, n AS new_share, CASE WHEN o > 0 THEN n / o END AS ratio, CASE WHEN o = 0 THEN 'new' WHEN n = 0 THEN 'gone' WHEN n / o >= 2 THEN 'emerging' WHEN n / o <= 0.5 THEN 'fading' END AS status FROM j) SELECT * FROM e WHERE status IS NOT NULL", "old_share new_share ratio")
query("readability", lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.readability(F.col("text")).alias("r")).select("conv_id", "turn", "r.words", "r.syllables", "r.complex_share"), r"WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z]+') AS w FROM conversations), s AS (SELECT conv_id, turn, list_transform(w, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')))) AS s FROM w) SELECT conv_id, turn, len(s)::BIGINT AS words, coalesce(list_sum(s), 0)::BIGINT AS syllables, CASE WHEN len(s) > 0 THEN len(list_filter(s, lambda x: x >= 3)) / len(s)::DOUBLE END AS complex_share FROM s", "complex_share")


def _hits(words: list[str]) -> str:
    return "len(list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(lower(coalesce(text, '')), w)))::BIGINT"


_METHOD = rf"""WITH t AS (SELECT doc_id, {_hits(lexicons.PARADIGMS["quantitative"])} AS a, {_hits(lexicons.PARADIGMS["qualitative"])} AS b, {_hits(lexicons.PARADIGMS["mixed"])} AS c, {_hits(lexicons.DESIGNS)} AS designs, {_hits(lexicons.SOFTWARE)} AS software,
len(list_distinct(list_filter(list_transform(list_concat(regexp_extract_all(text, '(?i)\bn\s*=\s*(\d[\d,]*)', 1), regexp_extract_all(text, '(?i)\b(\d[\d,]*)\s+(?:participants|patients|respondents|subjects|students|samples|interviews)', 1)), lambda x: TRY_CAST(replace(x, ',', '') AS BIGINT)), lambda n: n BETWEEN 1 AND 1000000)))::BIGINT AS sizes FROM documents)
SELECT doc_id, CASE WHEN c > 0 THEN 'mixed' WHEN a > b THEN 'quantitative' WHEN b > a THEN 'qualitative' WHEN a > 0 THEN 'mixed' ELSE 'unclear' END AS paradigm, designs, software, sizes FROM t"""
query("methodology", lambda s, d: text.methodology(table(s, d, "documents"), "text", lexicons.PARADIGMS, lexicons.DESIGNS, lexicons.SOFTWARE).select("doc_id", "paradigm", F.size("designs").alias("designs"), F.size("software").alias("software"), F.size("sample_sizes").alias("sizes")), _METHOD)
_FLAGS = "SELECT doc_id, " + ", ".join(f"coalesce(regexp_matches(text, '(?i){p}'), false)::INT::BIGINT AS {k}" for k, p in lexicons.PRACTICES.items()) + " FROM documents"
query("open_science", lambda s, d: text.practices(table(s, d, "documents"), "text", lexicons.PRACTICES, ("request",)), f"SELECT *, (link + number + mail + license) / 4.0::DOUBLE AS score FROM ({_FLAGS})", "score")
query("methodology_summary", lambda s, d: text.methodology_summary(text.methodology(table(s, d, "documents"), "text", lexicons.PARADIGMS, lexicons.DESIGNS, lexicons.SOFTWARE)), f"""WITH m AS ({_METHOD}),
x AS (SELECT 'paradigm' AS kind, paradigm AS item FROM m UNION ALL SELECT 'designs', w FROM documents, (SELECT unnest({lexicons.DESIGNS}) AS w) WHERE contains(lower(coalesce(text, '')), w) UNION ALL SELECT 'software', w FROM documents, (SELECT unnest({lexicons.SOFTWARE}) AS w) WHERE contains(lower(coalesce(text, '')), w))
SELECT kind, item, count(*)::BIGINT AS documents, count(*) / (SELECT count(*) FROM documents)::DOUBLE AS share FROM x GROUP BY ALL""", "share")


def _among(words: list[str]) -> str:
    return "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in words) + ")))"


_SENTIMENT = rf"""WITH w AS (SELECT conv_id || '-' || turn AS doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Pc}}]{{2,}}') AS w FROM conversations), k AS (SELECT doc_id, len(w) AS n, {_among(lexicons.POSITIVE)} AS p, {_among(lexicons.NEGATIVE)} AS m, {_among(lexicons.HEDGES)} AS h FROM w),
s AS (SELECT doc_id, CASE WHEN p + m > 0 THEN (p - m) / (p + m)::DOUBLE ELSE 0.0 END AS polarity, CASE WHEN n > 0 THEN h / n::DOUBLE ELSE 0.0 END AS hedging FROM k)
SELECT *, CASE WHEN polarity > 0.1 THEN 'positive' WHEN polarity < -0.1 THEN 'negative' ELSE 'neutral' END AS tone FROM s"""


def _scores(s, d):
    rows = table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), "text")
    return text.sentiment(rows, "text", lexicons.POSITIVE, lexicons.NEGATIVE, lexicons.HEDGES)


_TONES = "count(*)::BIGINT AS documents, avg(polarity) AS polarity, avg(hedging) AS hedging, " + ", ".join(f"avg((tone = '{t}')::INT::DOUBLE) AS {t}" for t in ("positive", "negative", "neutral"))
query("sentiment", _scores, _SENTIMENT, "polarity hedging")
query("sentiment_corpus", lambda s, d: text.tone_summary(_scores(s, d)), f"SELECT {_TONES} FROM ({_SENTIMENT})", "polarity hedging positive negative neutral")
query("sentiment_groups", lambda s, d: text.tone_summary(_scores(s, d), table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("doc_id"), F.col("role").alias("group_name"))), f"SELECT role AS group_name, {_TONES} FROM ({_SENTIMENT}) x JOIN conversations c ON x.doc_id = c.conv_id || '-' || c.turn GROUP BY role", "polarity hedging positive negative neutral")
query("count_ngrams_conversations", lambda s, d: count_text(table(s, d, "conversations").select("text"), "text", 1, 1).select("item", "n_docs", "n_total"), r"WITH w AS (SELECT row_number() OVER () AS r, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}')) AS item FROM conversations) SELECT item, count(DISTINCT r)::BIGINT AS n_docs, count(*)::BIGINT AS n_total FROM w GROUP BY item")
query("repository_links", lambda s, d: table(s, d, "pages").select("page_id", F.size(strings.repository_links(F.col("html"))).alias("n_links")), r"SELECT page_id, len(list_distinct(list_transform(regexp_extract_all(html, '((?:https?://)?(?:www\.)?(?:github\.com|gitlab\.com|bitbucket\.org|zenodo\.org|figshare\.com|datadryad\.org|osf\.io|dataverse\.[a-z.]+|huggingface\.co|kaggle\.com)/[^\s)\]>" + '"' + r"'']+)', 1), lambda x: regexp_replace(x, '[.,;]+$', ''))))::BIGINT AS n_links FROM pages")
query("normal_titles", lambda s, d: table(s, d, "part").select("p_partkey", strings.normal_title(F.concat(F.col("p_name"), F.lit(", "), F.col("p_type"))).alias("title")), r"SELECT p_partkey, CASE WHEN length(trim(regexp_replace(regexp_replace(lower(p_name || ', ' || p_type), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))) >= 10 THEN trim(regexp_replace(regexp_replace(lower(p_name || ', ' || p_type), '[^\w\s]', '', 'g'), '\s+', ' ', 'g')) END AS title FROM part")
query("split_lists", lambda s, d: table(s, d, "part").select("p_partkey", F.size(as_list(F.concat_ws("; ", "p_name", "p_brand", "p_type"))).alias("n")), "SELECT p_partkey, len(list_filter(list_transform(string_split(concat_ws('; ', p_name, p_brand, p_type), ';'), lambda x: trim(x)), lambda x: x <> ''))::BIGINT AS n FROM part")
query("h_index_by_year", lambda s, d: h_indices(P(s, d, "base"), "year"), f"WITH {PUBS}, t AS (SELECT year, cited_by, row_number() OVER (PARTITION BY year ORDER BY cited_by DESC) AS i FROM pubs) SELECT year::BIGINT AS year, sum((cited_by >= i)::INT)::BIGINT AS h FROM t GROUP BY year")

# models -------------------------------------------------------------------------------------------------------------

query("topics", lambda s, d: models.topics(table(s, d, "documents"), "text", 4, rounds=5)[1])
query("cluster_texts", lambda s, d: models.cluster_texts(table(s, d, "documents"), "text", 4))
query("cluster_vectors", lambda s, d: models.cluster_vectors(table(s, d, "embeddings"), "embedding", [4, 8]))
query("principal_components", lambda s, d: models.components_of(table(s, d, "embeddings"), "embedding").select("vec_id", F.size("coordinates").alias("k")), "SELECT vec_id, 2::BIGINT AS k FROM embeddings")
query("classify_texts", lambda s, d: models.classify_texts(table(s, d, "documents").join(table(s, d, "labels").select("doc_id", "quality"), "doc_id", "left"), "text", "quality"))
query("predict_citations", lambda s, d: models.predict_citations(P(s, d, "authors").withColumn("n_authors", F.size(F.coalesce("authors", F.array()))), ["year", "n_authors", "price"]))
