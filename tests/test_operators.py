import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import distributions as dist
from folioscope.functions import strings
from folioscope.operators import cooccurrence, counting, diversity, graph, groups, impact, indices, lookup, quality, stats, text
from folioscope.operators import timeseries as ts
from folioscope.operators.longform import as_list, long, ranked


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_counts_of_repeats_and_nulls(spark):
    df = spark.createDataFrame([(1, ["a", "a", "b"]), (2, ["a"]), (3, None), (4, [])], "doc_id int, k array<string>")
    got = {r["item"]: r for r in rows(counting.count_list(df, "k"))}
    assert got["a"]["n_docs"] == 3 and got["a"]["fractional"] == pytest.approx(1.5) and got["a"]["proportion"] == 0.75 and got["a"]["rank"] == 1
    assert got["b"]["fractional"] == pytest.approx(0.5) and got["b"]["percent_rank"] == 0.0
    one = spark.createDataFrame([("x",), (" ",), (None,), ("x",)], "s string")
    assert rows(counting.count_single(one, "s")) == [{"item": "x", "n_docs": 2, "rank": 1, "proportion": 0.5, "percentage": 50.0, "percent_rank": 1.0}]
    assert rows(spark.createDataFrame([("a; ; b ;",), (None,)], "s string").select(as_list("s").alias("l"))) == [{"l": ["a", "b"]}, {"l": None}]


def test_text_counts(spark):
    df = spark.createDataFrame([("The cat the cat",), ("a dog",), (None,)], "t string")
    got = {r["item"]: (r["n_docs"], r["n_total"]) for r in rows(counting.count_text(df, "t", 1, 2))}
    assert got == {"the": (1, 2), "cat": (1, 2), "dog": (1, 1), "the cat": (1, 2), "cat the": (1, 1)}


def test_ranks(spark):
    rng = random.Random(1)
    data = [(f"i{k:03d}", rng.randrange(6)) for k in range(200)]
    got = {r["item"]: r["rank"] for r in rows(ranked(spark.createDataFrame(data, "item string, n int"), "n", "item"))}
    assert got == {item: i for i, (item, _) in enumerate(sorted(data, key=lambda x: (-x[1], x[0])), 1)}


def plain_indices(c):
    c = sorted(c, reverse=True)
    h = max([i for i, x in enumerate(c, 1) if x >= i], default=0)
    g = max([i for i in range(1, len(c) + 1) if sum(c[:i]) >= i * i], default=0)
    return h, g, sum(c[:h]) / h if h else 0


def test_indices(spark):
    rng = random.Random(2)
    data = [(f"a{k}", rng.randrange(30)) for k in range(12) for _ in range(rng.randrange(1, 25))] + [("zero", 0)]
    got = {r["item"]: r for r in rows(indices.citation_indices(spark.createDataFrame(data, "item string, cited_by int"), "item"))}
    for e in {x for x, _ in data}:
        h, g, a = plain_indices([c for x, c in data if x == e])
        r = got[e]
        assert (r["h"], r["g"]) == (h, g) and r["a"] == pytest.approx(a) and r["h"] <= r["n_docs"] and 0 <= r["gini"] < 1 and r["tapered_h"] == h


def test_fractional_index_of_equal_sums(spark):
    """5 x 1/5 and 6 x 1/6 are 2, which 2 citations allow, though their sum of doubles is greater."""
    data = [("a", 2, 2000, n) for n in [5] * 5 + [6] * 6 + [7]]
    got = rows(indices.citation_indices(spark.createDataFrame(data, "item string, cited_by int, year int, n int"), "item", year="year", authors="n", now=2002))
    assert got[0]["h_frac"] == pytest.approx(2)


def test_distributions():
    # values from printed tables
    assert dist.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and dist.chi2_sf(18.307038, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_sf2(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and dist.f_sf(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert dist.normal_sf2(1.959964) == pytest.approx(0.05, abs=1e-6) and dist.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857143, abs=1e-6)
    assert dist.beta_cdf(0.5, 2, 2) == pytest.approx(0.5)


def test_tests(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 5)] + [("b", float(x)) for x in (3, 4, 5, 6, 7)], "g string, v double")
    t = rows(stats.pairwise_t(df, "v", "g"))[0]
    assert t["t"] == pytest.approx(-2.0) and t["dof"] == 8 and t["cohens_d"] == pytest.approx(2 / math.sqrt(2.5))
    assert rows(stats.anova(df, "v", "g"))[0]["f"] == pytest.approx(4.0)
    u = rows(stats.mann_whitney(df, "v", "g", "a", "b"))[0]
    assert u["u"] == pytest.approx(4.5)
    two = spark.createDataFrame([("x", "p")] * 3 + [("x", "q")] + [("y", "p")] + [("y", "q")] * 3, "r string, c string")
    r = stats.chi_square_test(two, "r", "c")
    assert r["chi2"] == pytest.approx(2.0) and r["fisher_p"] == pytest.approx(0.4857143, abs=1e-6)
    b = rows(stats.bootstrap(df, "v", 200))[0]
    assert b["low"] < 4.0 < b["high"]


def test_diversity(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "item string, n int")
    r = rows(diversity.diversity(df))[0]
    assert r["shannon"] == pytest.approx(-(0.5 * math.log(0.25) + 0.5 * math.log(0.5))) and r["simpson"] == pytest.approx(0.625) and r["dominant"] == "c"
    one = rows(diversity.diversity(df.where("item = 'a'")))[0]
    assert one["shannon"] == 0 and one["evenness"] == 0 and one["gini"] == 0
    d = spark.createDataFrame([("a", "b", 1.0), ("a", "c", 0.5), ("b", "c", 0.5)], "a string, b string, d double")
    assert rows(diversity.rao_stirling(df, d))[0]["rao"] == pytest.approx(2 * (1 / 16 + 0.5 / 8 + 0.5 / 8))


def test_pairs(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a", "b", "c"]), (3, ["c"]), (4, None)], "doc_id int, k array<string>")
    assert {(r["a"], r["b"]): r["n"] for r in rows(cooccurrence.cooccurrence(df, "k"))} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert {(r["a"], r["b"]): r["n"] for r in rows(cooccurrence.coupling(df, "k"))} == {(1, 2): 2, (2, 3): 1}


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 4, 1), (10, 11, 1)] + [(100 + i, 101 + i, 1) for i in range(40)], "a long, b long, n long")
    comp = {r["node"]: r["component"] for r in rows(graph.components(e))}
    assert {comp[i] for i in (1, 2, 3, 4)} == {1} and comp[11] == 10 and {comp[i] for i in range(100, 141)} == {100}
    tri = {r["node"]: r for r in rows(graph.triangles(e))}
    assert tri[1]["triangles"] == 1 and tri[3]["clustering"] == pytest.approx(1 / 3) and tri[4]["triangles"] == 0
    d = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("x", "d")], "src string, dst string")
    spc = {(r["src"], r["dst"]): r["spc"] for r in rows(graph.traversal_weights(d))}
    assert spc[("d", "e")] == 3 and spc[("a", "b")] == 1
    assert [r["node"] for r in sorted(rows(graph.main_path(graph.traversal_weights(d))), key=lambda r: r["place"])] == ["a", "c", "d", "e"]
    assert sum(r["rank"] for r in rows(graph.pagerank(d, 10))) == pytest.approx(1)
    two = spark.createDataFrame([(a, b, 3) for g in (0, 10) for a in range(g, g + 4) for b in range(a + 1, g + 4)] + [(0, 10, 1)], "a long, b long, n long")
    c = {r["node"]: r["community"] for r in rows(graph.label_propagation(two))}
    assert len({c[i] for i in range(4)}) == 1 and len({c[i] for i in range(10, 14)}) == 1 and c[1] != c[11]


def test_disruption(spark):
    e = spark.createDataFrame([("f", "r"), ("i", "f"), ("j", "f"), ("j", "r"), ("k", "r")], "citing string, cited string")
    r = {x["doc_id"]: x for x in rows(impact.disruption(e))}["f"]
    assert (r["n_i"], r["n_j"], r["n_k"]) == (1, 1, 1) and r["cd"] == 0 and r["label"] == "neutral"


def test_trajectories(spark):
    h = spark.createDataFrame([(1, 2000, 2000 + k, n) for k, n in enumerate([0, 0, 0, 0, 0, 0, 9, 3])], "doc_id int, pub_year int, cite_year int, n int")
    r = rows(impact.trajectories(h, 2007).withColumn("label", impact.pattern(2007)))[0]
    assert r["total"] == 12 and r["years_to_peak"] == 6 and r["early_share"] == 0 and r["label"] == "sleeping beauty"
    b = rows(impact.beauty(h))[0]
    assert b["beauty"] > 15 and b["awakening"] == 5


def test_series(spark):
    df = spark.createDataFrame([(1, 2000), (2, 2000), (3, 2003), (4, None)], "doc_id int, year int")
    assert [(r["year"], r["count"], r["cumulative"]) for r in sorted(rows(ts.trend(df)), key=lambda r: r["year"])] == [(2000, 2, 2), (2001, 0, 2), (2002, 0, 2), (2003, 1, 3)]
    y = spark.createDataFrame([(k, k) for k in range(1, 8)], "year int, doc_id int")
    assert sorted((r["start"], r["stop"], r["doc_id"]) for r in rows(ts.windows(y, 3)) if r["doc_id"] in (3, 4, 7)) == [(1, 3, 3), (4, 6, 4), (7, 7, 7)]
    assert sorted(r["start"] for r in rows(ts.windows(y, 3, "sliding", 2)) if r["doc_id"] == 3) == [1, 3]
    k = rows(ts.mann_kendall(y.select("year", F.col("doc_id").cast("double").alias("value"))))[0]
    assert k["s"] == 21 and k["slope"] == 1 and k["tau"] == pytest.approx(1)
    s = spark.createDataFrame([(2000 + x, int(100 / (1 + math.exp(-0.5 * (x - 10))))) for x in range(21)], "year int, cumulative int")
    m = rows(ts.life_cycle(s))[0]
    assert m["saturation"] == pytest.approx(100, rel=0.05) and m["mid_year"] == pytest.approx(2010, abs=0.5) and m["phase"] == "saturation"
    b = spark.createDataFrame([(i, 2000 + i % 10, ["hot"] if i % 10 in (6, 7) else ["hot"] if i == 1 else ["cold"]) for i in range(400)], "doc_id int, year int, k array<string>")
    hot = [r for r in rows(ts.bursts(b, "k", 3.0)) if r["item"] == "hot"]
    assert [(r["start"], r["stop"]) for r in hot] == [(2006, 2007)]


def test_groups(spark):
    df = spark.createDataFrame([(1, ["x", "y"], 1.0), (2, ["x"], 3.0), (3, None, 5.0)], "doc_id int, g array<string>, v double")
    m = groups.membership(df, "g")
    assert {(r["a"], r["b"]): r["n"] for r in rows(groups.intersections(m))} == {("x", "x"): 2, ("y", "y"): 1, ("x", "y"): 1}
    r = {x["group_name"]: x for x in rows(groups.compare_continuous(df, m, "v"))}
    assert r["x"]["mean"] == 2 and r["x"]["rest_mean"] == 5 and r["y"]["rest_n"] == 2
    assert {(x["doc_id"], x["group_name"]) for x in rows(groups.by_concepts(spark.createDataFrame([(1, "Solar and wind"), (2, None)], "doc_id int, t string"), "t", {"s": "solar", "w": "WIND"}))} == {(1, "s"), (1, "w")}


def test_strings(spark):
    df = spark.createDataFrame([("https://doi.org/10.1/AB",), ("doi: 10.2/x",), ("http://x.y",), (None,)], "d string")
    assert [r[0] for r in df.select(strings.normal_doi(F.col("d"))).collect()] == ["10.1/ab", "10.2/x", None, None]
    one = spark.range(1)
    f = lambda c: one.select(c.alias("x")).first()["x"]
    assert f(strings.normal_title(F.lit("A Title:  with, marks!"))) == "a title with marks" and f(strings.normal_title(F.lit("Short"))) is None
    assert f(strings.short_author(F.lit("Doe, Jane Mary"))) == "Doe, J." and f(strings.author_parts(F.lit("Jane M. Doe"))).asDict() == {"last": "Doe", "first": "Jane M.", "initials": "JM"}
    assert f(strings.bigram_similarity(F.lit("night"), F.lit("nacht"))) == pytest.approx(1 / 7)
    assert f(strings.reference_dois(F.lit("A. doi 10.1000/Abc. B 10.1000/abc; C (10.2000/x)."))) == ["10.1000/abc", "10.2000/x"]
    r = f(strings.reference_parts(F.lit("Doe, J. (2001). A study of things. Journal, vol 12, pp. 3-9. doi:10.1000/z1.")))
    assert (r["year"], r["volume"], r["pages"], r["doi"]) == (2001, "12", "3-9", "10.1000/z1")
    assert f(strings.sample_sizes(F.lit("n = 1,200 and 30 patients; N=30"))) == [30, 1200]
    assert f(strings.ca_country(F.lit("Doe, J.; Univ X, Ljubljana, Slovenia; email: a@b.si"))) == "Slovenia" and f(strings.mail_domain(F.lit("x a@b.co.si y"))) == "si"
    assert f(strings.keywords(F.array(F.lit("Machine-Learning"), F.lit("machine_learning"), F.lit("AI!")), {"ai": "artificial intelligence"})) == ["artificial intelligence", "machine learning"]
    assert f(strings.clean_text(F.lit("The cats, of Rome!"), ["the"])) == "cats rome"


def test_quality(spark):
    a = spark.createDataFrame([(1, "10.1/a", "A title long enough", 3, ["x"]), (2, None, "Another title here", 1, ["y"])], "doc_id int, doi string, title string, cited_by int, keywords array<string>")
    b = spark.createDataFrame([(7, "10.1/a", "A Title Long Enough!", 9, ["z", "x"]), (8, None, "another title: here", 0, None), (9, None, "no", 2, [])], "doc_id int, doi string, title string, cited_by int, keywords array<string>")
    m = {r["doc_id"]: r for r in rows(quality.merge_sources({"s": a, "w": b}, ["w", "s"]))}
    assert set(m) == {7, 8, 9} and m[7]["cited_by"] == 9 and m[7]["keywords"] == ["x", "z"] and m[8]["sources"] == ["s", "w"] and m[9]["n_records"] == 1
    over = {(r["a"], r["b"]): r["n"] for r in rows(quality.source_overlap(quality.merge_sources({"s": a, "w": b}, ["w", "s"])))}
    assert over == {("s", "s"): 2, ("s", "w"): 2, ("w", "s"): 2, ("w", "w"): 3}
    names = spark.createDataFrame([("Doe, Jane", 5), ("Doe, J.", 2), ("Doe, Jim", 1), ("Roe, Rick", 1), ("Doe, Peter", 3)], "name string, n int")
    v = {r["name"]: r["canonical"] for r in rows(quality.author_variants(names))}
    assert v["Doe, J."] == "Doe, Jane" and v["Roe, Rick"] == "Roe, Rick" and v["Doe, Peter"] == "Doe, Peter"
    t = spark.createDataFrame([(1, 2000, "A study of many things in rivers"), (2, 2000, "A study of many things in river"), (3, 2001, "A study of many things in rivers")], "doc_id int, year int, title string")
    assert [(r["a"], r["b"]) for r in rows(quality.similar_titles(t))] == [(1, 2)]
    d = spark.createDataFrame([(1, "k", 1), (2, "k", 5), (3, None, 0)], "doc_id int, key string, cited_by int")
    for keep, want in (("first", {1, 3}), ("last", {2, 3}), ("most_cited", {2, 3})):
        assert {r["doc_id"] for r in rows(quality.remove_duplicates(d, F.col("key"), keep))} == want


@pytest.mark.parametrize(
    "query,hits",
    [("solar", {1, 2}), ("solar AND wind", {1}), ("wind OR {heat pump}", {1, 3}), ("(solar OR heat) AND pump*", {3}), ("sol*", {1, 2}), ("SOLAR wind", {1}), ("heat OR solar AND wind", {1, 3})],
)
def test_queries(spark, query, hits):
    df = spark.createDataFrame([(1, "Solar and wind power"), (2, "The solar system"), (3, "A heat pump; heat pumps"), (4, None)], "doc_id int, t string")
    assert {r["doc_id"] for r in df.where(text.query_column(query, F.col("t"))).collect()} == hits


def test_broken_queries():
    for q in ("(a OR b", "a AND", "", "a)"):
        with pytest.raises(ValueError):
            text.parse_query(q)


def test_texts(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "term string, share double")
    assert rows(text.drift(a, a))[0] == {"jensen_shannon": 0.0, "cosine": pytest.approx(0, abs=1e-12), "jaccard": 0.0}
    b = spark.createDataFrame([("z", 1.0)], "term string, share double")
    assert rows(text.drift(a, b))[0]["jensen_shannon"] == pytest.approx(1) and {r["status"] for r in rows(text.emerging(a, b))} == {"new", "gone"}
    r = spark.range(1).select(text.readability(F.lit("The cat sat. A beautiful elephant ran!")).alias("r")).first()["r"]
    assert (r["sentences"], r["words"], r["syllables"]) == (2, 7, 5 + 3 + 3 - 0) or r["words"] == 7
    df = spark.createDataFrame([(1, "We ran a regression survey with SPSS, n = 40."), (2, "Interviews and focus groups"), (3, None)], "doc_id int, t string")
    m = {x["doc_id"]: x for x in rows(text.methodology(df, "t", {"quantitative": ["regression"], "qualitative": ["interview"], "mixed": ["both ways"]}, ["panel"], ["spss"]))}
    assert m[1]["paradigm"] == "quantitative" and m[1]["sample_sizes"] == [40] and m[2]["paradigm"] == "qualitative" and m[3]["paradigm"] == "unclear"


def test_lookup(spark):
    c = spark.createDataFrame([("A", 10), ("b", 5), ("c", 1)], "country string, n int")
    ref = spark.createDataFrame([("a", 2e6), ("B", 0.0)], "country string, people double")
    assert {r["country"]: r["rate"] for r in rows(lookup.per_reference(c.withColumnRenamed("country", "k"), ref.withColumnRenamed("country", "k"), "k", "people").withColumnRenamed("k", "country"))} == {"A": 5.0, "b": None, "c": None}
    df = spark.createDataFrame([(1, ["b", "a", "c"]), (2, ["a"])], "doc_id int, l array<string>")
    m = spark.createDataFrame([("b", "c")], "variant string, canonical string")
    assert {r["doc_id"]: r["l"] for r in rows(lookup.mapped(df, "l", m))} == {1: ["c", "a"], 2: ["a"]}
    h = spark.createDataFrame([('{"2001": 3, "2002": 1}', "2001|2002", "3|1")], "j string, y string, n string")
    r = h.select(lookup.history(F.col("j")).alias("a"), lookup.history(F.col("y"), F.col("n")).alias("b")).first()
    assert r["a"] == r["b"] == {2001: 3, 2002: 1}
    d = spark.createDataFrame([(1, ["p", "q"]), (2, ["p"])], "doc_id int, refs array<string>")
    det = spark.createDataFrame([("p", "S", "F1", 1990), ("q", "T", "F1", 2000)], "ref string, source string, field string, year int")
    got = {x["doc_id"]: x for x in rows(lookup.reference_diversity(d, "refs", det, 2001))}
    assert got[1]["source_entropy"] == pytest.approx(1) and got[1]["field_entropy"] == 0 and got[1]["mean_age"] == 6 and got[2]["references"] == 1


def test_long(spark):
    df = spark.createDataFrame([(1, "a; b; a")], "doc_id int, s string")
    assert [r["item"] for r in rows(long(df, "s"))] == ["a", "b"] and len(rows(long(df, "s", distinct=False))) == 3


def test_communities(spark):
    from folioscope.operators import communities

    edges = [(a, b, 1.0) for g in (0, 10, 20) for a in range(g, g + 5) for b in range(a + 1, g + 5)] + [(0, 10, 1.0), (10, 20, 1.0)]
    c = communities.louvain(edges)
    assert len(set(c.values())) == 3 and all(len({c[i] for i in range(g, g + 5)}) == 1 for g in (0, 10, 20))
    assert communities.louvain([]) == {}
    old = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b"), (5, "b"), (8, "x")], "node int, community string")
    new = spark.createDataFrame([(1, "A"), (2, "A"), (3, "A"), (6, "A"), (7, "A"), (4, "B"), (5, "B"), (9, "N")], "node int, community string")
    got = {(r["old"], r["new"]): r["event"] for r in rows(communities.evolution(old, new))}
    assert got == {("a", "A"): "growth", ("b", "B"): "stable", ("x", None): "death", (None, "N"): "birth"}
    w = spark.createDataFrame([("a", "b", 4.0), ("b", "d", 4.0), ("a", "c", 1.0), ("d", "e", 3.0)], "src string, dst string, spc double")
    from folioscope.operators import network

    assert rows(network.key_routes(w).orderBy("place"))[0]["route"] == ["a", "b", "d", "e"]


def test_evaluation(spark):
    from folioscope.operators import evaluation

    cells = spark.createDataFrame([("r1", "c1", 10), ("r1", "c2", 1), ("r2", "c1", 1), ("r2", "c2", 10), ("r3", "c1", 5), ("r3", "c2", 6)], "a string, b string, n int")
    ca = {r["item"]: r["coordinates"][0] for r in rows(evaluation.correspondence(cells, "a", "b"))}
    assert ca["r1"] * ca["r2"] < 0 and ca["r1"] * ca["c1"] > 0 and abs(ca["r3"]) < abs(ca["r1"])
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(["good", "fine"] if i % 2 else ["poor", "sad"]) for _ in range(8)), i % 2) for i in range(120)], "doc_id int, t string, y int")
    cv = rows(evaluation.cross_validate(docs, "t", "y", 3, 50))
    assert sum(r["n"] for r in cv) == 120 and all(r["accuracy"] > 0.95 for r in cv)
    x = spark.createDataFrame([(float(v),) for v in range(200)], "v double")
    assert 0.04 < rows(stats.ks_normal(x, "v"))[0]["distance"] < 0.08


def test_match_references(spark):
    df = spark.createDataFrame([(1, "10.1000/A", "x doi:10.1000/b; y 10.9999/none"), (2, "https://doi.org/10.1000/b", "10.1000/a, 10.1000/b"), (3, None, None)], "doc_id int, doi string, references string")
    e = impact.match_references(df)
    assert {tuple(r) for r in e.collect()} == {(1, 2), (2, 1)}
    assert rows(impact.internal_rate(df, e)) == [{"documents": 3, "edges": 2, "linked": 2, "rate": pytest.approx(2 / 3)}]


def test_paths_and_splits(spark):
    from folioscope.operators import communities

    w = spark.createDataFrame([("a", "b", 2.0), ("a", "c", 3.0), ("b", "d", 9.0), ("c", "e", 1.0), ("d", "f", 4.0)], "src string, dst string, spc double")
    assert [r["node"] for r in rows(graph.greedy_path(w).orderBy("place"))] == ["a", "c", "e"]
    assert [r["node"] for r in rows(graph.greedy_path(w, forward=False).orderBy("place"))] == ["a", "b", "d", "f"]
    old = spark.createDataFrame([(i, "a") for i in range(6)], "node int, community string")
    new = spark.createDataFrame([(i, "x" if i < 3 else "y") for i in range(6)], "node int, community string")
    assert rows(communities.splits(old, new)) == [{"old": "a", "parts": ["x", "y"]}]


def test_shapes(spark):
    rng = random.Random(9)
    g = spark.createDataFrame([(rng.gammavariate(3.0, 2.0),) for _ in range(4000)], "v double")
    p = {r["family"]: r for r in rows(stats.fit_shapes(g, "v"))}
    assert p["gamma"]["parameters"][0] == pytest.approx(3, rel=0.1) and p["gamma"]["parameters"][1] == pytest.approx(2, rel=0.1) and p["gamma"]["aic"] < p["weibull"]["aic"]
    w = spark.createDataFrame([(rng.weibullvariate(5.0, 0.8),) for _ in range(4000)], "v double")
    p = {r["family"]: r for r in rows(stats.fit_shapes(w, "v"))}
    assert p["weibull"]["parameters"][0] == pytest.approx(0.8, rel=0.1) and p["weibull"]["parameters"][1] == pytest.approx(5, rel=0.1)


def test_topics_over_time(spark):
    from folioscope.operators import models

    rng = random.Random(2)
    themes = [["alpha", "beta", "gamma"], ["river", "stone", "water"]]
    df = spark.createDataFrame([(i, 2000 + i % 4, " ".join(rng.choice(themes[i % 2 if i % 3 else 0]) for _ in range(20))) for i in range(120)], "doc_id int, year int, t string")
    t = models.sequential_topics(df, "t", 2, 2, 50, 10)
    assert {r["start"] for r in t.select("start").distinct().collect()} == {2000, 2002}
    a = rows(models.aligned_topics(t))
    assert a and all(r["next"] == 2002 and 0.3 <= r["cosine"] <= 1.0001 for r in a)
    m = df.select("doc_id", F.lit("g").alias("group_name"))
    one = models.semantic_dispersion(text.tfidf(df.where("doc_id = 0"), "t"), m.where("doc_id = 0"))
    assert rows(one)[0]["dispersion"] == pytest.approx(0, abs=1e-9)


def test_normality(spark):
    w, p = dist.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.005) and p == pytest.approx(0.0067, abs=0.0006)
    rng = random.Random(3)
    good = spark.createDataFrame([(rng.gauss(0, 1),) for _ in range(500)], "v double")
    bad = spark.createDataFrame([(rng.expovariate(1),) for _ in range(500)], "v double")
    assert stats.normality(good, "v")["p"] > 0.01 and stats.normality(bad, "v")["p"] < 1e-6
    many = spark.range(6000).select(F.col("id").cast("double").alias("v"))
    assert stats.normality(many, "v")["test"] == "kolmogorov-smirnov" and stats.normality(many, "v")["p"] < 1e-6
    with pytest.raises(ValueError):
        dist.shapiro_wilk([1.0, 1.0, 1.0, 1.0])


def test_long_chains(spark):
    from folioscope.operators import network

    n = 202
    d = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(0, 2)], "src long, dst long").coalesce(1).cache()
    assert {r["node"]: r["paths"] for r in rows(graph.path_counts(d))} == {i: 1.0 if i < 2 else 2.0 for i in range(n + 1)}
    assert [r["route"] for r in rows(network.key_routes(d.withColumn("spc", F.lit(1.0))).orderBy("place"))] == [list(range(n + 1)), [0, *range(2, n + 1)]]
    long = spark.createDataFrame([(i, i + 1, 1.0) for i in range(502)], "src long, dst long, spc double").coalesce(1)
    assert [r["node"] for r in rows(graph.greedy_path(long).orderBy("place"))] == list(range(503))


def test_cycles(spark):
    from folioscope.operators import network

    loop = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 1, 1.0), (2, 3, 0.5)], "src long, dst long, spc double").coalesce(1)
    for f in (graph.path_counts, graph.main_path, graph.greedy_path, network.key_routes):
        with pytest.raises(ValueError, match="cycle"):
            f(loop)
