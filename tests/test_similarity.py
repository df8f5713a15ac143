"""Similar strings against all pairs, references against plain versions."""

import random

import pytest

from folioscope.operators import references, similarity


def plain_indel(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b, 1):
            row[j] = before[j - 1] + 1 if x == y else max(before[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b))


def plain_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
    return 1 - row[-1] / max(len(a), len(b))


PLAIN = {"indel": plain_indel, "levenshtein": plain_levenshtein}


def some_texts(seed, n=120):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcd é日") for _ in range(rng.randint(1, 24))) for _ in range(n // 6)]
    out = []
    while len(out) < n:
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(t))
            t[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "xy"])
        out.append("".join(t))
    return out


def all_pairs(rows, threshold, measure):
    rows = [(k, g, t) for k, g, t in rows if t and g is not None]
    least = {}
    for k, g, t in rows:
        least[g, t] = min(k, least.get((g, t), k))
    want = {(least[g, t], k): 1.0 for k, g, t in rows if least[g, t] != k}
    for (g, t), k in least.items():
        for (h, u), m in least.items():
            if g == h and k < m and PLAIN[measure](t, u) >= threshold - 1e-9:
                want[k, m] = PLAIN[measure](t, u)
    return want


@pytest.mark.parametrize("measure,threshold", [("indel", 0.7), ("indel", 0.85), ("indel", 1.0), ("levenshtein", 0.55), ("levenshtein", 0.8)])
def test_pairs_are_all_pairs(spark, measure, threshold):
    rows = [(i, i % 2, t) for i, t in enumerate(some_texts(7))] + [(900, 0, None), (901, 0, ""), (902, None, "abcd"), (903, 1, "")]
    got = similarity.ratio_pairs(spark.createDataFrame(rows, "k int, g int, t string"), "k", "t", threshold, ["g"], measure).collect()
    want = all_pairs(rows, threshold, measure)
    assert len(got) == len(want) and {(r.a, r.b): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}


def test_pairs_of_tables(spark, sf):
    """All pairs of the whole tables of nations, suppliers, customers and parts."""
    from pyspark.sql import functions as F

    texts = {"nation": ("n_nationkey", "n_name", 0.7), "supplier": ("s_suppkey", "s_name", 0.9), "customer": ("c_custkey", "c_name", 0.95), "part": ("p_partkey", "concat_ws(' ', p_name, p_brand)", 0.85)}
    for name, (key, text, threshold) in texts.items():
        t = spark.read.parquet(f"{sf}/{name}.parquet").select(F.col(key).alias("k"), F.lit(1).alias("g"), F.expr(text).alias("t"))
        rows = [tuple(r) for r in t.collect()]
        got = {(r.a, r.b): round(r.similarity, 9) for r in similarity.ratio_pairs(t, "k", "t", threshold).collect()}
        assert got == {k: round(v, 9) for k, v in all_pairs(rows, threshold, "indel").items()}, name


@pytest.mark.parametrize("measure", ["indel", "levenshtein"])
def test_matches_are_all_matches(spark, measure):
    left, right = list(enumerate(some_texts(3, 80))), list(enumerate(some_texts(3, 60)[::-1]))
    frames = [spark.createDataFrame(x + [(999, None)], "k int, t string") for x in (left, right)]
    got = similarity.ratio_matches(*frames, "k", "t", 0.8, None, measure).collect()
    least = {}
    for k, t in right:
        if t:
            least[t] = min(k, least.get(t, k))
    want = {(k, m): round(PLAIN[measure](t, u), 9) for k, t in left if t for u, m in least.items() if PLAIN[measure](t, u) >= 0.8 - 1e-9}
    assert len(got) == len(want) and {(r.a, r.b): round(r.similarity, 9) for r in got} == want


def test_bounds_are_refused(spark):
    df = spark.createDataFrame([(1, "a")], "k int, t string")
    for threshold, measure in ((0.66, "indel"), (0.5, "levenshtein"), (1.1, "indel"), (0.9, "jaro")):
        with pytest.raises(ValueError):
            similarity.ratio_pairs(df, "k", "t", threshold, None, measure)
    assert similarity.ratio_pairs(df.limit(0), "k", "t", 0.9).count() == 0


def test_own_references(spark):
    docs = [
        (1, "Müller, Karl; Novak, Ana", "Muller K. (2001). One. J; Novák, A., 1999. Two. J; Smith, J. (2000). Three. J"),
        (2, "Novak, Ana", "Nowak Ana and Novak, B. (2003). Four. J; 2004"),
        (3, None, "Novak A. (2003). Five. J"),
        (4, "Novak, Ana", None),
        (5, "Novak, Anja; Li, Po", "Novak Anya & Novák Anja (2003). Six. J"),
    ]
    got = {r.doc_id: (r.n_refs, r.n_self, r.n_self_refs, r.rate, r.self_authors) for r in references.own_references(spark.createDataFrame(docs, "doc_id int, authors string, references string")).collect()}
    assert got[1] == (3, 0, 0, 0.0, [])  # "muller k" and "muller karl" have 2 * 8 of 19 letters, 0.84
    assert got[2] == (2, 1, 1, 50.0, ["Novak, Ana"])  # last words and first letters are equal
    assert got[3] == (1, 0, 0, 0.0, []) and got[4] == (0, 0, 0, 0.0, [])
    assert got[5] == (1, 2, 1, 200.0, ["Novak, Anja"])  # one by ratio only, one by both


@pytest.mark.parametrize("measure", ["indel", "levenshtein"])
def test_own_references_in_rows_and_by_joins(spark, monkeypatch, measure):
    """Documents done in their rows, by joins, and some by each: the same rows; in rows nothing is joined or shuffled."""
    rng = random.Random(8)
    names = ["Müller, Karl", "Muller K", "Novák, Ana", "Nowak Ana", "Li, Po", "ΣΑΣ Σ", "Øre-Sund, P", "Smith, John", "Smyth, John", "", " "]
    docs = [(i, "; ".join(rng.choices(names, k=rng.randrange(5))), "; ".join(f"{rng.choice(names)} & {rng.choice(names).lower()} (2001). T{i}. J" for _ in range(rng.randrange(5)))) for i in range(60)] + [(90, None, None), (91, "Li, Po", None), (92, None, "Li Po. 2001")]
    df = spark.createDataFrame(docs, "doc_id int, authors string, references string")
    got = {}
    for most in (0, 5, 5000):
        monkeypatch.setattr(references, "IN_ROW", most, raising=False)
        out = references.own_references(df, measure=measure)
        got[most] = sorted(map(tuple, out.collect()))
    assert got[0] == got[5] == got[5000] and len(got[0]) == len(docs) and sum(r[2] > 0 for r in got[0]) > 10
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_linked_references(spark):
    docs = [
        (1, 2000, "Spark plans for citation graphs", None),
        (2, 2001, "Spark plans for citation graphs", ["Doe, J. (2000). Spark plans for citation graphs. J", "Doe, J. (2000). Spark plan for citation graph. K", "Doe (2000). Short. J"]),
        (3, 2005, "Another title altogether", ["Roe (2005). Another title altogether. J", "Roe (2001). Spark plans of citation graphs. J", None]),
        (4, None, None, []),
    ]
    df = spark.createDataFrame(docs, "doc_id int, year int, title string, references array<string>")
    got = {(r.citing, r.cited): round(r.similarity, 6) for r in references.linked_references(df).collect()}
    assert got == {(2, 1): 1.0, (3, 1): round(plain_indel("spark plans of citation graphs", "spark plans for citation graphs"), 6)}
    near = {(r.citing, r.cited) for r in references.linked_references(df, years=0).collect()}
    assert near == {(2, 1), (3, 2)}


def test_references_are_taken_apart_once(spark, monkeypatch):
    """A reference of many documents is taken apart once (twice, if a plan's parts don't share it), and a document that it means cites the next best one."""
    from pyspark.sql import functions as F

    taken = spark.sparkContext.accumulator(0)

    def count(x):
        taken.add(1)
        return x

    whole = references.reference_parts
    monkeypatch.setattr(references, "reference_parts", lambda c: whole(F.udf(count)(c)))
    refs = ["Doe, J. (2000). Spark plans for citation graphs. J", "Roe (2005). Another title altogether. J"]
    docs = [(i, 2000, ("Spark plans for citation graphs", "Spark plans of citation graphs", "Another title altogether")[i] if i < 3 else None, refs) for i in range(200)]
    got = {(r.citing, r.cited) for r in references.linked_references(spark.createDataFrame(docs, "doc_id int, year int, title string, references array<string>")).collect()}
    assert got == {(i, 0) for i in range(1, 200)} | {(i, 2) for i in range(200) if i != 2} | {(0, 1)}
    assert taken.value <= 40


@pytest.mark.parametrize("size", [2, 3, 4])
def test_combination_gaps(spark, size):
    """Against all sets of a small corpus, with and without a prior, sets never seen among them."""
    from itertools import combinations

    from folioscope.operators.cooccurrence import combination_gaps

    rng = random.Random(5)
    docs = [(i, sorted(rng.sample("abcde", rng.randint(1, 3))) + (["z"] if i % 3 == 0 else [])) for i in range(60)]
    docs = [(i, [x for x in items if not ("a" in items and x == "b")]) for i, items in docs] + [(90, None), (91, [])]
    df = spark.createDataFrame(docs, "doc_id int, keywords array<string>")
    k = {x: sum(x in (items or []) for _, items in docs) for x in "abcdez"}
    prior = spark.createDataFrame([("a", "b", 1.5), ("c", "z", 0.0)], "a string, b string, prior double")
    for frame, known in ((None, {}), (prior, {("a", "b"): 1.5, ("c", "z"): 0.0})):
        want = {}
        for m in range(2, size + 1):
            for s in combinations(sorted(k), m):
                p = [known.get(x, 0.3) for x in combinations(s, 2)]
                e = len(docs) * (1 + sum(p) / len(p))
                for x in s:
                    e *= k[x] / len(docs)
                n = sum(set(s) <= set(items or []) for _, items in docs)
                if e >= 2 and e / max(n, 1) >= 1.2:
                    want[s] = (n, round(e, 6))
        got = {tuple(r["items"]): (r.n, round(r.expected, 6)) for r in combination_gaps(df, "keywords", size, 2.0, 1.2, prior=frame).collect()}
        assert got == want and any(n == 0 for n, _ in want.values())
