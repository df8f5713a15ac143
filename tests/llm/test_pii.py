import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    """The patterns as they are written."""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return [(s, e, pii.KINDS[k]) for s, k, e in sorted(out)]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("ab0129.@+-_% ()\n,é日"), max_size=40))
def test_seeds(text):
    assert pii.seeds(text) == plain(text)


def test_seeds_random():
    rng = random.Random(4)
    bits = ["a@b.co", "1.2.3.4", "255.256.1.1", "4111 1111 1111 1111", "4465758382889437", "+1 (743) 555-3824", " ", "x", ".", "@", "-", "+", "0", "\n", "a.b_c@d-e.f.g_h@i.jj", "1.2.3.4.5.6.7.8.9"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert pii.seeds(t) == plain(t), t


def test_long_texts_are_fast():
    for t in ("a" * 400_000, "a" * 400_000 + "@", "1" * 400_000, "1." * 200_000, "+" + " " * 300_000, "@" * 300_000, "a@" * 150_000, "9 " * 150_000):
        pii.scan_text(t)


def plain_contexts(text, start):
    words = [w if len(w) <= 64 else "~" + hashlib.blake2b(w.encode(), digest_size=16).hexdigest() for w in re.findall(r"\S+", re.sub("[0-9]", "0", text[:start]).lower())]
    return [" ".join(words[-n:]) for n in (1, 2) if len(words) >= n]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab0 \n,É"), max_size=30), st.integers(1, 40))
def test_contexts(text, times):
    text = " ".join([text, text * times])
    places = sorted({0, len(text), *range(0, len(text) + 1, 3)})
    assert pii.contexts(text, places) == {p: plain_contexts(text, p) for p in places}


def plain_patterns(edges, how):
    """The rounds with dictionaries: (kind, context) -> confidence, support, accepted."""
    link, other, seed = {}, Counter(), set()
    for context, kind, instance, is_seed, n in edges:
        link.setdefault((kind, context), set()).add(instance)
        other[kind, context] += n
        if is_seed:
            seed.add((kind, instance))
    names = {(k, i) for (k, _), v in link.items() for i in v}
    score, known = {x: float(x in seed) for x in names}, set(seed)
    for left in range(how.rounds, 0, -1):
        out = {}
        for (k, c), v in link.items():
            confidence = sum(score[k, i] for i in v) / (len(v) + other[k, c])
            support = sum((k, i) in known for i in v)
            out[k, c] = confidence, support, confidence >= how.confidence and support >= how.support
        if left > 1:
            score, known = {}, set(seed)
            for k, i in names:
                mine = [out[k2, c] for (k2, c), v in link.items() if k2 == k and i in v]
                found = any(x[2] for x in mine)
                score[k, i] = 1.0 if (k, i) in seed else how.decay * max(x[0] for x in mine if x[2]) if found else sum(x[0] for x in mine) / len(mine)
                if found:
                    known.add((k, i))
    return out


def test_score_patterns(spark):
    rng = random.Random(12)
    how = pii.Bootstrap()
    edges = [(f"c{rng.randrange(12)}", rng.choice(["ip", "phone"]), f"i{rng.randrange(30)}", False, 0) for _ in range(300)]
    edges = [(c, k, i, int(i[1:]) < 14 and int(c[1:]) < 8, rng.choice([0, 0, 0, 1])) for c, k, i, _, _ in edges]
    edges += [("x", "ip", f"s{j}", True, 0) for j in range(9)] + [("x", "ip", "f0", False, 0), ("y", "ip", "f0", False, 0)]
    got = {(r["kind"], r["context"]): (r["confidence"], r["support"], r["accepted"]) for r in pii.score_patterns(spark.createDataFrame(edges, "context string, kind string, instance string, seed boolean, other int"), how).collect()}
    want = plain_patterns(edges, how)
    assert got.keys() == want.keys() and any(x[2] for x in want.values())
    for k, (confidence, support, accepted) in want.items():
        assert abs(got[k][0] - confidence) < 1e-9 and got[k][1:] == (support, accepted), k


def test_found_instances_support_patterns(spark):
    """'phone no' has seeds; what it finds stands after 'ring me', too, which no seed does: that finds more in the next round."""
    rows = [(100 + i, f"phone no +1 (20{i % 10}) 555-01{i:02d} end") for i in range(40)]
    rows += [(30 + i, f"phone no 0664 123 45 6{i} today") for i in range(5)] + [(40 + i, f"please ring me 0664 123 45 6{i} now") for i in range(5)]
    rows += [(50, "ring me 0699 888 77 66 or so"), (51, "plain 0699 111 22 33 here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = spans(pii.extract(df).collect())
    assert [x["kind"] for x in got[50][1]] == ["phone"] and got[51] == ([], [])
    only = spans(pii.extract(df, how=pii.Bootstrap(rounds=1)).collect())
    assert only[50] == ([], []) and only[32][1]


def spans(rows):
    return {r["doc_id"]: (r["seeds"], r["found"]) for r in rows}


def test_bootstrapping(spark):
    """'phone no' is followed by known numbers often enough; what stands there in an unknown form is found. Words after 'the' are not."""
    rows = [(i, f"text {i} before, phone no +1 (20{i % 10}) 555-01{i:02d} and the {i} end the cat the dog the cow the hen.") for i in range(20)]
    rows += [(100, "see phone no 0664 123 45 67 today"), (101, "the 5551234567 thing and the cat"), (102, "phone no later"), (103, "mail ann(at)example.org")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = spans(pii.extract(df).collect())
    assert [(x["s"], x["e"], x["kind"]) for x in got[100][1]] == [(13, 27, "phone")]
    assert got[101] == ([], []) and got[102] == ([], []) and got[103] == ([], [])
    assert all(len(got[i][0]) == 1 and not got[i][1] for i in range(20))
    out = {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}
    assert out[100] == "see phone no [PHONE] today" and "[PHONE]" in out[3] and out[101] == rows[21][1]


def test_odd_rows(odd, empty):
    got = pii.extract(odd).collect()
    assert len(got) == odd.count() and not any(r["seeds"] or r["found"] for r in got)
    out = pii.mask(odd)
    assert out.columns == odd.columns and sorted(map(str, out.collect())) == sorted(map(str, odd.collect()))
    assert pii.extract(empty).collect() == [] and pii.mask(empty).collect() == []


def test_digest(spark):
    t = "é a.b@c.de 1.2.3.4 4111 1111 1111 1111, +1 (743) 555-3824"
    df = spark.createDataFrame([(1, t)], "doc_id long, text string")
    r = pii.extract(df).select(pii.span_text(pii.F.col("seeds")).alias("s"), pii.F.sha2(pii.span_text(pii.F.col("seeds")), 256).alias("h")).first()
    want = ",".join(f"{k}:{s}:{e}" for s, e, k in plain(t))
    assert r["s"] == want and r["h"] == hashlib.sha256(want.encode()).hexdigest()


def test_masked_text():
    assert pii.masked_text("abcdefgh", [(1, 3, "ip"), (2, 5, "phone"), (6, 7, "card")]) == "a[IP]f[CARD]h"
    assert pii.masked_text(None, [(0, 1, "ip")]) is None and pii.masked_text("x", []) == "x"
