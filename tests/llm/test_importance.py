import hashlib
import math
import random
import re
import zlib
from collections import Counter

from folioscope.llm import importance
from folioscope.llm.importance import Draw
from tests.llm.conftest import prose


def parts(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in words + [" ".join(x) for x in zip(words, words[1:], strict=False)]]


def plain(rows, targets, draw=Draw()):
    """(id, n_features, weight, score, rank) of all rows by the definition."""
    made = [(i, *parts(t)) for i, t in rows]
    s, t = Counter(b for *_, f in made for b in f), Counter(b for x in targets for b in parts(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, n_words, f in made:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{draw.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words))
    order = sorted((r for r in out if r[4] >= draw.min_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[2]))
    drawn = order[: draw.percent * len(order) // 100]
    return Counter([(*r[:4], k + 1) for k, r in enumerate(drawn)] + [(*r[:4], None) for r in order[len(drawn) :]] + [(*r[:4], None) for r in out if r[4] < draw.min_words])


def texts():
    rng = random.Random(3)
    return [(i, prose(rng, 10 + i % 60) + (" Grüße, O'Neil 42x" if i % 3 == 0 else "")) for i in range(300)], [prose(rng, 40, ["river", "stone", "green"]) for _ in range(5)] + [None, ""]


def test_equals_plain(spark):
    rows, targets = texts()
    rows += [(7, rows[7][1]), (8, "something else " * 20), (None, rows[3][1]), (None, rows[3][1]), (None, None)]
    target = spark.createDataFrame([(x,) for x in targets], "body string")
    for n in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        assert Counter(map(tuple, importance.resample(df, target, target_col="body").collect())) == plain(rows, targets)
    draw = Draw(percent=60, min_words=30, seed=11)
    assert Counter(map(tuple, importance.resample(df, target, target_col="body", draw=draw).collect())) == plain(rows, targets, draw)


def test_drawn_rows(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, 40, ["river", "stone", "green"] if i % 4 == 0 else None)) for i in range(400)]
    targets = [prose(rng, 40, ["river", "stone", "green"]) for _ in range(20)]
    df = spark.createDataFrame([(i, t, i % 5) for i, t in rows], "doc_id long, text string, __score int").repartition(3)
    got = importance.drawn(df, spark.createDataFrame([(x,) for x in targets], "text string"))
    want = {r[0] for r in plain(rows, targets) if r[4]}
    assert got.columns == df.columns and sorted(r["doc_id"] for r in got.collect()) == sorted(want) and len(want) == 100
    assert sum(i % 4 == 0 for i in want) > 45  # 25 of them without weights


def test_ties_at_the_cut(spark):
    """Copies of one id have one score: as many are drawn as there is room for."""
    df = spark.createDataFrame([(1, "some words " * 15)] * 40, "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("words",)], "text string")
    ranks = [r["rank"] for r in importance.resample(df, target).collect()]
    assert sorted(x for x in ranks if x) == list(range(1, 11)) and ranks.count(None) == 30
    assert importance.drawn(df, target).count() == 10


def test_odd_and_empty(spark, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = importance.resample(odd, odd)
    assert Counter(map(tuple, got.collect())) == plain(rows, [t for _, t in rows])
    assert importance.drawn(odd, odd).columns == odd.columns
    assert importance.resample(empty, odd).collect() == [] and importance.drawn(empty, empty).collect() == []
    assert Counter(map(tuple, importance.resample(odd, empty).collect())) == plain(rows, [])


def test_plan(spark, sf):
    """A document's features are made and summed inside its row."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = importance.scores(docs, [1] * 10_000, "doc_id", "text", Draw())._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
