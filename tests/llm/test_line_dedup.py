import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from folioscope.llm import line_dedup
from folioscope.llm.line_dedup import Rule
from tests.llm.conftest import prose


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))


def plain(rows, rule=Rule()):
    """(id, n_lines, n_dropped, kept text) of all rows by the definition."""
    docs = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            docs[key_of(line)].add(i)
    order = lambda i: (i is not None, i or 0)
    last = {k: max(d, key=order) for k, d in docs.items() if len(k) >= rule.min_chars and len(d) >= rule.min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key_of(x) not in last or last[key_of(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest(), "\n".join(kept)))
    return Counter(out)


def corpus():
    rng = random.Random(5)
    common = ["A line that many documents share, in full and with its end.", "Ünïcode line of forty code points: ñandú", "x" * 39 + "é", "x" * 39, "short"]
    rows = []
    for i in range(200):
        lines = [prose(rng, 12) for _ in range(rng.randrange(6))]
        for k, line in enumerate(common):
            if i % (k + 2) == 0:
                lines.insert(rng.randrange(len(lines) + 1), rng.choice([line, f" \t{line.upper() if line.isascii() else line}\r", line]))
        rows.append((i, "\n".join(lines)))
    rows += [(i, "Four documents have this line of more than forty characters.") for i in range(300, 304)]
    rows += [(i, "Five documents have this line of more than forty characters.\n" * 2) for i in range(400, 405)]
    return rows


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_equals_plain(spark, monkeypatch, limit):
    """Whether keys are sent to all tasks or joined."""
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert Counter(map(tuple, line_dedup.drop_repeated(df).collect())) == plain(rows)
    rule = Rule(min_chars=5, min_docs=3)
    assert Counter(map(tuple, line_dedup.drop_repeated(df, rule=rule).collect())) == plain(rows, rule)


def test_full_filters_change_nothing(spark, monkeypatch):
    """Where the filters are far too small, every line is a suspect and is counted."""
    monkeypatch.setattr(line_dedup, "places", lambda h, n: (np.zeros(len(h), np.int64), *[np.zeros(len(h), np.int64)] * 2))
    rows = corpus()
    pair = line_dedup.Pair()
    pair.add(np.array([1, 2], np.uint64), np.zeros(0, np.uint64))
    pair.add(np.array([3], np.uint64), np.zeros(0, np.uint64))
    assert pair.twice[0]
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(line_dedup, "twice_filter", lambda *a: np.full((1, line_dedup.SEGMENT // 8), 255, np.uint8))
    assert Counter(map(tuple, line_dedup.drop_repeated(df).collect())) == plain(rows)


def test_filters():
    """No repeat is missed, however its hashes come; few others are suspected."""
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 60_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    once, twice = h[:50_000], h[50_000:]
    whole, a, b = line_dedup.Pair(), line_dedup.Pair(), line_dedup.Pair()
    none = np.zeros(0, np.uint64)
    a.add(np.concatenate([once[:25_000], twice]), none)
    b.add(np.concatenate([once[25_000:], twice[:5_000]]), twice[:100])
    b.add(twice[5_000:], none)
    whole.merge(a.once, a.twice)
    whole.merge(b.once, b.twice)
    _, x, y = line_dedup.places(h, 1)
    hit = whole.twice[x] & whole.twice[y]
    assert hit[50_000:].all() and hit[:50_000].sum() < 1000
    for n in (1, 2, 1024):
        assert line_dedup.places(h, n)[0].max() == n - 1
    assert [line_dedup.segments_for(n) for n in (0, 1 << 26, (1 << 26) + 1, 1 << 45)] == [1, 1, 2, 1024]


@pytest.mark.parametrize("n_segments", [4, 128])
def test_segments(spark, n_segments):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    packed = line_dedup.twice_filter(df, n_segments=n_segments)
    assert packed.shape == (n_segments, line_dedup.SEGMENT // 8)
    n = Counter(k for _, t in rows for k in {key_of(x) for x in t.split("\n")} if len(k) >= 40)
    keys = [k.encode() for k in n]
    found = {keys[i] for i in line_dedup.suspected(keys, packed)}
    assert {k.encode() for k, x in n.items() if x > 1} <= found and len(found) < len([1 for x in n.values() if x > 1]) + 3


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_odd_and_empty(spark, odd, empty, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", limit)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    rule = Rule(min_docs=2)
    assert Counter(map(tuple, line_dedup.drop_repeated(odd, rule=rule).collect())) == plain(rows, rule)
    got = plain(rows, rule)
    assert any(r[2] for r in got)
    assert line_dedup.drop_repeated(empty).collect() == []


def test_strings_as_ids(spark):
    rows = [(x, "The line that they all have in common, of good length.") for x in "abcdef"]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in line_dedup.drop_repeated(df).collect()}
    assert got == dict.fromkeys("abcde", 1) | {"f": 0}
