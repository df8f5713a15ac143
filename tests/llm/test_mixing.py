import math
from collections import Counter

import pytest

from folioscope.llm import mixing
from folioscope.llm.mixing import Target


def test_exponent_meets_targets():
    sizes = [10_000, 1_000, 1_000, 100]
    a = mixing.exponent(sizes, Target(entropy=0.9))
    p = mixing.weights(sizes, a)
    assert abs(mixing.entropy(p) - 0.9 * math.log(4)) < 1e-9 and abs(sum(p) - 1) < 1e-12
    a = mixing.exponent(sizes, Target(entropy=0.99, repetition=3.0, budget=sum(sizes)))
    assert abs(mixing.repetitions(sizes, mixing.weights(sizes, a), sum(sizes)) - 3) < 1e-6
    a = mixing.exponent(sizes, Target(entropy=0.99, repetition=2.0))
    assert abs(mixing.repetitions(sizes, mixing.weights(sizes, a), None) - 2) < 1e-6
    assert mixing.exponent(sizes, Target()) == 1.0 and mixing.exponent([5, 0], Target(entropy=0.9)) == 1.0 and mixing.exponent([], Target(entropy=0.5)) == 1.0


def docs(spark):
    rows = [(i, f"{'w ' * (5 + i % 7)}", "big" if i % 10 else f"small{i % 3}") for i in range(1200)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), rows


def test_budgets_are_met(spark):
    df, rows = docs(spark)
    target = Target(entropy=0.95, budget=8000)
    out = mixing.mix(df.repartition(4), target).collect()
    size = Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    names = sorted(size)
    want = dict(zip(names, mixing.budgets([size[s] for s in names], target), strict=True))
    got = Counter()
    for r in out:
        got[r["source"]] += r["_n_tokens"]
    assert all(want[s] <= got[s] < want[s] + 12 for s in names)
    times = Counter((r["doc_id"], r["_epoch"]) for r in out)
    assert set(times.values()) == {1}
    per = Counter(r["doc_id"] for r in out)
    for s in names:
        n = [per[i] for i, _, x in rows if x == s]
        assert max(n) - min(n) <= 1
    again = mixing.mix(df.repartition(7), target).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    other = mixing.mix(df, Target(entropy=0.95, budget=8000, seed="x")).collect()
    assert {(r["doc_id"], r["_epoch"]) for r in other} != {(r["doc_id"], r["_epoch"]) for r in out}


def test_nothing_lost(spark, odd, empty):
    df, rows = docs(spark)
    out = mixing.mix(df, Target(entropy=0.95, repetition=1.5)).collect()
    assert {r["doc_id"] for r in out} == {r[0] for r in rows} and max(Counter(r["doc_id"] for r in out).values()) <= 2
    with pytest.raises(ValueError):
        mixing.mix(odd, Target(entropy=0.9))
    got = mixing.mix(odd, Target(entropy=0.9, repetition=3.0), marks=False)
    assert got.columns == odd.columns
    count = lambda d: Counter(tuple(r) for r in d.collect())
    assert set(count(odd)) == set(count(got)) and all(count(got)[k] >= n for k, n in count(odd).items())
    assert mixing.mix(empty, Target(entropy=0.9), marks=False).collect() == []


def test_too_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    with pytest.raises(ValueError):
        mixing.mix(docs(spark)[0], Target(entropy=0.9))


def test_shuffle_join_agrees(spark, monkeypatch):
    df, _ = docs(spark)
    a = sorted(map(tuple, mixing.mix(df, Target(entropy=0.95)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    assert a == sorted(map(tuple, mixing.mix(df, Target(entropy=0.95)).collect()))


def test_blocks_grow_with_the_input(spark):
    assert [mixing.block_digits(n) for n in (0, 16 << 30, 17 << 30, 256 << 30, 100 << 40)] == [3, 3, 4, 4, 5]
    # rows without an id, or with one and the same, don't share a block
    df = spark.createDataFrame([(None, f"text {i}", "a") for i in range(500)] + [(7, f"other {i}", "b") for i in range(500)], "doc_id long, text string, source string")
    out = mixing.mix(df, Target(budget=1000)).collect()
    assert len({r["_position"] for r in out if r["source"] == "a"}) > 100 and len({r["_position"] for r in out if r["source"] == "b"}) > 100
