import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf_of(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climbed(nodes):
    """The node above a list of leaves, and each leaf's siblings (left and right of each level)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for i, path in enumerate(paths):
            r, p = runs[at[i] // 3], at[i] % 3
            path += ["".join(r[:p]), "".join(r[p + 1 :])]
            at[i] //= 3
        nodes = [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain(rows, changed=lambda r: r):
    """rows: (doc_id, source, lang, n_chars, text)."""
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: climbed([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    root, ups = climbed([tops[s][0] for s in names])
    out = []
    for s, up in zip(names, ups, strict=True):
        for x, path in zip(sorted(groups[s], key=lambda x: x[:3]), tops[s][1], strict=True):
            back = leaf_of(changed(x[3]))
            for left, right in zip((path + up)[::2], (path + up)[1::2], strict=True):
                back = sha(left + back + right)
            out.append((x[3][0], x[2], tops[s][0], root, sha("".join(path + up)), back, back == root))
    return Counter(out)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(df, changed=None, **more):
    return Counter(tuple(r) for r in merkle.proofs(df, "doc_id", "source", COLUMNS, changed, **more).collect())


def corpus():
    rows = [(3 * i, "hot", "en", i, f"text {i}\nmore") for i in range(2500)]
    rows += [(i, f"s{i % 7}", None, None, f"ünï {i}") for i in range(40)] + [(1, None, "de", 0, ""), (2, "one", None, 1, None), (3, "", "x", 2, "a\nb")]
    return rows


@pytest.mark.parametrize("depth", [1, 2, 6])
def test_equals_plain(spark, depth):
    """One, two or many rounds of blocks."""
    rows = corpus() if depth > 1 else corpus()[2200:]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    change = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    other = lambda r: (*r[:4], r[4] and r[4].replace("\n", "") if zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[4])
    want = plain(rows, other)
    assert got(df, {"text": change}, depth=depth) == want
    assert {r[6] for r in want} == {True, False}


def test_small_trees(spark):
    for n in (1, 2, 3, 4, 9, 10, 28):
        rows = [(i, "a", None, i, str(i)) for i in range(n)]
        assert got(spark.createDataFrame(rows, SCHEMA), depth=2) == plain(rows)


def test_odd_and_empty(spark, odd, empty):
    rows = [tuple(r[c] for c in COLUMNS) for r in odd.collect()]
    assert got(odd) == plain(rows) and all(r[6] for r in got(odd))
    assert not got(empty)
    same = [(None, "a", None, None, None)] * 30 + [(None, None, None, None, None)]
    assert got(spark.createDataFrame(same, SCHEMA).repartition(4)) == plain(same)


def test_any_change_shows(spark):
    """A change of any column, and only it, breaks the proof; the siblings lead to the root."""
    rows = corpus()[2400:]
    df = spark.createDataFrame(rows, SCHEMA)
    for c, x in (("lang", F.lit("zz")), ("n_chars", F.col("n_chars") + 1), ("text", F.concat("text", F.lit(" "))), ("source", F.lit("q"))):
        r = merkle.proofs(df, "doc_id", "source", COLUMNS, {c: x}).collect()
        null = {i for i, *v in rows if dict(zip(COLUMNS[1:], v, strict=True))[c] is None} if c in ("n_chars", "text") else set()
        assert all(x["verified"] == (x["doc_id"] in null) for x in r if x["doc_id"] not in (1, 2, 3) or c == "lang")
    for r in merkle.proofs(df, "doc_id", "source", COLUMNS, with_path=True).collect():
        assert merkle.folded(r["leaf"], r["path"]) == r["root"] and r["verified"]


def test_matrices():
    nodes = [sha(str(i)) for i in range(11)]
    m = np.frombuffer("".join(nodes).encode(), np.uint8).reshape(-1, 64)
    assert [r.tobytes().decode() for r in merkle.parents(m)] == [sha("".join(nodes[i : i + 3])) for i in range(0, 11, 3)]
    assert [merkle.height(n) for n in (0, 1, 2, 3, 4, 9, 10, 27, 28)] == [0, 0, 1, 1, 2, 2, 3, 3, 4]
