import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import mixing, quality_model
from folioscope.llm.jaccard import Similarity
from folioscope.llm.mixing import Target
from tests.llm.conftest import prose
from tests.llm.test_jaccard import plain_classes
from tests.llm.test_packing import check
from tests.llm.test_pii import plain


def crc(i):
    import zlib

    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    docs, labels = [], []
    for i in range(360):
        good = i % 4 != 0
        text = prose(rng, rng.randrange(60, 200), [f"w{k}" for k in range(300)])
        if not good:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 10 == 1:
            text += f" write to user{i}@mail.example.com or +1 (743) 555-{i:04d}"
        elif i > 40 and i % 10 == 3:
            words = docs[i - 40][1].split()
            for _ in range(rng.choice([0, 1, 30])):
                words[rng.randrange(len(words))] = "other"
            text = " ".join(words)
        docs.append((i, text, "en", "big" if i % 3 else f"small{i % 2}", len(text)))
        labels.append((i, int(good), 0))
    docs += [(900, None, None, None, None), (901, "", "en", "big", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def plain_quality(rows, labels):
    train = sorted((r for r in rows if crc(r[0]) % 4 != 2 and r[0] in labels), key=lambda r: str(r[0]))
    bags = [quality_model.passages([(r[1] or "").encode()])[0] for r in train]
    net = quality_model.train(np.concatenate(bags), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), np.array([float(labels[r[0]] > 0) for r in train]))
    return [r for r in rows if net.score([(r[1] or "").encode()])[0] >= 0.7]


def plain_dedup(rows):
    rows = sorted(rows, key=lambda r: r[0])
    component = plain_classes([r[1] for r in rows], Similarity())
    return [r for k, r in enumerate(rows) if component[k][0] == k]


def plain_mask(rows):
    out = []
    for r in rows:
        text = r[1]
        for s, e, kind in sorted(plain(text or ""), reverse=True):
            text = text[:s] + f"[{kind.upper()}]" + text[e:]
        out.append((r[0], text, r[2], r[3], None if text is None else len(text)))
    return out


def plain_mix(rows):
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    ident = lambda r: f"{r[0]}:{md5(r[1] or '')}"
    tokens = lambda r: len((r[1] or "").encode().split())
    by = defaultdict(list)
    for r in rows:
        by["null" if r[3] is None else f"={r[3]}"].append(r)
    names = sorted(by)
    sizes = [sum(map(tokens, by[n])) for n in names]
    out = []
    for name, size, budget in zip(names, sizes, mixing.budgets(sizes, Target(entropy=0.95, repetition=4.0)), strict=True):
        epochs, rest = (budget // size, budget % size) if size else (0, 0)
        blocks = defaultdict(list)
        for r in by[name]:
            blocks[md5(ident(r))[:3]].append(r)
        for e in range(max(1, epochs + (rest > 0))):
            room = rest
            for b in sorted(blocks, key=lambda b: (md5(f"mix:{e}:{name}:{b}"), b)):
                n = sum(map(tokens, blocks[b]))
                if e < epochs or room >= n:
                    out += blocks[b]
                elif room > 0:
                    left = room
                    for r in sorted(blocks[b], key=lambda r: md5(f"mix:{e}:{ident(r)}")):
                        if left > 0:
                            out.append(r)
                        left -= tokens(r)
                room -= n
    return out


def test_stages(spark, folder, tmp_path):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    want = [tuple(r) for r in docs.collect()]
    steps = [lambda rows: plain_quality(rows, labels), plain_dedup, plain_mask, plain_mix]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        want = steps[k](want)
        got = Counter(tuple(r) for r in docs.collect())
        assert got == Counter(want), name
        assert 0 < sum(got.values()) and (k != 0 or sum(got.values()) < 362)
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    check(rows, [(r[0], r[1]) for r in want], 1024)
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert Counter(map(key, whole)) == Counter(map(key, rows))


def test_order_of_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]


def test_stages_on_odd_rows(spark, odd, folder):
    """Nulls, repeats, long texts and columns with the names that stages use inside: each stage gives the input's columns."""
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, folder)
        assert out.columns == odd.columns and out.schema["score"].dataType == odd.schema["score"].dataType
        rows = out.collect()
        assert {r["_text_key"] for r in rows} <= {8, None} and {r["_n_tokens"] for r in rows} <= {9, None} and {r["score"] for r in rows} <= {1, None}
