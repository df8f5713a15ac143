import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import packing, tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(test_same_ids, "t"):
        test_same_ids.t = Tokenizer.from_file(PATH)
        test_same_ids.t.encode_special_tokens = True
    assert tokens.document_ids(text, PATH).tolist() == [*test_same_ids.t.encode(text, add_special_tokens=False).ids, 2]


def test_same_ids_of_table(library, sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet")["text"].to_pylist() + ["a <|endoftext|> b", "\x00\x01", "ñ" * 5000, "ab" * 20000]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert tokens.document_ids(t, PATH)[:-1].tolist() == e.ids


@pytest.mark.parametrize("space", [" ", "\n", "\u00a0"])
def test_long_white_space(library, space):
    text = "a" + space * 1_000_000 + "b <|endoftext|>"
    assert tokens.document_ids(text, PATH)[:-1].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed,n,size", [(0, 0, 64), (1, 1, 64), (2, 50, 64), (3, 5000, 256), (4, 20000, 1024)])
def test_plan(seed, n, size):
    rng = np.random.default_rng(seed)
    lengths = np.minimum(rng.lognormal(4, 1, n).astype(int) + 1, size - 1)
    hist = np.bincount(lengths, minlength=size + 1)
    used, total = np.zeros(size + 1, int), 0
    for lens, m in packing.plan(hist):
        assert sum(lens) <= size and m > 0
        for v in lens:
            used[v] += m
        total += m
    assert (used == hist).all()
    lower = -(-int(lengths.sum()) // size)
    assert total <= lower * 1.03 + 2
    keys, sequences, offsets = packing.runs(packing.plan(hist))
    assert (np.diff(keys) > 0).all() and len(keys) == len(sequences) == len(offsets)


def check(rows, docs, size):
    want = {}
    for i, t in docs:
        ids = tokens.document_ids(t, PATH)
        first = len(ids) % size
        starts = ([0] if first else []) + list(range(first, len(ids), size))
        want.setdefault(i, []).append([(k, s, min(len(ids), first if s == 0 and first else s + size) - s, zlib.crc32(ids[s : first if s == 0 and first else s + size].tobytes())) for k, s in enumerate(starts)])
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
    assert {i: sorted(x for d in v for x in d) for i, v in want.items()} == {i: sorted(v) for i, v in got.items()}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in by.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= size
    return len(by)


def test_pack(spark, odd, empty):
    rows = packing.pack(odd, PATH).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in odd.collect()], 1024)
    assert packing.pack(empty, PATH).collect() == []
    rng = random.Random(5)
    docs = [(i, " ".join(rng.choice(["stone", "river", "of", "the"]) for _ in range(rng.randrange(0, 90)))) for i in range(700)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    rows = packing.pack(df, PATH, size=64).collect()
    n = check(rows, docs, 64)
    assert n <= 1.03 * sum(r["length"] for r in rows) / 64 + 2
