import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import token_order, tokens
from folioscope.llm.token_order import Order

PATH = tokens.default_path()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**63))
def test_permutation(n, key):
    order = Order(n, key)
    slots = order.slots(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert (order.numbers(slots) == np.arange(n)).all()


def test_keys_differ_and_spread():
    x = np.arange(100_000) + 7 * token_order.TASK_SEQUENCES
    n = token_order.TASKS * token_order.TASK_SEQUENCES
    a, b = Order(n, 1).slots(x), Order(n, 2).slots(x)
    assert len(set(a.tolist())) == len(x) and (a != b).mean() > 0.999
    counts = np.bincount(a // (-(-n // 50)), minlength=50)
    assert counts.min() > 1700 and counts.max() < 2300


@pytest.mark.parametrize("files", [1, 7])
def test_write_and_read(spark, odd, tmp_path, files):
    folder = f"file://{tmp_path}/order"
    rows = sorted(token_order.write_order(odd, folder, PATH, length=128, n_files=files, bytes_each=4).collect())
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    read = list(token_order.read_order(folder, 0, length=128, bytes_each=4))
    assert len(read) == len(rows) and all(zlib.crc32(x.tobytes()) == r["ids_crc32"] for x, r in zip(read, rows, strict=True))
    later = list(token_order.read_order(folder, len(rows) // 2, length=128, bytes_each=4))
    assert len(later) == len(rows) - len(rows) // 2 and (later[0] == read[len(rows) // 2]).all()
    # in order of numbers and without padding, the tasks' streams hold every document once
    by = sorted(zip((r["number"] for r in rows), (r["n_valid"] for r in rows), read, strict=True), key=lambda x: x[0])
    stream = np.concatenate([x[:n] for _, n, x in by])
    want = [tokens.document_ids(r["text"], PATH) for r in odd.collect()]
    assert len(stream) == sum(map(len, want))
    ends = np.flatnonzero(stream == tokens.END)
    assert np.bincount(stream).tolist() == np.bincount(np.concatenate(want)).tolist() and len(ends) >= len(want)
    assert [r["number"] for r in rows] != sorted(r["number"] for r in rows)


def test_empty(spark, empty, tmp_path):
    folder = f"file://{tmp_path}/none"
    assert token_order.write_order(empty, folder, PATH).collect() == []
    assert list(token_order.read_order(folder, 0)) == []


def test_two_bytes(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    folder = f"file://{tmp_path}/two"
    rows = sorted(token_order.write_order(docs, folder, PATH).collect())
    assert all(zlib.crc32(x.tobytes()) == r["ids_crc32"] for x, r in zip(token_order.read_order(folder, 0), rows, strict=True))
