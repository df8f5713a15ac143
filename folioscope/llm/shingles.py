"""Words and hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words (runs without space, \\t, \\n, \\v, \\f, \\r; with lower A-Z in small letters) of all texts, and where each text's begin (with the end last)."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = lists.flatten()
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    ends = np.asarray(lists.offsets).astype(np.int64)
    ends -= ends[0]
    starts = np.concatenate([[0], np.cumsum(real)])[ends]
    return flat.filter(pa.array(real)).dictionary_encode(), starts


def word_hashes(coded: pa.DictionaryArray) -> np.ndarray:
    """64-bit hash of each word, in order."""
    table = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    return table[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)


def sequence_hash(h: np.ndarray, k: int, n: int) -> np.ndarray:
    """Hash of the k words from each of n places on."""
    acc = np.full(n, k, np.uint64)
    for j in range(k):
        acc = acc * _MUL + h[j : j + n]
    return mixed(acc)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; with fewer words the whole sequence is the only one, without words there is none."""
    coded, starts = words(texts)
    with np.errstate(over="ignore"):
        h = word_hashes(coded)
        whole = sequence_hash(h, k, max(0, len(h) - k + 1))
        out = []
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if b - a >= k:
                out.append(np.unique(whole[a : b - k + 1]))
            elif b > a:
                out.append(sequence_hash(h[a:b], b - a, 1))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
