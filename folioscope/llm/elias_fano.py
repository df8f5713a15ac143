"""Elias-Fano sequences and a two-level n-gram trie over them.

A trie's first level has the contexts (32-bit prints, ascending), pointers to their successors and the weight that each leaves to the unigrams.
The second has the successors: ascending within a context, and made ascending over all by adding what the contexts before end with. Each of these
is an Elias-Fano sequence; the smoothed probabilities are quantised to a byte.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

#: Codes 1 to 255 cover log10 values from -DEPTH to 0; 0 means absent.
DEPTH = 12.0
STEP = DEPTH / 254
#: Numbers that a search decodes at a time.
BLOCK = 8192
#: Place of the k-th set bit of a byte.
_SELECT = np.zeros((256, 8), np.int64)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _SELECT[_b, : len(_ones)] = _ones


def quantised(log10: np.ndarray) -> np.ndarray:
    """Bytes for logarithms of at most 0; 0, as for what is absent, for that of 0."""
    log10 = np.asarray(log10, np.float64)
    return np.where(np.isneginf(log10), 0, 255 - np.clip(np.rint(-log10 / STEP), 0, 254)).astype(np.uint8)


def restored(codes: np.ndarray) -> np.ndarray:
    """Probabilities of codes; 0 for what is absent."""
    return np.where(codes == 0, 0.0, 10.0 ** ((codes.astype(np.float64) - 255) * STEP))


@dataclass
class EliasFano:
    """An ascending sequence of n numbers (repeats allowed): `width` low bits of each side by side, high parts in unary."""

    n: int
    width: int
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n = len(v)
        top = int(v[-1]) + 1 if n else 1
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        # blocks of numbers end at whole bytes
        bits = np.arange(width, dtype=np.uint64)
        low = np.concatenate([np.packbits((v[i : i + BLOCK, None] >> bits & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") for i in range(0, n, BLOCK)]) if width and n else np.zeros(0, np.uint8)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, width, np.concatenate([low, np.zeros(8, np.uint8)]), np.packbits(bits, bitorder="little"))

    def parts(self) -> list[bytes]:
        return [struct.pack("<QQQQ", self.n, self.width, len(self.low), len(self.high)), self.low.tobytes(), self.high.tobytes()]

    @classmethod
    def read(cls, data: np.ndarray, at: int) -> tuple[EliasFano, int]:
        """From bytes (which may be mapped from a file) at a place; the place after it."""
        n, width, low, high = struct.unpack("<QQQQ", data[at : at + 32].tobytes())
        at += 32
        return cls(n, width, data[at : at + low], data[at + low : at + low + high]), at + low + high

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """The high bits as 64-bit words and the ones before each: the only thing made when a sequence is opened, about four bits a number."""
        if not hasattr(self, "_index"):
            words = np.zeros(max(1, -(-len(self.high) // 8)), np.uint64)
            words.view(np.uint8)[: len(self.high)] = self.high
            ones = np.bitwise_count(words).astype(np.int64)
            self._index = words, np.cumsum(ones) - ones
        return self._index

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th (from 0) one among the high bits."""
        words, before = self.index()
        k = np.asarray(k, np.int64)
        w = np.searchsorted(before, k, "right") - 1
        left = (k - before[w]).astype(np.uint8)
        parts = words[w][:, None].view(np.uint8)
        upto = np.cumsum(np.bitwise_count(parts), 1, dtype=np.uint8)
        byte = (upto <= left[:, None]).sum(1)
        row = np.arange(len(k))
        skipped = np.where(byte > 0, upto[row, byte - 1], 0)
        return 64 * w + 8 * byte + _SELECT[parts[row, byte], left - skipped]

    def lows(self, i: np.ndarray) -> np.ndarray:
        bit = np.asarray(i, np.int64) * self.width
        byte, shift = bit >> 3, (bit & 7).astype(np.uint64)
        word = np.zeros(len(bit), np.uint64)
        for k in range((self.width + 14) // 8):
            word |= np.asarray(self.low)[byte + k].astype(np.uint64) << np.uint64(8 * k)
        return word >> shift & np.uint64((1 << self.width) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The numbers at places."""
        i = np.asarray(i, np.int64)
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def decoded(self, a: int, b: int) -> np.ndarray:
        """The numbers at places a to b - 1, a < b."""
        first, last = self.select(np.array([a, b - 1])).tolist()
        bits = np.unpackbits(np.asarray(self.high[first >> 3 : (last >> 3) + 1]), bitorder="little")
        i = np.arange(a, b)
        high = np.flatnonzero(bits[first & 7 :])[: b - a] + first - i
        return (high.astype(np.uint64) << np.uint64(self.width)) | self.lows(i)

    def search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each x the first place whose number is x or more (n if there is none), and whether it is x. Only blocks that are asked for are decoded, one at a time."""
        x = np.asarray(x).astype(np.uint64)
        place, hit = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        if not self.n or not len(x):
            return place, hit
        order = None if (x[1:] >= x[:-1]).all() else np.argsort(x)
        asked = x if order is None else x[order]
        starts = self.get(np.arange(0, self.n, BLOCK))
        block = np.maximum(np.searchsorted(starts, asked, "left") - 1, 0)  # the last block that begins below x
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            a = int(block[i]) * BLOCK
            b = min(a + BLOCK + 1, self.n)  # with the next block's first
            held = self.decoded(a, b)
            at = np.searchsorted(held, asked[i:j], "left")
            same = (at < len(held)) & (held[np.minimum(at, len(held) - 1)] == asked[i:j])
            some = slice(i, j) if order is None else order[i:j]
            place[some], hit[some] = a + at, same
        return place, hit

    def successor(self, x: np.ndarray) -> np.ndarray:
        """For each x the first place whose number is x or more (n if there is none)."""
        return self.search(x)[0]


@dataclass
class Trie:
    contexts: EliasFano
    pointers: EliasFano
    successors: EliasFano
    weights: np.ndarray
    probabilities: np.ndarray

    @classmethod
    def of(cls, context: np.ndarray, successor: np.ndarray, probability: np.ndarray, weight: np.ndarray) -> Trie:
        """From rows sorted by context and successor (32-bit, no repeats), log10 probabilities; weight: log10 for each context in order."""
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        ends = np.concatenate([first[1:], [len(context)]])
        last = successor[ends - 1].astype(np.uint64) + np.uint64(1) if len(first) else np.zeros(0, np.uint64)
        base = np.cumsum(last) - last
        spread = successor.astype(np.uint64) + np.repeat(base, ends - first) if len(first) else np.zeros(0, np.uint64)
        return cls(EliasFano.of(context[first]), EliasFano.of(np.concatenate([first, [len(context)]])), EliasFano.of(spread), quantised(weight), quantised(probability))

    def to_bytes(self) -> bytes:
        head = struct.pack("<4sQQ", b"EFT1", len(self.weights), len(self.probabilities))
        return b"".join([head, *self.contexts.parts(), *self.pointers.parts(), *self.successors.parts(), self.weights.tobytes(), self.probabilities.tobytes()])

    @classmethod
    def open(cls, data: np.ndarray) -> Trie:
        """Over bytes, such as np.memmap of a file: no level is copied."""
        mark, n, m = struct.unpack("<4sQQ", data[:20].tobytes())
        if mark != b"EFT1":
            raise ValueError("not a trie")
        contexts, at = EliasFano.read(data, 20)
        pointers, at = EliasFano.read(data, at)
        successors, at = EliasFano.read(data, at)
        return cls(contexts, pointers, successors, data[at : at + n], data[at + n : at + n + m])

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of (context, successor) and of the context's weight; 0 where the trie lacks them."""
        codes, weights = np.zeros(len(context), np.uint8), np.zeros(len(context), np.uint8)
        if not self.contexts.n:
            return codes, weights
        # neighbours with the same context share its lookup
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        node, known = self.contexts.search(context[first])
        node = node[known]
        begin, end = self.pointers.get(node), self.pointers.get(node + 1)
        # what the context's successors are relative to
        base = np.where(begin > 0, self.successors.get(np.maximum(begin.astype(np.int64) - 1, 0)) + np.uint64(1), np.uint64(0))
        size = np.diff(np.concatenate([first, [len(context)]]))
        met = np.flatnonzero(np.repeat(known, size))
        own = np.repeat(np.arange(len(node)), size[known])
        weights[met] = np.asarray(self.weights)[node][own]
        at, hit = self.successors.search(base[own] + successor[met].astype(np.uint64))
        inside = np.flatnonzero(hit & (at < end.astype(np.int64)[own]))
        codes[met[inside]] = np.asarray(self.probabilities)[at[inside]]
        return codes, weights
