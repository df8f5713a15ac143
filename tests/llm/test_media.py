import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from folioscope.llm import media


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_odd_rows(odd):
    got = rows_of(media.media_features(media.store_media(odd)))
    assert len(got) == odd.count()
    want = []
    for r in odd.collect():
        b = (r["text"] or "").encode()
        padded = b + bytes(-len(b) % 64 if b else 64)
        want.append((r["doc_id"], len(b), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    key = lambda x: tuple(map(str, x))
    assert sorted(want, key=key) == sorted(((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=key)
    same = {}
    for r in got:
        assert r["error"] is None and len(r["feature"]) == 16
        assert same.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_empty(empty):
    assert rows_of(media.media_features(media.store_media(empty))) == []


def test_broken_media(spark):
    good = media.encode_png(b"a" * 128)
    flipped = good[:60] + bytes([good[60] ^ 1]) + good[61:]
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(good[:40])), (3, None), (4, bytearray(flipped)), (5, bytearray(b"no"))], "doc_id long, media binary")
    got = {r["doc_id"]: r for r in rows_of(media.media_features(df))}
    assert got[1]["error"] is None and got[1]["payload_bytes"] == 128
    assert all(got[i]["error"] and got[i]["payload_sha256"] is None for i in (2, 3, 4, 5))


def filtered(rows, kinds, step):
    """Filters by the book, pixel by pixel."""
    out = []
    for r, kind in enumerate(kinds):
        line = [kind]
        for i in range(rows.shape[1]):
            a = int(rows[r, i - step]) if i >= step else 0
            b = int(rows[r - 1, i]) if r else 0
            c = int(rows[r - 1, i - step]) if r and i >= step else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            line.append((int(rows[r, i]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255)
        out.append(line)
    return np.array(out, np.uint8)


@pytest.mark.parametrize("kinds", [[0, 1, 2, 2, 1, 2, 0, 2], [2, 2, 2, 2, 2, 2, 2, 2], [3, 4, 0, 1, 2, 4, 3, 4], [4, 4, 3, 3, 2, 1, 0, 4]])
@pytest.mark.parametrize("colour", [0, 2, 4, 6])
def test_unfilter(kinds, colour):
    step = media.SAMPLES[colour]
    rows = np.random.default_rng(3).integers(0, 256, (8, 5 * step)).astype(np.uint8)
    raw = filtered(rows, kinds, step)
    png = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 5, 8, 8, colour, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(raw.tobytes())) + media._chunk(b"IEND", b"")
    assert (media.decode_png(png)[0] == rows).all()


def test_round_trip_and_hash():
    rng = np.random.default_rng(5)
    for n in (64, 64 * 31, 64 * 33, 64 * 500):
        body = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        rows, noted = media.decode_png(media.encode_png(body, n_bytes=n - 3))
        assert rows.tobytes() == body and noted == n - 3
    smooth = np.kron(rng.integers(20, 236, (8, 8)), np.ones((8, 8), int)).astype(np.uint8)
    noisy = np.clip(smooth.astype(int) + rng.integers(-2, 3, smooth.shape), 0, 255).astype(np.uint8)
    a, b = (int(h, 16) for h in media.cosine_hashes(np.stack([media.shrunk(smooth), media.shrunk(noisy)])))
    assert (a ^ b).bit_count() <= 20


def plain_hash(cells):
    """Every coefficient as a sum over all cells; a bit is set where it lies above the median of all but the first."""
    side = len(cells)
    wave = lambda k, x: round(math.cos(math.pi * k * (2 * x + 1) / (2 * side)) * 4096)
    low = [sum(wave(u, y) * wave(v, x) * int(cells[y][x]) for y in range(side) for x in range(side)) for u in range(8) for v in range(8)]
    rest = sorted(low[1:])
    bits = "".join("1" if c > rest[31] else "0" for c in low)
    return f"{int(bits, 2):016x}"


def test_hash_plain():
    rng = np.random.default_rng(6)
    images = [rng.integers(0, 65536, (media.SIDE, media.SIDE)) for _ in range(3)] + [np.zeros((media.SIDE, media.SIDE), int)]
    assert media.cosine_hashes(np.stack(images)) == [plain_hash(x.tolist()) for x in images]
