"""Media columns: payloads as 8-bit grey PNG in a binary column, read back with all checks, hashed by their low frequencies.

Nulls are empty payloads; an empty payload has one block of zeros. Equal texts give equal bytes, so equal values.
Media that fails a check (signature, chunk CRC, Adler sum, sizes) gives nulls and the reason in `error`.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, slices, table

#: Fixed values of the PNG format: signature; samples a pixel by colour type, at 8 bits.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 4: 2, 6: 4}

BLOCK = 64
IDAT_BYTES = 1 << 16
LEVEL = 4
#: The hash looks at SIDE x SIDE means and keeps LOW x LOW frequencies.
SIDE, LOW = 32, 8
#: Cosines as integers: sums are exact, so hashes don't depend on machine or batch.
COSINES = np.rint(np.cos(np.pi * np.outer(np.arange(LOW), 2 * np.arange(SIDE) + 1) / (2 * SIDE)) * (1 << 12)).astype(np.int64)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def encode_png(payload: bytes, width: int = BLOCK, n_bytes: int | None = None) -> bytes:
    """A grey PNG whose rows are the payload (a multiple of width). Each row takes the filter (none, left or up) of the least absolute sum."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    forms = np.stack([rows, rows, rows])
    forms[1, :, 1:] -= rows[:, :-1]
    forms[2, 1:] -= rows[:-1]
    costs = np.abs(forms.view(np.int8).astype(np.int16)).sum(2)
    kinds = costs.argmin(0)
    lines = np.empty((len(rows), width + 1), np.uint8)
    lines[:, 0] = kinds
    lines[:, 1:] = forms[kinds, np.arange(len(rows))]
    packed = zlib.compress(lines.tobytes(), LEVEL)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0))]
    if n_bytes is not None:
        parts.append(_chunk(b"tEXt", b"payload-length\0" + str(n_bytes).encode()))
    parts += [_chunk(b"IDAT", packed[i : i + IDAT_BYTES]) for i in range(0, len(packed), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def read_chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk up to IEND, its CRC tested."""
    if media[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while True:
        if at + 12 > len(media):
            raise ValueError("ends within a chunk")
        n, kind = struct.unpack_from(">I4s", media, at)
        if at + 12 + n > len(media):
            raise ValueError("ends within a chunk")
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError(f"wrong CRC in {kind!r}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + n


def unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Undoes the row filters 0 to 4; step: bytes a pixel. Rows of 0 to 2 are undone all at once; where 3 or 4 occur, pixels of one diagonal at a time, as each
    depends on those to the left, above, and above to the left."""
    if kinds.size and kinds.max() > 4:
        raise ValueError("unknown filter")
    if not (kinds > 2).any():
        out = lines.copy()
        left, up = kinds == 1, kinds == 2
        if left.any():
            rows = out[left].reshape(left.sum(), -1, step)
            out[left] = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(left.sum(), -1)
        if up.any():
            up[0] = False  # nothing stands above the first row
            total = np.cumsum(out, axis=0, dtype=np.uint8)
            first = np.maximum.accumulate(np.where(up, 0, np.arange(len(kinds))))
            before = np.where((first > 0)[:, None], total[first - 1], 0).astype(np.uint8)
            out = total - before
        return out
    height, pixels = lines.shape[0], lines.shape[1] // step
    data = lines.reshape(height, pixels, step).astype(np.int16)
    out = np.zeros((height + 1, pixels + 1, step), np.int16)
    for d in range(height + pixels - 1):
        r = np.arange(max(0, d - pixels + 1), min(height, d + 1))
        i = d - r
        a, b, c = out[r + 1, i], out[r, i + 1], out[r, i]
        to_a, to_b, to_c = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
        nearest = np.where((to_a <= to_b) & (to_a <= to_c), a, np.where(to_b <= to_c, b, c))
        kind = kinds[r][:, None]
        guess = np.select([kind == 1, kind == 2, kind == 3, kind == 4], [a, b, (a + b) >> 1, nearest], 0)
        out[r + 1, i + 1] = (data[r, i] + guess) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)


def decode_png(media: bytes) -> tuple[np.ndarray, int | None]:
    """Samples as rows x bytes, and the payload length noted in the file, if any. Raises ValueError on what is broken or not 8-bit and plain."""
    head, packed, noted = None, [], None
    for kind, body in read_chunks(media):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"tEXt" and body.startswith(b"payload-length\0"):
            noted = int(body.partition(b"\0")[2])
    if head is None or head[2] != 8 or head[3] not in SAMPLES or any(head[4:]):
        raise ValueError("not an 8-bit PNG without interlace")
    width, height, step = head[0] * SAMPLES[head[3]], head[1], SAMPLES[head[3]]
    unpack = zlib.decompressobj()  # its end tests the Adler sum
    try:
        raw = unpack.decompress(b"".join(packed), height * (width + 1) + 1)
    except zlib.error as e:
        raise ValueError(str(e)) from e
    if not unpack.eof or len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    lines = np.frombuffer(raw, np.uint8).reshape(height, width + 1)
    return unfilter(lines[:, 0], lines[:, 1:], step), noted


def shrunk(rows: np.ndarray) -> np.ndarray:
    """SIDE x SIDE sums over near-equal cells, scaled to 16 bits; short images repeat their rows."""
    height, width = rows.shape
    ys, xs = (np.arange(SIDE) * height // SIDE, np.arange(SIDE) * width // SIDE)
    tall = np.add.reduceat(rows.astype(np.int64), ys, axis=0) if height >= SIDE else rows[ys].astype(np.int64)
    cells = np.add.reduceat(tall, xs, axis=1) if width >= SIDE else tall[:, xs]
    area = np.outer(np.diff([*ys, height]) if height >= SIDE else np.ones(SIDE, int), np.diff([*xs, width]) if width >= SIDE else np.ones(SIDE, int))
    return cells * 256 // area


def cosine_hashes(images: np.ndarray) -> list[str]:
    """64-bit hashes in hex: which low frequencies lie above their median (the mean level aside)."""
    if not len(images):
        return []
    low = (COSINES @ images @ COSINES.T).reshape(len(images), -1)
    bits = low > np.median(low[:, 1:], axis=1, keepdims=True)
    return [x.tobytes().hex() for x in np.packbits(bits, axis=1)]


def store_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text's UTF-8, padded with zeros to a positive multiple of BLOCK, as PNG. Keeps ids as they are, repeated or null."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            media = []
            for x in b.column("text").cast(pa.binary()).to_pylist():
                x = x or b""
                media.append(encode_png(x + bytes(-len(x) % BLOCK if x else BLOCK), n_bytes=len(x)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(media, pa.binary())], ["id", "media"])

    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, media binary").withColumnRenamed("id", id_col)


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, height int, error string"


def media_features(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Reads each PNG back and returns what it holds. Null media gives nulls with error 'no media'."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def one(media: bytes | None) -> tuple[list, np.ndarray | None]:
        try:
            if media is None:
                raise ValueError("no media")
            rows, noted = decode_png(media)
        except ValueError as e:
            return [None, None, None, None, None if media is None else len(media), None, None, None, str(e)], None
        payload = rows.tobytes()
        return [noted, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), None, len(rows), None], shrunk(rows) if rows.size else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "media"):
            out = [one(x) for x in b.column("media").to_pylist()]
            held = [(row, image) for row, image in out if image is not None]
            for (row, _), text in zip(held, cosine_hashes(np.stack([i for _, i in held])) if held else [], strict=True):
                row[6] = text
            kinds = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
            columns = [pa.array([row[i] for row, _ in out], kinds[x.split()[1]]) for i, x in enumerate(FEATURES.split(", "))]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns], ["id", *names])

    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, {FEATURES}").withColumnRenamed("id", id_col)


def op5_media(spark, sf_dir: str) -> DataFrame:
    """Every document stored as PNG and read back."""
    return media_features(store_media(table(spark, sf_dir, "documents")))
