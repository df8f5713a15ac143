"""Quality by attention-based multiple-instance learning: a document is a bag of passages and only the bag has a label.

Every passage (PASSAGE bytes; the passages cover the whole text) is encoded; gated attention weights, learned from the document labels,
give the document's representation as a weighted mean, and a logistic unit scores it.
Null and empty texts are one empty passage and get its score. Repeated rows get equal scores. Null ids are never trained on or held out.
With no label, or labels of one kind only, every score is the share of label 1 (0.5 with none).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import SLICE_BYTES, arrow_limits, crc_mod, held_out, sample_ids, slices, stored, table, whole_rows

PASSAGE = 512
#: Labelled rows to train on, at most, and passages of all of them together (texts are taken whole or not at all).
TRAIN_ROWS = 6000
TRAIN_PASSAGES = 100_000
DECAY = 1e-4
PAIRS = 64
OCCUPANCY = 1024
THRESHOLD = 0.7

#: A class for each byte value: by default control, then the kinds below, then bytes of other scripts.
_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\r\v\f", b"\n", b".", b",;:", b"!", b"?", b"\"'`", b"()[]{}", b"#", b"*", b"$", b"%", b"&", b"|", b"<>", b"-_/\\=+~^", b"@"]
CLASSES = len(_KINDS) + 2
CLASS_OF = np.zeros(256, np.int64)
for _i, _k in enumerate(_KINDS):
    CLASS_OF[list(_k)] = _i + 1
CLASS_OF[128:] = CLASSES - 1
N_FEATURES = CLASSES + PAIRS + 4


def passages(texts: list[bytes], whole: list[int] | None = None, after: bytes = bytes(4)) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage (rows) and the text that each is of; every text has one at least. A passage's features depend on its own text alone.
    For pieces of texts, whole has the whole texts' sizes and after the four bytes that follow a piece."""
    sizes = np.array([len(x) for x in texts], np.int64)
    of = sizes if whole is None else np.array(whole, np.int64)
    counts = np.maximum(1, -(-sizes // PASSAGE))
    owner = np.repeat(np.arange(len(texts)), counts)
    n = len(owner)
    body = np.frombuffer(b"".join(x + after for x in texts), np.uint8).astype(np.int64)
    at = np.arange(int(sizes.sum())) + np.repeat(4 * np.arange(len(texts)), sizes)
    first_passage = np.cumsum(counts) - counts
    within = np.arange(n) - first_passage[owner]
    length = np.clip(sizes[owner] - within * PASSAGE, 0, PASSAGE)
    passage = np.repeat(np.arange(n), length)
    b, after_1 = body[at], body[at + 1]
    out = np.zeros((n, N_FEATURES), np.float32)
    scale = 1 / np.maximum(length, 1)[:, None]
    out[:, :CLASSES] = np.bincount(passage * CLASSES + CLASS_OF[b], minlength=n * CLASSES).reshape(n, -1) * scale
    pair = (b * 37 + after_1 * 101 + (b ^ after_1)) % PAIRS
    out[:, CLASSES : CLASSES + PAIRS] = np.bincount(passage * PAIRS + pair, minlength=n * PAIRS).reshape(n, -1) * scale
    # how many different runs of four bytes a passage has: few where words repeat
    four = b + (after_1 << 8) + (body[at + 2] << 16) + (body[at + 3] << 24)
    met = np.zeros(n * OCCUPANCY, bool)
    met[passage * OCCUPANCY + ((four * 2654435761) >> 16) % OCCUPANCY] = True
    k = CLASSES + PAIRS
    out[:, k] = met.reshape(n, -1).sum(1) / np.maximum(length, 1)
    out[:, k + 1] = length / PASSAGE
    out[:, k + 2] = np.log1p(of[owner]) / 10
    out[:, k + 3] = of[owner] == 0
    return out, owner


def pieces(text: bytes, size: int) -> Iterator[np.ndarray]:
    """The passages' features of one text in pieces of about size bytes: the same rows as in one go, in bounded memory."""
    size = -(-size // PASSAGE) * PASSAGE
    for i in range(0, max(1, len(text)), size):
        yield passages([text[i : i + size]], [len(text)], (text[i + size : i + size + 4] + bytes(4))[:4])[0]


@dataclass
class Attention:
    """mean, spread: to standardise features; encode, attend (V), gate (U), weigh (w): the attention; last: the logistic unit."""

    mean: np.ndarray
    spread: np.ndarray
    encode: np.ndarray
    encode_bias: np.ndarray
    attend: np.ndarray
    gate: np.ndarray
    weigh: np.ndarray
    last: np.ndarray
    last_bias: np.ndarray
    constant: float | None = None

    def arrays(self) -> list[np.ndarray]:
        return [self.encode, self.encode_bias, self.attend, self.gate, self.weigh, self.last, self.last_bias]

    def encoded(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """Standardised features, encoding, the two factors of the gate and the attention before normalisation of every passage."""
        x = (x - self.mean) / self.spread
        h = np.tanh(x @ self.encode + self.encode_bias)
        t, s = np.tanh(h @ self.attend), 1 / (1 + np.exp(-(h @ self.gate)))
        return x, h, t, s, (t * s) @ self.weigh

    def logistic(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.last + self.last_bias[0], -30, 30)))

    def forward(self, x: np.ndarray, owner: np.ndarray, n: int) -> dict:
        x, h, t, s, e = self.encoded(x)
        top = np.full(n, -np.inf, e.dtype)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a /= np.bincount(owner, a, n)[owner]
        z = np.zeros((n, h.shape[1]))
        np.add.at(z, owner, a[:, None] * h)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "p": self.logistic(z)}

    def gradients(self, x: np.ndarray, owner: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy of bags and DECAY / 2 times the squares of encode and last, for each of arrays()."""
        n = len(y)
        f = self.forward(x, owner, n)
        d = (f["p"] - y) / n
        dz = d[:, None] * self.last
        dh = f["a"][:, None] * dz[owner]
        da = (f["h"] * dz[owner]).sum(1)
        de = f["a"] * (da - np.bincount(owner, f["a"] * da, n)[owner])
        dt = de[:, None] * self.weigh * f["s"] * (1 - f["t"] ** 2)
        ds = de[:, None] * self.weigh * f["t"] * f["s"] * (1 - f["s"])
        dh += dt @ self.attend.T + ds @ self.gate.T
        du = dh * (1 - f["h"] ** 2)
        return [f["x"].T @ du + DECAY * self.encode, du.sum(0), f["h"].T @ dt, f["h"].T @ ds, (f["t"] * f["s"]).T @ de, f["z"].T @ d + DECAY * self.last, np.array([d.sum()])]

    def score_long(self, text: bytes, size: int) -> float:
        """The score of one text, read in pieces: the attention's sums are kept relative to the greatest weight so far."""
        top, mass, z = -np.inf, 0.0, np.zeros(self.encode.shape[1])
        for x in pieces(text, size):
            _, h, _, _, e = self.encoded(x)
            new = max(top, float(e.max()))
            a = np.exp(e - new)
            keep = np.exp(top - new)
            mass, z, top = mass * keep + a.sum(), z * keep + a @ h, new
        return float(self.logistic(z / mass))

    def score(self, texts: list[bytes], size: int = SLICE_BYTES) -> np.ndarray:
        """Scores of texts; those beyond size bytes are read in pieces."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = np.empty(len(texts))
        short = [k for k, x in enumerate(texts) if len(x) <= size]
        if short:
            x, owner = passages([texts[k] for k in short])
            out[short] = self.forward(x, owner, len(short))["p"]
        for k, x in enumerate(texts):
            if len(x) > size:
                out[k] = self.score_long(x, size)
        return out


def train(x: np.ndarray, owner: np.ndarray, y: np.ndarray, hidden: int = 32, gated: int = 16, epochs: int = 30, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> Attention:
    """Adam on the cross entropy of bags; x: passages' features, owner: their bag (ascending), y: the bags' labels."""
    rng = np.random.default_rng(seed)
    some = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
    mean, spread = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(N_FEATURES), np.ones(N_FEATURES))
    net = Attention(mean, spread, some(N_FEATURES, hidden), np.zeros(hidden), some(hidden, gated), some(hidden, gated), some(gated), some(hidden), np.zeros(1))
    if len(y) == 0 or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    starts = np.searchsorted(owner, np.arange(len(y) + 1))
    w = net.arrays()
    m, v = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w]
    step, steps = 0, epochs * -(-len(y) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i : i + batch]
            rows = np.concatenate([np.arange(starts[k], starts[k + 1]) for k in bags])
            grads = net.gradients(x[rows], np.repeat(np.arange(len(bags)), starts[bags + 1] - starts[bags]), y[bags])
            step += 1
            pace = rate * (1 - step / (steps + 1))
            for k, (a, g) in enumerate(zip(w, grads, strict=True)):
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g * g - v[k])
                a -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", train_rows: int = TRAIN_ROWS, train_passages: int = TRAIN_PASSAGES) -> Attention:
    """Trains on whole texts of labelled rows of df: the first of them by a hash of the id, at most train_rows and as many as have train_passages passages together;
    one that is too long for what is left is passed over, and the shortest of each class comes first. Of several labels of an id the least counts."""
    spark = df.sparkSession
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    ids = sample_ids(df.select(F.col(id_col).alias("id")).join(marked, "id", "left_semi"), "id", train_rows)
    chosen = ids.join(marked, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            bags = [np.concatenate(list(pieces(t or b"", SLICE_BYTES))) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([len(x) for x in bags], pa.int64()), pa.array([x.tobytes() for x in bags], pa.binary())], ["id", "label", "n", "bag"])

    arrow_limits(spark)
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= train_passages * PASSAGE)  # no features of a text that can't be taken
    # an id that stands for several rows is learned once, from the text whose features come first
    bags = stored(spark, rows.mapInArrow(run, f"id {kind}, label int, n long, bag binary").groupBy("id").agg(F.min_by(F.struct("label", "n", "bag"), "bag").alias("x")).select("id", "x.*"), "quality-bags")
    got = whole_rows(bags.withColumn("h", F.xxhash64("id")), ["h", "id"], "n", train_passages, "label").select("id", "label", "bag").collect()
    got.sort(key=lambda r: str(r[0]))
    found = [np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES) for r in got]
    x = np.concatenate(found) if found else np.zeros((0, N_FEATURES), np.float32)
    return train(x, np.repeat(np.arange(len(found)), [len(b) for b in found]), np.array([float(r[1] > 0) for r in got]))


def _scored(df: DataFrame, net: Attention, text_col: str) -> DataFrame:
    """All columns of df by place, _0, _1, ..., with _score: no name can clash."""
    names = [f"_{i}" for i in range(len(df.columns))]
    at = df.columns.index(text_col)
    text = names[at] if df.schema[at].dataType.simpleString() == "string" else "_text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            p = net.score([t or b"" for t in b.column(text).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(np.round(p, 9), pa.float64())], [*names, "_score"])

    arrow_limits(df.sparkSession)
    rows = df.toDF(*names)
    rows = rows if text != "_text" else rows.withColumn("_text", F.col(names[at]).cast("string"))
    return rows.mapInArrow(run, ", ".join([*(f"{x} {f.dataType.simpleString()}" for x, f in zip(names, df.schema, strict=True)), "_score double"]))


def score(df: DataFrame, net: Attention, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    return _scored(df.select(id_col, text_col), net, text_col).select(F.col("_0").alias(id_col), F.col("_score").alias("score"))


def accepted(df: DataFrame, net: Attention, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of df whose score is threshold or more, with their columns as they are."""
    return _scored(df, net, text_col).where(F.col("_score") >= threshold).drop("_score").toDF(*df.columns)


def op4_quality_attention(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; those whose crc32(doc_id) mod 4 is 2 are held out of training."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(crc_mod("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    return score(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
