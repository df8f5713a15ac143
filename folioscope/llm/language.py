"""Language identification by a byte convolutional network: filters of several widths, max pooling and softmax, trained in numpy.

A text is cut into windows of WINDOW bytes that cover it whole; its scores are the windows' mean, weighted by their bytes.
Null texts and texts without a letter are `und` with score 0. Repeated rows get equal predictions; a null id is never held out and never trained on.
With no labelled row every text is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_limits, crc_mod, held_out, slices, stored, table, whole_rows

WINDOW = 256
PAD = 256
#: Bytes of a text that are held as windows at a time.
PIECE = 256 * WINDOW
WIDTHS = (2, 3, 4, 5)
#: Rows to train on, over all languages: at most so many, and as many as have so many bytes together (texts are taken whole or not at all).
TRAIN_ROWS = 6000
TRAIN_BYTES = 48 << 20
UNKNOWN = "und"


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (n x WINDOW of bytes or PAD), which text each is of, and its bytes. Every text has one at least."""
    sizes = np.array([len(x) for x in texts], np.int64)
    counts = np.maximum(1, -(-sizes // WINDOW))
    owner = np.repeat(np.arange(len(texts)), counts)
    out = np.full((int(counts.sum()), WINDOW), PAD, np.int16)
    first = np.cumsum(counts) - counts
    flat = out.reshape(-1)
    for text, k, n in zip(texts, first.tolist(), sizes.tolist(), strict=True):
        flat[k * WINDOW : k * WINDOW + n] = np.frombuffer(text, np.uint8)
    place = np.arange(len(owner)) - first[owner]
    return out, owner, np.clip(sizes[owner] - place * WINDOW, 0, WINDOW)


@dataclass
class ByteNet:
    """The network's arrays; `filters` holds all widths, a narrower one padded with zeros that stay zero."""

    labels: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def patches(self, x: np.ndarray) -> np.ndarray:
        vectors = self.embed[x]
        n, span = x.shape[0], WINDOW - max(WIDTHS) + 1
        s = vectors.strides
        view = np.lib.stride_tricks.as_strided(vectors, (n, span, max(WIDTHS) * vectors.shape[2]), (s[0], s[1], s[2]))
        return np.ascontiguousarray(view).reshape(n * span, -1)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest activation of each filter in each window before bias and rectifier, and where it is."""
        p = self.patches(x)
        a = (p @ self.filters).reshape(len(x), -1, self.filters.shape[1])
        return p, a

    def probabilities(self, x: np.ndarray, step: int = 32) -> np.ndarray:
        parts = []
        for i in range(0, len(x), step):
            _, a = self.pooled(x[i : i + step])
            z = np.maximum(a.max(1) + self.bias, 0) @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            parts.append(z / z.sum(1, keepdims=True))
        return np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        letters = [any(map(str.isalpha, x or "")) for x in texts]
        held = [x.encode() for x, ok in zip(texts, letters, strict=True) if ok]
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if not held or not self.labels:
            return labels, scores
        # long texts go in pieces, so that memory is bounded
        total = np.zeros((len(held), len(self.labels)))
        pieces = [(k, t[i : i + PIECE]) for k, t in enumerate(held) for i in range(0, len(t), PIECE)]
        for some in batched(pieces, 64):
            x, owner, size = windows([t for _, t in some])
            np.add.at(total, np.array([k for k, _ in some])[owner], self.probabilities(x) * size[:, None])
        total /= np.array([len(t) for t in held])[:, None]
        best = total.argmax(1)
        for k, j in enumerate(i for i, ok in enumerate(letters) if ok):
            labels[j], scores[j] = self.labels[best[k]], float(min(1.0, total[k, best[k]]))
        return labels, scores


def train(texts: list[str], labels: list[str], dims: int = 8, per_width: int = 8, steps: int = 1500, batch: int = 64, rate: float = 3e-3, seed: int = 7) -> ByteNet:
    """Fits the network with Adam on windows drawn evenly from the labels, then from the label's texts, then from the whole text."""
    names = sorted(set(labels))
    rng = np.random.default_rng(seed)
    widest, n_filters = max(WIDTHS), per_width * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(widest) < w).astype(np.float32), dims)[:, None].repeat(per_width, 1) for w in WIDTHS], 1)
    net = ByteNet(names, rng.normal(0, 0.5, (257, dims)).astype(np.float32), rng.normal(0, 0.3, mask.shape).astype(np.float32) * mask, np.zeros(n_filters, np.float32), rng.normal(0, 0.1, (n_filters, len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    if not names:
        return net
    net.embed[PAD] = 0
    bodies = [t.encode() for t in texts]
    n_windows = np.array([max(1, -(-len(b) // WINDOW)) for b in bodies])
    place = {name: c for c, name in enumerate(names)}
    y = np.array([place[v] for v in labels])
    by_label = [np.flatnonzero(y == c) for c in range(len(names))]
    arrays = [net.embed, net.filters, net.bias, net.out, net.out_bias]
    m, v = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays]
    for step in range(1, steps + 1):
        classes = rng.integers(0, len(names), batch)
        rows = np.array([by_label[c][rng.integers(len(by_label[c]))] for c in classes])
        at = rng.integers(0, n_windows[rows]) * WINDOW
        xb = windows([bodies[r][i : i + WINDOW] for r, i in zip(rows.tolist(), at.tolist(), strict=True)])[0]
        p, a = net.pooled(xb)
        at = a.argmax(1)
        h = np.take_along_axis(a, at[:, None], 1)[:, 0] + net.bias
        r = np.maximum(h, 0)
        z = r @ net.out + net.out_bias
        z = np.exp(z - z.max(1, keepdims=True))
        z /= z.sum(1, keepdims=True)
        z[np.arange(batch), classes] -= 1
        z /= batch
        g = (z @ net.out.T) * (h > 0)
        span = a.shape[1]
        chosen = p.reshape(batch, span, -1)[np.arange(batch)[:, None], at]
        g_patch = (g[:, :, None] * net.filters.T).reshape(batch, n_filters, widest, dims)
        g_embed = np.zeros_like(net.embed)
        np.add.at(g_embed, xb[np.arange(batch)[:, None, None], at[:, :, None] + np.arange(widest)], g_patch)
        g_embed[PAD] = 0
        grads = [g_embed, np.einsum("bfk,bf->kf", chosen, g) * mask, g.sum(0), r.T @ z + 1e-4 * net.out, z.sum(0)]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, (w, d) in enumerate(zip(arrays, grads, strict=True)):
            m[k] += 0.1 * (d - m[k])
            v[k] += 0.01 * (d * d - v[k])
            w -= pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> ByteNet:
    """Trains on whole texts of at most train_rows of the rows given, shared out evenly among all labels, in an order by a hash of the id and while they have
    train_bytes together (one that is too long for what is left is passed over, the shortest of each label comes first); rows without text or label count nothing. With more labels than train_rows, each label has one row."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where(f"id IS NOT NULL AND label IS NOT NULL AND length(text) > 0 AND octet_length(text) <= {train_bytes}")
    counts = stored(spark, rows.groupBy("label").agg(F.count("*").alias("n")), "language-labels")
    n_labels = counts.count()
    if not n_labels:
        return train([], [])
    each = max(1, train_rows // n_labels)
    # about twice as many as needed of each label are drawn by a hash of the id; their places within the label then decide
    hashed = F.xxhash64("id", F.lit("language"))
    wanted = rows.select("id", "label").join(counts, "label").where(F.pmod(hashed, F.lit(1 << 40)) / F.lit(1 << 40) < F.lit(2.0 * each + 40) / F.col("n"))
    ranked = wanted.select("id", "label", hashed.alias("h")).distinct().withColumn("place", F.row_number().over(Window.partitionBy("label").orderBy("h", "id")))
    chosen = stored(spark, ranked.where(F.col("place") <= each).select("id", "label", "place", "h"), "language-ids")
    n_chosen = chosen.count()
    few = F.broadcast if n_chosen <= 10 * train_rows else (lambda x: x)
    texts = rows.join(few(chosen), ["id", "label"]).groupBy("label", "place", "h", "id").agg(F.min("text").alias("text"))
    texts = stored(spark, texts.withColumn("n", F.octet_length("text")), "language-texts")
    got = whole_rows(texts, ["place", "h", "label", "id"], "n", train_bytes, "label").select("id", "label", "text").collect()
    got.sort(key=lambda r: (str(r[0]), r[1]))
    return train([r[2] for r in got], [r[1] for r in got])


def identify(df: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            labels, scores = net.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    arrow_limits(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    """The predicted language of every document; documents whose crc32(doc_id) mod 4 is 2 are held out."""
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(crc_mod("doc_id", 4) != 2))
    return identify(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
