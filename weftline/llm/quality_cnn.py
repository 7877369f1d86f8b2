"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters of six bytes slide over overlapping 512-byte chunks that cover
the whole document. Each chunk is max-pooled; the maximum and the mean over
the chunks feed a logistic unit, which gives one probability.

Training reads the whole texts of a bounded sample of labelled rows
(``sample_rows`` rows, ``sample_bytes`` of text), because a few thousand
documents fix its few thousand weights; scoring reads all bytes of all documents.

Nulls: a null text is scored as an empty one; rows of ``labels`` with a null
id or label are ignored; several labels of one id count as their minimum.
Without labels of both kinds, the score is the share of good labels (0.5
without any). Documents with a repeated id are scored row by row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import batches
from .textbuf import text_buffer

CHUNK, WIDTH = 512, 6


@dataclass
class Settings:
    filters: int = 16
    embedding: int = 8
    sample_rows: int = 4000
    sample_bytes: int = 48 << 20
    epochs: int = 4
    least_steps: int = 200  # small samples are gone through more often
    batch: int = 64
    rate: float = 0.01
    threshold: float = 0.3
    seed: int = 17


@dataclass
class Model:
    tables: np.ndarray  # WIDTH x 256 x filters: the filters' response to a byte at each offset
    bias: np.ndarray
    weights: np.ndarray
    intercept: float


def chunked(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents laid out on whole chunks, zeros behind each: (bytes, chunk offset of each document, barred starts)."""
    size = np.diff(offsets)
    counts = (size + WIDTH - 1 + CHUNK - 1) // CHUNK
    counts = np.maximum(counts, 1)
    at = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(at[-1]) * CHUNK + WIDTH, np.uint8)
    for i, s in enumerate(size.tolist()):
        if s:
            out[at[i] * CHUNK : at[i] * CHUNK + s] = buf[offsets[i] : offsets[i] + s]
    barred = (at[1:, None] * CHUNK - np.arange(1, WIDTH)).ravel()
    return out, at, barred


def _pooled(z: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """Maximum and mean over each document's chunks of the rectified chunk maxima."""
    r = np.maximum(z, 0)
    return np.hstack([np.maximum.reduceat(r, chunks[:-1]), np.add.reduceat(r, chunks[:-1]) / np.diff(chunks)[:, None]])


def train(texts: list[bytes], labels: np.ndarray, s: Settings) -> Model:
    rng = np.random.default_rng(s.seed)
    emb = rng.normal(0, 0.5, (256, s.embedding)).astype(np.float32)
    fil = rng.normal(0, 0.3, (WIDTH, s.embedding, s.filters)).astype(np.float32)
    bias = np.zeros(s.filters, np.float32)
    share = float(np.clip(labels.mean(), 0.02, 0.98)) if len(labels) else 0.5
    w = np.concatenate([rng.normal(0, 0.1, 2 * s.filters), [np.log(share / (1 - share))]]).astype(np.float32)
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros((WIDTH, 256, s.filters), np.float32), bias, np.zeros(2 * s.filters, np.float32), float(w[-1]))
    params = [emb, fil, bias, w]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    a_pass = len(texts) // s.batch + 1
    epochs = max(s.epochs, -(-s.least_steps // a_pass))
    steps = epochs * a_pass
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), s.batch):
            pick = order[lo : lo + s.batch]
            raw = [texts[i] for i in pick]
            off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
            buf, at, barred = chunked(np.frombuffer(b"".join(raw), np.uint8), off)
            y = labels[pick].astype(np.float32)
            tables = emb @ fil
            n = len(buf) - WIDTH
            z = tables[0][buf[:n]]
            for k in range(1, WIDTH):
                z += tables[k][buf[k : n + k]]
            z += bias
            z[barred] = -1e9
            z = z.reshape(-1, CHUNK, s.filters)
            arg = z.argmax(1)
            top = np.take_along_axis(z, arg[:, None], 1)[:, 0]
            x = _pooled(top, at)
            p = 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
            d = (p - y) / len(pick)
            gw = np.concatenate([x.T @ d + 1e-4 * w[:-1], [d.sum()]]).astype(np.float32)
            dx = d[:, None] * w[:-1]
            counts = np.diff(at)
            doc = np.repeat(np.arange(len(pick)), counts)
            r = np.maximum(top, 0)
            best = r == x[doc, : s.filters]
            dr = dx[doc, s.filters :] / counts[doc, None] + best * dx[doc, : s.filters]
            dr *= top > 0
            pos = arg + np.arange(len(arg))[:, None] * CHUNK
            cols = np.broadcast_to(np.arange(s.filters), pos.shape)
            dt = np.stack([
                np.bincount((buf[pos + k].astype(np.int64) * s.filters + cols).ravel(), dr.ravel(), 256 * s.filters)
                for k in range(WIDTH)
            ]).reshape(WIDTH, 256, s.filters).astype(np.float32)
            grads = [np.einsum("kbf,kef->be", dt, fil), np.einsum("kbf,be->kef", dt, emb), dr.sum(0), gw]
            step += 1
            rate = s.rate * (1 - step / (steps + 1))
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model((emb @ fil).astype(np.float32), bias, w[:-1], float(w[-1]))


class Scorer:
    """Scores slices of texts; two offsets at a time are looked up in tables over byte pairs."""

    BLOCK = 48 * CHUNK

    def __init__(self, model: Model):
        t = model.tables
        self.model = model
        self.pairs = [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, WIDTH, 2)]

    def maxima(self, buf: np.ndarray, barred: np.ndarray) -> np.ndarray:
        out = []
        total = len(buf) - WIDTH
        for lo in range(0, total, self.BLOCK):
            hi = min(lo + self.BLOCK, total)
            b = buf[lo : hi + WIDTH].astype(np.int64)
            pair = b[:-1] * 256 + b[1:]
            n = hi - lo
            z = np.take(self.pairs[0], pair[:n], axis=0)
            for j, table in enumerate(self.pairs[1:], 1):
                z += np.take(table, pair[2 * j : n + 2 * j], axis=0)
            z[barred[(barred >= lo) & (barred < hi)] - lo] = -1e9
            out.append(z.reshape(-1, CHUNK, z.shape[1]).max(1))
        return np.concatenate(out) + self.model.bias

    def __call__(self, column) -> np.ndarray:
        buf, offsets = text_buffer(column)
        buf, at, barred = chunked(buf, offsets)
        x = _pooled(self.maxima(buf, barred), at)
        logit = x.astype(np.float64) @ self.model.weights + self.model.intercept
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, s: Settings, folds: int = 5) -> tuple[list[bytes], np.ndarray]:
    """Whole texts and labels of at most ``sample_rows`` labelled rows outside the held-out fold, in the order of a hash of id and text.

    A row that would pass ``sample_bytes`` ends the sample. Rows of a repeated id count as rows, not ids.
    """
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("label"))
        .where(~batches.held_out(F.col("doc_id"), folds))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample_rows)
    )
    # known: sample_rows rows of two numbers at most; sizes first, so that no text comes to the driver that is not used
    rows = batches.id_and_text(docs).join(F.broadcast(known), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    sizes = rows.select("h", F.octet_length("text").alias("n")).orderBy("h").limit(s.sample_rows).collect()
    total, most = 0, None
    for r in sizes:
        total += r["n"]
        if total > s.sample_bytes:
            break
        most = r["h"]
    if most is None:
        return [], np.zeros(0, np.int64)
    got = rows.where(F.col("h") <= most).orderBy("h").limit(s.sample_rows).select("label", F.col("text").cast("binary").alias("text")).collect()
    return [bytes(r["text"]) for r in got], np.array([r["label"] for r in got], dtype=np.int64)


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> Model:
    s = settings or Settings()
    return train(*training_sample(docs, labels, s), s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""

    def make():
        scorer = Scorer(model)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer(batch.column("text")))], ["doc_id", "score"])

        return work

    return batches.id_and_text(docs).mapInArrow(batches.each_slice(make), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    s = settings or Settings()
    return score(docs, fit(docs, labels, s)).select(
        "doc_id", batches.held_out(F.col("doc_id"), 5).alias("held_out"), "score",
        (F.col("score") >= s.threshold).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The rows of docs that the classifier does not reject, unchanged; one pass, no join back."""
    s = settings or Settings()
    model = fit(docs, labels, s)
    schema = docs.schema

    def run(it):
        scorer = Scorer(model)
        for batch in it:
            at = batch.schema.get_field_index("text")
            for lo, hi in batches.slices(batches.byte_sizes(batch.column(at))):
                part = batch.slice(lo, hi - lo)
                yield part.filter(pa.array(scorer(part.column(at)) >= s.threshold))

    return docs.mapInArrow(run, schema)
