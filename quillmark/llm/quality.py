"""Quality classifier: a byte-level convolutional network in numpy.

Filters of 8 bytes, 4 apart, run over overlapping chunks of about 256 bytes
that cover the whole document. Each filter's maximum is taken per chunk; the
means and the maxima of these over all chunks give one probability.

A null text scores as an empty one; long texts are scored whole in pieces;
repeated rows score alike; an empty table gives an empty one, and with nothing
to learn from, or one label only, every text has the same score. Null labels are
not learned from.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, learned_from, sample_texts, small_batches, table, texts_of

EMBED, FILTERS = 8, 16
STEP = 4
#: Positions in a group; a chunk is 4 groups and starts 3 groups after the one before.
GROUP, CHUNK_GROUPS, CHUNK_STEP = 16, 4, 3
#: Bound of the labelled sample that the network is fitted on: texts in hash order, of any length, until one bound is met.
SAMPLE_ROWS = 1200
SAMPLE_BYTES = 4_000_000
EPOCHS = 10
THRESHOLD = 0.3


@dataclass
class Network:
    embed: np.ndarray
    left: np.ndarray
    right: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.left, self.right, self.bias, self.out, self.out_bias]


def _new(rng: np.random.Generator) -> Network:
    f32 = np.float32
    n = STEP * EMBED
    embed = rng.normal(0, 0.5, (256, EMBED)).astype(f32)
    embed[0] = 0
    w = lambda *s: rng.normal(0, (2 / (2 * n)) ** 0.5, s).astype(f32)
    return Network(embed, w(n, FILTERS), w(n, FILTERS), np.zeros(FILTERS, f32), np.zeros(2 * FILTERS, f32), np.zeros(1, f32))


def chunks_of(n: int) -> int:
    """Chunks that cover n bytes."""
    groups = -(-max(n, 1) // (STEP * GROUP))
    return 1 + max(0, -(-(groups - CHUNK_GROUPS) // CHUNK_STEP))


def padded(data: bytes) -> np.ndarray:
    """Bytes as blocks of STEP: the groups of all chunks and one block more."""
    size = STEP * (GROUP * (CHUNK_STEP * (chunks_of(len(data)) - 1) + CHUNK_GROUPS) + 1)
    out = np.zeros(size, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(-1, STEP)


def _groups(net: Network, blocks: np.ndarray) -> np.ndarray:
    """(positions, FILTERS) after the ReLU."""
    x = net.embed[blocks].reshape(len(blocks), -1)
    y = x[:-1] @ net.left
    y += x[1:] @ net.right
    y += net.bias
    return np.maximum(y, 0, out=y)


def _chunk_max(y: np.ndarray) -> np.ndarray:
    """(chunks, FILTERS): maxima over each chunk's positions."""
    g = y.reshape(-1, GROUP, FILTERS).max(axis=1)
    k = (len(g) - CHUNK_GROUPS) // CHUNK_STEP + 1
    return np.stack([g[i : i + CHUNK_STEP * (k - 1) + 1 : CHUNK_STEP] for i in range(CHUNK_GROUPS)]).max(axis=0)


def features(net: Network, data: bytes) -> np.ndarray:
    """Mean and maximum over all chunks; a chunk span at a time, so that a long text needs little memory."""
    blocks = padded(data)
    sums, most = np.zeros(FILTERS), np.zeros(FILTERS, np.float32)
    step = GROUP * CHUNK_STEP * 64
    last = len(blocks) - 1 - GROUP * CHUNK_GROUPS
    for at in range(0, last + 1, step):
        m = _chunk_max(_groups(net, blocks[at : min(at + step - GROUP * CHUNK_STEP, last) + GROUP * CHUNK_GROUPS + 1]))
        sums += m.sum(axis=0)
        most = np.maximum(most, m.max(axis=0))
    return np.concatenate((sums / chunks_of(len(data)), most))


def probability(net: Network, data: bytes) -> float:
    z = float(features(net, data) @ net.out + net.out_bias[0])
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _backward(net: Network, data: bytes, label: int, grads: list[np.ndarray]) -> None:
    """Add the gradient of one document's log loss."""
    blocks = padded(data)
    x = net.embed[blocks].reshape(len(blocks), -1)
    y = np.maximum(x[:-1] @ net.left + x[1:] @ net.right + net.bias, 0)
    k = chunks_of(len(data))
    chunk = GROUP * CHUNK_GROUPS
    views = np.lib.stride_tricks.sliding_window_view(y, chunk, axis=0)[:: GROUP * CHUNK_STEP]
    where = views.argmax(axis=2) + (np.arange(k) * GROUP * CHUNK_STEP)[:, None]
    m = np.take_along_axis(y, where, axis=0)
    best = m.argmax(axis=0)
    h = np.concatenate((m.mean(axis=0), m.max(axis=0)))
    z = float(h @ net.out + net.out_bias[0])
    d = 1 / (1 + np.exp(-z)) - label
    grads[4] += d * h
    grads[5] += d
    dm = np.broadcast_to(d * net.out[:FILTERS] / k, m.shape).copy()
    dm[best, np.arange(FILTERS)] += d * net.out[FILTERS:]
    dm *= m > 0
    at, f = where.ravel(), np.tile(np.arange(FILTERS), k)
    g = dm.ravel()
    grads[3] += dm.sum(axis=0)
    for side, w, j in ((0, net.left, 1), (1, net.right, 2)):
        np.add.at(grads[j].T, f, g[:, None] * x[at + side])
        np.add.at(grads[0], blocks[at + side], (g[:, None] * w.T[f]).reshape(-1, STEP, EMBED))


def train(rows: list[tuple[bytes, int]], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Fit by Adam on (text, label 0 or 1); with one label only, or none, a constant."""
    rng = np.random.default_rng(seed)
    net = _new(rng)
    labels = [y for _, y in rows]
    rate = (sum(labels) + 1) / (len(labels) + 2)
    net.out_bias[0] = np.log(rate / (1 - rate))
    if len(set(labels)) < 2:
        return net
    net.out[:] = rng.normal(0, 0.1, 2 * FILTERS)
    m = [np.zeros_like(p) for p in net.parts()]
    v = [np.zeros_like(p) for p in net.parts()]
    step, batch = 0, 16
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            grads = [np.zeros_like(p) for p in net.parts()]
            some = order[at : at + batch]
            for i in some:
                _backward(net, *rows[i], grads)
            step += 1
            lr = 0.01 * min(1, 2 * (1 - epoch / epochs))
            for p, g, a, b in zip(net.parts(), grads, m, v, strict=True):
                g /= len(some)
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= lr * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            net.embed[0] = 0
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", k: int = 5, r: int = 0, rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Learn from at most ``rows`` whole texts with a label whose crc32(doc_id) mod k is not r, and about ``sample_bytes`` of them.

    The sample is that of the least hashes of doc_id among labelled texts, so
    labels that are repeated or that no text has take no place in it; a
    document with conflicting labels counts once per label. Texts are not cut:
    the last one may go beyond the bytes.
    """
    known = labels.where(F.col(label).isin(0, 1) & learned_from(k, r)).select("doc_id", F.col(label).alias("_qm_y"))
    sample = sorted(sample_texts(docs, known, rows, sample_bytes), key=lambda x: (len(x[1]), x[0], x[2]))
    return train([(text, y) for _, text, y in sample])


def _score(net: Network):
    def run(batches):
        for b in batches:
            p = [probability(net, x) for x in texts_of(b, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p, pa.float64())], names=["doc_id", "score"])

    return run


def scores(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score): every row once; a null text scores as an empty one."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("_qm_b")).mapInArrow(_score(net), f"doc_id {kind}, score double")


def accepted(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that score below ``threshold``; columns unchanged."""

    def run(batches):
        for b in batches:
            keep = [probability(net, x) >= threshold for x in texts_of(b, b.schema.get_field_index("text"))]
            yield b.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs, table(spark, sf_dir, "labels"))
    s = scores(docs, net)
    return s.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
