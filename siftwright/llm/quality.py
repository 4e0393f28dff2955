"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. Learned filters slide
over each chunk; each filter's largest response in a chunk is its pooled value. A document's
features are, for each filter, the largest and the mean pooled value over its chunks; a logistic
layer combines them into one probability.

Training takes a bounded sample of labelled rows on the driver. Scoring is a map over all rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from siftwright.llm.common import crc_of, keep_texts, map_texts, table

#: Bytes of a chunk and of its overlap with the next; width and number of the filters.
CHUNK, OVERLAP, WIDTH, FILTERS = 512, 64, 4, 24
#: Labelled rows of each class that training may take.
SAMPLE_ROWS = 1500
#: Documents of a training step, passes over the sample, rate, decay and seed.
BATCH, EPOCHS, RATE, DECAY, SEED = 32, 8, 0.01, 1e-4, 7


def chunks_of(raw: bytes) -> np.ndarray:
    """Overlapping chunks, one per row, as byte values; 256 stands behind the end."""
    step = CHUNK - OVERLAP
    n = max(1, -(-(len(raw) - OVERLAP) // step))
    padded = np.full((n - 1) * step + CHUNK, 256, dtype=np.int16)
    padded[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (step * padded.itemsize, padded.itemsize))


class Network:
    """weights: (WIDTH, 257, FILTERS), the response of a filter to a byte at an offset; bias; the
    logistic layer over largest and mean pooled values."""

    def __init__(self, rng: np.random.Generator | None = None):
        rng = rng or np.random.default_rng(SEED)
        self.weights = rng.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        self.weights[:, 256] = 0
        self.bias = np.zeros(FILTERS, dtype=np.float32)
        self.out = rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32)
        self.shift = np.zeros(1, dtype=np.float32)

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.weights, self.bias, self.out, self.shift]

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter in each chunk (after a rectifier), and its position; some
        chunks at a time."""
        n, most, where = chunks.shape[1] - WIDTH + 1, [], []
        for at in range(0, len(chunks), 64):
            part = chunks[at : at + 64]
            response = self.weights[0][part[:, :n]]
            for k in range(1, WIDTH):
                response += self.weights[k][part[:, k : k + n]]
            where.append(response.argmax(1))
            most.append(np.take_along_axis(response, where[-1][:, None], 1)[:, 0])
        return np.maximum(np.concatenate(most) + self.bias, 0), np.concatenate(where)

    def pairs(self) -> list[np.ndarray]:
        """The filters as tables over byte pairs, for scoring: two look-ups a position, not four."""
        return [(self.weights[k][:, None] + self.weights[k + 1][None]).reshape(257 * 257, FILTERS) for k in range(0, WIDTH, 2)]

    def logit(self, pooled: np.ndarray) -> float:
        return float(pooled.max(0) @ self.out[:FILTERS] + pooled.mean(0) @ self.out[FILTERS:] + self.shift[0])


def gradients(net: Network, own: list[np.ndarray], y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """Of the weighted mean log loss over documents, each with its chunks, by each of the network's parts;
    with half of DECAY times the squared length of ``out``."""
    chunks, doc = np.concatenate(own), np.repeat(np.arange(len(own)), [len(x) for x in own])
    pooled, where = net.pooled(chunks)
    starts = np.searchsorted(doc, np.arange(len(own)))
    counts = np.diff([*starts, len(doc)])[:, None]
    top = np.maximum.reduceat(pooled, starts)
    avg = np.add.reduceat(pooled, starts) / counts
    feats = np.concatenate([top, avg], 1)
    p = 1 / (1 + np.exp(-np.clip(feats @ net.out + net.shift[0], -30, 30)))
    dz = w * (p - y) / w.sum()
    dfeat = dz[:, None] * net.out
    is_top = pooled >= top[doc]
    dpool = (is_top * dfeat[doc, :FILTERS] + (dfeat[:, FILTERS:] / counts)[doc]) * (pooled > 0)
    grads = [np.zeros_like(net.weights), dpool.sum(0), feats.T @ dz + DECAY * net.out, dz.sum(keepdims=True)]
    rows = np.arange(len(chunks))[:, None]
    for k in range(WIDTH):
        np.add.at(grads[0][k], (chunks[rows, where + k], np.arange(FILTERS)), dpool)
    return grads


def fit(texts: list[str], labels: list[int], weights: list[float]) -> Network:
    """Trains by Adam on weighted log loss, each step over all chunks of its documents, as scores are
    taken. Deterministic for given rows in given order."""
    rng = np.random.default_rng(SEED)
    net = Network(rng)
    docs = [chunks_of(t.encode("utf-8", "replace")) for t in texts]
    y, w = np.array(labels, dtype=np.float32), np.array(weights, dtype=np.float32)
    mean, square = [np.zeros_like(p) for p in net.parts], [np.zeros_like(p) for p in net.parts]
    t = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            picked = order[at : at + BATCH]
            grads = gradients(net, [docs[i] for i in picked], y[picked], w[picked])
            t += 1
            rate = RATE * (1 - 0.9 * epoch / EPOCHS)
            for part, g, m, s in zip(net.parts, grads, mean, square):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                part -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
            net.weights[:, 256] = 0
    return net


class Scorer:
    """Scores whole texts for one task, a bounded number of chunks at a time."""

    BLOCK = 64

    def __init__(self, net: Network):
        self.net, self.tables = net, net.pairs()

    def pooled(self, chunks: np.ndarray) -> np.ndarray:
        pair = chunks[:, :-1].astype(np.int32) * 257 + chunks[:, 1:]
        n = chunks.shape[1] - WIDTH + 1
        response = np.take(self.tables[0], pair[:, :n], 0)
        for k in range(1, WIDTH // 2):
            response += np.take(self.tables[k], pair[:, 2 * k : 2 * k + n], 0)
        return np.maximum(response.max(1) + self.net.bias, 0)

    def score(self, text: str | None) -> float:
        """Probability of label 1. A null or empty text is one chunk of padding."""
        chunks = chunks_of((text or "").encode("utf-8", "replace"))
        top, total = np.zeros(FILTERS, dtype=np.float32), np.zeros(FILTERS, dtype=np.float64)
        for at in range(0, len(chunks), self.BLOCK):
            part = self.pooled(chunks[at : at + self.BLOCK])
            top = np.maximum(top, part.max(0))
            total += part.sum(0)
        z = float(top @ self.net.out[:FILTERS] + (total / len(chunks)) @ self.net.out[FILTERS:] + self.net.shift[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: DataFrame, labels: DataFrame) -> Network:
    """Fits on at most SAMPLE_ROWS labelled rows of each class, first in hash order, that are not
    held out. Rows are weighted so that the classes keep their share of all such rows.

    Ids are chosen before texts are read, so only the chosen ids (at most 2 x SAMPLE_ROWS) are
    broadcast and only their texts come to the driver. Null labels, ids and texts are left out.
    If a class has no row, the network stays as it began but for its share of label 1.
    """
    ours = labels.select("doc_id", "quality").filter((crc_of("doc_id") % 3 != 1) & F.col("quality").isin(0, 1)).distinct()
    share = {r["quality"]: r["count"] for r in ours.groupBy("quality").count().collect()}
    chosen = None
    for value in (0, 1):
        own = ours.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        chosen = own if chosen is None else chosen.unionByName(own)
    known = docs.select("doc_id", "text").filter((crc_of("doc_id") % 3 != 1) & F.col("text").isNotNull())
    rows = known.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "text").collect()
    rows = sorted((r["doc_id"], r["quality"], r["text"]) for r in rows)
    have = {v: sum(r[1] == v for r in rows) for v in (0, 1)}
    if not have[0] or not have[1]:
        net = Network()
        net.out[:] = 0
        net.shift[0] = np.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))
        return net
    weight = {v: share[v] / have[v] for v in (0, 1)}
    return fit([r[2] for r in rows], [r[1] for r in rows], [weight[r[1]] for r in rows])


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score, predicted for every whole text; null and empty texts too."""

    def make():
        scorer = Scorer(net)
        return lambda texts: [pa.array(list(map(scorer.score, texts)), pa.float64())]

    scored = map_texts(docs, make, "score double")
    held = F.coalesce(crc_of("doc_id") % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, net: Network, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more."""

    def make():
        scorer = Scorer(net)
        return lambda text: scorer.score(text) >= least

    return keep_texts(docs, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, train(docs, table(spark, sf_dir, "labels")))
