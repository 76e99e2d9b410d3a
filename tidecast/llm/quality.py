"""Quality classifier: random-indexing word vectors, pooled per document, and a small network.

Each word has a fixed sparse index vector of +1 and -1 derived from its hash; its context
vector is the sum of the index vectors of its neighbours over the whole corpus. Words
are hashed to a fixed number of rows, so the vectors have a fixed size (BUCKETS x DIMS
floats) at any corpus size. A document is the mean and spread of its words' vectors; a
two-layer network scores it, and a temperature fitted on rows kept from training
calibrates its probabilities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, held_out

BUCKETS = 1 << 14
DIMS = 32
NONZERO = 4
REACH = 2
HIDDEN = 32
#: Bound of the labelled sample on which the network is fitted, on the driver.
TRAIN_ROWS = 20_000
FAN_IN = 64
CHUNK = 256

_TERMS = re.compile(r"\w+|[^\w\s]+")


class Words(dict):
    """word -> row; rows from 1 (row 0 stands for a gap between documents)."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        row = 1 + crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
        if len(word) <= 64:
            self[word] = row
        return row


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(20_003)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for sign, half in ((1, slice(0, NONZERO // 2)), (-1, slice(NONZERO // 2, NONZERO))):
        places = np.argsort(rng.random((BUCKETS, DIMS)), axis=1)[:, half]
        np.put_along_axis(out, places, sign, axis=1)
    out[0] = 0
    return out


def word_rows(text: str, words: Words) -> np.ndarray:
    found = _TERMS.findall(text)
    return np.fromiter(map(words.__getitem__, found), np.int32, len(found))


def add_contexts(rows: np.ndarray, index: np.ndarray, total: np.ndarray) -> None:
    """Add the neighbours' index vectors of each place to its word's context vector."""
    vectors = index[rows]
    near = np.zeros_like(vectors)
    for k in range(1, REACH + 1):
        near[k:] += vectors[:-k]
        near[:-k] += vectors[k:]
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered = rows[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    total[ordered[first]] += np.add.reduceat(near[order], first, axis=0)


def context_vectors(docs: DataFrame, text_col: str) -> np.ndarray:
    """Context vectors over all documents: one partial matrix per task, summed in a tree."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, index, total = Words(), index_vectors(), np.zeros((BUCKETS, DIMS))
        gap, held, n = np.zeros(REACH, np.int32), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    held += [word_rows(text, words), gap]
                    n += len(held[-2]) + REACH
                if n > 200_000:
                    add_contexts(np.concatenate(held), index, total)
                    held, n = [], 0
        if held:
            add_contexts(np.concatenate(held), index, total)
        if total.any():
            parts = [total[a : a + CHUNK].tobytes() for a in range(0, BUCKETS, CHUNK)]
            yield pa.record_batch(
                [pa.array(np.full(len(parts), TaskContext.get().partitionId(), np.int64)), pa.array(np.arange(len(parts)), pa.int64()), pa.array(parts, pa.binary())],
                names=["part", "chunk", "v"],
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(v) for v in pdf["v"]], axis=0)
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // FAN_IN], "chunk": [int(pdf["chunk"].iloc[0])], "v": [total.tobytes()]})

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    parts, sums = texts.rdd.getNumPartitions(), texts.mapInArrow(partial, "part long, chunk long, v binary")
    while True:
        sums = sums.groupBy(F.floor(F.col("part") / FAN_IN).alias("to"), "chunk").applyInPandas(add, "part long, chunk long, v binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    total = np.zeros((BUCKETS, DIMS))
    for row in sums.collect():  # BUCKETS x DIMS numbers
        total[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] += np.frombuffer(row["v"]).reshape(CHUNK, DIMS)
    return total


def unit_vectors(total: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    v = np.where(norm > 0, total / np.maximum(norm, 1e-12), 0)
    seen = v[norm[:, 0] > 0]
    return (v - (seen.mean(0) if len(seen) else 0)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, x``: pooled features of each document as float32 bytes."""
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, v = Words(), shared.value
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                rows = word_rows(text or "", words)
                if not len(rows):
                    out.append(np.zeros(2 * DIMS + 1, np.float32).tobytes())
                    continue
                counts = np.bincount(rows) if len(rows) > 4000 else None
                if counts is not None:  # long texts: each word once, weighted
                    distinct = np.flatnonzero(counts)
                    w, own = counts[distinct, None] / len(rows), v[distinct]
                    mean = (w * own).sum(0)
                    spread = np.sqrt(np.maximum(0, (w * own * own).sum(0) - mean * mean))
                else:
                    own = v[rows]
                    mean, spread = own.mean(0), own.std(0)
                out.append(np.concatenate([mean, spread, [np.log1p(len(rows))]]).astype(np.float32).tobytes())
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "x"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, x binary")


class Network:
    """Standardised input, one hidden layer of tanh units, one logit, divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5, epochs: int = 60, batch: int = 256):
        self.constant = (y.sum() + 1) / (len(y) + 2) if len(set(y.tolist())) < 2 else None
        if self.constant is not None:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        kept = rng.random(len(y)) < 0.2  # for the temperature
        if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
            kept = np.zeros(len(y), bool)
        xs, ys = (x[~kept] - self.mean) / self.scale, y[~kept].astype(float)
        self.p = [rng.normal(0, xs.shape[1] ** -0.5, (xs.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, s, t = [0 * p for p in self.p], [0 * p for p in self.p], 0
        for _ in range(max(epochs, -(-1500 * batch // max(1, len(ys))) if len(ys) < 6000 else epochs)):
            order = rng.permutation(len(ys))
            for a in range(0, len(ys), batch):
                xb, yb, t = xs[order[a : a + batch]], ys[order[a : a + batch]], t + 1
                hidden = np.tanh(xb @ self.p[0] + self.p[1])
                g = (1 / (1 + np.exp(-(hidden @ self.p[2] + self.p[3]))) - yb) / len(yb)
                back = np.outer(g, self.p[2]) * (1 - hidden * hidden)
                grads = [xb.T @ back + 1e-4 * self.p[0], back.sum(0), hidden.T @ g + 1e-4 * self.p[2], np.array([g.sum()])]
                for i, grad in enumerate(grads):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * grad, 0.999 * s[i] + 0.001 * grad * grad
                    self.p[i] = self.p[i] - 3e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        self.temperature = 1.0
        z, yk = self.logit(x[kept] if kept.any() else x), (y[kept] if kept.any() else y)
        grid = np.geomspace(0.25, 8, 200)
        losses = [(np.logaddexp(0, z / t) - yk * z / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]
        return z / self.temperature

    def probability(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -500, 500)))


def label_rows(labels: DataFrame, label_col: str, label_id: str) -> DataFrame:
    """One label per document that may be learned from: ``lab_id, y`` (the largest label of a repeated id)."""
    known = labels.where(~held_out(label_id) & F.col(label_col).isNotNull() & F.col(label_id).isNotNull())
    return known.groupBy(F.col(label_id).cast("long").alias("lab_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))


def score_quality(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id", threshold: float = 0.5
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document.

    Learns only from labels whose id is not held out, a sample of at most
    ``TRAIN_ROWS`` by hash of the id. Null and empty texts have the features of
    no words and are scored like the rest; without both classes among the labels
    all scores are the smoothed share of label 1. Repeated rows and null ids stay.
    """
    features = cut(pooled(docs, unit_vectors(context_vectors(docs, text_col)), id_col, text_col))
    known = cut(label_rows(labels, label_col, label_id))
    chosen = bounded_sample(known, "lab_id", TRAIN_ROWS, known.count())
    sample = features.join(F.broadcast(chosen), F.col("doc_id") == F.col("lab_id")).select("doc_id", "x", "y").toPandas().sort_values(["doc_id", "x"])
    x = np.frombuffer(b"".join(sample["x"]), np.float32).reshape(-1, 2 * DIMS + 1).astype(float)
    network = Network(x, sample["y"].to_numpy(int))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float32).reshape(-1, 2 * DIMS + 1).astype(float)
            yield pa.record_batch([batch.column(0), pa.array(network.probability(x))], names=["doc_id", "score"])

    scored = features.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
