"""Language identification by a convolutional network over bytes.

Filters of several widths slide over the bytes of fixed-length windows; the rectified
maximum of each filter over a window goes into a softmax over the languages. The network is trained
in numpy on windows of a bounded sample of labelled documents. A text is cut into
windows that together hold every place a filter can stand, and the mean of their
log-probabilities names its language, so long texts are read whole.

A filter over one-hot bytes is a sum of table rows, one table for each of its places.
For texts the tables of neighbouring places are added up once for all pairs of bytes,
so that all filters take two table rows and a byte's row for each place of a text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

WIDTHS = (2, 3, 4)
FILTERS = 16
#: Bytes of a window, and the places of the widest filter in it; the next window begins so many bytes later.
WINDOW = 256
PLACES = WINDOW - WIDTHS[-1] + 1
#: Bounds of what is learned from: documents of a language (chosen by hash), windows of each, languages (the most frequent).
TRAIN_ROWS = 1_500
TRAIN_WINDOWS = 3
LANGUAGES = 256
STEPS = 900
BATCH = 64
UNKNOWN = "und"

_PLAIN = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    if _PLAIN.search(text):
        return True
    import regex

    return not text.isascii() and regex.search(r"\p{L}", text.decode("utf-8", "replace")) is not None


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts, in lower case (A-Z), as one array of bytes with zeros behind each; the start of every window and the text it is of."""
    counts = np.array([max(1, math.ceil((len(t) - WIDTHS[-1] + 1) / PLACES)) for t in texts], np.int64)
    sizes = counts * PLACES + WIDTHS[-1] - 1
    flat = np.frombuffer(b"".join(t.lower().ljust(n, b"\0") for t, n in zip(texts, sizes.tolist())), np.uint8)
    first = np.cumsum(sizes) - sizes
    own = np.repeat(np.arange(len(texts)), counts)
    within = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    return flat, first[own] + within * PLACES, own


class Network:
    """``tables[w][j]``: of each byte, its part in the filters of width w at their place j."""

    def __init__(self, classes: int, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.tables = [[rng.normal(0, w**-0.5, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        n = len(WIDTHS) * FILTERS
        self.out, self.out_bias = rng.normal(0, n**-0.5, (n, classes)).astype(np.float32), np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*(t for side in self.tables for t in side), self.bias, self.out, self.out_bias]

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maxima (before rectifying) of all filters over windows ``x`` (rows of bytes), and where they are."""
        most, at = [], []
        for w, side, bias in zip(WIDTHS, self.tables, self.bias):
            z = sum(table[x[:, j : j + PLACES]] for j, table in enumerate(side))
            where = z.argmax(1)
            most.append(np.take_along_axis(z, where[:, None], 1)[:, 0] + bias)
            at.append(where)
        return np.concatenate(most, 1), np.stack(at, 1)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy of windows ``x`` with classes ``y``, and its gradient by each of ``parameters()``."""
        most, at = self.pooled(x)
        h = np.maximum(most, 0)
        p = softmax(h @ self.out + self.out_bias)
        loss = -np.log(p[np.arange(len(y)), y] + 1e-30).mean()
        p[np.arange(len(y)), y] -= 1
        g = p / len(y)
        back = ((g @ self.out.T) * (most > 0)).reshape(len(x), len(WIDTHS), FILTERS)
        grads, rows, each = [], np.arange(len(x))[:, None], np.arange(FILTERS)
        for i, side in enumerate(self.tables):
            for j, table in enumerate(side):
                grad = np.zeros_like(table)
                np.add.at(grad, (x[rows, at[:, i] + j], each), back[:, i])
                grads.append(grad)
        return float(loss), [*grads, back.sum(0), h.T @ g, g.sum(0)]

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 4) -> Network:
        """Adam over windows drawn equally from all classes; the rate falls to nothing."""
        rng, params = np.random.default_rng(seed), self.parameters()
        of_class = [np.flatnonzero(y == c) for c in range(len(self.out_bias))]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for t in range(1, steps + 1):
            pick = np.array([rng.choice(of_class[c]) for c in rng.permutation(max(BATCH, len(of_class))) % len(of_class)])
            _, grads = self.loss(x[pick], y[pick])
            rate = 0.01 * (1 - (t - 1) / steps)
            for p, g, a, b in zip(params, grads, m, v):
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate / (1 - 0.9**t)) * a / (np.sqrt(b / (1 - 0.99**t)) + 1e-7)
        return self


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Reader:
    """A trained network with its tables added up for pairs of bytes."""

    def __init__(self, net: Network):
        self.net = net
        two, three, four = net.tables
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(-1, FILTERS)
        self.near = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], 1)
        self.far, self.third = pair(four[2], four[3]), three[2]

    def log_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean log-probabilities of each text's windows, one row a text."""
        flat, starts, own = windows(texts)
        pairs = flat[:-1].astype(np.uint16) * np.uint16(256) + flat[1:]
        total = np.zeros((len(texts), len(self.net.out_bias)))
        for lo in range(0, len(starts), 64):
            at = starts[lo : lo + 64, None] + np.arange(PLACES)
            z = self.near[pairs[at]]
            z[:, :, FILTERS : 2 * FILTERS] += self.third[flat[at + 2]]
            z[:, :, 2 * FILTERS :] += self.far[pairs[at + 2]]
            h = np.maximum(z.max(1) + self.net.bias.ravel(), 0)
            p = softmax((h @ self.net.out + self.net.out_bias).astype(float))
            np.add.at(total, own[lo : lo + 64], np.log(p + 1e-12))
        return total / np.bincount(own, minlength=len(texts))[:, None]


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 4 is 2; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, windows, number of each one's language): at most TRAIN_WINDOWS of at most about TRAIN_ROWS documents of a language."""
    known = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return [], np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64)
    share = F.create_map(*(F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, TRAIN_ROWS / n) * (1 << 30)))))
    place = F.pmod(F.xxhash64(F.lit(29), "id", F.xxhash64("text")), F.lit(1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(lang, w) for lang, text in zip(*(c.to_pylist() for c in batch.columns)) if has_letter(text) for w in some_windows(text)]
            yield pa.record_batch([pa.array([x for x, _ in found], pa.string()), pa.array([w for _, w in found], pa.binary())], names=["lang", "w"])

    chosen = known.where(place < share[F.col("lang")]).select("lang", "text").mapInArrow(run, "lang string, w binary")
    # the hash only leaves a little over the bound; where many rows are equal, the limit holds
    rows = cut(chosen).limit(2 * TRAIN_ROWS * TRAIN_WINDOWS * len(counts)).toPandas().sort_values(["lang", "w"])
    langs = sorted(set(rows["lang"]))
    return langs, np.frombuffer(b"".join(rows["w"]), np.uint8).reshape(-1, WINDOW), np.array([langs.index(x) for x in rows["lang"]], np.int64)


def some_windows(text: bytes) -> list[bytes]:
    """At most TRAIN_WINDOWS windows of a text, chosen by hash."""
    flat, starts, _ = windows([text])
    rng = np.random.default_rng(crc32(text))
    return [flat[a : a + WINDOW].tobytes() for a in rng.choice(starts, min(len(starts), TRAIN_WINDOWS), replace=False).tolist()]


def identify_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every document.

    Learns from the text and language of rows whose id is there and not held out: a sample by hash of about TRAIN_ROWS rows of each
    of the LANGUAGES most frequent languages. Texts of any length are read whole. Null texts and those without a letter are
    ``und`` with score 0, as are all where there is no language to learn; with one language alone its score is 1. Repeated rows and null ids stay and get
    equal answers; columns of other names are ignored; an empty table gives no rows.
    """
    langs, x, y = training_windows(docs, id_col, text_col, lang_col)
    net = Network(len(langs)).fit(x, y) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([UNKNOWN] * len(texts), object)
            score = np.zeros(len(texts))
            asked = [i for i, t in enumerate(texts) if reader and t and has_letter(t)]
            for lo in range(0, len(asked), 256):
                part = asked[lo : lo + 256]
                p = softmax(reader.log_probabilities([texts[i] for i in part]))
                found[part] = [langs[c] for c in p.argmax(1)]
                score[part] = p.max(1)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.string()), pa.array(np.minimum(score, 1.0))], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double").select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
