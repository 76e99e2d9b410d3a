"""Periodic runs of words: stretches that repeat themselves at a fixed distance, found by minimizers of several scales.

A run of period q is a maximal stretch whose words at distance q are equal, at least
two periods long. Periods up to LAGS are found by comparing the words with
themselves shifted by each lag. For longer ones, scale by scale (Q, 2Q]: of every Q/2 + 1 neighbouring
grams of Q/2 words the one of the least hash is marked. Inside a run the marks repeat at the distance of
the period, so equal marks at most 2Q apart are the seeds; each is extended to both sides word by word.

A gram that is itself periodic (a third of its length or less) would be marked all over; it is left out, and
the first or last other gram beside such a stretch is marked instead. What this cannot see is a period that lies
wholly within one short-period stretch and returns in the next: these are tried directly where two
such stretches meet, one lag for each whole turn of the shorter period. So every run is found, in a time near to
linear in the words and runs. Documents of one Arrow batch are searched together, a word of its own between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Periods of up to so many words are found by direct comparison; a power of two, 32 or more.
LAGS = 32
#: About so many words are searched together.
BATCH_WORDS = 400_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the stretches of True."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).view(np.int8)))
    return edges[::2], edges[1::2]


def same_length(w: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on (or, with step -1, before them) are equal; i < j."""
    room, done, size = (len(w) - j if step > 0 else i), 0, 64
    while done < room:
        size = min(size, room - done)
        a, b = (i + done, j + done) if step > 0 else (i - done - size, j - done - size)
        differ = w[a : a + size] != w[b : b + size]
        if differ.any():
            return done + int(np.argmax(differ) if step > 0 else np.argmax(differ[::-1]))
        done, size = done + size, min(4 * size, 1 << 20)
    return done


class Search:
    """All runs of ``w`` (whole numbers; equal words, equal numbers) of ``least`` words or more; shorter ones may be among them."""

    def __init__(self, w: np.ndarray, least: int):
        self.w, self.least = w, min(least, LAGS // 2)
        #: (start, end) -> smallest period
        self.runs: dict[tuple[int, int], int] = {}
        #: period -> ends of what has been tried, so that seeds of one stretch are extended once
        self.tried: dict[int, tuple[int, int]] = {}

    def keep(self, start: int, end: int, q: int) -> None:
        if end - start >= max(self.least, 2 * q) and self.runs.get((start, end), q) >= q:
            self.runs[start, end] = q

    def extend(self, m: int, q: int) -> None:
        """The stretch of period ``q`` around word ``m``, which equals that at ``m + q``. Calls of one q come in order of m."""
        low, high = self.tried.get(q, (0, 0))
        if low <= m < high:
            return
        low, high = m - same_length(self.w, m, m + q, -1), m + same_length(self.w, m, m + q, 1)
        self.tried[q] = (low, high)
        self.keep(low, high + q, q)

    def short(self) -> None:
        for q in range(1, min(LAGS, len(self.w) - 1) + 1):
            same = self.w[q:] == self.w[:-q]
            need = max(self.least - q, q)
            if not same[need - 1 :: need].any():  # a stretch of `need` places would hold one of these
                continue
            low, high = stretches(same)
            long = high - low >= need
            for a, b in zip(low[long].tolist(), high[long].tolist()):
                self.keep(a, b + q, q)

    def turning(self, k: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Which grams of ``k`` words have a period of k / 3 or less, and the runs (period, start, end) they lie in."""
        inside = sorted((q, a, b) for (a, b), q in self.runs.items() if 3 * q <= k and b - a >= k)
        steps = np.zeros(len(self.w) - k + 2, np.int64)
        for _, a, b in inside:
            steps[a] += 1
            steps[b - k + 1] -= 1
        return np.cumsum(steps[:-1]) > 0, inside

    def scale(self, size: int, grams: np.ndarray) -> None:
        """Runs of periods over ``size`` and up to twice that; ``grams`` are hashes of size / 2 words from each place."""
        k, self.tried = size // 2, {}
        periodic, inside = self.turning(k)
        windows, places, width = np.where(periodic, np.uint64(2**64 - 1), grams), np.arange(len(grams)), 1
        while width < k + 1:  # the leftmost least of k + 1 grams: windows that double, then overlap
            add = min(width, k + 1 - width)
            a, b = windows[:-add], windows[add:]
            places = np.where(a <= b, places[:-add], places[add:])
            windows, width = np.minimum(a, b), width + add
        edges = np.flatnonzero(periodic[1:] != periodic[:-1])
        marks = np.unique(np.concatenate([places[np.flatnonzero(np.diff(places, prepend=-1))], edges, edges + 1]))
        marks = marks[~periodic[marks]]
        order = np.argsort(grams[marks], kind="stable")
        at, value = marks[order], grams[marks][order]
        back, seeds = 1, []
        while True:  # equal grams stand over k / 3 words apart, so few rounds reach 2 * size
            near = (value[back:] == value[:-back]) & (at[back:] - at[:-back] <= 2 * size)
            if not near.any():
                break
            left, q = at[:-back][near], (at[back:] - at[:-back])[near]
            seeds.append(np.stack([q, left])[:, q > size])
            back += 1
        # stretches of one period overlap by less than that, so only neighbours in this order can meet
        for (p, a, b), (r, c, d) in zip(inside, inside[1:]):
            if r == p and c <= b and (q := self.seam(a, b, c, d, p, size, grams)) is not None:
                seeds.append(q)
        if seeds:
            q, m = np.concatenate(seeds, axis=1)
            order = np.lexsort((m, q))
            for lag, place in zip(q[order].tolist(), m[order].tolist()):
                self.extend(place, lag)

    def seam(self, a: int, b: int, c: int, d: int, p: int, size: int, grams: np.ndarray) -> np.ndarray | None:
        """Two stretches of period ``p``, words a to b and c to d, meet out of step. Lags that bring one onto the other differ by whole turns.

        Where both ends of what is equal are ends of one stretch, the run is known; the lags (and a place) that
        bring two ends onto each other are returned, as more may be equal there.
        """
        k, most = size // 2, min(2 * size, b - a, d - c)
        same = np.flatnonzero(grams[b - k - p + 1 : b - k + 1] == grams[c]) if most > size else []
        if not len(same):
            return None
        q = np.arange(most - (most - (c - (b - k - p + 1 + int(same[0])))) % p, size, -p)
        low, high = np.maximum(a, c - q), np.minimum(b, d - q)
        open_ended = (a == c - q) | (b == d - q)
        for lag, x, y in zip(*(z[(high - low >= q) & ~open_ended].tolist() for z in (q, low, high))):
            self.keep(x, y + lag, lag)
        return np.stack([q, b - q])[:, open_ended & (b < d)]

    def found(self, longest: int) -> np.ndarray:
        """Rows (start, length, period) by start, then period; no text between two separating words is longer than ``longest``."""
        self.short()
        size, k, grams = LAGS, 1, mixed(self.w.astype(np.int64).view(np.uint64) + np.uint64(1))
        while 2 * size < min(longest, len(self.w)):  # a run of a period over `size` is longer than twice that
            while k < size // 2:
                grams = mixed(grams[:-k] * np.uint64(0x9E3779B97F4A7C15) + grams[k:])
                k *= 2
            self.scale(size, grams)
            size *= 2
        rows = np.array([(a, b - a, q) for (a, b), q in self.runs.items()], np.int64).reshape(-1, 3)
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def runs_of(texts: list[bytes | None], least: int = 12) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """For each text (UTF-8) its runs, rows (start, length, period), and its words. Texts of like length are searched together."""
    words = [t.split() if t else [] for t in texts]
    flat = [x for w in words for x in w]
    numbers = pc.dictionary_encode(pa.array(flat, pa.binary())).indices.to_numpy(zero_copy_only=False).astype(np.int64) if flat else np.zeros(0, np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(lengths) - lengths
    found: list[np.ndarray] = [np.zeros((0, 3), np.int64)] * len(texts)
    classes: dict[int, list[int]] = {}
    for i, n in enumerate(lengths.tolist()):
        if n >= least:
            classes.setdefault((n // (2 * LAGS)).bit_length(), []).append(i)
    for members in classes.values():
        parts = [x for i in members for x in (numbers[begins[i] : begins[i] + lengths[i]], np.array([-1 - i]))]
        rows = Search(np.concatenate(parts), least).found(int(lengths[members].max()))
        rows = rows[rows[:, 1] >= least]
        starts = np.cumsum(np.concatenate([[0], lengths[members] + 1]))
        cuts = np.searchsorted(rows[:, 0], starts)
        for j, i in enumerate(members):
            found[i] = rows[cuts[j] : cuts[j + 1]] - np.array([starts[j], 0, 0])
    yield from zip(found, words)


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words, one space between them, without those that a run repeats: all of each run but its first period."""
    if not len(runs):
        return b" ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(steps[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 12) -> DataFrame:
    """``doc_id, n_words, runs, collapsed``: the runs of each text by start, then period, and the text without their repetitions.

    Words are what stands between ASCII white space. A run is at least ``least`` words and two periods long, and its period is
    its smallest; runs may overlap. ``collapsed`` keeps the words, joined by one space, that no run repeats.
    Null, empty and blank texts have no words, no runs and an empty collapsed text. Texts of any length are searched
    whole, in memory of a few dozen bytes a word. Repeated rows and null ids stay; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            # about six bytes a word
            cuts = np.cumsum([len(t or b"") for t in texts]) // (6 * BATCH_WORDS)
            lo = 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + 1)))
                found = list(runs_of(texts[lo:hi], least))
                rows = np.concatenate([r for r, _ in found])
                offsets = np.cumsum([0] + [len(r) for r, _ in found]).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["start", "length", "period"])
                kept = pa.array([collapsed(w, r) for r, w in found], pa.binary()).cast(pa.string())
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), pa.array([len(w) for _, w in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items), kept], names=["doc_id", "n_words", "runs", "collapsed"]
                )
                lo = hi

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")
