"""Benchmark decontamination by the q-gram lemma.

A document region within k edits of a passage of m characters shares at least
m - q + 1 - k q of the passage's q-grams, all on nearby diagonals (place in the document minus
place in the item). Shared q-grams are counted by item in overlapping diagonal bands; in a
band that has enough of them, each passage of the item (``window`` characters at every
``stride``, and the last ones) is counted by its own places, and passages that reach the
lemma's bound are verified by a banded alignment. Texts are compared as lower-case letters
and digits with single spaces. So every leaked run of window + stride - 1 normalised characters
(95 by default; the whole item if it is shorter) within the edits is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back

FILTER_BITS = 22
#: Characters of benchmark items in one index (about 25 bytes each, broadcast), and how many indexes are alive at once.
BLOCK_CHARS = 2_000_000
BLOCKS_AT_ONCE = 8
#: Characters of documents that are searched together, pairs of equal q-grams and passages that are held at once.
BATCH_CHARS = 1 << 18
PAIRS = 1 << 20
PASSAGES = 2048

_P = 0x9E3779B97F4A7C15
_SPACE = 32


@dataclass(frozen=True)
class Settings:
    """``q`` is a power of two. A passage of m characters may differ by ``edit_rate`` x m edits, and by no more
    than the lemma can show, (m - q) / q."""

    q: int = 8
    window: int = 80
    stride: int = 16
    edit_rate: float = 0.08

    def edits(self, m: int) -> int:
        return max(0, min(int(m * self.edit_rate), (m - self.q) // self.q))

    def bound(self, m: int) -> int:
        return m - self.q + 1 - self.edits(m) * self.q

    def starts(self, length: int) -> list[int]:
        last = max(0, length - self.window)
        return [*range(0, last, self.stride), last]


@cache
def folded() -> np.ndarray:
    """For each code point its lower case (the first of several), or 0 if that is no letter or digit."""
    low = [chr(c).lower()[0] for c in range(0x110000)]
    return np.array([ord(c) if c.isalnum() else 0 for c in low], np.uint32)


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised characters and the place of each in the text (spaces: the place after the word)."""
    f = folded()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = f != 0
    keep = word.copy()
    keep[1:] |= word[:-1]
    places = np.flatnonzero(keep)
    if len(places) and not word[places[-1]]:
        places = places[:-1]
    return np.where(word[places], f[places], np.uint32(_SPACE)), places


def normalise(text: str) -> str:
    return normalised(text)[0].tobytes().decode("utf-32-le", "surrogatepass")


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all q-grams, by doubling."""
    h, width, p = codes.astype(np.uint64), 1, _P
    while width < q:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * np.uint64(p) + h[width:]
        p, width = p * p % (1 << 64), 2 * width
    return h


def align(patterns: np.ndarray, texts: np.ndarray, low: int, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least edits of each whole pattern (n x m) against a piece of its text (n x (m + width)), for all n at once.

    Column j of a text is the character under diagonal ``low`` + j of the pattern's first
    character. The piece may start on any diagonal if ``free``, else on diagonal 0.
    Returns the edits and the length of text from diagonal 0's first character to the piece's end.
    """
    n, m = patterns.shape
    width = texts.shape[1] - m
    steps = np.arange(width, dtype=np.int32)
    far = np.int32(m + width)
    diagonal = steps + low
    row = np.zeros((n, width), np.int32) if free else np.broadcast_to(np.where(diagonal >= 0, diagonal, far), (n, width)).astype(np.int32)
    for i in range(m):
        new = row + (texts[:, i : i + width] != patterns[:, i : i + 1])
        if not free:
            new[:, diagonal + i < 0] = far  # before the text's first character
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    j = row.argmin(1)
    return row[np.arange(n), j], j + low + m


class Index:
    """The q-grams of a block of items (normalised characters); items of fewer than q characters match nothing."""

    def __init__(self, items: list, texts: list[np.ndarray], settings: Settings):
        self.settings, self.items = settings, items
        starts = [self.distinct(t, settings) for t in texts]
        # places of q-grams that a passage needs: all, but in items that repeat themselves
        offsets = [self.needed(s, len(t), settings) for s, t in zip(starts, texts)]
        lengths = np.array([len(o) for o in offsets], np.int64)
        keys = np.concatenate([np.zeros(0, np.uint64), *(qgrams(t, settings.q)[o] for t, o in zip(texts, offsets))])
        item = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
        offset = np.concatenate([np.zeros(0, np.int32), *offsets]).astype(np.int32)
        order = np.argsort(keys, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.text = np.concatenate([np.zeros(0, np.uint32), *texts])
        ends = np.cumsum([0, *map(len, texts)])
        self.start, self.length = ends[:-1], np.diff(ends)
        m = np.minimum(self.length, settings.window)
        self.bound = np.array([max(1, settings.bound(int(x))) for x in m], np.int64)
        self.most_edits = max((settings.edits(int(x)) for x in m), default=0)
        self.band = self.most_edits + 1
        self.longest = int(self.length.max(initial=0))
        self.passage_count = np.array([len(x) for x in starts], np.int64)
        self.passage_first = np.cumsum(self.passage_count) - self.passage_count
        self.passage_start = np.concatenate([np.zeros(0, np.int64), *starts]).astype(np.int64)
        #: beyond both ends of a document, and between two of them: more than any passage can bridge
        self.margin = 4 * (settings.window + 2 * self.band)

    @staticmethod
    def distinct(text: np.ndarray, settings: Settings) -> np.ndarray:
        """Starts of an item's passages, the first of equal ones: what matches one of them matches the first."""
        starts, m = np.array(settings.starts(len(text))), min(len(text), settings.window)
        if len(starts) < 2:
            return starts
        views = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, m)[starts])
        return starts[np.sort(np.unique(views.view([("", views.dtype)] * m).ravel(), return_index=True)[1])]

    @staticmethod
    def needed(starts: np.ndarray, length: int, settings: Settings) -> np.ndarray:
        """Places of the q-grams of the passages at ``starts``."""
        grams, own = max(0, length - settings.q + 1), max(0, min(length, settings.window) - settings.q + 1)
        steps = np.zeros(length + 1, np.int64)
        np.add.at(steps, starts, 1)
        np.add.at(steps, starts + own, -1)
        return np.flatnonzero(np.cumsum(steps)[:grams] > 0)

    def first_of_repeats(self, codes: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Those of the places ``at`` that some region needs which is not the same as an earlier one of its text.

        A region that stands earlier in the text has been found there, so repetitive texts cost no more than what they repeat.
        """
        reach = 1 << int(self.settings.window + 2 * self.band).bit_length()
        h = qgrams(codes, reach) + owner[: max(0, len(codes) - reach + 1)].astype(np.uint64) * np.uint64(_P)
        new = np.ones(len(codes), np.int64)
        new[: len(h)] = 0
        new[np.unique(h, return_index=True)[1]] = 1
        upto = np.cumsum(new)
        return at[upto[at] > np.where(at >= reach, upto[np.maximum(at - reach, 0)], 0)]

    def candidates(self, codes: np.ndarray, first: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of (item, start of the passage, lowest diagonal of its band), some more than once. ``first``: where texts begin."""
        h = qgrams(codes, self.settings.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[k] == h[at]
        at, k = at[hit], k[hit]
        if self.count[k].sum() > 4 * len(codes):
            kept = np.isin(at, self.first_of_repeats(codes, np.searchsorted(first, np.arange(len(codes)), "right"), at))
            at, k = at[kept], k[kept]
        pairs = np.cumsum(self.count[k])
        span = (len(codes) + self.longest) // self.band + 2
        # stretches with a bounded number of pairs; they overlap, so that each region of a passage lies whole in one
        overlap, a = self.settings.window + 2 * self.band, 0
        while a < len(at):
            b = int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, "right"))
            b = min(len(at), max(b, int(np.searchsorted(at, at[a] + 2 * overlap))))
            n = self.count[k[a:b]]
            rows = np.repeat(self.first[k[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            item, offset = self.item[rows], self.offset[rows]
            keys = item.astype(np.int64) * span + (np.repeat(at[a:b], n) - offset + self.longest) // self.band
            groups, counts = np.unique(keys, return_counts=True)
            # a band is two neighbouring groups of diagonals, so a region that drifts by less lies whole in one
            wide = np.append((groups[1:] == groups[:-1] + 1) * counts[1:], [0] * min(1, len(groups)))
            good = groups[counts + wide >= self.bound[groups // span]]
            # bands with a bounded number of passages at a time
            sizes = np.cumsum(self.passage_count[good // span])
            lo = 0
            while lo < len(good):
                hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + PAIRS, "right")))
                yield self.passages(good[lo:hi], span, keys, offset)
                lo = hi
            if b == len(at):
                return
            a = max(a + 1, int(np.searchsorted(at, at[b] - overlap)))

    def passages(self, good: np.ndarray, span: int, keys: np.ndarray, offset: np.ndarray) -> np.ndarray:
        """In the bands that begin with the groups ``good``, the passages whose own q-grams reach the bound."""
        size, there = self.longest + 1, []
        for group in (keys, keys - 1):
            g = np.minimum(np.searchsorted(good, group), len(good) - 1)
            own = good[g] == group
            there.append(g[own] * size + offset[own])
        there = np.unique(np.concatenate(there))  # band and place in the item, each once
        item = good // span
        n = self.passage_count[item]
        band = np.repeat(np.arange(len(good)), n)
        start = self.passage_start[np.repeat(self.passage_first[item] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        m = np.minimum(self.length[item[band]], self.settings.window)
        low = band * size + start
        shared = np.searchsorted(there, low + m - self.settings.q + 1) - np.searchsorted(there, low)
        enough = shared >= self.bound[item[band]]
        band, start = band[enough], start[enough]
        return np.stack([item[band], start, good[band] % span * self.band - self.longest], axis=1)

    def verified(self, codes: np.ndarray, found: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(item, start, end, edits) of those passages that align within their edits. ``codes`` has the margin at both ends."""
        sizes = np.minimum(self.length[found[:, 0]], self.settings.window)
        for m in np.unique(sizes).tolist():
            item, start, low = found[sizes == m].T
            k = self.settings.edits(m)
            patterns = self.text[(self.start[item] + start)[:, None] + np.arange(m)]
            base = low - k + start
            edits, length = align(patterns, codes[base[:, None] + np.arange(m + 2 * self.band + 2 * k)], 0, True)
            end = base + length
            good = edits <= k
            item, patterns, edits, end = item[good], patterns[good], edits[good], end[good]
            if len(item):
                # backwards from the end, for the start
                back = end[:, None] - 1 + k - np.arange(m + 2 * k + 1)
                _, length = align(patterns[:, ::-1], codes[back], -k, False)
                yield from zip(item.tolist(), (end - length).tolist(), end.tolist(), edits.tolist())

    def search(self, texts: list[str]) -> list[dict[int, tuple[int, int, int]]]:
        """For each text: item -> (edits, start, end), places in the text's code points, of the passage with the fewest edits, then the first."""
        gap = np.zeros(self.margin, np.uint32)
        parts, places, starts, at = [gap], [], [], self.margin
        for text in texts:
            codes, where = normalised(text)
            parts += [codes, gap]
            places.append(where)
            starts.append(at)
            at += len(codes) + self.margin
        codes, first = np.concatenate(parts), np.array(starts)
        best: list[dict[int, tuple[int, int, int]]] = [{} for _ in texts]

        for found in self.candidates(codes, first):
            for lo in range(0, len(found), PASSAGES):
                for item, a, b, edits in self.verified(codes, found[lo : lo + PASSAGES]):
                    i = int(np.searchsorted(first, b, "right")) - 1
                    if i < 0 or not len(places[i]):
                        continue
                    where, a, b = places[i], a - first[i], min(b - first[i], len(places[i]))
                    one = (edits, int(where[max(0, min(a, len(where) - 1))]), int(where[b - 1]) + 1)
                    best[i][item] = min(best[i].get(item, one), one)
        return best


def batches_of(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) with about BATCH_CHARS characters, at least one text."""
    first, held, chars = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text or "")
        chars += len(held[-1])
        if chars >= BATCH_CHARS or len(held) >= 1024:
            yield first, held
            first, held, chars = i + 1, [], 0
    if held:
        yield first, held


def indexes(benchmark: DataFrame, item_col: str, text_col: str, settings: Settings) -> Iterator[Broadcast]:
    """Broadcast indexes, made one after another, of items whose characters are bounded by BLOCK_CHARS (one longer item stands alone).

    All texts of an item are in one index.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([normalise(t or "") for t in batch.column(1).to_pylist()], pa.string())], names=["item", "piece"])

    rows = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text"))
    pieces = cut(rows.mapInArrow(run, "item long, piece string").where(F.length("piece") >= settings.q).distinct())
    blocks = max(1, -(-(pieces.agg(F.sum(F.length("piece"))).first()[0] or 0) // BLOCK_CHARS))
    for block in range(blocks):
        part = pieces.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).orderBy("item", "piece").toArrow()
        texts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in part["piece"].to_pylist()]
        yield benchmark.sparkSession.sparkContext.broadcast(Index(part["item"].to_pylist(), texts, settings))


def leaks(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``doc_id, item_id, start, end, edits``: benchmark passages in documents.

    One row per row of ``docs`` and item (the passage with the fewest edits, then the
    first), with places in the document's code points; equal rows and null ids each have their own.
    Several texts of one item count as one item. Items of fewer than q normalised characters
    match nothing; null texts count as empty; other columns are ignored; empty tables give
    no rows. Texts of any length are searched in stretches with a bounded number of pairs.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, start long, end long, edits long"

    def pass_of(index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                ids, out = batch.column(0).to_pylist(), []
                for at, texts in batches_of(batch.column(1).to_pylist()):
                    for i, found in enumerate(own.search(texts), at):
                        of_item: dict = {}
                        for k, one in found.items():
                            of_item[own.items[k]] = min(of_item.get(own.items[k], one), one)
                        out += [(ids[i], item, a, b, edits) for item, (edits, a, b) in sorted(of_item.items(), key=str)]
                yield pa.record_batch([pa.array([r[i] for r in out], pa.int64()) for i in range(5)], names=["doc_id", "item_id", "start", "end", "edits"])

        return rows.mapInArrow(run, schema)

    found, alive = None, []
    for index in indexes(benchmark, item_col, item_text_col, settings):
        if len(alive) >= BLOCKS_AT_ONCE:
            found = cut(found)
            for used in alive:
                used.destroy()
            alive.clear()
        alive.append(index)
        found = pass_of(index) if found is None else found.unionByName(pass_of(index))
    return found


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()
) -> DataFrame:
    """``docs`` without the rows in which a benchmark passage is found.

    Row by row, without a join: ids may be null or repeated, and rows that share an id
    with a leaked one stay. Null and empty texts stay; so do all rows if the benchmark
    is empty; an empty table stays empty. All columns stay as they are.
    """
    at, schema = docs.columns.index(text_col), docs.schema

    def pass_of(rows: DataFrame, index: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                clean: list[bool] = []
                for _, texts in batches_of(batch.column(at).to_pylist()):
                    clean += [not found for found in own.search(texts)]
                yield batch.filter(pa.array(clean, pa.bool_()))
            give_back()

        return rows.mapInArrow(run, schema)

    out, alive = docs, []
    for index in indexes(benchmark, item_col, item_text_col, settings):
        if len(alive) >= BLOCKS_AT_ONCE:
            out = cut(out)
            for used in alive:
                used.destroy()
            alive.clear()
        alive.append(index)
        out = pass_of(out, index)
    return out
