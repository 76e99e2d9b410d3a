"""SimHash near-duplicates by vantage-point partitioning of Hamming space.

Equal fingerprints are merged first, so copies cost one row. A vantage-point tree
fitted on a bounded sample of fingerprints splits the space by distance to one
fingerprint per node: the far side holds everything beyond the radius, the near side
everything up to the radius plus the link distance. By the triangle bound each linked
pair meets in at least one leaf, so leaves can be searched alone, whatever the
sample was. A leaf answers with one edge per linked fingerprint (to the smallest
one it reaches there), never with its pairs; the edges' connected components are
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, components, cut

#: The sample on which the tree is fitted has at least so many rows, and so many for each leaf;
#: at the largest depth that is 1,048,576 fingerprints of 8 bytes.
SAMPLE_ROWS = 32_768
SAMPLE_PER_LEAF = 16
MAX_DEPTH = 16
#: Rows of a leaf that the depth aims at, and rows of a block of a leaf that is still too large.
LEAF_ROWS = 4096
BLOCK_ROWS = 16_384

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_SLOTS = (np.arange(8) * 256).astype(np.int64)


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of the space-joined word shingles in order, repeats included; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(found), max(1, len(found) - words + 1)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[len(found) - n :].tolist()
    return np.fromiter([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, ends)], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of ``h``; none of no hashes."""
    if not len(h):
        return 0
    counts = np.bincount((h.view(np.uint8).reshape(len(h), 8) + _SLOTS).ravel(), minlength=2048).reshape(8, 256)
    bits = (2 * (counts @ _BITS) > len(h)).ravel()
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle_words: int = 3) -> int:
    """64-bit SimHash of the word shingles."""
    return majority(shingle_hashes(text, shingle_words))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint as a signed long). Null texts count as empty: fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle_words) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b))


def split(points: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 8) -> tuple[int, int] | None:
    """Vantage point and radius with the smallest larger side, or None if none divides the points."""
    best, found = len(points), None
    for v in points[rng.integers(0, len(points), tries)]:
        upto = np.cumsum(np.bincount(distance(points, v), minlength=65))
        near = upto[np.minimum(np.arange(65) + reach, 64)]
        worst = np.maximum(near, len(points) - upto)
        r = int(np.argmin(worst))
        if worst[r] < best:
            best, found = int(worst[r]), (int(v), r)
    return found


class Tree:
    """Vantage points and radii in heap order; a leaf is where no node stands."""

    def __init__(self, sample: np.ndarray, depth: int, reach: int):
        self.nodes: dict[int, tuple[int, int]] = {}
        self.reach = reach
        rng = np.random.default_rng(7)

        def grow(at: int, points: np.ndarray, levels: int) -> None:
            if not levels or len(points) < 8:
                return
            if (node := split(points, reach, rng)) is None:
                return
            self.nodes[at] = node
            d = distance(points, np.uint64(node[0]))
            grow(2 * at, points[d <= node[1] + reach], levels - 1)
            grow(2 * at + 1, points[d > node[1]], levels - 1)

        grow(1, sample, depth)

    def leaves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point's index, leaf) for every leaf that a point belongs to."""
        done, todo = [], [(1, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if at not in self.nodes:
                done.append((rows, np.full(len(rows), at, np.int64)))
                continue
            v, r = self.nodes[at]
            d = distance(points[rows], np.uint64(v))
            todo += [(2 * at, rows[d <= r + self.reach]), (2 * at + 1, rows[d > r])]
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])


def links(fp: np.ndarray, rep: np.ndarray, reach: int, rng: np.random.Generator | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges (node, smallest node linked to it here) among distinct fingerprints; ``rep`` has the node of each.

    Larger sets are divided by further vantage points; the rest is compared in
    blocks of rows, and labels spread until they settle.
    """
    rng = rng or np.random.default_rng(11)
    if len(fp) > LEAF_ROWS // 2 and (node := split(fp, reach, rng)) is not None:
        d = distance(fp, np.uint64(node[0]))
        near, far = d <= node[1] + reach, d > node[1]
        if max(near.sum(), far.sum()) < 0.9 * len(fp):
            yield from links(fp[near], rep[near], reach, rng)
            yield from links(fp[far], rep[far], reach, rng)
            return
    step = max(1, (1 << 22) // max(1, len(fp)))
    linked = np.zeros(len(fp), bool)
    for a in range(0, len(fp), step):
        linked[a : a + step] = (distance(fp[a : a + step, None], fp[None, :]) <= reach).sum(1) > 1
    fp, rep = fp[linked], rep[linked]
    if not len(fp):
        return
    label, step = rep.copy(), max(1, (1 << 22) // len(fp))
    while True:
        new = label.copy()
        for a in range(0, len(fp), step):
            close = distance(fp[a : a + step, None], fp[None, :]) <= reach
            new[a : a + step] = np.where(close, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            break
        label = new
    keep = label != rep
    yield rep[keep], label[keep]


def near_duplicates(fps: DataFrame, *, reach: int = 2) -> DataFrame:
    """``doc_id, fp, component_id``: the smallest doc_id reachable over links of ``reach`` bits.

    ``fps`` has ``doc_id, fp``; it should be materialised, as it is read three
    times. Null ids are linked like any other row and never name a component
    (a component of null ids alone has a null id). Repeated rows come out as
    often as they go in; an empty table gives an empty result.
    """
    spark = fps.sparkSession
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    n = distinct.count()
    depth = min(MAX_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / LEAF_ROWS))))))
    sample = bounded_sample(distinct, "fp", max(SAMPLE_ROWS, SAMPLE_PER_LEAF << depth), n).select("fp").toPandas().sort_values("fp")
    tree = Tree(sample["fp"].to_numpy(np.int64).view(np.uint64), depth, reach)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, leaf = tree.leaves(batch.column(0).to_numpy().view(np.uint64))
                yield pa.record_batch([pa.array(leaf), batch.column(0).take(pa.array(rows))], names=["leaf", "fp"])

    placed = cut(distinct.select("fp").mapInArrow(place, "leaf long, fp long"))
    # one row per leaf, at most 2 ** MAX_DEPTH: leaves too large for one task are
    # searched as pairs of blocks
    blocks = [
        (r["leaf"], -(-r["n"] // BLOCK_ROWS))
        for r in placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK_ROWS).collect()
    ]
    if blocks:
        sizes = spark.createDataFrame(blocks, "leaf long, k int")
        placed = placed.join(F.broadcast(sizes), "leaf", "left").withColumn("k", F.coalesce("k", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("k"))
        placed = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        placed = placed.select("leaf", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    else:
        placed = placed.select("leaf", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "fp")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        fp = pdf["fp"].to_numpy(np.int64)
        found = list(links(fp.view(np.uint64), fp, reach))
        u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*found) if found else ((), ())))
        return pd.DataFrame({"u": u, "v": v})

    edges = placed.groupBy("leaf", "a", "b").applyInPandas(search, "u long, v long")
    # fingerprints are the nodes, so rows without an id link others too
    comps = distinct.join(components(edges), F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("comp"))
    groups = comps.join(comps.groupBy("comp").agg(F.min("rep").alias("component_id")), "comp").select("fp", "component_id")
    return fps.join(groups, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, reach: int = 2) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every document.

    Null, empty and blank texts have fingerprint 0; texts of any length are taken whole. Rows with
    null or repeated ids are linked like all others; see ``near_duplicates``.
    """
    fps = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle_words=shingle_words))
    return near_duplicates(fps, reach=reach).select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")
