"""Near-duplicates by word shingles: every pair of a Jaccard similarity of 0.8 or more is linked.

Documents with equal sets of shingles are merged first, so copies cost one row. Candidates
are the links of SimHash fingerprints in vantage-point leaves and, as these reach only the closest
copies, documents that share one of BANDS keys, each of ROWS min-hashes: a pair at similarity 0.8
meets in a key with a probability of 1 - 1.3e-7, one at 0.1 with 4e-4. All candidates are
verified by the true similarity of their shingle sets. First each member of a key is compared with
the key's smallest document; where a key still holds documents of different components, the few
outside its largest component are compared with all of the others. In a crowded key (a passage that many share, say) only those are
compared that share a second crowded key: a pair at similarity 0.8 shares 13 of the 40 keys on average, and a single one with a
probability of 2e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, give_back
from .simhash import majority, near_duplicates, shingle_hashes

SHINGLE_WORDS = 5
BANDS = 40
ROWS = 5
#: Of the 200 min-hashes a pair at similarity 0.8 shares 160 on average, and fewer than this with a probability of 1e-9.
AGREEING = 124
#: So many members outside the largest component of a key are compared with all of it; a key with more is crowded.
FEW = 16
#: The least similarity of a link is NUMERATOR / DENOMINATOR.
NUMERATOR, DENOMINATOR = 4, 5
#: Up to so many keys or ids are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_RNG = np.random.default_rng(5)
_A = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64) | np.uint64(1)
_B = _RNG.integers(0, 2**64, (BANDS * ROWS, 1), dtype=np.uint64)
_C = _RNG.integers(0, 2**64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(0, 2**64, BANDS, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The min-hashes of a set, one for each row of each band."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for a in range(0, len(s), 1024):
        least = np.minimum(least, (s[None, a : a + 1024] * _A + _B).min(1))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One key for each band of min-hashes."""
    h = least.reshape(BANDS, ROWS)
    h = (h ^ (h >> np.uint64(29))) * _C
    return (h ^ (h >> np.uint64(32))).sum(1, dtype=np.uint64) + _BAND


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, th, text``: a row is known by its id and a hash of its text."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("th"), text.alias("text"))


def sketches(docs: DataFrame) -> DataFrame:
    """``doc_id, th, same`` (a hash of the whole set), ``node`` (its first 64 bits), ``fp`` (fingerprint), ``keys`` and ``mins`` (the last byte of each min-hash) of ``doc_id, th, text``."""
    from xxhash import xxh3_128_digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                hashes = [shingle_hashes(t or "", SHINGLE_WORDS) for t in batch.column(2).to_pylist()]
                sets = [np.unique(h) for h in hashes]
                same = [xxh3_128_digest(s.tobytes()) for s in sets]
                nodes = np.frombuffer(b"".join(d[:8] for d in same), np.int64)
                prints = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
                least = [minima(s) for s in sets]
                keys = pa.array([band_keys(m).view(np.int64) if len(s) else np.zeros(0, np.int64) for s, m in zip(sets, least)], pa.list_(pa.int64()))
                mins = pa.array([m.astype(np.uint8).tobytes() for m in least], pa.binary())
                yield pa.record_batch([batch.column(0), batch.column(1), pa.array(same, pa.binary()), pa.array(nodes), pa.array(prints), keys, mins], names=["doc_id", "th", "same", "node", "fp", "keys", "mins"])
        give_back()

    return docs.mapInArrow(run, "doc_id long, th long, same binary, node long, fp long, keys array<long>, mins binary")


def bounded(side: DataFrame) -> DataFrame:
    """``side`` (materialised), broadcast only if it has few rows."""
    return F.broadcast(side) if side.count() <= BROADCAST_ROWS else side


def promising(merged: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose min-hashes agree often enough, so that few sets have to move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, BANDS * ROWS) for i in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array((a == b).sum(1) >= AGREEING))

    sides = pairs.join(merged.select(F.col("node").alias("u"), F.col("mins").alias("a")), "u").join(merged.select(F.col("node").alias("v"), F.col("mins").alias("b")), "v")
    return cut(sides.select("u", "v", "a", "b").mapInArrow(run, "u long, v long"))


def verified(docs: DataFrame, merged: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (nodes u, v; materialised) whose shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sets = [np.unique(shingle_hashes(t or "", SHINGLE_WORDS)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "s"])

    pairs = promising(merged, pairs)
    ids = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    ids = cut(merged.join(ids, "node").select("node", F.col("first.doc_id").alias("d"), F.col("first.th").alias("t")))
    wanted = docs.join(bounded(ids), docs["doc_id"].eqNullSafe(F.col("d")) & (docs["th"] == F.col("t"))).select("node", "text")
    sets = cut(wanted.mapInArrow(run, "id long, s array<long>").dropDuplicates(["id"]))
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    return cut(both.where(shared * (NUMERATOR + DENOMINATOR) >= total * NUMERATOR).select("u", "v").distinct())


def unsettled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the ``links`` leave to compare in keys (``key, node``) that hold several components: (pairs u, v; rows of crowded keys as ``key, node, comp, main``).

    Members of a key's largest component meet only those outside it. A key with more than FEW of these is crowded.
    """
    placed = members.join(components(links).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
    sizes = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n")).groupBy("key")
    mixed = cut(sizes.agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0"))
    rest = cut(placed.join(bounded(mixed), "key"))
    return pairs_of(rest.where(F.col("outside") <= FEW)), rest.where(F.col("outside") > FEW).select("key", "node", "comp", "main")


def pairs_of(rest: DataFrame) -> DataFrame:
    """Pairs (u, v) of different components of a key, one of them outside its main one."""
    a, b = rest.where("comp <> main").select("key", F.col("node").alias("a"), F.col("comp").alias("x")), rest.select("key", F.col("node").alias("b"), F.col("comp").alias("y"))
    return a.join(b, "key").where("x <> y").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows to drop, rows to keep once), both ``doc_id, th`` with th the xxhash64 of the text.

    Of each component the row with the smallest id stays (null ids last, then the smaller hash of the
    text). The second table has those of them that occur more than once. Null and empty texts
    are equal. Two sets of shingles are taken for one if 64 bits of their hashes agree.
    """
    texts = keyed(docs, id_col, text_col)
    rows = cut(sketches(texts))
    name = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "th")
    merged = cut(
        rows.groupBy("same").agg(F.first("node").alias("node"), F.min(name).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("mins").alias("mins"))
    )
    close = near_duplicates(merged.select(F.col("node").alias("doc_id"), "fp")).where("doc_id <> component_id").select(F.col("component_id").alias("u"), F.col("doc_id").alias("v"))
    bands = merged.select("node", F.explode("keys").alias("key"))
    shared = cut(bands.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least"))
    members = cut(bands.join(bounded(shared), "key"))

    stars = cut(members.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).unionByName(close).distinct())
    links = verified(texts, merged, stars)
    near, crowded = unsettled(members.select("key", "node"), links)
    links = links.unionByName(verified(texts, merged, cut(near.join(stars, ["u", "v"], "left_anti"))))
    if not crowded.isEmpty():
        # two documents of a crowded key also share a second one, or meet in a key that is not crowded
        both = crowded.groupBy("node").agg(F.array_sort(F.collect_list("key")).alias("k")).where("size(k) > 1")
        second = F.flatten(F.transform("k", lambda x, i: F.transform(F.slice("k", i + 2, F.size("k")), lambda y: F.xxhash64(x, y))))
        both = cut(both.select("node", F.explode(second).alias("key")))
        hubs = cut(both.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least <> most").select("key", "least"))
        both = cut(both.join(bounded(hubs), "key"))
        more = cut(both.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v")).distinct())
        links = cut(links.unionByName(verified(texts, merged, more)))
        near, crowded = unsettled(both.select("key", "node"), links)
        rest = near.unionByName(pairs_of(crowded)).distinct()
        links = links.unionByName(verified(texts, merged, cut(rest.join(stars.unionByName(more).distinct(), ["u", "v"], "left_anti"))))

    labels = merged.join(components(links).withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    labels = cut(labels.where("component is not null or copies > 1").select("same", "first", F.coalesce("component", "node").alias("comp")))
    keep = labels.groupBy("comp").agg(F.min("first").alias("keep"))
    groups = cut(labels.join(keep, "comp").select("same", "keep"))
    grouped = cut(rows.join(bounded(groups), "same").select("doc_id", "th", name.eqNullSafe(F.col("keep")).alias("stays")).groupBy("doc_id", "th", "stays").agg(F.count(F.lit(1)).alias("n")))
    return grouped.where("not stays").select("doc_id", "th"), grouped.where("stays and n > 1").select("doc_id", "th")


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the smallest id.

    Row by row: a null id is no protection (null ids come last), rows of equal id and text are copies of
    each other (any one of them stays), and rows that share an id but not the text are told apart. All
    null, empty and blank texts are copies of each other. All columns stay as they are; an
    empty table stays empty.
    """
    drop, once = near_copies(docs, id_col=id_col, text_col=text_col)
    rows = docs.withColumn("__id", F.col(id_col).cast("long")).withColumn("__th", F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))

    def of(side: DataFrame):
        return bounded(side.toDF("__d", "__t")), F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__th") == F.col("__t"))

    rows = rows.join(*of(drop), "left_anti")
    if once.limit(1).count():
        rows = rows.join(*of(once), "left_anti").unionByName(rows.join(*of(once), "left_semi").dropDuplicates(["__id", "__th"]))
    return rows.select(*docs.columns)
