"""Token ids as Parquet list columns, written in id order and read back selectively.

Files hold one row per document: ``doc_id, shard, shard_start, n_tokens, ids``. The
writer sorts by range of doc_id, so shard numbers and row order follow doc_id; it
sets the row-group and page sizes (small pages carry the page index with which
readers skip), keeps the small, repetitive id vocabulary dictionary-encoded, and
leaves the ascending integer columns to delta encoding (Parquet v2 pages).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import default_vocabulary, encoder
from .common import shared_root

SCHEMA = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"
ARROW = pa.schema(
    [("doc_id", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))]
)


def write_tokens(
    docs: DataFrame,
    path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    row_group_bytes: int = 32 << 20,
    page_bytes: int = 256 << 10,
    codec: str = "zstd",
) -> None:
    """Encode every whole text, end it with ``end_id`` and write ids in ascending doc_id order.

    Null texts count as empty and give just the end id; null ids sort first;
    rows that share an id stay separate rows (in order of their text). Other
    columns are ignored. An empty table writes no rows.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, at, enc = TaskContext.get().partitionId(), 0, encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = [x + end for x in enc.encode_all([t or "" for t in part.column(1).to_pylist()])]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                starts = at + np.cumsum(lengths) - lengths
                at += int(lengths.sum())
                offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.record_batch(
                    [part.column(0), pa.array(np.full(len(ids), shard, np.int32)), pa.array(starts), pa.array(lengths), lists],
                    schema=ARROW,
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    (
        rows.repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(encode, SCHEMA)
        .write.option("compression", codec)
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#ids.list.element", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """The files' rows with ``start``, the ids of all documents before each one.

    The id range is a plain predicate, so row groups and pages outside it are
    skipped; selecting only metadata columns never opens the id pages. Shard
    totals (one row per written file, never per document) give the starts.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    totals = sorted(
        tuple(r) for r in files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    )
    starts, at = [], 0
    for shard, n in totals:
        starts.append((shard, at))
        at += n
    before = spark.createDataFrame(starts, "shard int, before long")
    if first_id is not None:
        files = files.where(F.col("doc_id") >= first_id)
    if last_id is not None:
        files = files.where(F.col("doc_id") <= last_id)
    return files.join(F.broadcast(before), "shard").withColumn("start", F.col("before") + F.col("shard_start")).drop("before")


def ids_digest(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32``, with the checksum over the stored ids."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, offsets = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), np.asarray(lists.offsets)
            offsets = offsets - offsets[0] if len(offsets) else offsets
            sums = [crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files (by default in the shared folder) and return what is read back."""
    spark = docs.sparkSession
    path = path or f"{shared_root(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path, **options)
    return read_tokens(spark, path)
