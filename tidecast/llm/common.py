"""Helpers shared by the training-data operators: inputs, cut lineage, components."""

from __future__ import annotations

import ctypes
import re
import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and one machine does all the work (tests, a laptop) a temporary
    folder is taken; on a cluster it must be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        root = context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidecast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_root(df.sparkSession)
    return df.checkpoint()


def held_out(id_col: str) -> Column:
    """Whether crc32(id as text) mod 3 is 1; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def give_back() -> None:
    """Return what this Python worker has freed to the system: idle workers live on beside the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


#: A task of a round has about so many edges at least.
EDGES = 10_000


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs) as ``(node, component)``.

    Alternates large-star and small-star rounds until nothing changes; the
    component is the smallest node. Nodes without an edge to another node are
    not in the result. Each round is two partial aggregations and two joins
    on node ids, with its result checkpointed.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = cut(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .distinct()
    )
    seen = state(e)
    while seen[0]:
        e = e.coalesce(max(1, seen[0] // EDGES))  # few edges make no many small files a round
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = state(e)
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def bounded_sample(df: DataFrame, key: str, rows: int, of: int) -> DataFrame:
    """About ``rows`` of the ``of`` rows of ``df``, chosen by a hash of ``key``; all of them if there are no more.

    A plain filter: no task sends more than its share to the driver. The final
    limit only cuts what the hash leaves over the bound by chance.
    """
    if of <= rows:
        return df
    share = int(rows / of * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.lit(17), F.col(key)), F.lit(1 << 30)) < share).limit(rows + rows // 8)
