"""A training corpus from ``documents``: five stages, each a whole pass over what the last one kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm.common import read_table, shared_root
from tidecast.llm.decontaminate import decontaminate
from tidecast.llm.line_dedup import dedup_lines
from tidecast.llm.near_copies import drop_near_copies
from tidecast.llm.packing import pack
from tidecast.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go, row by row.

    Null and empty texts are scored like all others (they have no evidence); texts are taken whole. Repeated rows get
    equal scores; null ids, and other columns of any name, stay as they are. An empty table stays empty.
    """
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand earlier in the corpus go; all documents stay, with the length of what is left in ``n_chars``, where there is such a column.

    Null texts stay null, a text whose lines all go becomes empty. Earlier is a smaller id (null first), then an earlier
    line; rows of equal id and text are one document. Texts and lines may have any length. An empty table stays empty.
    """
    out = dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the smallest id (null last): 5-word shingles, Jaccard similarity of 0.8.

    Row by row: rows of equal id and text are copies, other texts under the id of a copy stay. Null, empty and blank
    texts are copies of each other. Texts are taken whole. An empty table stays empty.
    """
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, row by row.

    Null and empty texts hold none; null, shared and repeated ids do not matter. Texts are taken whole. An empty table
    stays empty, and an empty benchmark takes nothing away.
    """
    return decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences.

    Null and empty texts are documents of one end id. Long texts are cut into whole sequences first. Repeated rows are packed
    as often as they occur, null ids too. An empty table gives no pieces.
    """
    return pack(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models and token ids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, root = read_table(spark, sf_dir, "documents"), f"{shared_root(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
