"""A folder that all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, also set for ``checkpoint()``.

    Only where it is unset and one machine does all the work, a temporary folder; on a cluster it must be set.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidecast-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root
