"""Where intermediate tables go: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and Spark runs in this process."""
    global _own
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    _own = _own or tempfile.mkdtemp(prefix="sparklog-")
    return f"file://{_own}"


def folder(spark: SparkSession, name: str) -> str:
    """A new path in it."""
    return f"{root(spark)}/sparklog/{name}-{uuid.uuid4().hex}"
