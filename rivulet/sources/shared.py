"""A folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir; below the machine's temporary folder only where that is unset, as in tests."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="rivulet-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
