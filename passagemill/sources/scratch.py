"""A folder that driver and executors share, for tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def base(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the context's checkpoint folder; a temporary one only where neither is set and Spark is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        if given.isDefined():
            named = given.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            named = tempfile.mkdtemp(prefix="passagemill-")
        else:
            raise RuntimeError("no folder that driver and executors share is known: set spark.checkpoint.dir")
    return named.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``base``."""
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"
