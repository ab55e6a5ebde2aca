"""Session settings that the engine expects."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(app: str = "shotlake", **more: str) -> SparkSession:
    """A session in UTC with adaptive execution and Arrow transfer; master and resources come from the submitter."""
    builder = SparkSession.builder.appName(app)
    for key, value in {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true", **more}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder's name in the one that all executors share, spark.checkpoint.dir.  Where that is unset, a local one stands in, under a local master only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shotlake-")
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"
