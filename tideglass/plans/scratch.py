"""A fresh path in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def path(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("name a folder that driver and executors share in spark.checkpoint.dir")
        at = tempfile.mkdtemp(prefix="tideglass-")
        sc.setCheckpointDir(at)
    return f"{at.rstrip('/')}/tideglass-{uuid.uuid4().hex}/{name}"
