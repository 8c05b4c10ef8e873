"""Folders for tables that queries derive and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, tag: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir`` (the warehouse, if that is unset)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/kinetrail-{tag}-{uuid.uuid4().hex}"
