"""Tables written once and read again: what is dear to make, or used more than once, outlives lost executors that way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file:" + tempfile.mkdtemp(prefix="pulsewarden-")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def committed(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """df, written as Parquet (to a folder of its own, or to path) and read back."""
    path = path or folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
