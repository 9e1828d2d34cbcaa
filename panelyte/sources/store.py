"""Intermediate tables on the storage that the cluster shares, for plans that read one result several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir. Where that is unset it is set to a temporary folder if everything runs on
    one machine; on a cluster that is an error, as each executor would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelyte-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelyte/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "panel") -> DataFrame:
    """df written once and read again: later plans scan its files, with their own columns and filters, instead of
    computing it once for each use, and a lost executor costs a read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
