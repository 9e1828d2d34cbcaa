"""What the operators of this subpackage share: reading tables, scratch tables, walking texts in tasks."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir. Where that is unset and everything runs
    on one machine (as in tests), in a temporary folder that is then set for the session; on a cluster that is an
    error, as executors would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="panelyte-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/panelyte/{name}-{uuid.uuid4().hex}"


#: Shuffle files go when the query that made them has ended: the written table stands for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder once and go on from the files: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of materialized tables that no later plan reads."""
    for t in tables:
        target = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        target.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(target, True)


def fold_of(id_col: str, modulus: int) -> Column:
    """crc32 of the id as decimal text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus


def text_groups(batches, id_col: str, text_col: str, max_chars: int = 1 << 20):
    """Walk Arrow batches in groups of at most max_chars (one text at least): (ids, texts), null texts as ''."""
    for batch in batches:
        ids, texts = batch.column(id_col).to_pylist(), batch.column(text_col)
        lo, size = 0, 0
        held: list = []
        for i in range(len(ids)):
            text = texts[i].as_py()
            text = b"" if text is None and pa.types.is_binary(texts.type) else ("" if text is None else text)
            if held and size + len(text) > max_chars:
                yield ids[lo:i], held
                lo, size, held = i, 0, []
            held.append(text)
            size += len(text)
        if held:
            yield ids[lo:], held
