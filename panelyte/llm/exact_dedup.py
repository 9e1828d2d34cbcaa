"""Exact deduplication with streaming keyed state on disk, in DataFrame functions only.

A stream over the rows' digests keeps, for each digest and without expiry, the smallest stable identifier, its
content locator (file and row) and the number of rows, in RocksDB state that is checkpointed to the shared folder.
Rows whose digest was met before are hits; the full bytes of hits are compared by grouping them on digest and whole
text. Only if one digest turns out to stand for several texts is its key split by text.

With a state folder the stream's checkpoint and what it has told are kept, so a later batch of rows goes on from it:
rows are held against all earlier ones, whose texts are read again, through their locators, where the bytes of a hit are
compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelyte.llm.shared import materialize, scratch

SPACE = r"[\x20\x09-\x0D]+"
#: Many small stores: without preallocated files.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def on_files(docs: DataFrame, at: str | None = None) -> DataFrame:
    """docs if its rows have places in files, else docs written to files (at a path, once, where one is given)."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
        return docs
    except AnalysisException:
        if at is None:
            return materialize(docs, "rows")
        write_once(docs, at)
        return docs.sparkSession.read.schema(docs.schema).parquet(at)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def write_once(rows: DataFrame, path: str) -> None:
    """Write rows unless an earlier try of the same run has finished writing them."""
    if not exists(rows.sparkSession, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)


def place() -> Column:
    """Where a row's content is: file and row."""
    return F.concat(F.col("_metadata.file_path"), F.lit("#"), F.col("_metadata.row_index").cast("string"))


def told_keys(out: str, id_type: str, spark: SparkSession, upto: int | None = None) -> DataFrame:
    """(__key, first, n) as the stream has last told them, up to a batch where one is given."""
    told = spark.read.schema(f"__key string, first struct<no_id: boolean, id: {id_type}, __at: string>, n long, batch long").parquet(f"{out}/*")
    told = told if upto is None else told.filter(F.col("batch") <= upto)
    latest = F.max(F.struct("batch", "n", "first"))  # n grows with every batch that updates a key
    return told.groupBy("__key").agg(latest.alias("last")).select("__key", F.col("last.first").alias("first"), F.col("last.n").alias("n"))


def stream_state(log: str, schema, files_per_batch: int, spark, out: str, checkpoint: str) -> DataFrame:
    """(__key, first, n) of all rows of the log, from the stream's state."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_batch)
            .parquet(log)
            .groupBy("__key")
            .agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "__at")).alias("first"), F.count(F.lit(1)).alias("n"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(lambda rows, batch: rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{out}/at={batch}"))
            .start()
            .awaitTermination()
        )
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return told_keys(out, schema["id"].dataType.simpleString(), spark)


def dedup_rows(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    key: Callable[[Column], Column] = lambda digest: digest,
    files_per_batch: int = 4096,
    salts: int = 16,
    state: str | None = None,
    run: str = "0",
) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256, __at) per row of docs; see exact_dedup().

    key maps the SHA-256 of the normalised text to the state's key; a weaker key only makes more hits to compare.
    """
    spark = docs.sparkSession
    norm = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), SPACE, " ")
    rows = on_files(docs, state and f"{state}/rows/{run}").select(F.col(id_col).alias("id"), norm.alias("norm"), place().alias("__at")).withColumn("text_sha256", F.sha2("norm", 256)).withColumn("__key", key(F.col("text_sha256")))
    log_path = f"{state}/digests/{run}" if state else scratch(spark, "digests")
    facts = rows.select("id", "text_sha256", "__key", "__at")
    write_once(facts, log_path)
    facts = spark.read.schema(facts.schema).parquet(log_path)
    out, checkpoint = (f"{state}/told", f"{state}/stream") if state else (scratch(spark, "state"), scratch(spark, "stream"))
    earlier = _before(spark, state, run, out, facts.schema["id"].dataType.simpleString()) if state else None
    keys = stream_state(f"{state}/digests/*" if state else log_path, facts.schema, files_per_batch, spark, out, checkpoint)
    keys = materialize(keys if earlier is None else keys.join(facts.select("__key").distinct(), "__key", "left_semi"), "keys")

    # Hits: their whole texts meet in a grouping that combines copies before the shuffle. The keys of hits are
    # broadcast only where the planner sees that their table is small; else both sides are dealt by key and salt.
    seen = keys.filter("n > 1").select("__key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    hits = rows.withColumn("salt", F.pmod(F.hash("__at"), F.lit(salts))).join(seen, ["__key", "salt"], "left_semi")
    hits = hits.select("__key", "norm")
    if earlier is not None:
        hits = hits.unionByName(_texts_at(spark, earlier.join(seen.select("__key").distinct(), "__key", "left_semi"), text_col, norm))
    texts = materialize(hits.groupBy("__key", "norm").agg(F.count(F.lit(1)).alias("n")).groupBy("__key").agg(F.count(F.lit(1)).alias("texts"), F.sum("n").alias("n")), "hits")
    plain = facts.join(keys, "__key")
    clash = texts.filter("texts > 1").select("__key")
    if not clash.isEmpty():
        if state:
            raise ValueError("a key stands for several texts: a state that is kept holds one text for each key, so keys must tell texts apart")
        plain = plain.join(clash, "__key", "left_anti")
        several = rows.join(clash, "__key", "left_semi")
        split = several.groupBy("__key", "norm").agg(F.min(F.struct(F.isnull("id").alias("no_id"), "id", "__at")).alias("first"), F.count(F.lit(1)).alias("n"))
        plain = plain.unionByName(several.join(split, ["__key", "norm"]).select(plain.columns))
    return plain.select(
        F.col("id").alias("doc_id"),
        F.col("first.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("__at") == F.col("first.__at")).alias("kept"),
        "text_sha256",
        "__at",
    )


def _before(spark: SparkSession, state: str, run: str, out: str, id_type: str) -> DataFrame | None:
    """(__key, first, n) as told before this run, or None for the first one. Where a run begins is written once, so that
    a run that is tried again begins where its first try did."""
    mark = f"{state}/begun/{run}"
    if not exists(spark, f"{mark}/_SUCCESS"):
        last = spark.read.schema("batch long").parquet(f"{out}/*").agg(F.max("batch").alias("last")) if exists(spark, out) else spark.range(1).select(F.lit(None).cast("long").alias("last"))
        last.coalesce(1).write.mode("overwrite").parquet(mark)
    upto = spark.read.parquet(mark).first()["last"]
    return None if upto is None else told_keys(out, id_type, spark, upto)


def _texts_at(spark: SparkSession, keys: DataFrame, text_col: str, norm: Column) -> DataFrame:
    """(__key, norm): the normalised texts at the places that keys (first) name, read from the files they are in."""
    places = materialize(keys.select("__key", F.col("first.__at").alias("__at")), "places")
    files = [r["file"] for r in places.select(F.substring_index("__at", "#", 1).alias("file")).distinct().collect()]  # files, not rows
    if not files:
        return places.select("__key", F.lit("").alias("norm")).limit(0)
    return spark.read.parquet(*files).select(norm.alias("norm"), place().alias("__at")).join(places, "__at").select("__key", "norm")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of docs.

    Texts are equal when identical after each run of ASCII white space became one space; null counts as empty, so
    null and empty texts are copies of each other. Of equal texts the row with the smallest id stays; a null id
    loses against any other, and of rows with the same id the first by place stays, so each group keeps exactly one
    row. Whole texts of any length take part. Empty table: no rows. Other columns, whatever their names, are not
    read.

    state, a folder that all executors share, keeps what is known for a later call with other rows and another name of
    its run: its rows are then copies of earlier ones too, group_size counts those, and an earlier row's smaller id
    keeps it. A call with the name of a run that failed or finished goes on from or repeats that run. The files of
    earlier rows must still be there, as hits are compared with them byte by byte.
    """
    return dedup_rows(docs, **options).drop("__at")


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns, whatever their names."""
    docs = on_files(docs)
    gone = materialize(dedup_rows(docs, **options).filter(~F.col("kept")).select("__at"), "gone")
    rows = docs.select(F.struct("*").alias("row"), place().alias("__at"))
    return rows.join(gone, "__at", "left_anti").select("row.*")
