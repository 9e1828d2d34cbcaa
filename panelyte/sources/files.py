"""Readers and sinks of bar files, statements, news, weight configurations, metric stores and trade logs."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_SCHEMA = "datetime date, open double, high double, low double, close double, volume double, openinterest double, amount double, amplitude double, change_percent double, change_amount double, turnover_rate double"

#: Localised headers of raw bar files.
RAW_HEADERS = {"日期": "date", "开盘": "open", "收盘": "close", "最高": "high", "最低": "low", "成交量": "volume", "成交额": "amount", "振幅": "amplitude", "涨跌幅": "change_percent", "涨跌额": "change_amount", "换手率": "turnover_rate"}


def read_bars(spark: SparkSession, folder: str, kinds: tuple[str, ...] = ("qfq", "hfq")) -> DataFrame:
    """(entity, kind, date, …) of files {entity}_{kind}.csv; of an entity's kinds the first listed one counts.

    One scan of all files; the entity and kind come from the file name.
    """
    rows = spark.read.schema(BAR_SCHEMA).csv(f"{folder.rstrip('/')}/*.csv", header=True)
    name = F.regexp_extract("_metadata.file_name", r"^(.+)_([^_]+)\.csv$", 1), F.regexp_extract("_metadata.file_name", r"^(.+)_([^_]+)\.csv$", 2)
    rows = rows.withColumn("entity", name[0]).withColumn("kind", name[1]).filter(F.col("kind").isin(*kinds)).withColumnRenamed("datetime", "date")
    order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    best = rows.groupBy("entity").agg(F.min(order).alias("__best"))
    return rows.join(best, "entity").filter(order == F.col("__best")).drop("__best")


def read_raw_bars(spark: SparkSession, folder: str) -> DataFrame:
    """(entity, kind, standard columns) of folders {entity}/{kind}.csv with localised headers; absent columns null."""
    rows = spark.read.csv(f"{folder.rstrip('/')}/*/*.csv", header=True)
    path = r"([^/]+)/([^/]+)\.csv$"
    out = rows.select(F.regexp_extract("_metadata.file_path", path, 1).alias("entity"), F.regexp_extract("_metadata.file_path", path, 2).alias("kind"), *rows.columns)
    typed = [(F.col(raw).try_cast("date" if name == "date" else "double") if raw in rows.columns else F.lit(None).cast("double")).alias(name) for raw, name in RAW_HEADERS.items()]
    return out.select("entity", "kind", *typed)


def adjustment_factors(raw: DataFrame, forward: DataFrame, backward: DataFrame) -> DataFrame:
    """(entity, date, qfq_factor, hfq_factor): adjusted closes over raw ones."""
    side = lambda df, name: df.select("entity", "date", F.col("close").alias(name))
    both = side(raw, "c").join(side(forward, "f"), ["entity", "date"]).join(side(backward, "b"), ["entity", "date"])
    return both.select("entity", "date", F.try_divide("f", "c").alias("qfq_factor"), F.try_divide("b", "c").alias("hfq_factor"))


def join_statements(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """The first part's rows with the others' columns, prefixed by their names, on the keys."""
    names = list(parts)
    rest = [parts[n].select(*keys, *[F.col(c).alias(f"{n}_{c}") for c in parts[n].columns if c not in keys]) for n in names[1:]]
    return reduce(lambda a, b: a.join(b, keys, "left"), rest, parts[names[0]])


def missing_periods(present: DataFrame, first: str, last: str, needed: int) -> DataFrame:
    """Quarter ends between first and last for which fewer than `needed` kinds (period, kind) are present."""
    spark = present.sparkSession
    quarters = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"), F.expr("interval 3 months"))).alias("q"))
    ends = quarters.select(F.last_day(F.add_months(F.trunc("q", "quarter"), 2)).alias("period"))
    complete = present.groupBy("period").agg(F.count_distinct("kind").alias("n")).filter(F.col("n") >= needed)
    return ends.join(complete, "period", "left_anti")


def write_news(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("date").json(path)


def read_news(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    rows = spark.read.json(path)
    return rows.filter(F.col("date") == date) if date else rows


def weights_as_of(rows: DataFrame, config: DataFrame, fallback: DataFrame) -> DataFrame:
    """rows (grp, date) with the factors and weights valid on their date, else those of the fallback (grp)."""
    valid = config.alias("c")
    hit = rows.join(valid, (rows["grp"] == F.col("c.grp")) & rows["date"].between(F.col("c.valid_from"), F.col("c.valid_to"))).select(rows["*"], F.col("c.factor"), F.col("c.weight"))
    rest = rows.join(hit.select("grp", "date").distinct(), ["grp", "date"], "left_anti").join(fallback.select("grp", "factor", "weight"), "grp")
    return hit.unionByName(rest.select(hit.columns))


class MetricStore:
    """A Parquet table of metrics by key, last write wins; versions are folders, so readers never see half a write."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys

    def _versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        done = [n for n in names if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/v{self._versions()[-1]}")

    def save(self, rows: DataFrame) -> None:
        from panelyte.operators.clean import upsert

        known = self._versions()
        merged = upsert(self.read(), rows, self.keys) if known else rows
        merged.write.mode("overwrite").parquet(f"{self.path}/v{known[-1] + 1 if known else 0}")


def parse_trades(spark: SparkSession, path: str) -> DataFrame:
    """(date, side, entity, qty, price) of log lines `YYYY-MM-DD … BUY|SELL code … qty @ price`; other lines are left."""
    pattern = r"^(\d{4}-\d{2}-\d{2})\S*\s.*?\b(BUY|SELL)\s+(\d{6})\b\D*(\d+)\s*@\s*([0-9.]+)"
    line = spark.read.text(path).filter(F.col("value").rlike(pattern))
    part = lambda k: F.regexp_extract("value", pattern, k)
    return line.select(part(1).cast("date").alias("date"), part(2).alias("side"), part(3).alias("entity"), part(4).cast("long").alias("qty"), part(5).cast("double").alias("price"))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, digest) that changes with any row's content, not with the order of rows."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count(F.lit(1)).alias("rows"), F.bit_xor("h").alias("digest"))


#: Columns of the signals table; a file that lacks some is read with nulls there.
SIGNAL_SCHEMA = "entity string, date date, buy boolean, sell boolean, score double, adjusted_score double, confidence double, factor_name string, factor_value double, industry string, buy_point int, sell_point int, signal_level int, trend_type int"


def write_signals(rows: DataFrame, path: str) -> None:
    """Signals partitioned by year and month of their date; the months in rows are replaced, others stay."""
    dated = rows.withColumn("month", F.date_format("date", "yyyy-MM"))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """Typed signals: columns that the files lack are null, others are cast, unknown ones are left out."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    fields = [f.split(" ") for f in SIGNAL_SCHEMA.split(", ")]
    return rows.select(*[(F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def write_report(table: DataFrame, path: str, form: str = "csv") -> None:
    """A report as CSV with a header or as JSON lines; nested columns become JSON text in a CSV."""
    nested = [f.name for f in table.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
    flat = table.select(*[F.to_json(c).alias(c) if c in nested and form == "csv" else F.col(c) for c in table.columns])
    writer = flat.write.mode("overwrite")
    writer.option("header", True).csv(path) if form == "csv" else writer.json(path)


def read_statements(spark: SparkSession, folder: str, kinds: list[str], key: str) -> DataFrame:
    """Statements of all report dates: files {folder}/{period}/{kind}.csv, the first kind's rows with the others' columns
    prefixed by their kind. One scan for each kind over all periods; a period without a kind has nulls there."""
    parts = {}
    for kind in kinds:
        rows = spark.read.csv(f"{folder.rstrip('/')}/*/{kind}.csv", header=True)
        parts[kind] = rows.withColumn("period", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.csv$", 1))
    return join_statements(parts, [key, "period"])


def new_statements(known: DataFrame, rows: DataFrame) -> DataFrame:
    """known with the rows of report periods that it lacks."""
    return known.unionByName(rows.join(known.select("period").distinct(), "period", "left_anti").select(known.columns))


def of_entities(spark: SparkSession, path: str, entities: list[str], dates: tuple[str, str] | None = None) -> DataFrame:
    """Rows of a Parquet table for the given entities, and dates; both conditions reach the scan."""
    rows = spark.read.parquet(path).filter(F.col("entity").isin(entities))
    return rows if dates is None else rows.filter(F.col("date").between(*[F.lit(d).cast("date") for d in dates]))


def _files_mark(rows: DataFrame) -> str:
    """Digest of the files that rows is read from; empty if it is not read from files alone."""
    paths, spark = sorted(rows.inputFiles()), rows.sparkSession
    if not paths:
        return ""
    conf, seen = spark._jsc.hadoopConfiguration(), hashlib.sha256(rows._jdf.queryExecution().analyzed().canonicalized().toString().encode())
    for p in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(p)
        status = target.getFileSystem(conf).getFileStatus(target)
        seen.update(f"{p} {status.getLen()} {status.getModificationTime()}\n".encode())
    return seen.hexdigest()[:32]


def reused(panel: DataFrame, path: str, inputs: list[DataFrame]) -> DataFrame:
    """panel as stored at path if it was stored for the same inputs, else written there. Inputs read from files are told
    by the files' paths, lengths and times, without a scan; others by a fingerprint of their rows."""
    spark = panel.sparkSession
    marks = "-".join(_files_mark(i) or "-".join(f"{v & (1 << 64) - 1:x}" for v in fingerprint(i).first()) for i in inputs)
    at = f"{path.rstrip('/')}/{marks}"
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        panel.write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def standard_bars(spark: SparkSession, raw_folder: str, path: str, first: str, last: str) -> DataFrame:
    """Raw bars of all entities between two dates written as one Parquet table in the standard columns."""
    rows = read_raw_bars(spark, raw_folder).filter(F.col("date").between(F.lit(first).cast("date"), F.lit(last).cast("date")) & F.col("close").isNotNull())
    rows.repartition("entity").sortWithinPartitions("entity", "date").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_mapped(spark: SparkSession, path: str, columns: dict[str, str], kinds: dict[str, str] | None = None, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """CSV files of a table from elsewhere in this library's names: columns maps its headers to ours, kinds gives types
    (double where none is given; `date` by date_format; `entity` and strings as text). Headers that a file lacks are
    null, others are left out; values that are no number are null."""
    kinds = {"entity": "string", "date": "date"} | (kinds or {})
    raw = spark.read.option("header", True).csv(path)
    typed = lambda c, to: F.to_date(c, date_format) if to == "date" else F.expr(f"try_cast(`{c}` as {to})")
    return raw.select(*[(typed(theirs, kinds.get(ours, "double")) if theirs in raw.columns else F.lit(None).cast(kinds.get(ours, "double"))).alias(ours) for theirs, ours in columns.items()])


def event_history(events: DataFrame) -> DataFrame:
    """(entity, dates, n) of events (entity, date): the distinct dates on which an entity is listed, in order."""
    return events.groupBy("entity").agg(F.sort_array(F.collect_set("date")).alias("dates"), F.count_distinct("date").alias("n"))


class History:
    """An append-only table: every run adds rows of its own, none is rewritten, and a repeated run replaces itself."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def append(self, rows: DataFrame, run: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/run={run}")

    def read(self) -> DataFrame:
        """All rows with the run that wrote them."""
        return self.spark.read.option("mergeSchema", "true").parquet(self.path)
