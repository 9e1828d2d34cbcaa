"""Stores that grow by runs: daily ICs with their ledger and selections, bars with restatements, sentiment scores.

Each run or micro-batch writes folders of its own, so a repeated one overwrites what it wrote, and a reader takes only
what a finished run has signed for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from panelyte.operators.ic import melt, rank_ic, walk_forward


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class ICStore:
    """ICs by date and factor, and the factors selected from them, extended run by run.

    path/ics/month=/run= and path/selected/month=/run= hold the rows, path/ledger/run= the dates that a run has done.
    A run is signed by its ledger, which is written last: rows of a run without a ledger are not read and the next run,
    which has the same number, replaces them. Readers name the months they need, so old partitions are not listed.
    """

    def __init__(self, spark: SparkSession, path: str, factors: list[str], horizon: int, lookback: int, window: int = 60, top: int = 3, families: dict[str, str] | None = None, least: int = 10):
        self.spark, self.path, self.factors = spark, path.rstrip("/"), factors
        self.horizon, self.lookback, self.window, self.top, self.families, self.least = horizon, lookback, window, top, families or {}, least

    def ledger(self) -> DataFrame:
        """(date, run) of the dates done."""
        schema = "date date, run int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/ledger") if exists(self.spark, f"{self.path}/ledger") else self.spark.createDataFrame([], schema)

    def _rows(self, kind: str, schema: str, since=None) -> DataFrame:
        path = f"{self.path}/{kind}"
        if not exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(f"{schema}, month string, run int").parquet(path)
        if since is not None:
            rows = rows.filter((F.col("month") >= since.strftime("%Y-%m")) & (F.col("date") >= F.lit(since)))
        done = self.ledger().select("run").distinct()  # a row for each run
        return rows.join(F.broadcast(done), "run", "left_semi").drop("month", "run")

    def ics(self, since=None) -> DataFrame:
        """(date, factor, ic, n), of the months from `since` on."""
        return self._rows("ics", "date date, factor string, ic double, n long", since)

    def selected(self, since=None) -> DataFrame:
        """(date, factor, ic_mean, ir, direction, weight)."""
        return self._rows("selected", "date date, factor string, ic_mean double, ir double, direction int, weight double", since)

    def update(self, calendar: DataFrame, panel_of: Callable[[object, object], DataFrame]) -> int:
        """Add every date of calendar (date, one row each, complete up to now) that is new; how many were.

        panel_of(first, last) gives the panel (entity, date, factors, target) of a span of dates; it is asked for the
        new dates and the `lookback` before them that factors reach back for, and no others. An IC is computed once its
        forward returns are known, `horizon` dates later; a selection exists for every date."""
        days = [r["date"] for r in calendar.select("date").distinct().orderBy("date").collect()]  # dates, not rows
        done = {r["date"]: r["run"] for r in self.ledger().collect()}
        place = {d: k for k, d in enumerate(days)}
        new = [d for d in days if d not in done]
        if not new:
            return 0
        run, first = max(done.values(), default=-1) + 1, place[new[0]]
        ripe = max(0, first - self.horizon)  # dates whose returns were not known at the last run come first
        part = panel_of(days[max(0, ripe - self.lookback)], days[-1])
        known = days[: len(days) - self.horizon]
        fresh = [d for d in known[ripe:]]
        before = self.ics(days[max(0, first - self.horizon - self.window)]) if done else self.ics()
        if fresh:
            span = part.filter(F.col("date").between(F.lit(fresh[0]), F.lit(fresh[-1])))
            ics = rank_ic(melt(span, self.factors, "target"), ["date", "factor"], self.least)
            self._write(ics.select("date", "factor", "ic", "n"), "ics", run)
            before = before.filter(F.col("date") < F.lit(fresh[0])).unionByName(self.spark.read.schema("date date, factor string, ic double, n long, month string, run int").parquet(f"{self.path}/ics").filter(F.col("run") == run).drop("month", "run"))
        near = self.spark.createDataFrame([(d,) for d in days[max(0, first - self.horizon - self.window) :]], "date date")
        chosen = walk_forward(before, near, self.window, self.horizon, self.top, self.families)
        self._write(chosen.filter(F.col("date") >= F.lit(new[0])), "selected", run)
        self.spark.createDataFrame([(d,) for d in new], "date date").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/run={run}")
        return len(new)

    def _write(self, rows: DataFrame, kind: str, run: int) -> None:
        rows = rows.withColumn("month", F.date_format("date", "yyyy-MM")).withColumn("run", F.lit(run))
        rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "run").parquet(f"{self.path}/{kind}")


class BarTable:
    """Bars by entity from micro-batches that may restate the past.

    A batch's rows of an entity are appended where they are newer than what is stored; where they say nothing new the
    entity is skipped; where the closes of the last `overlap` dates that both have differ by more than tolerance, the
    entity is loaded anew from history(entities) and older rows no longer count. path/rows/batch= holds a batch's rows,
    path/tails/batch= each touched entity's last dates, which is all that the next decision reads. A repeated batch
    decides from the batches before it and overwrites its own folders.
    """

    ROW = "entity string, date date, open double, high double, low double, close double, volume double"

    def __init__(self, spark: SparkSession, path: str, history: Callable[[DataFrame], DataFrame], tolerance: float = 0.01, overlap: int = 3):
        self.spark, self.path, self.history, self.tolerance, self.overlap = spark, path.rstrip("/"), history, tolerance, overlap
        self.columns = [c.strip().split(" ")[0] for c in self.ROW.split(",")]

    def _stored(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.path}/{kind}"
        return self.spark.read.schema(f"{schema}, batch long").parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], f"{schema}, batch long")

    def tails(self, before: int) -> DataFrame:
        """(entity, date, close): the last dates of each entity after the batches below `before`."""
        t = self._stored("tails", "entity string, date date, close double").filter(F.col("batch") < before)
        newest = Window.partitionBy("entity")
        return t.withColumn("newest", F.max("batch").over(newest)).filter("batch = newest").select("entity", "date", "close")

    def decide(self, batch: DataFrame, number: int) -> DataFrame:
        """(entity, action, last): append, skip or reload for each entity of a batch, and its last stored date."""
        old = self.tails(number)
        last = old.groupBy("entity").agg(F.max("date").alias("last"))
        both = batch.select("entity", "date", "close").join(old.withColumnRenamed("close", "was"), ["entity", "date"])
        recent = Window.partitionBy("entity").orderBy(F.desc("date"))
        worst = both.withColumn("k", F.row_number().over(recent)).filter(F.col("k") <= self.overlap).groupBy("entity").agg(F.max(F.abs(F.col("close") - F.col("was"))).alias("worst"))
        each = batch.groupBy("entity").agg(F.max("date").alias("newest")).join(last, "entity", "left").join(worst, "entity", "left")
        action = F.when(F.col("worst") > self.tolerance, "reload").when(F.col("last").isNull() | (F.col("newest") > F.col("last")), "append").otherwise("skip")
        return each.select("entity", action.alias("action"), "last")

    def apply(self, batch: DataFrame, number: int) -> None:
        """Write a micro-batch (also as foreachBatch). Of rows with one entity and date the last by price order counts."""
        at = Window.partitionBy("entity", "date").orderBy(*[F.desc(c) for c in self.columns[2:]])
        batch = batch.select(*self.columns).withColumn("k", F.row_number().over(at)).filter("k = 1").drop("k").persist()
        decided = self.decide(batch, number).persist()
        new = batch.join(decided.filter("action = 'append'"), "entity").filter(F.col("last").isNull() | (F.col("date") > F.col("last"))).select(*self.columns, F.lit(False).alias("whole"))
        again = self.history(decided.filter("action = 'reload'").select("entity")).select(*self.columns, F.lit(True).alias("whole"))
        new.unionByName(again).write.mode("overwrite").parquet(f"{self.path}/rows/batch={number}")
        written = self.spark.read.schema(f"{self.ROW}, whole boolean").parquet(f"{self.path}/rows/batch={number}")
        known = self.tails(number).join(decided.filter("action = 'append'").select("entity"), "entity", "left_semi")
        rows = known.unionByName(written.select("entity", "date", "close"))
        kept = rows.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))).filter(F.col("k") <= self.overlap)
        kept.drop("k").write.mode("overwrite").parquet(f"{self.path}/tails/batch={number}")
        batch.unpersist()
        decided.unpersist()

    def read(self) -> DataFrame:
        """The bars that count: an entity's rows from the batch on that last loaded it whole."""
        rows = self._stored("rows", f"{self.ROW}, whole boolean")
        since = F.coalesce(F.max(F.when(F.col("whole"), F.col("batch"))).over(Window.partitionBy("entity")), F.lit(-1))
        return rows.withColumn("since", since).filter(F.col("batch") >= F.col("since")).select(*self.columns)

    def stream(self, updates: DataFrame, checkpoint: str):
        """Start a stream over bars of ROW; each micro-batch counts exactly once however often it is run."""
        return updates.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class SentimentStore:
    """Daily scores by group (date, industry, score, importance, news), upserted by date and group.

    path/date=/batch= holds a batch's groups of a date; of the batches of a date and group the last counts, so a
    restated group replaces its own row and leaves the others of the day."""

    ROW = "industry string, score double, importance double, news long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, scores: DataFrame, batch: int) -> None:
        """Upsert scores (date and ROW); a repeated batch replaces itself."""
        rows = scores.select("date", "industry", "score", "importance", F.col("news").cast("long").alias("news"), F.lit(batch).alias("batch"))
        rows.repartition("date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date", "batch").parquet(self.path)

    def read(self, start=None, end=None) -> DataFrame:
        """(date, industry, score, importance, news) of a span of dates, whose folders alone are read."""
        if not exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"date date, {self.ROW}")
        rows = self.spark.read.schema(f"{self.ROW}, date date, batch int").parquet(self.path)
        for bound, keep in ((start, lambda d: F.col("date") >= F.lit(d)), (end, lambda d: F.col("date") <= F.lit(d))):
            rows = rows if bound is None else rows.filter(keep(bound).cast("boolean"))
        found = rows.groupBy("date", "industry").agg(F.max(F.struct("batch", "score", "importance", "news")).alias("row"))
        return found.select("date", "industry", "row.score", "row.importance", "row.news")

    def pivot(self, start, end, industries: list[str]) -> DataFrame:
        """A row for each date of the span, a column for each of the groups."""
        return self.read(start, end).groupBy("date").pivot("industry", industries).agg(F.avg("score"))

    def latest_mean(self, days: int = 3) -> DataFrame:
        """(industry, mean, n) over the dates from `days` before the newest one on."""
        last = self.read().agg(F.date_sub(F.max("date"), days).alias("first")).first()["first"]
        rows = self.read() if last is None else self.read(last)
        return rows.groupBy("industry").agg(F.avg("score").alias("mean"), F.count(F.lit(1)).alias("n"))


def latest_means(updates: DataFrame, n: int) -> DataFrame:
    """(industry, date, mean): after each micro-batch, the mean score of a group's last n dates, from updates (date,
    industry, score), batch or stream. The state holds n dates a group; a date that is there is replaced, an older one
    than all n is too late to count."""

    def step(key, frames, state):
        import pandas as pd

        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        for frame in frames:
            for date, score in zip(frame["date"].astype(str), frame["score"], strict=True):
                held[date] = float(score)
        held = dict(sorted(held.items())[-n:])
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"industry": [key[0]], "date": [max(held)], "mean": [sum(held.values()) / len(held)]})

    return updates.groupBy("industry").applyInPandasWithState(step, "industry string, date string, mean double", "dates array<string>, scores array<double>", "update", GroupStateTimeout.NoTimeout)
