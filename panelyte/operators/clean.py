"""Cleaning, calendars and universe filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PRICES = ["open", "high", "low", "close"]


def calendar_of(dates: DataFrame) -> DataFrame:
    """(date, ord) of the distinct dates."""
    return dates.select("date").filter("date is not null").distinct().withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))


def valid_bars(df: DataFrame) -> DataFrame:
    """Bars whose prices are positive and lie between low and high."""
    ok = F.lit(True)
    for p in PRICES:
        ok = ok & (F.col(p) > 0) & F.col(p).between(F.col("low"), F.col("high"))
    return df.filter(ok)


def trim_quantiles(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """Rows whose columns lie within their entity's quantiles."""
    bounds = df.groupBy("entity").agg(*[F.percentile(c, F.array(F.lit(low), F.lit(high))).alias(f"__{c}") for c in columns])
    out = df.join(bounds, "entity")
    for c in columns:
        out = out.filter(F.col(c).between(F.col(f"__{c}")[0], F.col(f"__{c}")[1])).drop(f"__{c}")
    return out


def winsorize_volume(df: DataFrame, p: float = 0.999) -> DataFrame:
    cap = df.groupBy("entity").agg(F.percentile("volume", p).alias("__cap"))
    return df.join(cap, "entity").withColumn("volume", F.least("volume", "__cap")).drop("__cap")


def complete(df: DataFrame, step_days: int = 1, weekdays_only: bool = False) -> DataFrame:
    """Rows for every step between an entity's first and last date; prices carried forward, volume and amount 0 where
    filled."""
    ends = df.groupBy("entity").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    grid = ends.select("entity", F.explode(F.sequence("lo", "hi", F.make_interval(days=F.lit(step_days)))).alias("date"))
    if weekdays_only:
        grid = grid.filter(F.weekday("date") < 5)
    out = grid.join(df.withColumn("__seen", F.lit(True)), ["entity", "date"], "left")
    forward = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    carried = [F.last(c, ignorenulls=True).over(forward).alias(c) for c in PRICES]
    zeroed = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("volume", "amount")]
    return out.select("entity", "date", *carried, *zeroed, F.isnull("__seen").alias("filled"))


def quality_report(df: DataFrame) -> DataFrame:
    """Per entity: rows, dates, null counts and bars that contradict themselves."""
    bad = (F.col("high") < F.col("low")) | ~F.col("open").between(F.col("low"), F.col("high")) | ~F.col("close").between(F.col("low"), F.col("high"))
    nulls = [F.count_if(F.isnull(c)).alias(f"null_{c}") for c in PRICES]
    return df.groupBy("entity").agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(bad).alias("bad_bars"), *nulls)


def restated(old: DataFrame, new: DataFrame, tolerance: float = 0.01, last: int = 3) -> DataFrame:
    """(entity, worst, reload): whether the last overlapping closes differ by more than tolerance."""
    both = old.select("entity", "date", F.col("close").alias("a")).join(new.select("entity", "date", F.col("close").alias("b")), ["entity", "date"])
    recent = both.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))).filter(F.col("k") <= last)
    return recent.groupBy("entity").agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("worst")).withColumn("reload", F.col("worst") > tolerance)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Union of both where new rows replace old ones of the same keys."""
    both = old.withColumn("__v", F.lit(0)).unionByName(new.withColumn("__v", F.lit(1)), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy(F.desc("__v"))
    return both.withColumn("__k", F.row_number().over(last)).filter("__k = 1").drop("__v", "__k")
