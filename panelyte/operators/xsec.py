"""Operators over each date's cross-section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions.numeric import clip, inverse_normal, ratio

def by_date():
    """A date's rows (made when asked for: a window needs a session)."""
    return Window.partitionBy("date")


def average_rank(x: Column, by: list[str]) -> Column:
    """Rank from 1 within `by`; tied values share the mean of their ranks; null for null."""
    group = Window.partitionBy(*by)
    ordered = group.orderBy(x.asc_nulls_last())
    ties = F.count(x).over(Window.partitionBy(*by, x))
    return F.when(x.isNotNull(), F.rank().over(ordered) + (ties - 1) / 2)


def percent_rank(x: Column, by: list[str]) -> Column:
    """Average rank over the number of values, in (0, 1]."""
    return average_rank(x, by) / F.count(x).over(Window.partitionBy(*by))


def rank_normal(x: Column, by: list[str], limit: float = 3.0) -> Column:
    """Normal score of the percent rank, clipped; the greatest value has the score of the limit."""
    p = percent_rank(x, by)
    return F.when(p.isNotNull(), F.when(p >= 1, F.lit(limit)).otherwise(clip(inverse_normal(p), -limit, limit)))


def zscore(x: Column, by: list[str]) -> Column:
    """(x - mean) / sample deviation; a deviation of 0 or of a single value counts as 1."""
    group = Window.partitionBy(*by)
    sd = F.stddev_samp(x).over(group)
    return (x - F.avg(x).over(group)) / F.when(sd > 0, sd).otherwise(1.0)


def neutralize_group(df: DataFrame, x: str, out: str, group: str = "grp", least_rows: int = 10, least_members: int = 3) -> DataFrame:
    """Residual of the group mean within date (groups below least_members: 0), brought back to the date's mean and
    deviation; dates below least_rows keep x."""
    value = F.col(x)
    inside = Window.partitionBy("date", group)
    residual = F.when(value.isNotNull(), F.when(F.count(value).over(inside) >= least_members, value - F.avg(value).over(inside)).otherwise(0.0))
    df = df.withColumn("__r", residual)
    r = F.col("__r")
    spread, before = F.stddev_pop(r).over(by_date()), F.stddev_pop(value).over(by_date())
    scaled = F.when(spread > 1e-10, (r - F.avg(r).over(by_date())) / spread * before).otherwise(r) + F.avg(value).over(by_date())
    return df.withColumn(out, F.when(F.count(value).over(by_date()) >= least_rows, scaled).otherwise(value)).drop("__r")


def neutralize_size(df: DataFrame, x: str, size: str, out: str) -> DataFrame:
    """Residual of the least-squares line of x on size within date."""
    both = F.col(x).isNotNull() & F.col(size).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(size))
    spread = F.var_pop(b).over(by_date())
    beta = F.when(spread > 1e-15, F.covar_pop(a, b).over(by_date()) / spread).otherwise(0.0)
    return df.withColumn(out, a - F.avg(a).over(by_date()) - beta * (b - F.avg(b).over(by_date())))


def purity(df: DataFrame, x: str, group: str = "grp") -> DataFrame:
    """(date, n, share): the share of a factor's variance that lies between groups."""
    g = df.filter(F.col(x).isNotNull()).groupBy("date", group).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v"))
    total = F.sum(F.col("n") * F.col("m") * F.col("m")) / F.sum("n") - F.pow(F.sum(F.col("n") * F.col("m")) / F.sum("n"), 2)
    within = F.sum(F.col("n") * F.col("v")) / F.sum("n")
    return g.groupBy("date").agg(F.sum("n").alias("n"), ratio(total, total + within).alias("share"))
