"""Macro series of different rhythm, aligned to months as they are published, and the states that they give together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOW = {"last": lambda: F.max_by("value", "date"), "mean": lambda: F.avg("value"), "sum": lambda: F.sum("value")}


def monthly(series: dict[str, tuple[DataFrame, str]], lags: dict[str, int] | None = None, filled: tuple[str, ...] = ()) -> DataFrame:
    """(month, one column for each series): series is name -> (rows (date, value), "last", "mean" or "sum" in the month).

    The first series gives the months. A series published lags[name] months late counts for the month that many later,
    so nothing is used before it is known. Series in `filled` (rates that hold until they change) go on with their last
    value; others are null in months without a row. Null values are no rows. One row a month: windows over months here
    hold a few hundred rows.
    """
    lags, out = lags or {}, None
    for name, (rows, how) in series.items():
        month = F.add_months(F.trunc("date", "month"), lags.get(name, 0))
        m = rows.filter(F.col("value").isNotNull()).groupBy(month.alias("month")).agg(HOW[how]().alias(name))
        out = m if out is None else out.join(m, "month", "left")
    so_far = Window.partitionBy(F.lit(1)).orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("month", *[F.last(c, ignorenulls=True).over(so_far).alias(c) if c in filled else F.col(c) for c in series])


def _by():
    return Window.partitionBy(F.lit(1)).orderBy("month")


def _mean3(x: Column) -> Column:
    over = _by().rowsBetween(-2, 0)
    return F.when(F.count(x).over(over) == 3, F.avg(x).over(over))


def _diff(x: Column, n: int) -> Column:
    return x - F.lag(x, n).over(_by())


def macro_states(months: DataFrame, tight: float = -0.05, easing: float = -0.25, tightening: float = 0.5) -> DataFrame:
    """months (month, m1, m2: growths on the year in percent; credit: new credit; margin: a balance; prices: an index;
    rate: a policy rate) with

    accel: m1 less m1 three months before; scissor: m1 - m2; turning: scissor above -1 after below -2 three months before;
    credit_better, prices_better: the mean of three months above that of three before; margin_change: of the mean of three
    months on three before; bull: accelerating, with better credit and no falling margin; bear: accel below -1, or
    neither credit nor margin; easing, tightening: the rate's change over six months; resonance: home and abroad together
    (bull or bear, then bull where rates ease and bear where they tighten; neutral where rates do neither); regime and
    severity, as of the month. A comparison with a missing month does not hold."""
    c, yes = F.col, lambda x: F.coalesce(x, F.lit(False))
    p = months.select("*", _mean3(c("credit")).alias("credit3"), _mean3(c("margin")).alias("margin3"), _mean3(c("prices")).alias("prices3"), _diff(c("m1"), 3).alias("accel"), (c("m1") - c("m2")).alias("scissor"))
    before = F.lag("margin3", 3).over(_by())
    p = p.select(
        "*", yes(_diff(c("credit3"), 3) > 0).alias("credit_better"), yes(_diff(c("prices3"), 3) > 0).alias("prices_better"), (F.try_divide(c("margin3"), before) - 1).alias("margin_change"),
        yes((c("scissor") > -1.0) & (F.lag("scissor", 3).over(_by()) < -2.0)).alias("turning"), yes(_diff(c("rate"), 6) <= easing).alias("easing"), yes(_diff(c("rate"), 6) >= tightening).alias("tightening"),
    )
    calm = yes(c("margin_change") > tight)
    p = p.withColumn("bull", yes(c("accel") > 0) & c("credit_better") & calm).withColumn("bear", yes(c("accel") < -1.0) | (~c("credit_better") & yes(c("margin_change") <= tight)))
    home = F.when(c("bear"), "bear").when(c("bull"), "bull")
    abroad = F.when(c("tightening"), "bear").when(c("easing"), "bull")
    regime = F.when(c("turning") & c("credit_better"), "bullish").when(yes(c("accel") > 0.5) & c("credit_better") & calm, "bullish").when(yes(c("accel") < -1.0) & ~c("credit_better"), "bearish").otherwise("neutral")
    severity = F.when(c("accel") < -2.0, "deep").when(c("accel") < -1.0, "shallow").otherwise("none")
    return p.withColumn("resonance", F.coalesce(F.concat_ws("_", home, F.when(home.isNotNull(), abroad)), F.lit("neutral"))).withColumn("resonance", F.when(home.isNotNull() & abroad.isNotNull(), c("resonance")).otherwise("neutral")).withColumn("regime", regime).withColumn("severity", severity)
