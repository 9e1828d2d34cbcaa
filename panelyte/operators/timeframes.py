"""Trends of longer time frames on daily rows, without looking into an unfinished week or month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions.numeric import clip
from panelyte.functions.recursive import smoothed
from panelyte.operators.asof import asof

#: Discounts against, partly with and with the longer trends, of weak trends, and the weight of a pattern.
AGAINST, PARTLY, WITH, WEAK, PATTERN = 0.50, 0.72, 1.0, 0.95, 0.15


def frame_trend(daily: DataFrame, every: str, fast: int, slow: int) -> DataFrame:
    """(entity, ends, up, strength, pattern) of an entity's weeks or months, from the slow span on: whether the fast
    mean is above the slow one, the squashed gap, and the pattern of the last bars."""
    frames = daily.groupBy("entity", F.trunc("date", every).alias("start")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "date").alias("close"), F.max("date").alias("ends")
    )
    means = smoothed(frames, {"fast": ("close", fast, False), "slow": ("close", slow, False)}, order="start")
    by = Window.partitionBy("entity").orderBy("start")
    ready = F.row_number().over(by) > slow
    gap = F.abs(F.col("fast") - F.col("slow")) / (F.col("slow") + 1e-10)
    return means.select("entity", "ends", (ready & (F.col("fast") > F.col("slow"))).alias("up"), F.when(ready, F.tanh(gap * 50)).otherwise(0.0).alias("strength"), bar_pattern(by).alias("pattern"))


def bar_pattern(by) -> Column:
    """0.8 or -0.8 for a bar that engulfs the one before against its direction; 0.6 or -0.5 for a long lower shadow with a
    small body after a fall or a rise; else 0."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    o1, c1, c2 = F.lag("open").over(by), F.lag("close").over(by), F.lag("close", 2).over(by)
    body, span = c - o, h - low
    hammer = (F.least(o, c) - low > span * 0.6) & (F.abs(body) < span * 0.3)
    return (
        F.when((span <= 0) | o1.isNull(), 0.0).when((c1 < o1) & (body > 0) & (c > o1) & (o < c1), 0.8).when((c1 > o1) & (body < 0) & (c < o1) & (o > c1), -0.8)
        .when(hammer & (c1 < c2), 0.6).when(hammer & (c1 > c2), -0.5).otherwise(0.0)
    )


def alignment(week_up: Column, month_up: Column, week: Column, month: Column) -> Column:
    """In [-1, 1]: mean strength where both agree; where they do not, half the month's against 0.3 of the week's."""
    mixed = F.when(month_up, month * 0.5 - week * 0.3).otherwise(-month * 0.5 + week * 0.3)
    return clip(F.when(week_up & month_up, (week + month) / 2).when(~week_up & ~month_up, -(week + month) / 2).otherwise(mixed), -1.0, 1.0)


def discount(align: Column, week: Column, month: Column, pattern: Column, resistance: Column | None = None, support: Column | None = None) -> Column:
    """Three lines over the alignment that meet at -0.3 and 0.3, less for weak trends, more or less by the pattern, more
    just above support and less just below resistance; within [0.30, 1.10]."""
    low = AGAINST + (PARTLY - AGAINST) * (align + 1) / 0.7
    middle, high = PARTLY + 0.06 * (align + 0.3) / 0.6, PARTLY + 0.06 + (WITH - PARTLY - 0.06) * (align - 0.3) / 0.7
    base = clip(F.when(align >= 0.3, high).when(align <= -0.3, low).otherwise(middle), AGAINST, WITH)
    base = base * F.when((week + month) / 2 < 0.3, WEAK).otherwise(1.0)
    base = base * F.when(pattern > 0.3, 1 + PATTERN * F.least(pattern, F.lit(1.0))).when(pattern < -0.3, 1 - PATTERN * F.least(F.abs(pattern), F.lit(1.0))).otherwise(1.0)
    if support is not None:
        base = base * F.when((support > 0) & (support < 0.05), 1.05).otherwise(1.0)
    if resistance is not None:
        base = base * F.when((resistance > 0) & (resistance < 0.03), 0.92).otherwise(1.0)
    return clip(base, 0.30, 1.10)


def aligned_trends(daily: DataFrame, week: tuple[int, int] = (20, 60), month: tuple[int, int] = (10, 30)) -> DataFrame:
    """daily with week_up, week_strength, month_up, month_strength, the week's pattern, alignment and discount. A week or
    month counts from its last day on; before any, trends are down with strength 0."""
    out = daily
    for name, (fast, slow) in (("week", week), ("month", month)):
        trend = frame_trend(daily, name, fast, slow).withColumnsRenamed({"up": f"{name}_up", "strength": f"{name}_strength"})
        trend = trend if name == "week" else trend.drop("pattern")
        values = [f"{name}_up", f"{name}_strength"] + (["pattern"] if name == "week" else [])
        out = asof(out, trend, "entity", "date", "ends", values)
    for c, v in (("week_up", False), ("month_up", False), ("week_strength", 0.0), ("month_strength", 0.0), ("pattern", 0.0)):
        out = out.withColumn(c, F.coalesce(c, F.lit(v)))
    out = out.withColumn("alignment", alignment(F.col("week_up"), F.col("month_up"), F.col("week_strength"), F.col("month_strength")))
    return out.withColumn("discount", discount(F.col("alignment"), F.col("week_strength"), F.col("month_strength"), F.col("pattern")))
