"""Candidates, weights and orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(scores: DataFrame, n: int, by: list[str] = ("date",), score: str = "score") -> DataFrame:
    """The n best rows of each cell (ties by entity), with `place` from 1."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), "entity"))
    return scores.filter(F.col(score).isNotNull()).withColumn("place", place).filter(F.col("place") <= n)


def rank_weights(chosen: DataFrame, decay: float = 0.5, name_cap: float = 0.25, group_cap: float = 0.5, exposure: float = 1.0, positions: int = 0, multiplier: Column | None = None, group: str = "grp") -> DataFrame:
    """Weights that fall in a line from 1 for the first of a date to 1 - decay for the last, times a multiplier (for
    example of ic_multiplier), scaled to the exposure, capped by name, then by group (a share of the exposure).

    With fewer names than `positions` the name cap rises by 1.5 times the missing share, 1.5 times at most. What is cut
    is not dealt again: it stays cash.
    """
    date, inside = Window.partitionBy("date"), Window.partitionBy("date", group)
    n = F.count(F.lit(1)).over(date)
    raw = 1 - decay * (F.col("place") - 1) / F.greatest(n - 1, F.lit(1))
    w = chosen.withColumn("weight", raw if multiplier is None else raw * multiplier)
    slack = F.greatest(F.lit(0.0), (positions - n) / max(positions, 1))
    cap = F.least(name_cap * (1 + slack * 1.5), F.lit(name_cap * 1.5))
    w = w.withColumn("weight", F.least(F.col("weight") / F.sum("weight").over(date) * exposure, cap))
    held = F.sum("weight").over(inside)
    return w.withColumn("weight", F.when(held > group_cap * exposure, F.col("weight") * group_cap * exposure / held).otherwise(F.col("weight")))


def ic_multiplier(ic: Column, confidence: Column, sentiment: Column) -> Column:
    """How much a group's IC (against 5 %), a signal's confidence and a group's sentiment weigh; missing ones as neutral."""
    by_ic = F.least(F.greatest(F.coalesce(ic, F.lit(0.05)) / 0.05, F.lit(0.6)), F.lit(1.5))
    return by_ic * F.coalesce(confidence, F.lit(1.0)) * F.coalesce(sentiment, F.lit(1.0))


def tired(weight: Column, risk: Column, exposure: float = 1.0, high: float = 0.6, moderate: float = 0.4, most: float = 0.05, reduce: float = 0.6) -> Column:
    """Weights of names whose rise is spent: capped at high risk, reduced at a moderate one."""
    return F.when(risk > high, F.least(weight, F.lit(most * exposure))).when(risk > moderate, weight * reduce).otherwise(weight)


def risk_parity(chosen: DataFrame, volatility: str) -> DataFrame:
    """Weights in inverse proportion to volatility, so that weight * volatility is the same for all names of a date."""
    inverse = 1 / F.col(volatility)
    return chosen.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy("date")))


def focus_groups(scores: DataFrame, groups: int, least_members: int, group: str = "grp", score: str = "score") -> DataFrame:
    """Rows of each date's groups with the best median score among those with enough members."""
    medians = scores.groupBy("date", group).agg(F.percentile(score, 0.5).alias("median"), F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least_members)
    best = medians.withColumn("gplace", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("median"), group))).filter(F.col("gplace") <= groups)
    return scores.join(best, ["date", group])


def order_diff(target: DataFrame, current: DataFrame, prices: DataFrame, capital: float, lot: int = 100) -> DataFrame:
    """(entity, have, want, delta, side): lots to reach target weights from current quantities."""
    both = target.select("entity", "weight").join(current.select("entity", "qty"), "entity", "full_outer").join(prices.select("entity", "price"), "entity", "left")
    want = F.floor(F.coalesce("weight", F.lit(0.0)) * capital / F.col("price") / lot) * lot
    both = both.select("entity", F.coalesce("qty", F.lit(0)).cast("long").alias("have"), want.cast("long").alias("want"))
    return both.withColumn("delta", F.col("want") - F.col("have")).withColumn("side", F.when(F.col("delta") > 0, "buy").when(F.col("delta") < 0, "sell").otherwise("hold"))


def order_plan(orders: DataFrame, prices: DataFrame, cash: float) -> DataFrame:
    """orders (order_diff()) with price, reason (enter, exit, raise, cut or keep), flow (what a row brings in or costs),
    cash_after and funded: sells come first, then buys from the largest on, and a buy is funded while the cash after it
    is not negative. One portfolio's orders, as many as it holds entities."""
    have, want = F.col("have"), F.col("want")
    reason = F.when((have == 0) & (want > 0), "enter").when((have > 0) & (want == 0), "exit").when(want > have, "raise").when(want < have, "cut").otherwise("keep")
    p = orders.join(prices.select("entity", "price"), "entity").withColumn("reason", reason).withColumn("flow", -F.col("delta") * F.col("price"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.when(F.col("flow") >= 0, 0).otherwise(1), F.col("flow"), "entity")
    p = p.withColumn("cash_after", F.lit(cash) + F.sum("flow").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return p.withColumn("funded", (F.col("flow") >= 0) | (F.col("cash_after") >= 0))
