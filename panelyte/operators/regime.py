"""Market regimes of an index series: momentum and trend ladder, bear risk, style, exposure, interpolated weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import clip, ratio
from panelyte.functions.recursive import smoothed

#: Thresholds of the ladder.
BEAR5, BEAR20, BEAR60, BEAR_LONG = -0.01, -0.015, -0.02, -0.03
BULL20, BULL60 = 0.015, -0.01
CALM, WILD = 0.15, 0.30
DEEP, DEEP_FAST, WEAK120, WEAK60 = 0.07, 0.05, -0.03, -0.02
SIZE = 0.03


def _count(conditions: list[Column]) -> Column:
    return sum((F.coalesce(c, F.lit(False)).cast("int") for c in conditions[1:]), F.coalesce(conditions[0], F.lit(False)).cast("int"))


def moved(n: int) -> Column:
    return F.col("close") / W.lag(F.col("close"), n) - 1


def ladder(index: DataFrame, periods: float = 252.0, warm: int = 60) -> DataFrame:
    """index (entity, date, close, volume; one entity for each index) with regime (-1, 0, 1), confidence, scores and risk.

    The first rule that holds decides: two of three falling momenta; a long fall under falling means; a rise on 20 and
    60 rows; weaker rises with means in order; else the majority of eight signs, which leaves 0 where they disagree.
    The first `warm` rows are 0. severe_bear: more than 70 % of the last 60 rows (30 at least) have bear_risk. One
    grouped pass an index computes the exponential means (weights that sum to 1 from the first row on).
    """
    base = smoothed(index, {f"e{n}": ("close", n, True) for n in (20, 60, 120)})
    p = base.withColumn("ord", F.row_number().over(W.by_entity())).withColumn("ret", moved(1))
    vol = F.when(F.count("ret").over(W.incl(20)) == 20, F.stddev_samp("ret").over(W.incl(20)) * math.sqrt(periods))
    fall = lambda w: F.col("close") / F.max("close").over(W.incl(w)) - 1
    p = p.select("*", *[moved(n).alias(f"m{n}") for n in (5, 10, 20, 60, 120)], vol.alias("vol"), fall(120).alias("fall120"), fall(60).alias("fall60"))
    m5, m20, m60 = F.col("m5"), F.col("m20"), F.col("m60")
    short, long = F.col("e20") > F.col("e60"), F.col("e60") > F.col("e120")
    bearish = ~short & ~long
    falling = _count([m5 < BEAR5, m20 < BEAR20, m60 < BEAR60])
    bulls, bears = _count([m5 > 0.01, m20 > 0.01, m60 > 0.02, short]), _count([m5 < -0.01, m20 < -0.01, m60 < -0.02, ~short])
    agreement = F.abs(bulls - bears) / F.greatest(bulls + bears, F.lit(1))
    rules = [
        ((falling >= 2) & (m60 < 0), -1, 0.7 + 0.1 * falling), ((m20 < BEAR_LONG) & bearish & (m60 < 0), -1, F.lit(0.8)), ((m20 > BULL20) & (m60 > BULL60), 1, F.lit(1.0)),
        ((m20 > BULL20 * 0.5) & short & long, 1, F.lit(0.7)), ((m20 > BULL20 * 0.67) & short, 1, F.lit(0.55)), ((m5 > BULL20 * 1.5) & (m20 > BULL20 * 0.5), 1, F.lit(0.45)),
        (agreement < 0.3, 0, F.lit(0.5)), (bears > bulls, -1, F.lit(0.45)), (bulls >= 3, 1, F.lit(0.35)),
    ]
    known = F.col("ord") > warm
    state = F.when(~known, F.struct(F.lit(0).alias("regime"), F.lit(0.0).alias("confidence")))
    for condition, regime, confidence in rules:
        state = state.when(condition, F.struct(F.lit(regime).alias("regime"), confidence.alias("confidence")))
    state = state.otherwise(F.struct(F.lit(0).alias("regime"), F.lit(0.30).alias("confidence")))
    trend = F.when(short & long, 1.0).when(bearish, -1.0).when(short, 0.5).otherwise(-0.5)
    only = lambda x, other: F.when(known, x).otherwise(other)
    risk = F.coalesce((F.col("fall120") < -DEEP) & (F.coalesce("m120", F.lit(0.0)) < WEAK120) & bearish, F.lit(False))
    fast = F.coalesce((F.col("fall60") < -DEEP_FAST) & (m60 < WEAK60), F.lit(False))
    p = p.select(
        "*", state.alias("state"), only(clip(m20 / 0.15, -1.0, 1.0), 0.0).alias("momentum_score"), only(trend, 0.0).alias("trend_score"), only(F.col("vol"), 0.0).alias("volatility"),
        only((F.col("vol") > WILD) | (F.col("vol") < CALM), False).alias("is_extreme"), only(risk, False).alias("bear_risk"), only(fast, False).alias("bear_risk_fast"),
    ).withColumn("regime", F.col("state.regime")).withColumn("confidence", F.col("state.confidence"))
    dense = F.avg(F.col("bear_risk").cast("double")).over(W.incl(60))
    p = p.withColumn("switched", F.coalesce(F.col("regime") != W.lag(F.col("regime")), F.lit(False)).cast("int"))
    switches = F.when(F.col("ord") > 20, F.least(F.sum("switched").over(W.incl(20)) / 20 * 5, F.lit(1.0))).otherwise(0.0)
    ready = F.col("ord") >= 5
    return p.select(
        "entity", "date", "ord", "close", "ret", "m10", "m20", "regime", "confidence", "momentum_score", "trend_score", "volatility", "is_extreme", "bear_risk", "bear_risk_fast",
        F.when(F.col("ord") >= 30, dense > 0.70).otherwise(False).alias("severe_bear"), switches.alias("regime_volatility"), F.when(ready, F.col("volume") / (F.avg("volume").over(W.incl(20)) + 1)).alias("index_volume_ratio"),
    )


def style(main: DataFrame, small: DataFrame, growth: DataFrame, warm: int = 60) -> DataFrame:
    """main (from ladder) with size_score, style_score, style_regime and style_confidence.

    small and growth have (date, aux): the one-row return of an index of small and of growth entities on its own dates;
    a date that an index lacks takes the main index's momentum instead. Scores are differences of mean returns over
    21 rows in units of 2 %.
    """
    side = lambda df, name: df.select("date", F.col("aux").alias(name))
    p = main.join(side(small, "small"), "date", "left").join(side(growth, "growth"), "date", "left")
    mean = lambda c: F.avg(c).over(W.incl(21))
    lead = lambda c: clip((mean(c) - mean("ret")) / 0.02, -1.0, 1.0)
    m10, m20 = F.coalesce("m10", F.lit(0.0)), F.coalesce("m20", F.lit(0.0))
    size = F.when(F.col("small").isNotNull(), lead("small")).otherwise(clip(m10 / SIZE, -1.0, 1.0))
    slow = F.when(m20 > SIZE, clip(m20 / 0.1, 0.0, 1.0)).when(m20 < -SIZE, clip(m20 / 0.1, -1.0, 0.0)).otherwise(0.0)
    known = F.col("ord") > warm
    p = p.withColumn("size_score", F.when(known, size).otherwise(0.0)).withColumn("style_score", F.when(known, F.when(F.col("growth").isNotNull(), lead("growth")).otherwise(slow)).otherwise(0.0))
    s, g = F.col("size_score"), F.col("style_score")
    name = F.concat(F.when(s > 0.3, "small_cap").when(s < -0.3, "large_cap").otherwise("balanced"), F.when(g > 0.3, "_growth").when(g < -0.3, "_value").otherwise(""))
    return p.withColumn("style_regime", name).withColumn("style_confidence", F.least(F.lit(1.0), F.abs(s) * 2)).drop("small", "growth")


def state_weights(trend_score: Column, volatility: Column) -> list[Column]:
    """Shares of the bull, neutral and bear weight sets: a sigmoid of the trend, shifted by volatility against 20 %."""
    up = 1 / (1 + F.exp(-F.coalesce(trend_score, F.lit(0.0)) * 5))
    wild = clip(F.coalesce(volatility, F.lit(0.15)) / 0.20, 0.5, 2.0)
    bull, bear = clip(up * (2 - wild * 0.5), 0.0, 1.0), clip((1 - up) * wild * 0.7, 0.0, 1.0)
    neutral = F.greatest(F.lit(0.0), 1 - bull - bear)
    total = bull + neutral + bear + 1e-10
    return [bull / total, neutral / total, bear / total]


def blended_weights(states: DataFrame, weights: DataFrame) -> DataFrame:
    """(date, factor, weight): for each date the mean of a factor's |weight| in the three states' sets by their shares.

    states has (date, trend_score, volatility); weights (state: bull, neutral or bear; factor; weight) is a small table.
    Factors whose weight does not exceed 0.001 are left out.
    """
    shares = states.select("date", F.explode(F.array(*[F.struct(F.lit(n).alias("state"), w.alias("share")) for n, w in zip(("bull", "neutral", "bear"), state_weights(F.col("trend_score"), F.col("volatility")), strict=True)])).alias("s"))
    joined = shares.select("date", "s.state", "s.share").join(weights.select("state", "factor", F.abs("weight").alias("w")), "state")
    return joined.groupBy("date", "factor").agg(F.sum(F.col("share") * F.col("w")).alias("weight")).filter("weight > 0.001")


def exposure(trend: Column, bear_risk: Column, bear_fast: Column, volume_ratio: Column, strong_buys: Column, volatility: Column, base: float = 0.95, target: float = 0.20) -> Column:
    """Share of capital to hold. The trend score sets it, bear risk empties it, thin index volume caps it; two strong
    buy points lift it to a floor that depends on the risk; realised volatility beyond the target scales it by 0.75 at
    least."""
    by_trend = F.when(bear_risk, 0.0).when(trend >= 0.5, base).when(trend > 0, 0.5 * base).otherwise(0.3 * base)
    capped = F.when(volume_ratio < 0.5, F.least(by_trend, F.lit(0.35))).when(volume_ratio < 0.7, F.least(by_trend, F.lit(0.50))).otherwise(by_trend)
    floor = F.when(bear_risk, 0.15).when(bear_fast, 0.45).otherwise(0.60)
    lifted = F.when((strong_buys >= 2) & (capped < 0.6), F.greatest(capped, floor)).otherwise(capped)
    return lifted * F.when(volatility > 0.01, clip(F.try_divide(F.lit(target), volatility), 0.75, 1.0)).otherwise(1.0)


def blend(level: Column, buy_point: Column, sell_point: Column, trend: Column, exhaustion: Column, regime: Column, weights=(0.4, 0.3, 0.3), least_level: int = 2, most: float = 0.3) -> Column:
    """Multiplier in [0, 1.5] of three sub-strategies: trend following, reversion and defence; defence weighs half in a
    bear market."""
    follow = F.when((level >= least_level) | (buy_point >= 2), F.least(F.lit(1.0), 0.5 + 0.25 * level + F.when(trend == 2, 0.15).otherwise(0.0))).when((buy_point == 1) & (level >= 1), 0.7).otherwise(0.5)
    revert = F.when(exhaustion <= most, 0.6 + 0.4 * (1 - exhaustion / max(most, 0.01))).when(buy_point == 1, 0.6).when(exhaustion <= 0.15, 0.7).otherwise(0.3)
    defend = F.when(sell_point >= 3, 0.0).when((sell_point >= 2) | (exhaustion > 0.4), 0.3).when(sell_point == 1, 0.5).when(trend == -2, 0.4).otherwise(1.0)
    mixed = lambda w: w[0] * follow + w[1] * revert + w[2] * defend
    return clip(F.when(regime == -1, mixed((0.3, 0.2, 0.5))).otherwise(mixed(weights)), 0.0, 1.5)


def yearly_excess(nav: DataFrame) -> DataFrame:
    """(year, strategy, index, excess, cumulative) of rows (date, strategy, index): levels, first and last of a year;
    cumulative compounds the strategy."""
    y = nav.groupBy(F.year("date").alias("year")).agg(*[(ratio(F.max_by(c, "date"), F.min_by(c, "date")) - 1).alias(c) for c in ("strategy", "index")])
    upto = Window.partitionBy(F.lit(1)).orderBy("year").rowsBetween(Window.unboundedPreceding, 0)  # a row for each year
    return y.withColumn("excess", F.col("strategy") - F.col("index")).withColumn("cumulative", F.exp(F.sum(F.log1p("strategy")).over(upto)) - 1)
