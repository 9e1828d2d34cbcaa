"""From factor values to signals: gates, score assembly, moving thresholds, confidence, buy and sell decisions.

Rows are (entity, date) with the columns that each function names; a missing column of structure or flow takes its
neutral value (`defaults`), so the decision runs on any panel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import clip
from panelyte.operators.factors import holds

#: Neutral values of what a panel may lack.
NEUTRAL = {
    "signal_level": 0, "buy_point": 0, "sell_point": 0, "trend_type": 0, "confirmed_buy": False, "confirmed_sell": False, "bottom_divergence": 0.0, "top_divergence": 0.0, "zhongyin": 0.0, "pivot_present": 0.0,
    "trend_initiation": 0.0, "bottom_fractal_quality": 0.0, "bottom_fractal_vol_spike": 1.0, "mtf_alignment_score": 0.0, "weekly_trend_up": False, "monthly_trend_up": False, "concept_heat": 0.5,
    "fundamental_score": 0.0, "ml_prediction": 0.0, "market_flow": 0.0, "margin_flow": 0.0, "entity_flow": 0.0, "bom_score": 0.5, "capital_flow_score": 0.0, "capital_flow_direction": 0, "news_score": 0.0, "news_direction": 0,
    "smart_money_flow": 0.0, "volume_ratio_raw": 1.0, "divergence_strength": 1.0, "buy_confidence": 0.35, "factor_quality": 0.0,
    "has_fundamental": False, "style_regime": "", "style_confidence": 0.0, "buy_systems": 0, "factor_name": "",
}


def defaults(rows: DataFrame) -> DataFrame:
    """rows with the columns of NEUTRAL that they lack."""
    return rows.select("*", *[F.lit(v).alias(k) for k, v in NEUTRAL.items() if k not in rows.columns])


def ladder(*rules: tuple[Column, float], default: float) -> Column:
    """Grade of the first rule that holds; a null condition does not."""
    return F.coalesce(*[F.when(holds(c), g) for c, g in rules], F.lit(default))


def gates() -> dict[str, Column]:
    """Grades of structure, timeframes, heat and trend; needs close, ma20, ema20, ema60 and ema120."""
    c = F.col
    begun = ((c("bottom_divergence") > 0.3) & (c("zhongyin") < 0.5) & (c("trend_type") != 0)) | ((c("trend_initiation") > 0.2) & (c("bottom_fractal_quality") > 0.25) & (c("bottom_fractal_vol_spike") > 1.5))
    found = ((c("buy_point") >= 2) | (c("signal_level") >= 1)) & (c("buy_point") != 1)
    lost = (c("trend_type") == -2) & (c("buy_point") == 0) & (c("signal_level") <= 0) & (c("bottom_divergence") < 0.2)
    structure = ladder(((c("signal_level") >= 2) & c("confirmed_buy"), 1.0), (c("buy_point") == 1, 0.85), (found, 0.72), (begun, 0.62), ((c("zhongyin") > 0.5) | (c("pivot_present") > 0.5), 0.50), (lost, 0.25), default=0.45)
    align, week, month = c("mtf_alignment_score"), c("weekly_trend_up"), c("monthly_trend_up")
    frames = ladder(((align > 0.35) | (week & month), 1.0), ((align > 0.05) | week | month, 0.72), (align > -0.10, 0.50), (align > -0.25, 0.35), default=0.25)
    heat = ladder((c("concept_heat") > 0.7, 1.0), (c("concept_heat") > 0.5, 0.8), (c("concept_heat") > 0.35, 0.6), default=0.4)
    valid = holds((c("close") > 0) & (c("ma20") > 0) & (c("ema20") > 0) & (c("ema60") > 0))
    above, bull = holds(c("close") > c("ma20")), holds(c("ema20") > c("ema60"))
    whole = bull & holds(c("ema60") > c("ema120"))
    trend = ladder((valid & above & whole, 1.0), (valid & above & bull, 0.72), (valid & above, 0.50), (valid & ~above & bull, 0.38), (valid & ~above & ~bull, 0.25), default=0.40)
    return {"gate_structure": structure, "gate_frames": frames, "gate_heat": heat, "gate_trend": trend}


def gate_quality(grades: list[Column]) -> Column:
    return clip(sum(grades[1:], grades[0]) / len(grades) / 0.55, 0.5, 2.0)


def hard_reject(ret: Column, limit: float = 0.095) -> Column:
    """A move to a price limit, or a confirmed sell at the strongest level."""
    return holds((ret <= -limit) | (ret >= limit)) | holds((F.col("signal_level") <= -3) & F.col("confirmed_sell"))


def assembled_score(factor_value: Column, fundamental_weight: float = 0.3, blend: float = 0.5) -> Column:
    """Factor value in [-10, 10], plus the weighted fundamental score where that is positive, blended with an active
    prediction, plus flows of the market (0.6 and 0.4 of 15 %) and of the entity (30 % beyond 0.01), times the chain's
    quality."""
    c = F.col
    score = clip(factor_value, -10.0, 10.0) + F.when(c("fundamental_score") > 0, c("fundamental_score") * fundamental_weight).otherwise(0.0)
    predicted = F.tanh(c("ml_prediction") * 3)
    score = F.when(F.abs(predicted) > 0.01, score * (1 - blend) + predicted * blend).otherwise(score)
    market = F.coalesce((c("market_flow") * 0.6 + c("margin_flow") * 0.4) * 0.15, F.lit(0.0))
    own = F.when(F.abs(c("entity_flow")) > 0.01, c("entity_flow") * 0.30).otherwise(0.0)
    late = F.col("ord") > 60
    return (score + F.when(late, market + own).otherwise(0.0)) * (0.7 + 0.6 * c("bom_score"))


def moving_thresholds(score: Column, buy: float = 0.12, sell: float = -0.35, share: float = 0.7, window: int = 400, least: int = 100) -> tuple[Column, Column]:
    """Quantiles of the scores of the rows before, never easier than a floor; the fixed thresholds without enough rows."""
    hi, lo = W.quantile_before(score, window, share, least), W.quantile_before(score, window, 1 - share, least)
    return F.when(hi.isNull(), buy).otherwise(F.greatest(hi, F.lit(buy * 0.15))), F.when(lo.isNull(), sell).otherwise(F.least(lo, F.lit(sell)))


def confidence(quality: Column) -> Column:
    c = F.col
    above = holds(c("close") > c("ma20"))
    extra = lambda condition, points: F.when(holds(condition), points).otherwise(0.0)
    total = (
        0.2 + quality * 0.4 + clip(c("factor_quality") * 2, 0.0, 0.2) + extra(F.abs(c("smart_money_flow")) > 0.15, 0.10)
        + extra((c("bottom_divergence") > 0.3) | (c("top_divergence") > 0.3), 0.08) + extra(c("bottom_fractal_quality") > 0.35, 0.06) + extra((c("volume_ratio_raw") > 1.2) & above, 0.06)
    )
    return clip(total, 0.0, 1.0)


def resonance(score: Column, buy: float = 0.12, sell: float = -0.35) -> tuple[Column, Column]:
    """How many of factor score, capital flow and news agree on buying, and on selling."""
    c = F.col
    one = lambda x: holds(x).cast("int")
    buys = one(score > buy * 0.7) + one((c("capital_flow_score") > 0.5) & (c("capital_flow_direction") == 1)) + one((c("news_score") > 0.3) & (c("news_direction") == 1))
    sells = one(score < sell) + one((c("capital_flow_score") > 0.35) & (c("capital_flow_direction") == -1)) + one((c("news_score") > 0.2) & (c("news_direction") == -1))
    return buys, sells


#: The least signal level of each kind of buy point, and the kinds that also ask for a trend that does not fall.
LEAST_LEVEL = {3: 1, 5: 1, 6: 1, 7: 2, 8: 2}
NO_FALL = (3, 6)
#: How far above its 20-row mean a price may be, by kind of buy point and signal level.
REACH = [(3, 2, 0.40), (3, None, 0.35), (1, 2, 0.30), (1, 1, 0.25), (6, None, 0.12)]


#: Tags that never buy, tags that buy below the threshold, and how far above it others must be, by a part of
#: their tag.
BANNED, PREMIUM, PREMIUM_SHARE = ("_T",), ("_FLA", "_FGR", "_FGRV", "_FLAV", "_FSM", "_FD"), 0.80
RESTRICTED = {"_FBA": 1.25, "_FV": 1.25, "_F": 1.20}
#: Entities of these prefixes have the wider price limit; those of FREE need no tag.
WIDE_LIMIT, FREE = {"688": 0.195, "300": 0.195}, ("688",)


def signal_tag() -> Column:
    """What a signal stands on: _F with fundamentals, two letters of a clear style, V with smart money, D with divergence,
    R and the number of agreeing systems from two on; _T for none of it."""
    c = F.col
    style = F.when(c("style_confidence") > 0.3, F.upper(F.substring(F.regexp_replace("style_regime", "_", ""), 1, 2))).otherwise("")
    parts = [
        F.when(c("has_fundamental"), "_F").otherwise(""), F.coalesce(style, F.lit("")), F.when(c("smart_money_flow") > 0.15, "V").otherwise(""),
        F.when((c("bottom_divergence") > 0.3) | (c("top_divergence") > 0.3), "D").otherwise(""), F.when(c("buy_systems") >= 2, F.concat(F.lit("R"), c("buy_systems").cast("string"))).otherwise(""),
    ]
    tag = F.concat(*parts)
    return F.when(tag == "", "_T").otherwise(tag)


def tag_allows(score: Column, threshold: Column, tag: Column) -> Column:
    """Whether a score is high enough for its tag: banned tags never, premium ones from a share of the threshold, others
    from the threshold times the largest factor of the parts that the tag holds."""
    factor = F.greatest(F.lit(1.0), *[F.when(tag.contains(part), k).otherwise(1.0) for part, k in RESTRICTED.items()])
    return ~tag.isin(*BANNED) & (score >= threshold * F.when(tag.isin(*PREMIUM), PREMIUM_SHARE).otherwise(factor))


def price_limit(entity: Column, limit: float) -> Column:
    """The largest move of a day by the entity's prefix."""
    out = F.lit(limit)
    for prefix, wide in WIDE_LIMIT.items():
        out = F.when(entity.startswith(prefix), wide).otherwise(out)
    return out


def decide(rows: DataFrame, limit: float = 0.095, least_divergence: float = 0.10, gate: bool | None = None) -> DataFrame:
    """rows with tag, buy and sell; needs entity, score, sell_threshold, quality, rejected, ret, close, ma20, ma60 and the
    columns of NEUTRAL. gate is the last rule for buys, that the tag allows the score: by default wherever rows have a
    buy_threshold.

    Buys: no reject, a score above -0.05, not too far above the 20-row mean for the kind of buy point, and either a
    structure (buy point or strong entity flow) or a positive score above that mean; not in a full downtrend without
    confirmed structure or divergence; each kind of buy point has its own floor. Strong entity flow at level 2 buys by
    itself. Sells: score below the threshold, or negative with a confirmed sell, a close below the 60-row mean, or weak
    gates. The first 60 rows and rows without a score do neither.
    """
    c, score = F.col, F.col("score")
    bp, level, flow = c("buy_point"), c("signal_level"), c("entity_flow")
    confirmed = (level >= 1) & c("confirmed_buy")
    far = F.when(c("ma20") > 0, (c("close") - c("ma20")) / c("ma20")).otherwise(1.0)
    reach = F.lit(0.30)
    for kind, at, most in reversed(REACH):
        reach = F.when((bp == kind) & (confirmed if kind != 6 else F.lit(True)) & (F.lit(True) if at is None else level >= at), most).otherwise(reach)
    structure = (bp >= 1) | (flow > 0.3)
    buy = ~c("rejected") & (score >= -0.05) & (structure | (c("close") > c("ma20"))) & (far < reach) & (structure | (score > 0))
    buy = buy & ((c("trend_type") != -2) | (bp >= 1) & confirmed | (c("bottom_divergence") > 0.3))
    rows = rows.withColumn("tag", signal_tag())
    if gate or gate is None and "buy_threshold" in rows.columns:
        named = ~c("factor_name").isin("V41", "NONE") & tag_allows(score, c("buy_threshold"), c("tag"))
        buy = buy & (F.col("entity").startswith(FREE[0]) | named)
    limit = price_limit(F.col("entity"), limit)
    buy = buy & ~holds(c("ret") <= -limit)
    strong = (flow > 0.3) & ~c("rejected") & ~holds(c("ret") <= -limit) & (level >= 2)
    buy = holds(buy) | holds(strong)
    for kind, least in LEAST_LEVEL.items():
        weak = level < least
        buy = buy & ~((bp == kind) & ((weak | (c("trend_type") < 0)) if kind in NO_FALL else weak))
    buy = buy & ~((bp == 2) & (c("divergence_strength") < least_divergence))
    confirmed_sell = (level <= -1) & c("confirmed_sell")
    broken = (c("close") < c("ma60")) & (score < 0) & (c("ma60") > 0)
    sure = holds(confirmed_sell) | holds(broken) | holds((c("quality") < 0.55) & (score < 0)) | holds((score < -0.20) & (c("quality") < 0.75))
    sell = holds(score < c("sell_threshold")) | (holds(score < 0) & sure)
    ready = (c("ord") > 60) & score.isNotNull()
    return rows.withColumn("buy", ready & buy).withColumn("sell", ready & sell)


def vote(directed: list[Column], level: float = 0.1) -> Column:
    """1, -1 or 0 by the mean of the factors that are there."""
    known = F.array_compact(F.array(*directed))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return F.when(F.size(known) == 0, 0).when(mean > level, 1).when(mean < -level, -1).otherwise(0)
