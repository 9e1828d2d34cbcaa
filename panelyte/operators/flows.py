"""Signals beside the factor score: capital flow and news by price and volume, divergences, flows of the market and of
entities, quality of a chain's segments, sentiment of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import clip
from panelyte.functions.recursive import smoothed
from panelyte.operators.asof import asof
from panelyte.operators.factors import EPS, flow_of_day, holds, late


def capital_flow(prepared: DataFrame) -> DataFrame:
    """prepared (see factors.prepare) with smart_money, accumulation, net_flow, breakout, their blend smoothed over
    three rows (capital_flow_score) and its direction (1 above 0.55, -1 below 0.35, before smoothing)."""
    o, h, c, v, r = (F.col(x) for x in ("open", "high", "close", "volume", "r"))
    mean = W.sma(v, 20)
    p = prepared.withColumn("mean20", mean).withColumn("vr20", F.coalesce(F.when(mean > 0, v / mean), F.lit(1.0)))
    p = p.withColumn("flow", flow_of_day(r, F.col("vr20"))).withColumn("net", (c - o) * v / (F.col("mean20") + EPS))
    p = p.withColumn("m10", W.sma(v, 10)).withColumn("m5", W.sma(v, 5)).withColumn("net_flow", late(W.total(F.col("net"), 5) / 5, 5))
    before10, before5 = W.lag(F.col("m10"), 10), W.lag(F.col("m5"), 5)
    trend = F.coalesce(F.when(before10 > 0, F.col("m10") / before10), F.lit(1.0))
    change = late((c - W.lag(c, 10)) / (W.lag(c, 10) + EPS), 10)
    steady = F.when((F.abs(change) < 0.05) & (trend > 1.3), 0.6).when((F.abs(change) < 0.08) & (trend > 1.1), 0.35).otherwise(0.0)
    turned = holds((change < -0.03) & (trend < 0.8) & (before5 > 0) & (F.col("m5") > before5 * 1.2) & (r > 0))
    still = holds((W.sma(F.col("turnover"), 10) < 0.01) & (F.abs(change) < 0.03))
    stored = clip(steady + F.when(turned, 0.4).otherwise(0.0) + F.when(still, 0.25).otherwise(0.0), 0.0, 1.0)
    top = late(F.max(h).over(W.incl(20)), 19, None)
    heavy = holds((v > F.col("mean20") * 1.5) & (c >= top * 0.98) & (c > o))
    mild = holds((v > F.col("mean20") * 1.2) & (c >= top * 0.95))
    broke = F.when(heavy, clip((v / (F.col("mean20") + EPS) - 1.5) * 0.5 + 0.6, 0.0, 1.0)).when(mild, 0.35).otherwise(0.0)
    p = p.withColumn("smart_money", late(F.sum("flow").over(W.incl(5)) / 5, 5)).withColumn("accumulation", stored).withColumn("breakout", broke)
    spread = F.when(F.col("ord") > 60, F.stddev_pop(F.coalesce("net_flow", F.lit(0.0))).over(W.incl(61)) + EPS).otherwise(1.0)
    blend = clip(F.col("smart_money") * 4 + 0.5, 0.0, 1.0) * 0.3 + clip(F.coalesce("net_flow", F.lit(0.0)) / spread * 0.15 + 0.5, 0.0, 1.0) * 0.3 + F.col("accumulation") * 0.2 + F.col("breakout") * 0.2
    p = p.withColumn("raw", blend).withColumn("capital_flow_direction", F.when(F.col("raw") > 0.55, 1).when(F.col("raw") < 0.35, -1).otherwise(0)).withColumn("raw", clip(F.col("raw"), 0.0, 1.0))
    return smoothed(p.select(*prepared.columns, "smart_money", "accumulation", F.coalesce("net_flow", F.lit(0.0)).alias("net_flow"), "breakout", "capital_flow_direction", "raw"), {"capital_flow_score": ("raw", 5, False)}).drop("raw")


def _steps(x: Column, rules: list[tuple[float, Column]], inclusive: bool) -> Column:
    return F.coalesce(*[F.when((x >= at) if inclusive else (x > at), value) for at, value in rules], F.lit(0.0))


def news_proxy(prepared: DataFrame) -> DataFrame:
    """prepared with gap_signal, volume_shock, abnormal_ret, limit_near, gap_kept, their blend news_score and direction."""
    h, low, c, v, r, gap = (F.col(x) for x in ("high", "low", "close", "volume", "r", "gap"))
    size, moved = F.abs(gap), F.abs(r)
    ratio = v / (W.sma(v, 20) + EPS)
    z = moved / (W.std(r, 20, W.incl(20)) + EPS)
    p = prepared.select(
        "*", _steps(size, [(0.05, F.lit(0.9)), (0.03, 0.65 + (size - 0.03) * 12.5), (0.015, 0.3 + (size - 0.015) * 23.3), (0.005, size * 30)], False).alias("gap_signal"),
        late(_steps(ratio, [(4.0, F.lit(0.9)), (3.0, 0.6 + (ratio - 3) * 0.3), (2.0, 0.3 + (ratio - 2) * 0.3), (1.5, 0.1 + (ratio - 1.5) * 0.4)], True), 20).alias("volume_shock"),
        late(_steps(z, [(3.0, F.lit(0.85)), (2.5, 0.55 + (z - 2.5) * 0.6), (2.0, 0.25 + (z - 2) * 0.6), (1.5, z * 0.17)], True), 20).alias("abnormal_ret"),
        _steps(moved, [(0.07, 0.5 + (moved - 0.07) * 16.7), (0.05, 0.2 + (moved - 0.05) * 15)], False).alias("limit_near"),
        F.lag("gap", 3).over(W.by_entity()).alias("gap3"), F.coalesce(F.lag("close", 4).over(W.by_entity()), F.lag("close", 3).over(W.by_entity())).alias("base"),
    )
    lows, highs = F.min(low).over(W.incl(3)), F.max(h).over(W.incl(3))
    open_up, open_down = (F.col("gap3") > 0) & (lows > F.col("base") * 1.005), (F.col("gap3") < 0) & (highs < F.col("base") * 0.995)
    kept = F.when(holds((F.abs("gap3") >= 0.01) & (open_up | open_down)), F.least(F.lit(0.7), F.abs("gap3") * 10 + 0.2)).otherwise(0.0)
    score = clip(F.col("gap_signal") * 0.25 + F.col("volume_shock") * 0.25 + F.col("abnormal_ret") * 0.20 + F.col("limit_near") * 0.15 + F.col("gap_kept") * 0.15, 0.0, 1.0)
    p = p.withColumn("gap_kept", kept).withColumn("news_score", score)
    loud = F.col("news_score") > 0.3
    return p.withColumn("news_direction", F.when(loud & (r > 0) & (gap > 0), 1).when(loud & (r < 0) & (gap < 0), -1).otherwise(0))


def divergences(rows: DataFrame, lookback: int = 20, around: int = 5, least: float = 0.3) -> DataFrame:
    """rows (entity, date, ord, close, macd_hist, ema20, ema60) with top_divergence, bottom_divergence, hidden_top,
    hidden_bottom and divergence_active.

    A top diverges where a close that is the highest of `around` rows back exceeds the last such close while the
    histogram is below its own last peak, in a rising trend (means in order, close above its mean of the 20 rows
    before). Its strength fades by half a row until the next one. Bottoms are the mirror image; hidden ones have the
    price fail and the histogram succeed.
    """
    c, m = F.col("close"), F.col("macd_hist")
    back = W.by_entity().rowsBetween(-around, 0)
    ready = F.col("ord") > around
    p = rows.select(
        "*", *[(ready & holds(x == f(x).over(back))).alias(f"{name}_{kind}") for name, x in (("c", c), ("m", m)) for kind, f in (("peak", F.max), ("trough", F.min))],
        F.avg(c).over(W.excl(20)).alias("mean_before"),
    )
    so_far = Window.partitionBy("entity").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda flag, x: F.last(F.when(F.col(flag), x), ignorenulls=True).over(so_far)
    p = p.select("*", last("c_peak", c).alias("c_top"), last("m_peak", m).alias("m_top"), last("c_trough", c).alias("c_low"), last("m_trough", m).alias("m_low"))
    up, down = (F.col("ema20") > F.col("ema60")) & (c > F.col("mean_before")), (F.col("ema20") < F.col("ema60")) & (c < F.col("mean_before"))
    ct, mt, cl, ml = (F.col(x) for x in ("c_top", "m_top", "c_low", "m_low"))
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    top = within(F.least(F.lit(1.0), (c / (ct + EPS) - 1) * 10) * (mt - m) / (F.abs(mt) + EPS))
    low = within(F.least(F.lit(1.0), (cl / (c + EPS) - 1) * 10) * (m - ml) / (F.abs(ml) + EPS))
    begun = F.col("ord") > lookback
    strong = lambda condition, x: F.when(begun & holds(condition & (x >= least)), x).otherwise(0.0)
    hidden_top, hidden_low = F.least(F.lit(0.8), (m - mt) / (F.abs(mt) + EPS)), F.least(F.lit(0.8), (ml - m) / (F.abs(ml) + EPS))
    half = lambda condition, x: F.when(begun & holds(condition & (x >= least * 0.5)), x).otherwise(0.0)
    p = p.select(
        "*", strong(F.col("c_peak") & (c > ct) & (m < mt) & up, top).alias("raw_top"), strong(F.col("c_trough") & (c < cl) & (m > ml) & down, low).alias("raw_bottom"),
        half(F.col("c_peak") & (c <= ct) & (m > mt), hidden_top).alias("hidden_top"), half(F.col("c_trough") & (c >= cl) & (m < ml), hidden_low).alias("hidden_bottom"),
    )
    faded = []
    for name in ("top", "bottom"):
        raw = F.col(f"raw_{name}")
        at = F.last(F.when(raw > 0, F.struct(raw.alias("x"), F.col("ord").alias("ord"))), ignorenulls=True).over(W.so_far())
        faded.append(F.coalesce(at["x"] * F.pow(F.lit(0.5), (F.col("ord") - at["ord"]).cast("double")), F.lit(0.0)).alias(f"{name}_divergence"))
    p = p.select("*", *faded)
    return p.withColumn("divergence_active", (F.col("top_divergence") > 0) | (F.col("bottom_divergence") > 0)).drop("c_peak", "c_trough", "m_peak", "m_trough", "mean_before", "c_top", "m_top", "c_low", "m_low", "raw_top", "raw_bottom")


def market_flow(flows: DataFrame) -> DataFrame:
    """flows (date, net_flow, lead_change, index_change; one series) with signal: the last five rows' net flow against
    the mean of the last 20; without any net flow, 0.6 and 0.4 of the squashed mean changes of the leaders and the
    index. 0 on the first four rows."""
    by = Window.partitionBy(F.lit(1)).orderBy("date")  # one market series
    w5, w20 = by.rowsBetween(-4, 0), by.rowsBetween(-19, 0)
    recent, mean = F.sum(F.coalesce("net_flow", F.lit(0.0))).over(w5), F.avg("net_flow").over(w20) + 0.01
    part = lambda x, scale: F.when(F.count(x).over(w20) >= 3, F.tanh(F.avg(x).over(w5) / scale))
    lead, index = part("lead_change", 5.0), part("index_change", 3.0)
    weight = F.when(lead.isNotNull(), 0.6).otherwise(0.0) + F.when(index.isNotNull(), 0.4).otherwise(0.0)
    fallback = F.coalesce(F.try_divide(F.coalesce(lead * 0.6, F.lit(0.0)) + F.coalesce(index * 0.4, F.lit(0.0)), weight), F.lit(0.0))
    main = F.when(F.abs(mean) * 5 < 1e-6, 0.0).otherwise(F.tanh(recent / F.greatest(F.abs(mean) * 5, F.lit(1.0))))
    return flows.withColumn("signal", F.when(F.count(F.lit(1)).over(w20) < 5, 0.0).when(F.count("net_flow").over(w20) > 0, main).otherwise(fallback))


def margin_flow(margin: DataFrame) -> DataFrame:
    """margin (date, balance; one series) with signal: a change of the balance over ten rows speaks for the market below
    3 %, against it beyond. 0 on the first four rows."""
    by = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-9, 0)  # one market series
    first = F.first("balance").over(by)
    change = (F.col("balance") - first) / (F.abs(first) + EPS)
    return margin.withColumn("signal", F.when(F.count(F.lit(1)).over(by) < 5, 0.0).otherwise(F.tanh(F.when(F.abs(change) < 0.03, change * 3).otherwise(-change * 2))))


def listed_flow(rows: DataFrame, events: DataFrame) -> DataFrame:
    """rows (entity, date) with entity_flow: net share of the purchases in the entity's last listing by the date
    (events: entity, date, bought, sold), squashed; 0 before any."""
    known = events.select("entity", F.col("date").alias("listed"), "bought", "sold")
    j = asof(rows, known, "entity", "date", "listed", ["bought", "sold"])
    return j.withColumn("entity_flow", F.coalesce(F.tanh((F.col("bought") - F.col("sold")) / (F.col("bought") + F.col("sold") + EPS) * 3), F.lit(0.0))).drop("bought", "sold")


#: Points of a segment's ordinal attributes, and their weights.
BARRIER = {"moat": 1.0, "high": 0.75, "medium": 0.5, "low": 0.25}
MARGIN = {"high": 1.0, "medium": 0.6, "low": 0.3}
TECH = {"import": 0.8, "self_sufficient": 0.5, "export": 1.0, "none": 0.3}


def segment_score(segments: DataFrame) -> DataFrame:
    """segments (chain, segment, concept, barrier, margin, tech) with score (0.40, 0.35 and 0.25 of the attributes'
    points; unknown words count as the middle) and choke (a high or moat barrier)."""
    points = lambda table, x, other: F.coalesce(F.create_map(*[F.lit(v) for kv in table.items() for v in kv])[F.col(x)], F.lit(other))
    score = points(BARRIER, "barrier", 0.5) * 0.40 + points(MARGIN, "margin", 0.6) * 0.35 + points(TECH, "tech", 0.5) * 0.25
    return segments.withColumn("score", clip(score, 0.0, 1.0)).withColumn("choke", F.col("barrier").isin("moat", "high"))


def chain_quality(members: DataFrame, segments: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """(entity, barrier_score, profit_score, quality, moats) of members (entity, concept): the best segment of an
    entity's concepts (0.3 without any), profit points of fundamentals (entity, roe, gross_margin as fractions; 0.5
    without), blended 55 to 45. A concept counts for the first segment that lists it."""
    first = Window.partitionBy("concept").orderBy("chain", "segment")
    known = segment_score(segments).withColumn("k", F.row_number().over(first)).filter("k = 1").select("concept", "score", "choke")
    best = members.join(known, "concept", "left").groupBy("entity").agg(F.coalesce(F.max("score"), F.lit(0.3)).alias("barrier_score"), F.count_if(F.col("choke")).alias("moats"))
    profit = clip(clip(F.col("roe") / 0.20, 0.0, 1.0) * 0.5 + clip(F.col("gross_margin") / 0.50, 0.0, 1.0) * 0.5, 0.0, 1.0)
    out = best.join(fundamentals.select("entity", "roe", "gross_margin"), "entity", "left").withColumn("profit_score", F.coalesce(profit, F.lit(0.5)))
    return out.select("entity", "barrier_score", "profit_score", clip(F.col("barrier_score") * 0.55 + F.col("profit_score") * 0.45, 0.0, 1.0).alias("quality"), "moats")


def returns_to_sentiment(returns: DataFrame, half_life: float = 5.0, least: int = 3) -> DataFrame:
    """(entity, date, sentiment) of group returns (entity, date, ret): a mean with the given half-life (weights sum to 1,
    from the third return on), its z-score within the date, squashed; 0 where fewer than three groups are known."""
    span = 2 / (1 - 0.5 ** (1 / half_life)) - 1
    p = smoothed(returns, {"m": ("ret", span, True)})
    p = p.withColumn("m", F.when(F.count("ret").over(W.so_far()) >= least, F.col("m")))
    date = Window.partitionBy("date")
    z = (F.col("m") - F.avg("m").over(date)) / (F.stddev_samp("m").over(date) + 1e-8)
    return p.select("entity", "date", F.when(F.count("m").over(date) < 3, 0.0).otherwise(clip(F.tanh(z * 0.8), -1.0, 1.0)).alias("sentiment"))


def multiplier(score: Column, regime: Column, most: float = 1.20, least: float = 0.80) -> Column:
    """Weight multiplier of a score in [-1, 1]: a line on each side of 0, halved in a bear market, 1.2 times in a bull
    market, held within [least, most]."""
    line = F.when(score > 0, 1 + score * (most - 1)).otherwise(1 + score * (1 - least))
    return clip(1 + (line - 1) * F.when(regime == -1, 0.5).when(regime == 1, 1.2).otherwise(1.0), least, most)


def asymmetric_multiplier(score: Column, smooth: Column, regime: Column, most: float = 1.15, least: float = 0.70, bias: float = 1.5) -> Column:
    """The same with 0.7 of the smoothed and 0.3 of the latest score, where bad news weighs `bias` times, and that 1.5
    times again in a bear market."""
    s = F.when(smooth.isNotNull(), 0.7 * smooth + 0.3 * score).otherwise(score)
    line = F.when(s > 0, 1 + s * (most - 1)).otherwise(1 + s * (1 - least) * bias)
    return clip(F.when((regime == -1) & (s < 0), 1 + (line - 1) * 1.5).otherwise(line), least, most)
