"""The factor catalogue: Columns over one entity's ordered rows, all on one partitioning.

`prepare` adds what several families share; each family is then one select of window Columns. Factors without enough
history are null where a mean or deviation is missing and 0 where the factor counts events, as each docstring says.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyte.functions import recursive
from panelyte.functions import windows as W
from panelyte.functions.numeric import clip, squash

EPS = 1e-10


def frame(first: int, last: int):
    """Rows from `first` to `last` before the row."""
    return W.by_entity().rowsBetween(-first, -last)


def holds(condition: Column) -> Column:
    """False where the condition is null."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    return holds(condition).cast("double")


def late(value: Column, rows: int, before: float | None = 0.0) -> Column:
    """value from the (rows + 1)-th row of an entity on, `before` until then."""
    return F.when(F.col("ord") > rows, value).otherwise(F.lit(before).cast("double"))


def prepare(bars: DataFrame) -> DataFrame:
    """bars (entity, date, ord, open, high, low, close, volume, turnover) with one-row moves.

    On an entity's first row every move is 0: r (return), dc and dv (changes of close and volume), gap (open against
    the close before), intra (close against open) and amp (range against close). vr is volume over its 20-row mean.
    """
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    before = W.lag(c)
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return bars.select(
        "*", zero((c - before) / (before + EPS)).alias("r"), zero(c - before).alias("dc"), zero(v - W.lag(v)).alias("dv"), zero((o - before) / (before + EPS)).alias("gap"),
        late((c - o) / (o + EPS), 1).alias("intra"), late((h - low) / (c + EPS), 1).alias("amp"), W.true_range(h, low, c).alias("tr"), (v / (W.sma(v, 20) + 1e-6)).alias("vr"),
        W.sma(c, 20).alias("ma20"), W.sma(c, 60).alias("ma60"), *[momentum(c, n).alias(f"mom_{n}") for n in (3, 5, 10, 20, 30)],
    )


def with_volatility(prepared: DataFrame) -> DataFrame:
    """prepared with volatility_5, _10 and _20: deviations of the returns of the rows before."""
    return prepared.select("*", *[W.std(F.col("r"), n).alias(f"volatility_{n}") for n in (5, 10, 20)])


def momentum(c: Column, n: int) -> Column:
    before = W.lag(c, n)
    return F.when(before > 0, (c - before) / (before + EPS))


def exponential(bars: DataFrame, spans: list[int] = (5, 10, 20, 60, 120, 250)) -> DataFrame:
    """bars with ema{span}, started from the first close, and the MACD columns; one grouped pass an entity."""
    return recursive.macd(recursive.smoothed(bars, {f"ema{n}": ("close", n, False) for n in spans}), "close")


def trend_family(prepared: DataFrame) -> dict[str, Column]:
    """Mean orders, spreads and slopes; needs the exponential means."""
    c = F.col("close")
    ma = {n: W.sma(c, n) for n in (5, 10, 20, 30, 60)}
    ema = {n: F.col(f"ema{n}") for n in (5, 20, 60)}
    slope = F.when(W.lag(ema[20], 10) > 0, ema[20] / W.lag(ema[20], 10) - 1)
    order = flag(c > ma[5]) + flag(ma[5] > ma[10]) + flag(ma[10] > ma[20]) + flag(ma[20] > ma[60]) + flag(ma[5] > ma[20])
    alignment = order / 5 * 0.4 + F.tanh((ma[5] - ma[60]) / (ma[60] + EPS) * 3) * 0.3 + F.tanh(slope * 10) * 0.3
    return {
        **{f"ma{n}": m for n, m in ma.items()},
        "ema5_above_20": ema[5] > ema[20], "ema20_above_60": ema[20] > ema[60],
        "full_golden": (ema[5] > ema[20]) & (ema[20] > ema[60]), "full_death": (ema[5] < ema[20]) & (ema[20] < ema[60]),
        "ma_alignment": alignment, "ema20_slope": slope, "ema_trend_strength": (ema[20] - ema[60]) / (ema[60] + EPS),
        "price_ma_30": c / (ma[30] + EPS) - 1, "price_ma_60": c / (ma[60] + EPS) - 1, "ma_cross_10_60": ma[10] / (ma[60] + EPS) - 1, "ma_cross_10_20": ma[10] / (ma[20] + EPS) - 1,
        "ma_golden_20_60": flag(ma[20] > ma[60]), "ma_all": flag((ma[5] > ma[20]) & (ma[20] > ma[60])), "trend_30": (c - ma[30]) / (ma[30] + EPS),
    }


def oscillator_family(prepared: DataFrame) -> dict[str, Column]:
    """RSI of four spans, Bollinger bands, ATR, price position and their combinations; needs ema20 and ema60."""
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    up, down = F.greatest(F.col("dc"), F.lit(0.0)), F.greatest(-F.col("dc"), F.lit(0.0))
    rsi = {n: W._rsi_of(up, down, n) for n in (6, 8, 10, 14)}
    middle, sd = W.sma(c, 20), W.std(c, 20, W.incl(20))
    upper, lower = middle + 2 * sd, middle - 2 * sd
    place = (c - lower) / (upper - lower + EPS)
    atr = {n: W.sma(F.col("tr"), n) for n in (10, 14, 20)}
    atr_ratio = atr[14] / (c + EPS)
    hi, lo = W.highest(h, 20), W.lowest(low, 20)
    strength = (F.col("ema20") - F.col("ema60")) / (F.col("ema60") + EPS)
    return {
        **{f"rsi_{n}": x for n, x in rsi.items()}, "bb_upper": upper, "bb_middle": middle, "bb_lower": lower, "bb_width_20": 4 * late(F.stddev_pop(c).over(W.excl(20)), 20) / (middle + EPS), "bb_pos_30": place,
        **{f"atr_{n}": x for n, x in atr.items()}, "atr_ratio": atr_ratio, "high_20": hi, "low_20": lo, "price_position_20": (c - lo) / (hi - lo + EPS),
        "rsi_vol_combo": F.tanh((50 - rsi[14]) / 100 - F.col("volatility_20") * 0.5), "bb_rsi_combo": F.tanh((50 - rsi[14]) / 100 - place * 0.3), "trend_lowvol": F.tanh(strength * -atr_ratio * 50),
    }


def downside(r: Column, w: int) -> Column:
    """Deviation of the negative returns among the w rows before, 0 with fewer than three of them."""
    bad = F.when(r < 0, r)
    return late(F.when(F.count(bad).over(W.excl(w)) > 2, F.stddev_pop(bad).over(W.excl(w))).otherwise(0.0), w)


def momentum_family(prepared: DataFrame, fund_score: Column | None = None) -> dict[str, Column]:
    """Momenta, volatilities, downside and their combinations; composites take a missing input as 0 (RSI: 50) and are
    null on the first 20 rows."""
    m, vol, r = (lambda n: F.col(f"mom_{n}")), (lambda n: F.col(f"volatility_{n}")), F.col("r")
    up, down = F.greatest(F.col("dc"), F.lit(0.0)), F.greatest(-F.col("dc"), F.lit(0.0))
    or_zero = lambda x: F.coalesce(x, F.lit(0.0))
    m5, m10, m20 = (or_zero(m(n)) for n in (5, 10, 20))
    rising = m10 > 0
    v41 = F.when(rising, F.tanh(m20 * 3)).otherwise(0.0)
    rsi = (F.coalesce(W._rsi_of(up, down, 14), F.lit(50.0)) - 50) / 100
    composite = {
        "trend_mom_v41": v41, "trend_mom_v24": F.when(rising, F.tanh(m20 * 3)).otherwise(F.tanh(m20 * 0.5)), "trend_mom_v46": F.when(rising, F.tanh(m20 * 2.5)).otherwise(0.0),
        "mom_diff_5_20": F.tanh((m5 - m20) * 5), "mom_diff_10_20": F.tanh((m10 - m20) * 5), "rsi_factor": rsi, "V41_RSI_915": v41 * 0.915 + rsi * 0.085,
        "tech_fund_combo": v41 * 0.7 + rsi * 0.1 + (F.lit(0.0) if fund_score is None else fund_score) * 0.2,
    }
    return {
        **{f"mom_{n}": m(n) for n in (3, 5, 10, 20, 30)}, **{f"volatility_{n}": vol(n) for n in (5, 10, 20)}, "volatility": F.tanh(-vol(20) * 20),
        "downside_dev_10": downside(r, 10), "downside_dev_20": downside(r, 20), "low_downside": F.tanh(-downside(r, 20) * 30),
        **{f"mom_x_lowvol_{a}_{b}": F.tanh(m(a) * -vol(b) * 20) for a in (10, 20) for b in (10, 20)}, **{f"ret_vol_ratio_{n}": squash(m(n) / (vol(n) + 1e-6)) for n in (10, 20)},
        "momentum_reversal": F.tanh(-m(20) * 3), "momentum_acceleration": F.tanh((m(10) - m(20)) * 5),
        **{k: late(x, 20, None) for k, x in composite.items()},
    }


def flow_of_day(r: Column, vr: Column) -> Column:
    """A day's return by how much volume stood behind it."""
    return (
        F.when((r > 0) & (vr > 1.2), r * F.least(vr, F.lit(3.0)) * 2).when((r > 0) & (vr < 0.7), r * 0.5)
        .when((r < 0) & (vr > 1.5), r * 0.3).otherwise(r)
    )


def volume_family(prepared: DataFrame) -> dict[str, Column]:
    """Volume, turnover, liquidity and limit-up factors; needs limit_run (rows in a row at or above 9.5 %), flow (the
    day's flow) and residual (return less its 20-row mean, 0 on the first 20 rows)."""
    c, v, t, r = (F.col(x) for x in ("close", "volume", "turnover", "r"))
    raw, mean = F.col("vr"), W.sma(t, 20)
    m20, vol = F.col("mom_20"), F.col("volatility_20")
    inverse = F.tanh((1 / (mean + 0.1) - 5) / 5)
    thin = W.sma(F.abs(r) / (c * v + EPS), 20)
    return {
        "volume_ratio_raw": raw, "volume_ratio": squash(raw - 1), "volume_surge": F.tanh((raw - 1.5) * 2), "turnover_burst": F.tanh((t / (mean + EPS) - 1.5) * 2),
        "inv_turnover": inverse, "turnover_shrink": F.tanh(-(t / (mean + 1e-6) - 1) * 3), "turnover_stability": F.tanh(-W.std(t, 20) / (mean + 1e-6) * 2),
        "illiq_20": F.tanh(-thin * 1e10), "vol_confirm": F.tanh(W.corr(r, v, 20) * m20 * 10), "price_volume_corr_20": F.tanh(W.corr(F.col("dc"), F.col("dv"), 20) * m20 * 10),
        "smart_money_flow": F.tanh(late(F.sum("flow").over(W.incl(5)) / 5, 5) * 3), "idiosyncratic_volatility": F.tanh(-W.std(F.col("residual"), 20) * 30),
        "earnings_quality": F.tanh(inverse / (1 + F.abs(F.tanh(-vol * 20)) * 10) * 3),
        "limit_up_freq": F.tanh(W.sma((r >= 0.095).cast("double"), 20) * 20 * 0.5), "consec_limit_up": F.tanh(F.col("limit_run") * 0.3),
    }


def shape_family(prepared: DataFrame) -> dict[str, Column]:
    """Overnight and intraday moves, higher moments, tails, gaps, relative strength and reversal of the last 20 rows;
    0 on the rows before a full frame (tail risk: null)."""
    c, h, low, r, gap = (F.col(x) for x in ("close", "high", "low", "r", "gap"))
    ex, sd = W.excl(20), F.stddev_pop(r).over(W.excl(20))
    cubed = sd * sd * sd
    gains, losses = F.when(r > 0, r), F.when(r < 0, r)
    spread = lambda x: F.when(F.count(x).over(ex) > 2, F.stddev_pop(x).over(ex)).otherwise(0.0)
    if_varied = lambda x: late(F.when(sd > EPS, x).otherwise(0.0), 20)
    own = F.stddev_pop(r).over(W.incl(20))
    drift = F.when(own > EPS, (F.sum(r).over(W.incl(5)) - 5 * F.avg(r).over(W.incl(20))) / own).otherwise(0.0)
    above, below = F.sum(F.when(gap > 0.01, gap).otherwise(0.0)).over(ex), -F.sum(F.when(gap < -0.01, gap).otherwise(0.0)).over(ex)
    back = lambda n: (c - W.lag(c, n)) / (W.lag(c, n) + EPS)
    steady = sum((F.when(back(n) > 0, 1.0).otherwise(-0.5) for n in (5, 10, 20)), F.lit(0.0))
    strong = F.when(own > 1e-6, back(20) / own * (0.5 + 0.5 * F.greatest(steady / 3, F.lit(0.0)))).otherwise(0.0)
    wide = F.avg(h - low).over(W.incl(5)) / (c + EPS) > 0.03
    worst = F.slice(F.array_sort(F.collect_list(r).over(W.incl(20))), 1, 5)
    return {
        "overnight_ret": F.tanh(late(F.sum(gap).over(W.incl(20)), 20) * 15), "intraday_ret": F.tanh(late(F.sum("intra").over(W.incl(20)), 20) * 15),
        "skewness_20": F.tanh(if_varied(F.skewness(r).over(ex) * cubed / (cubed + EPS))), "kurtosis_20": F.tanh(-if_varied(F.kurtosis(r).over(ex)) / 3),
        "volatility_skew": F.tanh(if_varied(F.when(spread(losses) > EPS, spread(gains) / spread(losses) - 1).otherwise(0.0))), "residual_momentum": F.tanh(if_varied(drift) * 2),
        "max_ret_20": F.tanh(late(F.max(r).over(ex), 20) * 3), "tail_risk": F.tanh(late(F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / 5, 19, None) * 5),
        "gap_ratio": F.tanh(late((above - below) / (above + below + EPS), 20) * 3), "relative_strength": F.tanh(late(strong, 20) * 0.5),
        "short_reversal": F.tanh(late(F.when((F.abs(r) > 0.04) & wide, -r * 2).otherwise(0.0), 5)),
    }


def initiation_family(prepared: DataFrame) -> dict[str, Column]:
    """Starts of trends: slope of the mean, fresh breakout above it, golden cross, and their blend with the RSI.

    A cross counts on its own row. Needs slope5 (relative change of ma20 over five rows) and ma5.
    """
    c, ma5, ma20, slope = (F.col(x) for x in ("close", "ma5", "ma20", "slope5"))
    up, down = F.greatest(F.col("dc"), F.lit(0.0)), F.greatest(-F.col("dc"), F.lit(0.0))
    rsi = W._rsi_of(up, down, 14)
    off = (c - ma20) / (ma20 + EPS)
    fresh = 1 - clip(F.abs(off) / 0.05, 0.0, 1.0)
    busy = clip((F.col("vr") - 0.8) / 1.2, 0.0, 1.0)
    breakout = F.tanh((flag(off > 0) * fresh * 0.35 + F.tanh(slope * 100 + 0.5) * 0.35 + busy * 0.30) * 3)
    crossed = flag((ma5 > ma20) & (W.lag(ma5) <= W.lag(ma20)))
    cross = crossed * F.tanh((ma5 - ma20) / (ma20 + EPS) * 50 + 0.5)
    steep = F.tanh(slope * 200)
    ramp = F.when(rsi < 40, 0.0).when(rsi < 55, (rsi - 40) / 15).when(rsi < 70, 1.0).otherwise(1 - (rsi - 70) / 30)
    return {"ma20_slope": steep, "trend_breakout": breakout, "ma_golden_cross": cross, "trend_initiation": breakout * 0.30 + cross * 0.25 + steep * 0.25 + ramp * 0.20}


def wash_sale(r: Column, v: Column, c: Column) -> Column:
    """Recovery from the worst of the 20 rows before: below -3 % on 1.5 times the mean volume and made up by more than
    half since; 0.2 more where volume shrank after it. The first of equal worst rows counts."""
    ex = W.excl(20)
    rs, vs, cs = (F.collect_list(x).over(ex) for x in (r, v, c))
    least = F.array_min(rs)
    at = F.array_position(rs, least).cast("int")
    then = F.element_at(cs, at)
    mean3 = lambda a, start: F.aggregate(F.slice(a, start, F.lit(3)), F.lit(0.0), lambda s, x: s + x) / 3
    made_up = (F.element_at(cs, 20) - then) / (F.abs(then) + EPS) > 0.5 * F.abs(least)
    quieter = (at <= 15) & (mean3(vs, F.lit(18)) < mean3(vs, at))
    score = F.abs(least) * 3 + F.when(quieter, 0.2).otherwise(0.0)
    ready = F.size(rs) == 20
    return F.when(ready, F.when((least < -0.03) & (F.element_at(vs, at) > F.avg(v).over(ex) * 1.5) & made_up, score).otherwise(0.0)).otherwise(0.0)


def breakout(close: Column, high: Column, volume: Column) -> Column:
    """1 where volume is twice its mean of the 20 rows before and the close above the highs of all but the last of them,
    0.5 above 98 % of that."""
    most = F.max(high).over(frame(20, 2))
    grade = F.when(close > most, 1.0).when(close > most * 0.98, 0.5).otherwise(0.0)
    return late(F.when(volume > F.avg(volume).over(W.excl(20)) * 2, grade).otherwise(0.0), 20)


def contraction(close: Column, volume: Column) -> Column:
    """A mild pullback (under 5 % of the 11-row high) on shrinking volume while the 20-row mean rises."""
    rising = F.col("ord") > 24
    mean, before = F.avg(close).over(W.incl(20)), F.avg(close).over(frame(24, 5))
    shrunk = F.avg(volume).over(W.incl(5)) < F.avg(volume).over(frame(9, 5)) * 0.8
    most = F.max(close).over(W.incl(11))
    fall = (most - close) / (most + EPS)
    return late(F.when(rising & (mean > before) & shrunk & (fall > 0) & (fall < 0.05), 1 - fall * 10).otherwise(0.0), 20)


def consolidation(close: Column, high: Column, low: Column, volume: Column) -> Column:
    """1 where the range of the last 10 rows (against their mean close) is below 0.7 of the range of the 10 before, volume
    below 0.8 of theirs, closes flat (deviation under 3 %) and the 20-row mean above the 60-row mean; 0.4 where the
    range narrows with either of the next two."""
    now, then = W.incl(10), frame(19, 10)
    span = lambda f: (F.max(high).over(f) - F.min(low).over(f)) / (F.avg(close).over(f) + EPS)
    tight, quiet = span(now) < span(then) * 0.7, F.avg(volume).over(now) < F.avg(volume).over(then) * 0.8
    flat = F.stddev_pop(close).over(now) / (F.avg(close).over(now) + EPS) < 0.03
    trend = F.col("ord") > 59
    trend = trend & (F.avg(close).over(W.incl(20)) > F.avg(close).over(W.incl(60)))
    return late(F.when(tight & quiet & flat & trend, 1.0).when(tight & (quiet | flat), 0.4).otherwise(0.0), 20)


def gap_breakout(gap: Column, vr: Column) -> Column:
    """Opening gaps beyond 2 % by the volume behind them, 1.3 times as much where the gap repeats the last one's side."""
    up = (
        F.when(vr > 2.0, 0.9).when(vr > 1.3, 0.5).when(vr < 0.7, -0.5).otherwise(0.2)
    )
    down = F.when(vr > 2.0, -0.9).when(vr < 0.5, 0.1).otherwise(-0.4)
    base = F.when(gap > 0.02, up).when(gap < -0.02, down).otherwise(0.0)
    again = holds((gap * W.lag(gap) > 0) & (F.abs(gap) > 0.01))
    return clip(base * F.when(again, 1.3).otherwise(1.0), -1.0, 1.0)


def opening_confirm(prepared: DataFrame) -> tuple[Column, Column]:
    """(confirmed, strength): the row before had 1.5 times its mean volume and this row opens above its close; the
    strength adds up trend, range, place, volume, body and close. Needs prev: a struct of the row before with vr, ret5
    (five-row return), amp5 (six-row range), place (20-row position), open and close."""
    p, o, c, i = F.col("prev"), F.col("open"), F.col("close"), F.col("ord") - 1
    body = (p["close"] - p["open"]) / (p["open"] + EPS)
    trend = F.when(i >= 6, F.when(p["ret5"] < -0.04, 0.15).when(p["ret5"] > 0.04, 0.05).otherwise(0.10)).otherwise(0.0)
    width = F.when(i >= 5, F.when(p["amp5"] < 0.05, 0.08).when(p["amp5"] > 0.15, -0.05).otherwise(0.0)).otherwise(0.0)
    place = F.when(i >= 20, F.when(p["place"] < 0.25, 0.12).when(p["place"] > 0.80, -0.10).otherwise(0.0)).otherwise(0.0)
    heavy = F.when(p["vr"] > 3.0, 0.30).when(p["vr"] > 2.0, 0.20).otherwise(0.12)
    solid = F.when(p["close"] > p["open"], 0.05 + F.least(F.lit(0.10), F.greatest(F.lit(0.0), body) * 2)).otherwise(-0.10)
    close = F.when(c > o, 0.08 + F.when(c > p["close"], 0.05).otherwise(0.0)).otherwise(-0.06)
    # a null volume ratio (history below 20 rows) is not below 1.5 and so counts
    ok = (i >= 1) & ~holds(p["vr"] < 1.5) & (o > p["close"])
    return F.when(ok, 1.0).otherwise(0.0), F.when(ok, clip(trend + width + place + heavy + solid + close, 0.15, 1.0)).otherwise(0.0)


def stroke_phase(place: Column) -> Column:
    """Early (positive) or late (negative) in a rise, or in a fall: position, volume against the rows before, range."""
    c, v, amp = F.col("close"), F.col("volume"), F.col("amp")
    rising = holds((c > F.col("ma20")) & (F.col("ma20") > F.col("ma60")))
    volume = F.avg(v).over(W.incl(6)) / (F.avg(v).over(frame(15, 6)) + EPS)
    ret = (c - W.lag(c, 5)) / (W.lag(c, 5) + EPS)
    moved = F.when(rising, ret > 0.03).otherwise(ret < -0.03)
    by_volume = F.when(moved & (volume > 1.3), 0.3).when(moved & (volume < 0.7), -0.5).otherwise(0.0)
    wide = F.avg(amp).over(W.incl(6)) / (F.avg(amp).over(frame(15, 6)) + EPS)
    by_range = F.when(wide > 2.5, -0.4).when(wide > 1.5, 0.3).otherwise(0.0)
    in_rise = F.when(place < 0.25, 0.8).when(place < 0.60, 0.4).when(place < 0.85, -0.2).otherwise(-0.7)
    in_fall = F.when(place > 0.75, 0.8).when(place > 0.40, 0.4).when(place > 0.15, -0.2).otherwise(-0.7)
    return clip(late(F.when(rising, in_rise).otherwise(in_fall) + by_volume + by_range, 20), -1.0, 1.0)


def exhaustion(place: Column, hist: Column) -> Column:
    """Risk that a rise is spent, high in the range: a new high on half the volume, ranges twice as wide, a falling MACD
    histogram, or a close below the open after a jump; 1 at most."""
    c, v, amp, r, intra = (F.col(x) for x in ("close", "volume", "amp", "r", "intra"))
    top = (c >= F.max(c).over(W.excl(10))) & (F.max(v).over(frame(15, 6)) > 0) & (F.avg(v).over(W.incl(4)) / F.max(v).over(frame(15, 6)) < 0.5)
    wide = F.avg(amp).over(W.incl(4)) / (F.avg(amp).over(frame(20, 6)) + EPS) > 2.0
    falling = (c > W.lag(c, 8)) & (hist < W.lag(hist, 8))
    spent = (r > 0.02) & (intra < -0.02)
    risk = flag(top) * 0.4 + flag(wide) * 0.3 + flag(falling) * 0.3 + flag(spent) * 0.2
    return late(F.when(place < 0.7, 0.0).otherwise(F.least(risk, F.lit(1.0))), 20)


def limit_pullback(prepared: DataFrame) -> DataFrame:
    """prepared with limit_pullback_score: after a limit-up close within 15 rows, low volume since then, a close at the
    five-row mean, and that mean not falling."""
    c, h, v = F.col("close"), F.col("high"), F.col("volume")
    hit = holds((F.col("ord") > 1) & (F.col("dc") / W.lag(c) >= 0.095) & (c / h >= 0.97))
    p = prepared.withColumn("ma5", W.sma(c, 5)).withColumn("hit", hit).withColumn("run", F.sum(v).over(W.so_far()))
    last = F.last(F.when(F.col("hit"), F.struct("ord", F.col("volume").alias("v"), "run")), ignorenulls=True).over(frame(20, 1))
    p = p.withColumn("hit_at", last).withColumn("ma5_before", W.lag(F.col("ma5"), 5))
    days, base = F.col("ord") - F.col("hit_at.ord"), F.col("hit_at.v")
    share = (F.col("run") - F.col("hit_at.run")) / days / base
    quiet = F.when(base > 0, F.when(share < 0.5, 1.0).when(share < 0.8, 1 - (share - 0.5) / 0.3).otherwise(0.0)).otherwise(0.0)
    x = c / F.col("ma5")
    near = (
        F.when(x.between(0.97, 1.02), 1 - F.abs(x - 1) / 0.03).when((x >= 0.95) & (x < 0.97), (x - 0.95) / 0.02 * 0.5)
        .when((x > 1.02) & (x <= 1.05), (1.05 - x) / 0.03 * 0.5).otherwise(0.0)
    )
    slope = F.when(F.col("ma5_before") > 0, (F.col("ma5") - F.col("ma5_before")) / F.col("ma5_before")).otherwise(0.0)
    trend = F.when(slope >= -0.005, 1.0).otherwise(F.greatest(F.lit(0.0), 1 + slope * 100))
    score = F.tanh((quiet * 0.35 + near * 0.40 + trend * 0.25) * 3)
    found = F.col("hit_at").isNotNull() & days.between(1, 15) & (F.col("ma5") > 0)
    return p.withColumn("limit_pullback_score", late(F.when(found, score).otherwise(0.0), 25)).drop("hit", "run", "hit_at", "ma5_before")


def with_flow(prepared: DataFrame) -> DataFrame:
    """prepared with limit_run, flow and residual, which the volume family needs."""
    r = F.col("r")
    vr = F.col("volume") / (F.avg("volume").over(W.incl(21)) + 1e-6)
    p = W.run_length(prepared, r >= 0.095, "limit_run")
    return p.select("*", flow_of_day(r, vr).alias("flow"), late(r - W.sma(r, 20), 20).alias("residual"))


def with_place(prepared: DataFrame) -> DataFrame:
    """prepared with place (position in the range of the 20 rows before) and prev, as opening_confirm needs."""
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    hi, lo = W.highest(h, 20), W.lowest(low, 20)
    ret5 = late((c - W.lag(c, 5)) / (W.lag(c, 5) + EPS), 5)
    amp5 = late((F.max(h).over(W.incl(6)) - F.min(low).over(W.incl(6))) / (c + EPS), 5)
    p = prepared.select("*", ((c - lo) / (hi - lo + EPS)).alias("place"), ret5.alias("ret5"), amp5.alias("amp5"))
    return p.withColumn("prev", W.lag(F.struct("vr", "ret5", "amp5", "place", "open", "close")))
