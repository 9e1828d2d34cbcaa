"""Wide feature sets: the mining set over lists of periods, and the features of the rows before a signal.

Columns come from (kernel, periods) lists, so a caller may pass its own; frames include the row and deviations are of
samples in the mining set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators.factors import EPS, flag

#: The mining set's periods.
PERIODS = {
    "ret": (1, 2, 3, 5, 8, 10, 15, 20, 30), "log_ret": (5, 10, 20), "vol": (3, 5, 10, 20, 30), "vol_chg": (5, 10), "rsi": (4, 6, 8, 10, 12, 14, 16, 20, 24), "mom": (3, 5, 8, 10, 12, 15, 20, 30, 60), "mom_acc": (5, 10),
    "bb": (10, 20, 30), "price_ma": (5, 10, 20, 30, 60, 120), "trend": (5, 10, 20, 30), "price_pos": (5, 10, 20, 30, 60), "new": (20, 60), "vol_ratio": (3, 5, 10, 20), "vol_break": (5, 10), "money_flow": (3, 5, 10),
    "main_flow": (5, 10), "atr": (5, 10, 14, 20), "williams": (10, 20), "kdj": (9, 14), "gap": (1, 2, 3), "turnover_chg": (5, 10), "vol_skew": (10, 20),
}
CROSSES = ((5, 10), (5, 20), (10, 20), (10, 60), (20, 60))


def _mean(x: Column, n: int) -> Column:
    return W.sma(x, n)


def _sd(x: Column, n: int) -> Column:
    return W.full(F.stddev_samp(x).over(W.incl(n)), x, W.incl(n), n)


def _most(x: Column, n: int, f=F.max) -> Column:
    return W.full(f(x).over(W.incl(n)), x, W.incl(n), n)


def _or(x: Column, value: float) -> Column:
    return F.coalesce(x, F.lit(value))


def first_stage(prepared: DataFrame, periods: dict = PERIODS) -> DataFrame:
    """prepared (see factors.prepare) with what needs a window of its own before the next one."""
    c, v = F.col("close"), F.col("volume")
    change = lambda n: c / (W.lag(c, n) + EPS) - 1
    p = prepared.withColumn("x", F.col("dc") / (c + EPS)).withColumn("tr0", F.when(F.col("ord") > 1, F.col("tr")).otherwise(0.0))
    return p.select(
        "*", *[_sd(F.col("x"), n).alias(f"s{n}") for n in {*periods["vol"], *periods["vol_chg"], 10, 20}], *[change(n).alias(f"m{n}") for n in {*periods["ret"], *periods["mom"], *periods["mom_acc"]}],
        *[_most(F.col("high"), n).alias(f"hi{n}") for n in {*periods["price_pos"], *periods["new"], *periods["williams"], *periods["kdj"]}], *[_most(F.col("low"), n, F.min).alias(f"lo{n}") for n in {*periods["price_pos"], *periods["new"], *periods["williams"], *periods["kdj"]}],
        *[_mean(v, n).alias(f"v{n}") for n in {*periods["vol_ratio"], *periods["turnover_chg"]}], *[(F.coalesce(c > _mean(c, n), F.lit(False)).cast("double") * v).alias(f"f{n}") for n in periods["main_flow"]],
    )


def mining(first: DataFrame, periods: dict = PERIODS) -> dict[str, Column]:
    """Columns of the mining set over first_stage(); defaults (0, 0.5, 50 or 1) stand in for rows without history."""
    o, h, c, v, r = (F.col(x) for x in ("open", "high", "close", "volume", "x"))
    out: dict[str, Column] = {f"ret_{n}": F.col(f"m{n}") for n in periods["ret"]}
    out |= {f"log_ret_{n}": F.log(c / W.lag(c, n)) for n in periods["log_ret"]} | {f"vol_{n}": F.col(f"s{n}") for n in periods["vol"]}
    out |= {f"vol_chg_{n}": _or(F.col(f"s{n}") / (_mean(F.col(f"s{n}"), n) + EPS) - 1, 0.0) for n in periods["vol_chg"]}
    up, down = F.greatest(F.col("dc"), F.lit(0.0)), F.greatest(-F.col("dc"), F.lit(0.0))
    out |= {f"rsi_{n}": _or(W._rsi_of(up, down, n), 50.0) for n in periods["rsi"]} | {f"mom_{n}": F.col(f"m{n}") for n in periods["mom"]}
    out |= {f"mom_acc_{n}": _or(F.col(f"m{n}") / (_mean(F.col(f"m{n}"), n) + EPS) - 1, 0.0) for n in periods["mom_acc"]}
    for n in periods["bb"]:
        middle, sd = _mean(c, n), _sd(c, n)
        lower, upper = middle - 2 * sd, middle + 2 * sd
        out |= {f"bb_width_{n}": _or(4 * sd / (middle + EPS), 0.0), f"bb_pos_{n}": _or((c - lower) / (upper - lower + EPS), 0.5), f"bb_upper_{n}": _or((c - upper) / (upper - lower + EPS), 0.0)}
    out |= {f"price_ma_{n}": _or(c / (_mean(c, n) + EPS) - 1, 0.0) for n in periods["price_ma"]} | {f"trend_{n}": _or((c - _mean(c, n)) / (_mean(c, n) + EPS), 0.0) for n in periods["trend"]}
    out |= {f"ma_golden_{a}_{b}": flag(_mean(c, a) > _mean(c, b)) for a, b in ((5, 10), (10, 20), (5, 20), (20, 60))} | {"ma_all": flag((_mean(c, 5) > _mean(c, 20)) & (_mean(c, 20) > _mean(c, 60)))}
    out |= {f"ma_cross_{a}_{b}": _or(_mean(c, a) / (_mean(c, b) + EPS) - 1, 0.0) for a, b in CROSSES}
    for n in periods["price_pos"]:
        hi, lo = F.col(f"hi{n}"), F.col(f"lo{n}")
        out |= {f"price_pos_{n}": _or((c - lo) / (hi - lo + EPS), 0.5), f"high_pos_{n}": _or((h - lo) / (hi - lo + EPS), 0.5)}
    out |= {f"new_high_{n}": flag(c >= F.col(f"hi{n}")) for n in periods["new"]} | {f"new_low_{n}": flag(c <= F.col(f"lo{n}")) for n in periods["new"]}
    out |= {f"vol_ratio_{n}": _or(v / (F.col(f"v{n}") + EPS), 1.0) for n in periods["vol_ratio"]} | {f"vol_break_{n}": _or(v / (_most(v, 2 * n) + EPS), 0.0) for n in periods["vol_break"]}
    out |= {"vol_break_20": _or(F.col("s20") / (_most(F.col("s20"), 40) + EPS), 0.0)}
    out |= {f"money_flow_{n}": _or(c * v / (_mean(c * v, n) + EPS) - 1, 0.0) for n in periods["money_flow"]} | {f"main_flow_{n}": _or(F.col(f"f{n}") / (W.total(F.col(f"f{n}"), n) + EPS), 0.0) for n in periods["main_flow"]}
    out |= {f"atr_{n}": _or(_mean(F.col("tr0"), n), 0.0) for n in periods["atr"]} | {f"atr_ratio_{n}": _or(_mean(F.col("tr0"), n) / (c + EPS), 0.0) for n in periods["atr"]}
    out |= {f"williams_{n}": _or(-100 * (F.col(f"hi{n}") - c) / (F.col(f"hi{n}") - F.col(f"lo{n}") + EPS), -50.0) for n in periods["williams"]}
    for n in periods["gap"]:
        gap = _or(c - W.lag(o, n), 0.0)
        out |= {f"gap_{n}": gap, f"gap_up_{n}": (gap > 0).cast("double"), f"gap_down_{n}": (gap < 0).cast("double")}
    out |= {f"turnover_chg_{n}": F.when(W.lag(F.col(f"v{n}"), n) != 0, (F.col(f"v{n}") - W.lag(F.col(f"v{n}"), n)) / (W.lag(F.col(f"v{n}"), n) + EPS)) for n in periods["turnover_chg"]}
    return out | {f"vol_skew_{n}": _or(_sd(c, n) / (_sd(r, n) + EPS), 0.0) for n in periods["vol_skew"]}


def kdj(first: DataFrame, n: int) -> DataFrame:
    """first_stage() with kdj_k, kdj_d and kdj_j of n rows: 50 without history."""
    c, hi, lo = F.col("close"), F.col(f"hi{n}"), F.col(f"lo{n}")
    p = first.withColumn("k0", _or(100 * (c - lo) / (hi - lo + EPS), 50.0))
    d = _mean(F.col("k0"), 3)
    return p.select("*", F.col("k0").alias(f"kdj_k_{n}"), _or(d, 50.0).alias(f"kdj_d_{n}"), _or(3 * F.col("k0") - 2 * d, 50.0).alias(f"kdj_j_{n}")).drop("k0")


def pre_signal(prepared: DataFrame) -> DataFrame:
    """(entity, date, …) of prepared rows with at least 60 before them: momentum, volume, turnover, deviation, position,
    drawdown, runs, range, jumps, shape, capture, distance to means and win rate, in percent where they are returns."""
    c, v, t, a = F.col("close"), F.col("volume"), F.col("turnover"), F.col("amp")
    p = prepared.withColumn("pct", F.when(F.col("ord") > 1, F.col("dc") / c * 100).otherwise(0.0)).withColumn("jump", F.col("r") * 100)
    p = W.run_length(W.run_length(p, F.col("pct") > 0, "run_up"), F.col("pct") < 0, "run_down")
    r, jump = F.col("pct"), F.col("jump")
    before = lambda x, n, f=F.avg: f(x).over(W.excl(n))
    at = lambda n: (c / W.lag(c, n) - 1) * 100
    dev = lambda n: F.stddev_pop(r).over(W.incl(n))
    hi, lo = {n: before(c, n, F.max) for n in (20, 60)}, {n: before(c, n, F.min) for n in (20, 60)}
    gains, losses = F.when(r > 0, r), F.when(r < 0, r)
    in20 = W.incl(20)
    up, fell = F.avg(gains).over(in20), F.abs(F.avg(losses).over(in20))
    both = (F.count(gains).over(in20) > 0) & (F.count(losses).over(in20) > 0)
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def fall(acc: Column, x: Column) -> Column:
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], (x - peak) / peak).alias("worst"))

    floor = lambda x, least: F.greatest(x, F.lit(least))
    cols = {
        **{f"mom_{n}d": at(n) for n in (5, 10, 20, 60)}, "mom_accel": at(5) - at(20), **{f"vol_ratio_{n}d": v / floor(before(v, n), 1.0) for n in (5, 20)}, "vol_trend_5d": before(v, 5) / floor(F.avg(v).over(W.by_entity().rowsBetween(-10, -6)), 1.0),
        "turnover": t, "turnover_5d_avg": before(t, 5), "turnover_20d_avg": before(t, 20), "turnover_ratio": t / floor(before(t, 20), 0.01), **{f"vol_{n}d": dev(n) for n in (5, 10, 20)}, "vol_regime": dev(20) / floor(dev(60), 0.01),
        **{f"pct_from_high_{n}d": (c - hi[n]) / floor(hi[n], 0.01) * 100 for n in (20, 60)}, **{f"pos_in_range_{n}d": F.when(hi[n] > lo[n], (c - lo[n]) / floor(hi[n] - lo[n], 0.01)).otherwise(0.5) for n in (20, 60)},
        "max_dd_20d": F.aggregate(F.collect_list(c).over(W.excl(20)), start, fall, lambda s: s["worst"]) * 100, "consecutive_up": F.least(W.lag(F.col("run_up")), F.lit(20)), "consecutive_down": F.least(W.lag(F.col("run_down")), F.lit(20)),
        "amplitude": a, "amplitude_5d_avg": before(a, 5), "amplitude_20d_avg": before(a, 20), "gap_up_count_20d": F.sum((jump > 2).cast("int")).over(in20), "gap_down_count_20d": F.sum((jump < -2).cast("int")).over(in20),
        "max_gap_20d": F.max(jump).over(in20), "min_gap_20d": F.min(jump).over(in20), "ret_skew_20d": F.skewness(r).over(in20), "ret_kurt_20d": F.kurtosis(r).over(in20), "up_capture": F.when(both, up), "down_capture": F.when(both, fell), "up_down_ratio": F.when(both, up / floor(fell, 0.01)),
        **{f"dist_ma{n}": (c - before(c, n)) / floor(before(c, n), 0.01) * 100 for n in (5, 10, 20, 60)}, "ma_bull_align": ((before(c, 5) > before(c, 10)) & (before(c, 10) > before(c, 20)) & (before(c, 20) > before(c, 60))).cast("int"),
        "daily_ret": r, "win_rate_20d": F.avg((r > 0).cast("double")).over(in20), "avg_up_ret": F.coalesce(up, F.lit(0.0)), "avg_down_ret": F.coalesce(fell, F.lit(0.0)), "max_ret_20d": F.max(r).over(in20), "min_ret_20d": F.min(r).over(in20),
    }
    return p.select("entity", "date", "ord", *[x.alias(k) for k, x in cols.items()]).filter("ord > 60").drop("ord")
