"""Queries over the wide feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyte.operators import mining as MI
from panelyte.plans.factors import BASE, E, full, lag, over, pick, prepared, rsi, sma
from panelyte.plans.kernels import rounded
from panelyte.plans.registry import query
from panelyte.plans.signals import adjusted

PE = MI.PERIODS


def sd(x: str, n: int, first: int = 0) -> str:
    """Sample deviation of n rows whose first row may lack a value for `first` rows."""
    return full(f"stddev_samp({x}) {over(n - 1)}", n + first)


def most(x: str, n: int, f: str = "max", first: int = 0) -> str:
    return full(f"{f}({x}) {over(n - 1)}", n + first)


def mean(x: str, n: int, first: int = 0) -> str:
    return full(f"avg({x}) {over(n - 1)}", n + first)


_HL = sorted({*PE["price_pos"], *PE["new"], *PE["williams"], *PE["kdj"]})
_M = sorted({*PE["ret"], *PE["mom"], *PE["mom_acc"]})
FIRST = f"""{BASE}, x0 as (select *, dc / (close + {E}) as x, case when ord > 1 then tr else 0 end as tr0 from p), x1 as (select *, {', '.join(f"{sd('x', n)} as s{n}" for n in (3, 5, 10, 20, 30))}, {', '.join(f"close / ({lag('close', n)} + {E}) - 1 as m{n}" for n in _M)},
  {', '.join(f"{most('high', n)} as hi{n}, {most('low', n, 'min')} as lo{n}" for n in _HL)}, {', '.join(f"{sma('volume', n)} as v{n}" for n in (3, 5, 10))}, {sma('volume', 20)} as v20, {', '.join(f"{sma('close', n)} as a{n}" for n in (5, 10, 20, 30, 60, 120) if n not in ())} from x0),
x2 as (select *, {', '.join(f"case when coalesce(close > a{n}, false) then volume else 0 end as f{n}" for n in (5, 10))}, {', '.join(f"coalesce(100 * (close - lo{n}) / (hi{n} - lo{n} + {E}), 50) as k{n}" for n in PE['kdj'])}, {', '.join(f"coalesce(close - {lag('open', n)}, 0) as g{n}" for n in PE['gap'])} from x1)"""
COLUMNS = {
    **{f"ret_{n}": f"m{n}" for n in PE["ret"]}, **{f"log_ret_{n}": f"ln(close / {lag('close', n)})" for n in PE["log_ret"]}, **{f"vol_{n}": f"s{n}" for n in PE["vol"]}, **{f"vol_chg_{n}": f"coalesce(s{n} / ({mean(f's{n}', n, n - 1)} + {E}) - 1, 0)" for n in PE["vol_chg"]},
    **{f"rsi_{n}": f"coalesce({rsi(n)}, 50)" for n in PE["rsi"]}, **{f"mom_{n}": f"m{n}" for n in PE["mom"]}, **{f"mom_acc_{n}": f"coalesce(m{n} / ({mean(f'm{n}', n, n)} + {E}) - 1, 0)" for n in PE["mom_acc"]},
    **{f"bb_width_{n}": f"coalesce(4 * {sd('close', n)} / (a{n} + {E}), 0)" for n in PE["bb"]}, **{f"bb_pos_{n}": f"coalesce((close - a{n} + 2 * {sd('close', n)}) / (4 * {sd('close', n)} + {E}), 0.5)" for n in PE["bb"]}, **{f"bb_upper_{n}": f"coalesce((close - a{n} - 2 * {sd('close', n)}) / (4 * {sd('close', n)} + {E}), 0)" for n in PE["bb"]},
    **{f"price_ma_{n}": f"coalesce(close / (a{n} + {E}) - 1, 0)" for n in PE["price_ma"]}, **{f"trend_{n}": f"coalesce((close - a{n}) / (a{n} + {E}), 0)" for n in PE["trend"]}, **{f"ma_golden_{a}_{b}": f"coalesce((a{a} > a{b})::int, 0)" for a, b in ((5, 10), (10, 20), (5, 20), (20, 60))}, "ma_all": "coalesce((a5 > a20 and a20 > a60)::int, 0)",
    **{f"ma_cross_{a}_{b}": f"coalesce(a{a} / (a{b} + {E}) - 1, 0)" for a, b in MI.CROSSES}, **{f"price_pos_{n}": f"coalesce((close - lo{n}) / (hi{n} - lo{n} + {E}), 0.5)" for n in PE["price_pos"]}, **{f"high_pos_{n}": f"coalesce((high - lo{n}) / (hi{n} - lo{n} + {E}), 0.5)" for n in PE["price_pos"]},
    **{f"new_high_{n}": f"coalesce((close >= hi{n})::int, 0)" for n in PE["new"]}, **{f"new_low_{n}": f"coalesce((close <= lo{n})::int, 0)" for n in PE["new"]}, **{f"vol_ratio_{n}": f"coalesce(volume / (v{n} + {E}), 1)" for n in PE["vol_ratio"]}, **{f"vol_break_{n}": f"coalesce(volume / ({most('volume', 2 * n)} + {E}), 0)" for n in PE["vol_break"]},
    "vol_break_20": f"coalesce(s20 / ({most('s20', 40, 'max', 19)} + {E}), 0)", **{f"money_flow_{n}": f"coalesce(close * volume / ({sma('close * volume', n)} + {E}) - 1, 0)" for n in PE["money_flow"]}, **{f"main_flow_{n}": f"coalesce(f{n} / ({full(f'sum(f{n}) {over(n - 1)}', n)} + {E}), 0)" for n in PE["main_flow"]},
    **{f"atr_{n}": f"coalesce({sma('tr0', n)}, 0)" for n in PE["atr"]}, **{f"atr_ratio_{n}": f"coalesce({sma('tr0', n)} / (close + {E}), 0)" for n in PE["atr"]}, **{f"williams_{n}": f"coalesce(-100 * (hi{n} - close) / (hi{n} - lo{n} + {E}), -50)" for n in PE["williams"]},
    **{f"gap_{n}": f"g{n}" for n in PE["gap"]}, **{f"gap_up_{n}": f"(g{n} > 0)::int" for n in PE["gap"]}, **{f"gap_down_{n}": f"(g{n} < 0)::int" for n in PE["gap"]}, **{f"turnover_chg_{n}": f"(v{n} - {lag(f'v{n}', n)}) / ({lag(f'v{n}', n)} + {E})" for n in PE["turnover_chg"]},
    **{f"vol_skew_{n}": f"coalesce({sd('close', n)} / ({sd('x', n)} + {E}), 0)" for n in PE["vol_skew"]},
}
_KDJ = {**{f"kdj_k_{n}": f"k{n}" for n in PE["kdj"]}, **{f"kdj_d_{n}": f"coalesce({sma(f'k{n}', 3)}, 50)" for n in PE["kdj"]}, **{f"kdj_j_{n}": f"coalesce(3 * k{n} - 2 * {sma(f'k{n}', 3)}, 50)" for n in PE["kdj"]}}
_BY = "partition by entity "


GAPS = {f"gap_{n}": f"g{n}" for n in PE["gap"]}  # differences of prices: more digits, so that none ends in a half


@query(f"{FIRST} select entity, date, {pick({k: v for k, v in COLUMNS.items() if k not in GAPS}, 4)}, {pick(GAPS, 8)} from x2")
def mining_set(spark, sf_dir):
    """Some hundred features over lists of periods."""
    p = MI.first_stage(prepared(spark, sf_dir))
    return p.select("entity", "date", *[F.round(x.cast("double"), 8 if k in GAPS else 4).alias(k) for k, x in MI.mining(p).items()])


@query(f"""{FIRST}, y1 as (select *, {adjusted('close', 12, _BY)} - {adjusted('close', 26, _BY)} as mc from x2), y2 as (select *, {adjusted('mc', 9, _BY)} as msig from y1) select entity, date, {pick({**_KDJ, 'macd': 'mc', 'macd_signal': 'msig', 'macd_hist': 'mc - msig'}, 4)} from y2""")
def mining_oscillators(spark, sf_dir):
    """KDJ of two spans, and MACD from means whose weights sum to 1."""
    from panelyte.functions.recursive import smoothed

    p = MI.first_stage(prepared(spark, sf_dir))
    for n in PE["kdj"]:
        p = MI.kdj(p, n)
    keep = [f"kdj_{x}_{n}" for x in "kdj" for n in PE["kdj"]]
    p = smoothed(p.select("entity", "date", "close", *keep), {"fast": ("close", 12, True), "slow": ("close", 26, True)}).withColumn("macd", F.col("fast") - F.col("slow"))
    p = smoothed(p, {"macd_signal": ("macd", 9, True)})
    return rounded(p.select("entity", "date", *keep, "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_hist")), 4)


def _e(x: str, n: int, f: str = "avg") -> str:
    return f"{f}({x}) {over(n, 1)}"


_I = over(19)
_P1, _P2, _P3, _P4 = (f"avg({x}) {_I}" for x in ("pct", "pct * pct", "pct * pct * pct", "pct * pct * pct * pct"))
PRE = {
    **{f"mom_{n}d": f"(close / {lag('close', n)} - 1) * 100" for n in (5, 10, 20, 60)}, "mom_accel": f"(close / {lag('close', 5)} - close / {lag('close', 20)}) * 100", **{f"vol_ratio_{n}d": f"volume / greatest({_e('volume', n)}, 1)" for n in (5, 20)}, "vol_trend_5d": f"{_e('volume', 5)} / greatest(avg(volume) {over(10, 6)}, 1)",
    "turnover": "turnover", "turnover_5d_avg": _e("turnover", 5), "turnover_20d_avg": _e("turnover", 20), "turnover_ratio": f"turnover / greatest({_e('turnover', 20)}, 0.01)", **{f"vol_{n}d": f"stddev_pop(pct) {over(n - 1)}" for n in (5, 10, 20)}, "vol_regime": f"stddev_pop(pct) {_I} / greatest(stddev_pop(pct) {over(59)}, 0.01)",
    **{f"pct_from_high_{n}d": f"(close - {_e('close', n, 'max')}) / greatest({_e('close', n, 'max')}, 0.01) * 100" for n in (20, 60)}, **{f"pos_in_range_{n}d": f"case when {_e('close', n, 'max')} > {_e('close', n, 'min')} then (close - {_e('close', n, 'min')}) / greatest({_e('close', n, 'max')} - {_e('close', n, 'min')}, 0.01) else 0.5 end" for n in (20, 60)},
    "consecutive_up": f"=least({lag('run_up')}, 20)::bigint", "consecutive_down": f"=least({lag('run_down')}, 20)::bigint", "amplitude": "amp", "amplitude_5d_avg": _e("amp", 5), "amplitude_20d_avg": _e("amp", 20), "gap_up_count_20d": f"=sum((r * 100 > 2)::int) {_I}::bigint", "gap_down_count_20d": f"=sum((r * 100 < -2)::int) {_I}::bigint",
    "max_gap_20d": f"max(r) {_I} * 100", "min_gap_20d": f"min(r) {_I} * 100", "ret_skew_20d": f"({_P3} - 3 * {_P1} * {_P2} + 2 * pow({_P1}, 3)) / pow(stddev_pop(pct) {_I}, 3)", "ret_kurt_20d": f"({_P4} - 4 * {_P1} * {_P3} + 6 * pow({_P1}, 2) * {_P2} - 3 * pow({_P1}, 4)) / pow(stddev_pop(pct) {_I}, 4) - 3",
    "up_capture": "case when nu > 0 and nd > 0 then au end", "down_capture": "case when nu > 0 and nd > 0 then ad end", "up_down_ratio": "case when nu > 0 and nd > 0 then au / greatest(ad, 0.01) end", **{f"dist_ma{n}": f"(close - {_e('close', n)}) / greatest({_e('close', n)}, 0.01) * 100" for n in (5, 10, 20, 60)},
    "ma_bull_align": f"=({_e('close', 5)} > {_e('close', 10)} and {_e('close', 10)} > {_e('close', 20)} and {_e('close', 20)} > {_e('close', 60)})::int", "daily_ret": "pct", "win_rate_20d": f"avg((pct > 0)::int) {_I}", "avg_up_ret": "coalesce(au, 0)", "avg_down_ret": "coalesce(ad, 0)", "max_ret_20d": f"max(pct) {_I}", "min_ret_20d": f"min(pct) {_I}",
}


@query(f"""{BASE}, q0 as (select *, case when ord > 1 then dc / close * 100 else 0 end as pct from p), q1 as (select *, sum((pct <= 0)::int) over (partition by entity order by date) as iu, sum((pct >= 0)::int) over (partition by entity order by date) as idn from q0),
q2 as (select *, sum((pct > 0)::int) over (partition by entity, iu order by date) as run_up, sum((pct < 0)::int) over (partition by entity, idn order by date) as run_down, avg(case when pct > 0 then pct end) {_I} as au, abs(avg(case when pct < 0 then pct end) {_I}) as ad, count(case when pct > 0 then 1 end) {_I} as nu, count(case when pct < 0 then 1 end) {_I} as nd, list(close) {over(20, 1)} as cs from q1),
q3 as (select entity, date, ord, {pick(PRE, 4)}, round(list_min(list_transform(range(1, 21), lambda i: cs[i] / list_max(cs[1:i]) - 1)) * 100, 4) as max_dd_20d from q2) select * exclude (ord) from q3 where ord > 60""")
def pre_signal_features(spark, sf_dir):
    return rounded(MI.pre_signal(prepared(spark, sf_dir)), 4)
