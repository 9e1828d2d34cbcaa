"""Queries over the factor catalogue, one for each family, on weekly bars of brands.

The SQL is written from the definitions: exponential means as folds over an entity's list of closes, frames by name.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import factors as FA
from panelyte.plans.kernels import panel, rounded
from panelyte.plans.registry import bars_sql, query


def over(first: int, last: int = 0) -> str:
    return f"over (partition by entity order by date rows between {first} preceding and {f'{last} preceding' if last else 'current row'})"


def full(value: str, rows: int) -> str:
    """value where the row has `rows` rows up to it."""
    return f"case when ord >= {rows} then {value} end"


def later(value: str, rows: int, before: str = "0.0") -> str:
    return f"case when ord > {rows} then {value} else {before} end"


def sma(x: str, n: int) -> str:
    return full(f"avg({x}) {over(n - 1)}", n)


def std(x: str, n: int) -> str:
    """Of the n rows before."""
    return later(f"stddev_pop({x}) {over(n, 1)}", n, "null")


def corr(x: str, y: str, n: int) -> str:
    f = over(n, 1)
    return later(f"case when stddev_pop({x}) {f} * stddev_pop({y}) {f} > 1e-15 then greatest(least(covar_pop({x}, {y}) {f} / (stddev_pop({x}) {f} * stddev_pop({y}) {f}), 1), -1) end", n, "null")


LAG = "lag({0}{1}) over (partition by entity order by date)"


def lag(x: str, n: int = 1) -> str:
    return LAG.format(x, f", {n}" if n > 1 else "")


def fold(x: str, span: int) -> str:
    """Exponential mean from the first value on."""
    return f"list_reduce(list({x}) over (partition by entity order by date), lambda a, v: a + (v - a) * 2 / {span + 1}.0)"


def rsi(n: int) -> str:
    return full(f"100 - 100 / (1 + avg(greatest(dc, 0.0)) {over(n - 1)} / (avg(greatest(-dc, 0.0)) {over(n - 1)} + 1e-10))", n)


def squash(x: str) -> str:
    return f"atan({x}) / (pi() / 2)"


def pick(columns: dict[str, str], digits: int = 6, nudge: str = "") -> str:
    """Rounded columns; those that start with '=' as they are. Prices end in a half at any digit: a nudge of 1e-9 first
    makes both engines round them alike."""
    return ", ".join(f"{v[1:]} as {k}" if v[0] == "=" else f"round(({v})::double{nudge}, {digits}) as {k}" for k, v in columns.items())


NUDGE = " + 1e-9"


E = "1e-10"
BASE = f"""{bars_sql()}, p0 as (select entity, date, ord, open, high, low, close, volume, volume / 100 as turnover, coalesce((close - {lag('close')}) / ({lag('close')} + {E}), 0) as r,
  coalesce(close - {lag('close')}, 0) as dc, coalesce(volume - {lag('volume')}, 0) as dv, coalesce((open - {lag('close')}) / ({lag('close')} + {E}), 0) as gap,
  {later(f'(close - open) / (open + {E})', 1)} as intra, {later(f'(high - low) / (close + {E})', 1)} as amp,
  case when ord > 1 then greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) else high - low end as tr,
  volume / ({sma('volume', 20)} + 1e-6) as vr, {sma('close', 20)} as ma20, {sma('close', 60)} as ma60,
  {', '.join(f"(close - {lag('close', n)}) / ({lag('close', n)} + {E}) as mom_{n}" for n in (3, 5, 10, 20, 30))} from b),
p as (select *, {', '.join(f"{std('r', n)} as volatility_{n}" for n in (5, 10, 20))} from p0)"""
EMAS = f"ema as (select *, {', '.join(f'{fold("close", n)} as ema{n}' for n in (5, 10, 20, 60, 120, 250))}, {fold('close', 12)} - {fold('close', 26)} as macd from p), em as (select *, macd - {fold('macd', 9)} as macd_hist, {fold('macd', 9)} as macd_signal from ema)"


def prepared(spark, sf_dir):
    p = panel(spark, sf_dir).drop("ret", "grp").withColumn("turnover", F.col("volume") / 100)
    return FA.with_volatility(FA.prepare(p))


def chosen(df, columns, digits=6, nudge=0.0):
    out = df.select("entity", "date", *[c.alias(k) for k, c in columns.items()])
    nudged = [F.col(f.name) + nudge if f.dataType.simpleString() == "double" else F.col(f.name) for f in out.schema.fields]
    return rounded(out.select(*[c.alias(f.name) for c, f in zip(nudged, out.schema.fields, strict=True)]) if nudge else out, digits)


_MEANS = {f"ma{n}": f"ma{n}" for n in (5, 10, 20, 30, 60)}
_ORDER = " + ".join(f"case when {x} then 1 else 0 end" for x in ("close > ma5", "ma5 > ma10", "ma10 > ma20", "ma20 > ma60", "ma5 > ma20"))


@query(f"""{BASE}, {EMAS}, m as (select *, {', '.join(f"{sma('close', n)} as ma{n}" for n in (5, 10, 30))}, ema20 / {lag('ema20', 10)} - 1 as slope from em)
select entity, date, {pick({
    **{f'ema{n}': f'ema{n}' for n in (5, 10, 20, 60, 120, 250)}, 'macd': 'macd', 'macd_signal': 'macd_signal', 'macd_hist': 'macd_hist', **_MEANS,
    'ma_alignment': f'0.4 * ({_ORDER}) / 5 + 0.3 * tanh(3 * (ma5 - ma60) / (ma60 + {E})) + 0.3 * tanh(10 * slope)', 'ema20_slope': 'slope', 'ema_trend_strength': f'(ema20 - ema60) / (ema60 + {E})',
    'price_ma_30': f'close / (ma30 + {E}) - 1', 'price_ma_60': f'close / (ma60 + {E}) - 1', 'ma_cross_10_60': f'ma10 / (ma60 + {E}) - 1', 'ma_cross_10_20': f'ma10 / (ma20 + {E}) - 1',
    'ma_golden_20_60': 'case when ma20 > ma60 then 1 else 0 end', 'ma_all': 'case when ma5 > ma20 and ma20 > ma60 then 1 else 0 end', 'trend_30': f'(close - ma30) / (ma30 + {E})',
    'ema5_above_20': '=ema5 > ema20', 'ema20_above_60': '=ema20 > ema60', 'full_golden': '=ema5 > ema20 and ema20 > ema60', 'full_death': '=ema5 < ema20 and ema20 < ema60',
}, 4, NUDGE)} from m""")
def factor_trend(spark, sf_dir):
    p = FA.exponential(prepared(spark, sf_dir))
    kept = {c: F.col(c) for c in (*[f"ema{n}" for n in (5, 10, 20, 60, 120, 250)], "macd", "macd_signal", "macd_hist")}
    return chosen(p, kept | FA.trend_family(p), 4, 1e-9)


@query(f"""{BASE}, {EMAS}, m as (select *, {', '.join(f'{rsi(n)} as rsi_{n}' for n in (6, 8, 10, 14))}, {', '.join(f"{sma('tr', n)} as atr_{n}" for n in (10, 14, 20))}, {full(f'stddev_pop(close) {over(19)}', 20)} as sd,
  {later(f'stddev_pop(close) {over(20, 1)}', 20)} as sdx, {later(f'max(high) {over(20, 1)}', 20, 'null')} as high_20, {later(f'min(low) {over(20, 1)}', 20, 'null')} as low_20 from em)
select entity, date, {pick({
    **{f'rsi_{n}': f'rsi_{n}' for n in (6, 8, 10, 14)}, 'bb_upper': 'ma20 + 2 * sd', 'bb_middle': 'ma20', 'bb_lower': 'ma20 - 2 * sd', 'bb_width_20': f'4 * sdx / (ma20 + {E})',
    'bb_pos_30': f'(close - ma20 + 2 * sd) / (4 * sd + {E})', **{f'atr_{n}': f'atr_{n}' for n in (10, 14, 20)}, 'atr_ratio': f'atr_14 / (close + {E})', 'high_20': 'high_20', 'low_20': 'low_20',
    'price_position_20': f'(close - low_20) / (high_20 - low_20 + {E})', 'rsi_vol_combo': 'tanh((50 - rsi_14) / 100 - 0.5 * volatility_20)',
    'bb_rsi_combo': f'tanh((50 - rsi_14) / 100 - 0.3 * (close - ma20 + 2 * sd) / (4 * sd + {E}))', 'trend_lowvol': f'tanh(-50 * (ema20 - ema60) / (ema60 + {E}) * atr_14 / (close + {E}))',
}, 6, NUDGE)} from m""")
def factor_oscillators(spark, sf_dir):
    p = FA.exponential(prepared(spark, sf_dir))
    return chosen(p, FA.oscillator_family(p), 6, 1e-9)


def _down(n: int) -> str:
    bad = "case when r < 0 then r end"
    return later(f"case when count({bad}) {over(n, 1)} > 2 then stddev_pop({bad}) {over(n, 1)} else 0 end", n)


_Z = {n: f"coalesce(mom_{n}, 0)" for n in (5, 10, 20)}
_V41 = f"case when {_Z[10]} > 0 then tanh(3 * {_Z[20]}) else 0 end"
_COMPOSITE = {
    "trend_mom_v41": _V41, "trend_mom_v24": f"case when {_Z[10]} > 0 then tanh(3 * {_Z[20]}) else tanh(0.5 * {_Z[20]}) end", "trend_mom_v46": f"case when {_Z[10]} > 0 then tanh(2.5 * {_Z[20]}) else 0 end",
    "mom_diff_5_20": f"tanh(5 * ({_Z[5]} - {_Z[20]}))", "mom_diff_10_20": f"tanh(5 * ({_Z[10]} - {_Z[20]}))", "rsi_factor": "(coalesce(rsi_14, 50) - 50) / 100",
    "V41_RSI_915": f"0.915 * ({_V41}) + 0.085 * (coalesce(rsi_14, 50) - 50) / 100", "tech_fund_combo": f"0.7 * ({_V41}) + 0.1 * (coalesce(rsi_14, 50) - 50) / 100",
}


@query(f"""{BASE}, m as (select *, {rsi(14)} as rsi_14, {_down(10)} as dd10, {_down(20)} as dd20 from p)
select entity, date, {pick({
    **{f'mom_{n}': f'mom_{n}' for n in (3, 5, 10, 20, 30)}, **{f'volatility_{n}': f'volatility_{n}' for n in (5, 10, 20)}, 'volatility': 'tanh(-20 * volatility_20)',
    'downside_dev_10': 'dd10', 'downside_dev_20': 'dd20', 'low_downside': 'tanh(-30 * dd20)', **{f'mom_x_lowvol_{a}_{b}': f'tanh(-20 * mom_{a} * volatility_{b})' for a in (10, 20) for b in (10, 20)},
    **{f'ret_vol_ratio_{n}': squash(f'mom_{n} / (volatility_{n} + 1e-6)') for n in (10, 20)}, 'momentum_reversal': 'tanh(-3 * mom_20)', 'momentum_acceleration': 'tanh(5 * (mom_10 - mom_20))',
    **{k: later(v, 20, 'null') for k, v in _COMPOSITE.items()},
})} from m""")
def factor_momentum(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return chosen(p, FA.momentum_family(p))


_FLOW = """case when r > 0 and w > 1.2 then 2 * r * least(w, 3) when r > 0 and w < 0.7 then r / 2 when r < 0 and w > 1.5 then 0.3 * r else r end"""


@query(f"""{BASE}, m0 as (select *, volume / (avg(volume) {over(20)} + 1e-6) as w, {later(f'r - avg(r) {over(19)}', 20)} as residual, sum(case when r >= 0.095 then 0 else 1 end) over (partition by entity order by date) as island, {sma('turnover', 20)} as tm from p),
m as (select *, {_FLOW} as flow, sum(case when r >= 0.095 then 1 else 0 end) over (partition by entity, island order by date) as run from m0)
select entity, date, {pick({
    'volume_ratio_raw': 'vr', 'volume_ratio': squash('vr - 1'), 'volume_surge': 'tanh(2 * (vr - 1.5))', 'turnover_burst': f'tanh(2 * (turnover / (tm + {E}) - 1.5))',
    'inv_turnover': 'tanh((1 / (tm + 0.1) - 5) / 5)', 'turnover_shrink': 'tanh(-3 * (turnover / (tm + 1e-6) - 1))', 'turnover_stability': f"tanh(-2 * {std('turnover', 20)} / (tm + 1e-6))",
    'illiq_20': f"tanh(-1e10 * {sma(f'abs(r) / (close * volume + {E})', 20)})", 'vol_confirm': f"tanh(10 * {corr('r', 'volume', 20)} * mom_20)", 'price_volume_corr_20': f"tanh(10 * {corr('dc', 'dv', 20)} * mom_20)",
    'smart_money_flow': f"tanh(3 * {later(f'sum(flow) {over(4)} / 5', 5)})", 'idiosyncratic_volatility': f"tanh(-30 * {std('residual', 20)})",
    'earnings_quality': 'tanh(3 * tanh((1 / (tm + 0.1) - 5) / 5) / (1 + 10 * abs(tanh(-20 * volatility_20))))',
    'limit_up_freq': f"tanh(10 * {sma('case when r >= 0.095 then 1.0 else 0.0 end', 20)})", 'consec_limit_up': 'tanh(0.3 * run)',
})} from m""")
def factor_volume(spark, sf_dir):
    p = FA.with_flow(prepared(spark, sf_dir))
    return chosen(p, FA.volume_family(p))


_X = over(20, 1)
_M1, _M2, _M3, _M4 = (f"avg({x}) {_X}" for x in ("r", "r * r", "r * r * r", "r * r * r * r"))
_SD = f"stddev_pop(r) {_X}"
_SPREAD = lambda c: f"case when count(case when {c} then r end) {_X} > 2 then stddev_pop(case when {c} then r end) {_X} else 0 end"
_BACK = {n: f"(close - {lag('close', n)}) / ({lag('close', n)} + {E})" for n in (5, 10, 20)}
_STEADY = " + ".join(f"case when {x} > 0 then 1.0 else -0.5 end" for x in _BACK.values())


@query(f"""{BASE}, m as (select *, {_SD} as sd, {_M1} as m1, {_M2} as m2, {_M3} as m3, {_M4} as m4, {_SPREAD('r > 0')} as ups, {_SPREAD('r < 0')} as downs, stddev_pop(r) {over(19)} as own,
  sum(r) {over(4)} - 5 * avg(r) {over(19)} as drift, sum(case when gap > 0.01 then gap else 0 end) {_X} as gu, -sum(case when gap < -0.01 then gap else 0 end) {_X} as gd,
  {_BACK[20]} as back20, {_STEADY} as steady, avg(high - low) {over(4)} / (close + {E}) as width, list_sort(list(r) {over(19)})[1:5] as worst from p)
select entity, date, {pick({
    'overnight_ret': f"tanh(15 * {later(f'sum(gap) {over(19)}', 20)})", 'intraday_ret': f"tanh(15 * {later(f'sum(intra) {over(19)}', 20)})",
    'skewness_20': f"tanh({later(f'case when sd > {E} then (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / (sd * sd * sd + {E}) else 0 end', 20)})",
    'kurtosis_20': f"tanh(-({later(f'case when sd > {E} then (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (sd * sd * sd * sd) - 3 else 0 end', 20)}) / 3)",
    'volatility_skew': f"tanh({later(f'case when sd > {E} and downs > {E} then ups / downs - 1 else 0 end', 20)})", 'residual_momentum': f"tanh(2 * {later(f'case when sd > {E} and own > {E} then drift / own else 0 end', 20)})",
    'max_ret_20': f"tanh(3 * {later(f'max(r) {_X}', 20)})", 'tail_risk': f"tanh(5 * {later('list_sum(worst) / 5', 19, 'null')})", 'gap_ratio': f"tanh(3 * {later(f'(gu - gd) / (gu + gd + {E})', 20)})",
    'relative_strength': f"tanh(0.5 * {later('case when own > 1e-6 then back20 / own * (0.5 + 0.5 * greatest((' + 'steady' + ') / 3, 0)) else 0 end', 20)})",
    'short_reversal': f"tanh({later('case when abs(r) > 0.04 and width > 0.03 then -2 * r else 0 end', 5)})",
})} from m""")
def factor_shape(spark, sf_dir):
    p = prepared(spark, sf_dir)
    return chosen(p, FA.shape_family(p))


@query(f"""{BASE}, m0 as (select *, {sma('close', 5)} as ma5, (ma20 - {lag('ma20', 5)}) / ({lag('ma20', 5)} + {E}) as slope, (close - ma20) / (ma20 + {E}) as off, {rsi(14)} as rsi_14 from p),
m1 as (select *, tanh(200 * slope) as ms, tanh(3 * (case when off > 0 then 0.35 * (1 - least(abs(off) / 0.05, 1)) else 0 end + 0.35 * tanh(100 * slope + 0.5) + 0.30 * greatest(least((vr - 0.8) / 1.2, 1), 0))) as tb,
  case when ma5 > ma20 and {lag('ma5')} <= {lag('ma20')} then 1 else 0 end * tanh(50 * (ma5 - ma20) / (ma20 + {E}) + 0.5) as gc from m0)
select entity, date, {pick({'ma20_slope': 'ms', 'trend_breakout': 'tb', 'ma_golden_cross': 'gc',
    'trend_initiation': '0.30 * tb + 0.25 * gc + 0.25 * ms + 0.20 * case when rsi_14 < 40 then 0 when rsi_14 < 55 then (rsi_14 - 40) / 15 when rsi_14 < 70 then 1 else 1 - (rsi_14 - 70) / 30 end'})} from m1""")
def factor_initiation(spark, sf_dir):
    p = prepared(spark, sf_dir).withColumn("ma5", W.sma(F.col("close"), 5))
    before = W.lag(F.col("ma20"), 5)
    p = p.withColumn("slope5", F.when(before > 0, (F.col("ma20") - before) / (before + FA.EPS)))
    return chosen(p, FA.initiation_family(p))


_NOW, _THEN = over(9), over(19, 10)
PATTERNS_SQL = f"""{BASE}, {EMAS}, m0 as (select *, list(r) {_X} as rs, list(volume) {_X} as vs, list(close) {_X} as cs, avg(volume) {_X} as v20, max(high) {over(20, 2)} as h19, max(close) {over(10)} as c11,
  (max(high) {_NOW} - min(low) {_NOW}) / (avg(close) {_NOW} + {E}) < 0.7 * ((max(high) {_THEN} - min(low) {_THEN}) / (avg(close) {_THEN} + {E})) as tight, avg(volume) {_NOW} < 0.8 * avg(volume) {_THEN} as quiet,
  stddev_pop(close) {_NOW} / (avg(close) {_NOW} + {E}) < 0.03 as flat, ord > 59 and avg(close) {over(19)} > avg(close) {over(59)} as up,
  ord > 24 and avg(close) {over(19)} > avg(close) {over(24, 5)} and avg(volume) {over(4)} < 0.8 * avg(volume) {over(9, 5)} as resting,
  {later(f'(close - min(low) {_X}) / (max(high) {_X} - min(low) {_X} + {E})', 20, 'null')} as place, {later(f"(close - {lag('close', 5)}) / ({lag('close', 5)} + {E})", 5)} as ret5,
  {later(f'(max(high) {over(5)} - min(low) {over(5)}) / (close + {E})', 5)} as amp5, {lag('gap')} as gap1,
  avg(volume) {over(5)} / (avg(volume) {over(15, 6)} + {E}) as vt, avg(amp) {over(5)} / (avg(amp) {over(15, 6)} + {E}) as aw, (close - {lag('close', 5)}) / ({lag('close', 5)} + {E}) as back5,
  close >= max(close) {over(10, 1)} and avg(volume) {over(3)} / max(volume) {over(15, 6)} < 0.5 as spent, avg(amp) {over(3)} / (avg(amp) {over(20, 6)} + {E}) > 2 as wide,
  close > {lag('close', 8)} and macd_hist < {lag('macd_hist', 8)} as falling, {sma('close', 5)} as ma5, coalesce(dc / {lag('close')} >= 0.095 and close / high >= 0.97, false) as hit, close > ma20 and ma20 > ma60 as rise from em),
m1 as (select *, list_position(rs, list_min(rs)) as k, {lag('vr')} as pvr, {lag('ret5')} as pret, {lag('amp5')} as pamp, {lag('place')} as ppl, {lag('open')} as pop, {lag('close')} as pcl,
  max(case when hit then ord end) {over(20, 1)} as hit_ord, {lag('ma5', 5)} as ma5b from m0),
m as (select m1.*, h.volume as hit_v, (select sum(volume) from m0 x where x.entity = m1.entity and x.ord between m1.hit_ord + 1 and m1.ord) / (m1.ord - hit_ord) as since from m1 left join m0 h on h.entity = m1.entity and h.ord = hit_ord)"""
_WASH = f"""case when ord > 20 and rs[k] < -0.03 and vs[k] > 1.5 * v20 and (cs[20] - cs[k]) / (abs(cs[k]) + {E}) > 0.5 * abs(rs[k])
  then 3 * abs(rs[k]) + case when k <= 15 and (vs[18] + vs[19] + vs[20]) / 3 < (vs[k] + vs[k + 1] + vs[k + 2]) / 3 then 0.2 else 0 end else 0 end"""
_GAP = """least(greatest(case when gap > 0.02 then case when vr > 2 then 0.9 when vr > 1.3 then 0.5 when vr < 0.7 then -0.5 else 0.2 end
  when gap < -0.02 then case when vr > 2 then -0.9 when vr < 0.5 then 0.1 else -0.4 end else 0 end * case when gap * gap1 > 0 and abs(gap) > 0.01 then 1.3 else 1 end, -1), 1)"""
_OPENS = "ord > 1 and not coalesce(pvr < 1.5, false) and open > pcl"
_STRENGTH = f"""case when ord > 6 then case when pret < -0.04 then 0.15 when pret > 0.04 then 0.05 else 0.1 end else 0 end + case when ord > 5 then case when pamp < 0.05 then 0.08 when pamp > 0.15 then -0.05 else 0 end else 0 end
  + case when ord > 20 then case when ppl < 0.25 then 0.12 when ppl > 0.8 then -0.1 else 0 end else 0 end + case when pvr > 3 then 0.3 when pvr > 2 then 0.2 else 0.12 end
  + case when pcl > pop then 0.05 + least(0.1, 2 * greatest(0, (pcl - pop) / (pop + {E}))) else -0.1 end + case when close > open then 0.08 + case when close > pcl then 0.05 else 0 end else -0.06 end"""
_PHASE = """least(greatest(case when coalesce(rise, false) then case when place < 0.25 then 0.8 when place < 0.6 then 0.4 when place < 0.85 then -0.2 else -0.7 end
    else case when place > 0.75 then 0.8 when place > 0.4 then 0.4 when place > 0.15 then -0.2 else -0.7 end end
  + case when case when coalesce(rise, false) then back5 > 0.03 else back5 < -0.03 end then case when vt > 1.3 then 0.3 when vt < 0.7 then -0.5 else 0 end else 0 end
  + case when aw > 2.5 then -0.4 when aw > 1.5 then 0.3 else 0 end, -1), 1)"""
_SPENT = "case when place < 0.7 then 0 else least(case when spent then 0.4 else 0 end + case when wide then 0.3 else 0 end + case when falling then 0.3 else 0 end + case when r > 0.02 and intra < -0.02 then 0.2 else 0 end, 1) end"
_PULL = """case when hit_ord is not null and ord - hit_ord <= 15 then tanh(3 * (0.35 * case when since / hit_v < 0.5 then 1 when since / hit_v < 0.8 then 1 - (since / hit_v - 0.5) / 0.3 else 0 end
  + 0.4 * case when close / ma5 between 0.97 and 1.02 then 1 - abs(close / ma5 - 1) / 0.03 when close / ma5 >= 0.95 and close / ma5 < 0.97 then (close / ma5 - 0.95) / 0.02 * 0.5 when close / ma5 > 1.02 and close / ma5 <= 1.05 then (1.05 - close / ma5) / 0.03 * 0.5 else 0 end
  + 0.25 * case when (ma5 - ma5b) / ma5b >= -0.005 then 1 else greatest(0, 1 + 100 * (ma5 - ma5b) / ma5b) end)) else 0 end"""


@query(f"""{PATTERNS_SQL} select entity, date, {pick({
    'wash_sale_score': f'tanh(2 * ({_WASH}))', 'vol_price_breakout': f"tanh(2 * {later('case when volume > 2 * v20 then case when close > h19 then 1 when close > 0.98 * h19 then 0.5 else 0 end else 0 end', 20)})",
    'volume_contraction': f"tanh(3 * {later(f'case when resting and c11 > close and (c11 - close) / (c11 + {E}) < 0.05 then 1 - 10 * (c11 - close) / (c11 + {E}) else 0 end', 20)})",
    'consolidation_breakout': f"tanh(2 * {later('case when tight and quiet and flat and up then 1 when tight and (quiet or flat) then 0.4 else 0 end', 20)})",
    'gap_breakout_confirm': _GAP, 'vol_opening_confirm': f'case when {_OPENS} then 1 else 0 end', 'vol_opening_strength': f'case when {_OPENS} then least(greatest({_STRENGTH}, 0.15), 1) else 0 end',
    'stroke_phase': later(_PHASE, 20), 'exhaustion_risk': later(_SPENT, 20), 'limit_pullback_score': later(_PULL, 25),
})} from m""")
def factor_patterns(spark, sf_dir):
    p = FA.limit_pullback(FA.with_place(FA.exponential(prepared(spark, sf_dir))))
    c, h, low, v, place = (F.col(x) for x in ("close", "high", "low", "volume", "place"))
    confirmed, strength = FA.opening_confirm(p)
    return chosen(p, {
        "wash_sale_score": F.tanh(FA.wash_sale(F.col("r"), v, c) * 2), "vol_price_breakout": F.tanh(FA.breakout(c, h, v) * 2), "volume_contraction": F.tanh(FA.contraction(c, v) * 3),
        "consolidation_breakout": F.tanh(FA.consolidation(c, h, low, v) * 2), "gap_breakout_confirm": FA.gap_breakout(F.col("gap"), F.col("vr")),
        "vol_opening_confirm": confirmed, "vol_opening_strength": strength, "stroke_phase": FA.stroke_phase(place), "exhaustion_risk": FA.exhaustion(place, F.col("macd_hist")),
        "limit_pullback_score": F.col("limit_pullback_score"),
    })


_CHOSEN = ["rsi_14", "bb_pos_30", "mom_x_lowvol_10_20", "gap_ratio", "price_ma_60", "ma7", "ret_30", "atr_ratio_20", "ln_cap"]


@query(f"""{BASE}, amt as (select entity, date, amount from bars), m as (select p.*, amount, {rsi(14)} as rsi_14, {full(f'stddev_pop(close) {over(19)}', 20)} as sd, {sma('tr', 20)} as atr_20, {sma('close', 7)} as ma7,
  sum(case when gap > 0.01 then gap else 0 end) {over(20, 1)} as above, -sum(case when gap < -0.01 then gap else 0 end) {over(20, 1)} as below from p join amt using (entity, date))
select entity, date, {pick({
    'rsi_14': 'rsi_14', 'bb_pos_30': f'(close - ma20 + 2 * sd) / (4 * sd + {E})', 'mom_x_lowvol_10_20': 'tanh(-20 * mom_10 * volatility_20)', 'gap_ratio': f"tanh(3 * {later(f'(above - below) / (above + below + {E})', 20)})",
    'price_ma_60': f'close / (ma60 + {E}) - 1', 'ma7': 'ma7', 'ret_30': f"close / {lag('close', 30)} - 1", 'atr_ratio_20': f'atr_20 / (close + {E})',
    'ln_cap': 'case when amount > 0 and turnover > 0.001 then tanh(ln(greatest(amount / (turnover / 100), 1e6)) / 10 - 0.5) else 0 end',
}, 6, NUDGE)} from m""")
def chosen_factors(spark, sf_dir):
    """Nine factors of five families by name; the registry plans what they need and nothing else."""
    from panelyte.operators.catalogue import REGISTRY

    p = REGISTRY.plan(panel(spark, sf_dir).drop("ret", "grp").withColumn("turnover", F.col("volume") / 100), _CHOSEN)
    return chosen(p, {c: F.col(c) for c in _CHOSEN}, 6, 1e-9)
