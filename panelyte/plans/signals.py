"""Queries over regimes, statements, flows, gates and decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import factors as FA
from panelyte.operators import flows as FL
from panelyte.operators import fundamentals as FU
from panelyte.operators import regime as RG
from panelyte.operators import signals as SG
from panelyte.operators import swing
from panelyte.operators.factors import EPS
from panelyte.operators.swing import WINDOW_POINTS
from panelyte.plans.factors import BASE, EMAS, E, fold, full, lag, later, over, pick, prepared, sma
from panelyte.plans.kernels import panel, rounded
from panelyte.plans.registry import REPORTS_SQL, bars_sql, query
from panelyte.plans.structure import WINDOW_CTES
from panelyte.sources.panels import bars, market, membership, reports

O = "over (order by date)"


def o(first: int, last: int = 0) -> str:
    return f"over (order by date rows between {first} preceding and {f'{last} preceding' if last else 'current row'})"


def adjusted(x: str, span: float, by: str = "") -> str:
    """Exponential mean whose weights sum to 1 from the first row on."""
    k = 2 / (span + 1)
    w = f"over ({by}order by date)"
    return f"list_reduce(list({x}) {w}, lambda a, v: a * {1 - k!r} + v) / ((1 - pow({1 - k!r}, count(*) {w})) / {k!r})"


LADDER = f"""{bars_sql()}, mk as (select date, avg(close) as close, sum(volume) as volume from bars group by 1),
i0 as (select *, row_number() {O} as ord, close / lag(close) {O} - 1 as ret, {', '.join(f'close / lag(close, {n}) {O} - 1 as m{n}' for n in (5, 10, 20, 60, 120))}, {', '.join(f'{adjusted("close", n)} as e{n}' for n in (20, 60, 120))},
  close / max(close) {o(119)} - 1 as fall120, close / max(close) {o(59)} - 1 as fall60 from mk),
i1 as (select *, case when count(ret) {o(19)} = 20 then stddev_samp(ret) {o(19)} * sqrt(252.0) end as vol, e20 > e60 as s, e60 > e120 as l,
  coalesce(m5 < -0.01, false)::int + coalesce(m20 < -0.015, false)::int + coalesce(m60 < -0.02, false)::int as falling,
  coalesce(m5 > 0.01, false)::int + coalesce(m20 > 0.01, false)::int + coalesce(m60 > 0.02, false)::int + (e20 > e60)::int as bulls,
  coalesce(m5 < -0.01, false)::int + coalesce(m20 < -0.01, false)::int + coalesce(m60 < -0.02, false)::int + (e20 <= e60)::int as bears from i0),
i2 as (select *, case when ord <= 60 then 0 when falling >= 2 and m60 < 0 then 1 when m20 < -0.03 and not s and not l and m60 < 0 then 2 when m20 > 0.015 and m60 > -0.01 then 3 when m20 > 0.0075 and s and l then 4
  when m20 > 0.015 * 0.67 and s then 5 when m5 > 0.0225 and m20 > 0.0075 then 6 when abs(bulls - bears) / greatest(bulls + bears, 1) < 0.3 then 7 when bears > bulls then 8 when bulls >= 3 then 9 else 10 end as rule from i1),
i3 as (select *, case when rule in (1, 2, 8) then -1 when rule in (3, 4, 5, 6, 9) then 1 else 0 end as regime, case rule when 0 then 0.0 when 1 then 0.7 + 0.1 * falling when 2 then 0.8 when 3 then 1.0 when 4 then 0.7 when 5 then 0.55 when 6 then 0.45 when 7 then 0.5 when 8 then 0.45 when 9 then 0.35 else 0.30 end::double as confidence,
  case when ord <= 60 then 0 else greatest(least(m20 / 0.15, 1), -1) end as momentum_score, case when ord <= 60 then 0.0 when s and l then 1.0 when not s and not l then -1.0 when s then 0.5 else -0.5 end::double as trend_score,
  case when ord <= 60 then 0 else vol end as volatility, ord > 60 and (vol > 0.30 or vol < 0.15) as is_extreme, ord > 60 and fall120 < -0.07 and coalesce(m120, 0) < -0.03 and not s and not l as bear_risk, ord > 60 and fall60 < -0.05 and m60 < -0.02 as bear_risk_fast from i2),
lad as (select *, case when ord >= 30 then avg(bear_risk::int) {o(59)} > 0.70 else false end as severe_bear, case when ord > 20 then least(sum(sw) {o(19)} / 20 * 5, 1) else 0 end as regime_volatility, case when ord >= 5 then volume / (avg(volume) {o(19)} + 1) end as index_volume_ratio
  from (select *, coalesce(regime <> lag(regime) {O}, false)::int as sw from i3))"""


def ladder(spark, sf_dir):
    return RG.ladder(market(bars(spark, sf_dir)))


@query(f"""{LADDER} select date, {pick({'regime': '=regime', 'confidence': 'confidence', 'momentum_score': 'momentum_score', 'trend_score': 'trend_score', 'volatility': 'volatility', 'is_extreme': '=is_extreme', 'bear_risk': '=bear_risk',
    'bear_risk_fast': '=bear_risk_fast', 'severe_bear': '=severe_bear', 'regime_volatility': 'regime_volatility', 'index_volume_ratio': 'index_volume_ratio'})} from lad""")
def regime_series(spark, sf_dir):
    """Regime, confidence, scores and risks of the mean close of all entities."""
    return rounded(ladder(spark, sf_dir).drop("entity", "ord", "close", "ret", "m10", "m20"))


STYLE = f"""{LADDER}, ax as (select date, grp, avg(close) as c from bars where grp in ('1', '5') and extract(month from date) <> 7 group by 1, 2), ar as (select *, c / lag(c) over (partition by grp order by date) - 1 as r from ax),
st0 as (select lad.*, a.r as small, g.r as growth from lad left join ar a on a.date = lad.date and a.grp = '1' left join ar g on g.date = lad.date and g.grp = '5'),
st1 as (select *, case when ord <= 60 then 0 when small is not null then greatest(least((avg(small) {o(20)} - avg(ret) {o(20)}) / 0.02, 1), -1) else greatest(least(coalesce(m10, 0) / 0.03, 1), -1) end as size_score,
  case when ord <= 60 then 0 when growth is not null then greatest(least((avg(growth) {o(20)} - avg(ret) {o(20)}) / 0.02, 1), -1) when m20 > 0.03 then least(m20 / 0.1, 1) when m20 < -0.03 then greatest(m20 / 0.1, -1) else 0 end as style_score from st0),
sty as (select *, case when size_score > 0.3 then 'small_cap' when size_score < -0.3 then 'large_cap' else 'balanced' end || case when style_score > 0.3 then '_growth' when style_score < -0.3 then '_value' else '' end as style_regime, least(1, abs(size_score) * 2) as style_confidence from st1)"""


@query(f"{STYLE} select date, {pick({'size_score': 'size_score', 'style_score': 'style_score', 'style_regime': '=style_regime', 'style_confidence': 'style_confidence'})} from sty")
def style_regime(spark, sf_dir):
    """Size and style against two group indices that lack July."""
    b = bars(spark, sf_dir).filter("grp in ('1', '5')").filter(F.month("date") != 7)
    aux = b.groupBy(F.col("grp").alias("entity"), "date").agg(F.avg("close").alias("close"))
    aux = aux.withColumn("aux", F.col("close") / W.lag(F.col("close")) - 1)
    p = RG.style(ladder(spark, sf_dir), aux.filter("entity = '1'"), aux.filter("entity = '5'"))
    return rounded(p.select("date", "size_score", "style_score", "style_regime", "style_confidence"))


SETS = {"bull": {"mom_20": 0.5, "mom_5": 0.3, "vr_20": -0.2}, "neutral": {"pos_20": 0.6, "vol_20": -0.4}, "bear": {"vol_20": -0.7, "mom_20": 0.0005, "pos_20": 0.3}}
_SETS = ", ".join(f"('{s}', '{f}', {w})" for s, fs in SETS.items() for f, w in fs.items())


@query(f"""{LADDER}, sh as (select date, 1 / (1 + exp(-5 * trend_score)) as up, greatest(least(coalesce(volatility, 0.15) / 0.20, 2.0), 0.5) as wild from lad),
sb as (select date, greatest(least(up * (2 - wild * 0.5), 1), 0) as bull, greatest(least((1 - up) * wild * 0.7, 1), 0) as bear from sh), sn as (select *, greatest(0, 1 - bull - bear) as neutral from sb),
sx as (select date, state, case state when 'bull' then bull when 'bear' then bear else neutral end / (bull + bear + neutral + 1e-10) as share from sn, (select unnest(['bull', 'neutral', 'bear']) as state))
select date, factor, round(sum(share * abs(weight)), 6) as weight from sx join (values {_SETS}) v(state, factor, weight) using (state) group by 1, 2 having sum(share * abs(weight)) > 0.001""")
def state_blended_weights(spark, sf_dir):
    """Factor weights of each date between the sets of three market states."""
    sets = spark.createDataFrame([(s, f, float(w)) for s, fs in SETS.items() for f, w in fs.items()], "state string, factor string, weight double")
    return rounded(RG.blended_weights(ladder(spark, sf_dir).select("date", "trend_score", "volatility"), sets))


@query(f"""{LADDER}, sg as (select date, count(*) filter (ret > 0.5) as strong from b group by 1), ex0 as (select lad.*, strong, case when bear_risk then 0 when trend_score >= 0.5 then 0.95 when trend_score > 0 then 0.475 else 0.285 end as e from lad join sg using (date)),
ex1 as (select *, case when index_volume_ratio < 0.5 then least(e, 0.35) when index_volume_ratio < 0.7 then least(e, 0.5) else e end as c from ex0),
ex2 as (select *, case when strong >= 2 and c < 0.6 then greatest(c, case when bear_risk then 0.15 when bear_risk_fast then 0.45 else 0.6 end) else c end as lf from ex1)
select date, {pick({'exposure': 'lf * case when volatility > 0.01 then greatest(least(0.20 / volatility, 1), 0.75) else 1 end'})} from ex2""")
def market_exposure(spark, sf_dir):
    """Share of capital by trend, bear risk, volume, number of strong moves and volatility."""
    strong = panel(spark, sf_dir).groupBy("date").agg(F.count_if(F.col("ret") > 0.5).alias("strong"))
    p = ladder(spark, sf_dir).join(strong, "date")
    e = RG.exposure(F.col("trend_score"), F.col("bear_risk"), F.col("bear_risk_fast"), F.col("index_volume_ratio"), F.col("strong"), F.col("volatility"))
    return rounded(p.select("date", e.alias("exposure")))


@query(f"""{LADDER}, yr as (select year(date) as year, first(c order by date) as c0, last(c order by date) as c1, first(i order by date) as i0, last(i order by date) as i1 from (select lad.date, lad.close as i, q.c from lad join (select date, avg(close) as c from bars where grp = '2' group by 1) q using (date)) group by 1),
ye as (select year, c1 / c0 - 1 as strategy, i1 / i0 - 1 as index from yr) select year, round(strategy, 6) as strategy, round(index, 6) as index, round(strategy - index, 6) as excess, round(exp(sum(ln(1 + strategy)) over (order by year)) - 1, 6) as cumulative from ye""")
def yearly_excess(spark, sf_dir):
    """A group's return against the market's, by year."""
    b = bars(spark, sf_dir)
    own = b.filter("grp = '2'").groupBy("date").agg(F.avg("close").alias("strategy"))
    return rounded(RG.yearly_excess(market(b).select("date", F.col("close").alias("index")).join(own, "date")))


NB = bars_sql("nation")
ASOF_REPORTS = f"""{NB}, {REPORTS_SQL}, fj as (select b.entity, b.date, b.close, rd.period, {', '.join('rd.' + f for f in FU.FIELDS)}, pg_improve, rg_improve, coalesce(profit_declining, null) as profit_declining, row_number() over (partition by b.entity, b.date order by rd.available desc, rd.period desc) as k
  from b left join rd on rd.entity = b.entity and rd.available <= b.date), ff as (select * from fj where k = 1)"""
_STEP = """least(1.0, case when roe / 100 > 0.15 then 0.35 when roe / 100 > 0.10 then 0.25 when roe / 100 > 0.05 then 0.15 else 0 end + case when profit_growth / 100 > 0.5 then 0.30 when profit_growth / 100 > 0.2 then 0.20 when profit_growth / 100 > 0 then 0.10 else 0 end
  + case when revenue_growth / 100 > 0.3 then 0.20 when revenue_growth / 100 > 0.15 then 0.12 when revenue_growth / 100 > 0 then 0.05 else 0 end + case when eps > 1 then 0.20 when eps > 0.5 then 0.12 else 0 end)"""


def _squash(x: str, lo: float, hi: float, centre: float, scale: float) -> str:
    return f"coalesce(tanh((case when {x} is null then null else greatest(least({x}, {hi}), {lo}) end - {centre}) * {scale}), 0)"


def of_reports(spark, sf_dir):
    return FU.as_of(bars(spark, sf_dir, "nation").select("entity", "date", "close"), reports(spark, sf_dir))


@query(f"""{ASOF_REPORTS} select entity, date, {pick({
    'fund_score': _squash(_STEP, 0, 1, 0.5, 3), 'fund_roe': _squash('roe', -50, 50, 10, 0.05), 'fund_profit_growth': _squash('profit_growth / 100', -100, 100, 0, 1), 'fund_revenue_growth': _squash('revenue_growth / 100', -100, 100, 0, 1),
    'fund_gross_margin': _squash('gross_margin', -20, 80, 30, '1 / 30.0'), 'fund_cf_to_profit': _squash('cf_to_profit', -5, 5, 1, 1), 'fund_pg_improve': _squash('pg_improve / 100', -5, 5, 0, 2), 'fund_rg_improve': _squash('rg_improve / 100', -5, 5, 0, 2),
    'fund_pe': _squash('(case when eps > 0 then close / eps end)', 1, 200, 15, '-1 / 30.0'), 'fund_pb': _squash('(case when bps > 0 then close / bps end)', 0.1, 50, 1.5, -0.2)})} from ff""")
def fundamental_factors(spark, sf_dir):
    """Ten compressed statement factors as known on each bar's date."""
    p = of_reports(spark, sf_dir)
    return rounded(p.select("entity", "date", *[x.alias(k) for k, x in FU.factors(p).items()]))


@query(f"""{ASOF_REPORTS}, fq as (select *, first_value(coalesce(roe >= 14 and profit_growth >= 0, false)) over (partition by entity, date_trunc('quarter', date) order by date) as qualified from ff)
select entity, date, period, {pick({'roe': 'roe', 'profit_growth': 'profit_growth', 'revenue_growth': 'revenue_growth', 'eps': 'eps', 'bps': 'bps', 'gross_margin': 'gross_margin', 'pe': 'case when eps > 0 then close / eps end', 'pb': 'case when bps > 0 then close / bps end',
    'rank_score': 'coalesce(least(roe, 40), 0) + coalesce(least(profit_growth / 2, 30), 0) + coalesce(least(revenue_growth / 3, 20), 0) + case when eps > 0 then least(eps * 5, 10) else 0 end', 'profit_declining': '=profit_declining', 'qualified': '=qualified'}, 4)} from fq""")
def asof_prev_report(spark, sf_dir):
    """Typed values of the latest report, ratios to price, ranking points, the profit screen and the quarter's filter."""
    p = FU.held_by_quarter(of_reports(spark, sf_dir), 14.0, 0.0)
    c = F.col
    return rounded(p.select(
        "entity", "date", "period", "roe", "profit_growth", "revenue_growth", "eps", "bps", "gross_margin", F.when(c("eps") > 0, c("close") / c("eps")).alias("pe"), F.when(c("bps") > 0, c("close") / c("bps")).alias("pb"),
        FU.rank_score(c("roe"), c("profit_growth"), c("revenue_growth"), c("eps")).alias("rank_score"), "profit_declining", "qualified",
    ), 4)


_FLOWDAY = "case when r > 0 and w > 1.2 then 2 * r * least(w, 3) when r > 0 and w < 0.7 then r / 2 when r < 0 and w > 1.5 then 0.3 * r else r end"
FLOW_SQL = f"""{BASE}, c0 as (select *, {sma('volume', 20)} as v20, {sma('volume', 10)} as v10, {sma('volume', 5)} as v5, {sma('turnover', 10)} as t10 from p),
c1 as (select *, coalesce(volume / v20, 1) as w, (close - open) * volume / (v20 + {E}) as net, coalesce(v10 / {lag('v10', 10)}, 1) as vt, {later(f"(close - {lag('close', 10)}) / ({lag('close', 10)} + {E})", 10)} as ch, {lag('v5', 5)} as v5b, {full(f'max(high) {over(19)}', 20)} as top from c0),
c2 as (select *, {_FLOWDAY} as flow, case when ord >= 6 then coalesce(case when count(net) {over(4)} = 5 then sum(net) {over(4)} / 5 end, 0) else 0 end as net_flow,
  least(case when abs(ch) < 0.05 and vt > 1.3 then 0.6 when abs(ch) < 0.08 and vt > 1.1 then 0.35 else 0 end + case when ch < -0.03 and vt < 0.8 and v5 > 1.2 * v5b and r > 0 then 0.4 else 0 end + case when t10 < 0.01 and abs(ch) < 0.03 then 0.25 else 0 end, 1) as accumulation,
  case when volume > 1.5 * v20 and close >= 0.98 * top and close > open then least(greatest((volume / (v20 + {E}) - 1.5) * 0.5 + 0.6, 0), 1) when volume > 1.2 * v20 and close >= 0.95 * top then 0.35 else 0 end as breakout from c1),
c3 as (select *, {later(f'sum(flow) {over(4)} / 5', 5)} as smart_money, case when ord > 60 then stddev_pop(net_flow) {over(60)} + {E} else 1 end as sd from c2),
c4 as (select *, 0.3 * greatest(least(smart_money * 4 + 0.5, 1), 0) + 0.3 * greatest(least(net_flow / sd * 0.15 + 0.5, 1), 0) + 0.2 * accumulation + 0.2 * breakout as raw from c3),
cf as (select *, case when raw > 0.55 then 1 when raw < 0.35 then -1 else 0 end as capital_flow_direction, {fold('raw', 5)} as capital_flow_score from c4)"""


@query(f"{FLOW_SQL} select entity, date, {pick({'smart_money': 'smart_money', 'accumulation': 'accumulation', 'net_flow': 'net_flow', 'breakout': 'breakout', 'capital_flow_direction': '=capital_flow_direction', 'capital_flow_score': 'capital_flow_score'}, 5)} from cf")
def capital_flow(spark, sf_dir):
    p = FL.capital_flow(prepared(spark, sf_dir))
    return rounded(p.select("entity", "date", "smart_money", "accumulation", "net_flow", "breakout", "capital_flow_direction", "capital_flow_score"), 5)


def _ladder(x: str, rules: list[tuple[str, str]]) -> str:
    return "case " + " ".join(f"when {x} {at} then {v}" for at, v in rules) + " else 0 end"


_SD20 = full(f"stddev_pop(r) {over(19)}", 20)
NEWS_SQL = f"""{BASE}, n0 as (select *, abs(gap) as g, abs(r) as m, volume / ({sma('volume', 20)} + {E}) as vq, abs(r) / ({_SD20} + {E}) as z, {lag('gap', 3)} as gap3, coalesce({lag('close', 4)}, {lag('close', 3)}) as base, min(low) {over(2)} as lo3, max(high) {over(2)} as hi3 from p),
n1 as (select *, {_ladder('g', [('> 0.05', '0.9'), ('> 0.03', '0.65 + (g - 0.03) * 12.5'), ('> 0.015', '0.3 + (g - 0.015) * 23.3'), ('> 0.005', 'g * 30')])} as gap_signal,
  case when ord > 20 then {_ladder('vq', [('>= 4', '0.9'), ('>= 3', '0.6 + (vq - 3) * 0.3'), ('>= 2', '0.3 + (vq - 2) * 0.3'), ('>= 1.5', '0.1 + (vq - 1.5) * 0.4')])} else 0 end as volume_shock,
  case when ord > 20 then {_ladder('z', [('>= 3', '0.85'), ('>= 2.5', '0.55 + (z - 2.5) * 0.6'), ('>= 2', '0.25 + (z - 2) * 0.6'), ('>= 1.5', 'z * 0.17')])} else 0 end as abnormal_ret,
  {_ladder('m', [('> 0.07', '0.5 + (m - 0.07) * 16.7'), ('> 0.05', '0.2 + (m - 0.05) * 15')])} as limit_near,
  case when abs(gap3) >= 0.01 and ((gap3 > 0 and lo3 > base * 1.005) or (gap3 < 0 and hi3 < base * 0.995)) then least(0.7, abs(gap3) * 10 + 0.2) else 0 end as gap_kept from n0),
nw as (select *, least(greatest(0.25 * gap_signal + 0.25 * volume_shock + 0.20 * abnormal_ret + 0.15 * limit_near + 0.15 * gap_kept, 0), 1) as news_score from n1)"""


@query(f"""{NEWS_SQL} select entity, date, {pick({'gap_signal': 'gap_signal', 'volume_shock': 'volume_shock', 'abnormal_ret': 'abnormal_ret', 'limit_near': 'limit_near', 'gap_kept': 'gap_kept', 'news_score': 'news_score',
    'news_direction': '=case when news_score > 0.3 and r > 0 and gap > 0 then 1 when news_score > 0.3 and r < 0 and gap < 0 then -1 else 0 end'})} from nw""")
def news_proxy(spark, sf_dir):
    p = FL.news_proxy(prepared(spark, sf_dir))
    return rounded(p.select("entity", "date", "gap_signal", "volume_shock", "abnormal_ret", "limit_near", "gap_kept", "news_score", "news_direction"))


_BACK = "over (partition by entity order by date rows between 5 preceding and current row)"
_PREV = "over (partition by entity order by date rows between unbounded preceding and 1 preceding)"
DIV_SQL = f"""{BASE}, {EMAS}, d0 as (select *, macd_hist as m, ord > 5 and close = max(close) {_BACK} as cp, ord > 5 and close = min(close) {_BACK} as ct, ord > 5 and macd_hist = max(macd_hist) {_BACK} as mp, ord > 5 and macd_hist = min(macd_hist) {_BACK} as mt, avg(close) {over(20, 1)} as before from em),
d1 as (select *, last_value(case when cp then close end ignore nulls) {_PREV} as c_top, last_value(case when mp then m end ignore nulls) {_PREV} as m_top, last_value(case when ct then close end ignore nulls) {_PREV} as c_low, last_value(case when mt then m end ignore nulls) {_PREV} as m_low from d0),
d2 as (select *, greatest(0, least(1, least(1, (close / (c_top + {E}) - 1) * 10) * (m_top - m) / (abs(m_top) + {E}))) as st, greatest(0, least(1, least(1, (c_low / (close + {E}) - 1) * 10) * (m - m_low) / (abs(m_low) + {E}))) as sb,
  least(0.8, (m - m_top) / (abs(m_top) + {E})) as ht, least(0.8, (m_low - m) / (abs(m_low) + {E})) as hb from d1),
d3 as (select *, case when ord > 20 and cp and close > c_top and m < m_top and ema20 > ema60 and close > before and st >= 0.3 then st end as rt, case when ord > 20 and ct and close < c_low and m > m_low and ema20 < ema60 and close < before and sb >= 0.3 then sb end as rb,
  case when ord > 20 and cp and close <= c_top and m > m_top and ht >= 0.15 then ht else 0 end as hidden_top, case when ord > 20 and ct and close >= c_low and m < m_low and hb >= 0.15 then hb else 0 end as hidden_bottom from d2),
dv as (select *, coalesce(last_value(rt ignore nulls) over e * pow(0.5, ord - max(case when rt is not null then ord end) over e), 0) as top_divergence, coalesce(last_value(rb ignore nulls) over e * pow(0.5, ord - max(case when rb is not null then ord end) over e), 0) as bottom_divergence
  from d3 window e as (partition by entity order by date rows between unbounded preceding and current row))"""


@query(f"{DIV_SQL} select entity, date, {pick({'top_divergence': 'top_divergence', 'bottom_divergence': 'bottom_divergence', 'hidden_top': 'hidden_top', 'hidden_bottom': 'hidden_bottom', 'divergence_active': '=top_divergence > 0 or bottom_divergence > 0'}, 5)} from dv")
def divergences(spark, sf_dir):
    p = FL.divergences(FA.exponential(prepared(spark, sf_dir)))
    return rounded(p.select("entity", "date", "top_divergence", "bottom_divergence", "hidden_top", "hidden_bottom", "divergence_active"), 5)


@query(f"""{bars_sql()}, fl as (select date, sum(amount * sign(ret)) / 1e6 as net_flow, avg(ret) * 100 as lead, sum(amount) as balance from b group by 1), gl as (select date, case when year(date) = 2000 then null else net_flow end as net_flow, lead, balance from fl),
ml as (select *, count(*) {o(19)} as n, avg(net_flow) {o(19)} + 0.01 as mean, sum(coalesce(net_flow, 0)) {o(4)} as recent, count(net_flow) {o(19)} as known, case when count(lead) {o(19)} >= 3 then tanh(avg(lead) {o(4)} / 5) end as a, case when count(lead) {o(19)} >= 3 then tanh(avg(lead) {o(4)} / 2 / 3) end as i, first_value(balance) {o(9)} as b0, count(*) {o(9)} as nb from gl)
select date, {pick({'flow_signal': 'case when n < 5 then 0 when known > 0 then case when abs(mean) * 5 < 1e-6 then 0 else tanh(recent / greatest(abs(mean) * 5, 1)) end else coalesce((coalesce(0.6 * a, 0) + coalesce(0.4 * i, 0)) / nullif(case when a is not null then 0.6 else 0 end + case when i is not null then 0.4 else 0 end, 0), 0) end',
    'margin_signal': f'case when nb < 5 then 0 else tanh(case when abs((balance - b0) / (abs(b0) + {E})) < 0.03 then 3 * (balance - b0) / (abs(b0) + {E}) else -2 * (balance - b0) / (abs(b0) + {E}) end) end'})} from ml""")
def market_flows(spark, sf_dir):
    """Flow and margin signals of the market; a year without flows falls back to price changes."""
    f = panel(spark, sf_dir).groupBy("date").agg((F.sum(F.col("amount") * F.signum("ret")) / 1e6).alias("net_flow"), (F.avg("ret") * 100).alias("lead_change"), F.sum("amount").alias("balance"))
    f = f.withColumn("net_flow", F.when(F.year("date") != 2000, F.col("net_flow"))).withColumn("index_change", F.col("lead_change") / 2)
    p = FL.margin_flow(FL.market_flow(f).withColumnRenamed("signal", "flow_signal")).withColumnRenamed("signal", "margin_signal")
    return rounded(p.select("date", "flow_signal", "margin_signal"))


@query(f"""{bars_sql()}, ev as (select p_brand as entity, cast(l_shipdate as date) as date, cast(sum(case when l_returnflag <> 'R' then cast(l_quantity as decimal(18,2)) else 0 end) as double) as bought, cast(sum(case when l_returnflag = 'R' then cast(l_quantity as decimal(18,2)) else 0 end) as double) as sold
  from lineitem join part on l_partkey = p_partkey group by 1, 2), lj as (select b.entity, b.date, bought, sold, row_number() over (partition by b.entity, b.date order by ev.date desc) as k from b left join ev on ev.entity = b.entity and ev.date <= b.date)
select entity, date, round(coalesce(tanh(3 * (bought - sold) / (bought + sold + {E})), 0), 6) as entity_flow from lj where k = 1""")
def listed_flow(spark, sf_dir):
    """Net share of purchases on an entity's last day with lines as of each bar's first day."""
    from panelyte.sources.panels import table

    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    qty, back = F.col("l_quantity").cast("decimal(18,2)"), F.col("l_returnflag") == "R"
    ev = lines.groupBy(F.col("p_brand").alias("entity"), F.to_date("l_shipdate").alias("date")).agg(F.sum(F.when(~back, qty).otherwise(0)).cast("double").alias("bought"), F.sum(F.when(back, qty).otherwise(0)).cast("double").alias("sold"))
    return rounded(FL.listed_flow(bars(spark, sf_dir).select("entity", "date"), ev))


SEGMENTS = [("metal", "raw", "ECONOMY", "moat", "high", "import"), ("metal", "parts", "LARGE", "high", "medium", "export"), ("goods", "sale", "PROMO", "low", "low", "none"), ("goods", "tools", "LARGE", "medium", "high", "self_sufficient")]
_SEG = ", ".join(str(s) for s in SEGMENTS)


@query(f"""{NB}, {REPORTS_SQL}, sg as (select *, least(greatest(0.40 * case barrier when 'moat' then 1.0 when 'high' then 0.75 when 'medium' then 0.5 when 'low' then 0.25 else 0.5 end + 0.35 * case margin when 'high' then 1.0 when 'medium' then 0.6 when 'low' then 0.3 else 0.6 end
  + 0.25 * case tech when 'import' then 0.8 when 'self_sufficient' then 0.5 when 'export' then 1.0 when 'none' then 0.3 else 0.5 end, 0), 1)::double as score, barrier in ('moat', 'high') as choke from (values {_SEG}) v(chain, segment, concept, barrier, margin, tech)),
s1 as (select * from (select *, row_number() over (partition by concept order by chain, segment) as k from sg) where k = 1), mb as (select distinct n_name as entity, p_type as concept from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey),
bs as (select entity, coalesce(max(score), 0.3) as barrier_score, count(*) filter (choke) as moats from mb left join s1 using (concept) group by 1), fu as (select entity, last(roe order by period) / 100 as roe, last(gross_margin order by period) / 100 as gross_margin from rp group by 1),
q as (select bs.*, coalesce(least(greatest(least(greatest(roe / 0.20, 0), 1) * 0.5 + least(greatest(gross_margin / 0.50, 0), 1) * 0.5, 0), 1), 0.5) as profit_score from bs left join fu using (entity))
select entity, moats, round(barrier_score, 6) as barrier_score, round(profit_score, 6) as profit_score, round(least(greatest(0.55 * barrier_score + 0.45 * profit_score, 0), 1), 6) as quality from q""")
def chain_quality(spark, sf_dir):
    """Quality of an entity by its chain segments and profits."""
    from panelyte.sources.panels import table

    segments = spark.createDataFrame(SEGMENTS, "chain string, segment string, concept string, barrier string, margin string, tech string")
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    nations = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    members = lines.join(nations, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("n_name").alias("entity"), F.col("p_type").alias("concept")).distinct()
    latest = reports(spark, sf_dir).groupBy("entity").agg((F.max_by("roe", "period") / 100).alias("roe"), (F.max_by("gross_margin", "period") / 100).alias("gross_margin"))
    return rounded(FL.chain_quality(members, segments, latest))


_HL = 2 / (1 - 0.5 ** (1 / 5)) - 1


@query(f"""{LADDER}, gr as (select grp as entity, date, avg(ret) as ret from b where ret is not null group by 1, 2), gm as (select *, case when count(*) over (partition by entity order by date) >= 3 then {adjusted('ret', _HL, 'partition by entity ')} end as m from gr),
gz as (select *, case when count(m) over d < 3 then 0 else tanh(0.8 * (m - avg(m) over d) / (stddev_samp(m) over d + 1e-8)) end as sentiment from gm window d as (partition by date)), gs as (select gz.*, lad.regime, {adjusted('sentiment', _HL, 'partition by entity ')} as smooth from (select * from gz where sentiment is not null) gz join lad using (date)),
gx as (select *, 0.7 * smooth + 0.3 * sentiment as s from gs)
select entity, date, {pick({'sentiment': 'sentiment', 'multiplier': 'greatest(least(1 + (case when sentiment > 0 then 0.2 else 1 - 0.8 end) * sentiment * case regime when -1 then 0.5 when 1 then 1.2 else 1 end, 1.2), 0.8)',
    'asymmetric': 'greatest(least(1 + case when s > 0 then 0.15 * s else 0.45 * s end * case when regime = -1 and s < 0 then 1.5 else 1 end, 1.15), 0.7)'}, 5)} from gx""")
def return_sentiment(spark, sf_dir):
    """Sentiment of groups from their returns, and both multipliers in the date's regime."""
    from panelyte.functions.recursive import smoothed

    g = panel(spark, sf_dir).filter("ret is not null").groupBy(F.col("grp").alias("entity"), "date").agg(F.avg("ret").alias("ret"))
    s = FL.returns_to_sentiment(g).filter("sentiment is not null").join(ladder(spark, sf_dir).select("date", "regime"), "date")
    s = smoothed(s, {"smooth": ("sentiment", _HL, True)})
    return rounded(s.select("entity", "date", "sentiment", FL.multiplier(F.col("sentiment"), F.col("regime")).alias("multiplier"), FL.asymmetric_multiplier(F.col("sentiment"), F.col("smooth"), F.col("regime")).alias("asymmetric")), 5)


DECIDE_SQL = f"""{DIV_SQL}{FLOW_SQL.removeprefix(BASE)}{NEWS_SQL.removeprefix(BASE)}, {WINDOW_CTES},
g0 as (select dv.*, cf.smart_money, cf.capital_flow_score, cf.capital_flow_direction, nw.news_score, case when nw.news_score > 0.3 and nw.r > 0 and nw.gap > 0 then 1 else 0 end as news_up,
  coalesce({', '.join(f'case when {n} is not null then {k} end' for n, k in WINDOW_POINTS.items())}, 0) as wp, coalesce({', '.join(WINDOW_POINTS)}, 0) as wc
  from dv join cf using (entity, date) join nw using (entity, date) join w4 using (entity, date)),
g1 as (select *, case when bottom_divergence > 0.3 then 1 else wp end as bp,
  case when bottom_divergence > 0.3 then case when close > ma20 then 2 else 1 end when top_divergence > 0.3 then case when close < ma20 then -3 else -1 end when wp > 0 then case when wc >= 0.35 then 2 else 1 end else 0 end as lv,
  bottom_divergence > 0.3 or (wp > 0 and wc >= 0.35) as cb, case when ema20 < ema60 and ema60 < ema120 then -2 when ema20 > ema60 and ema60 > ema120 then 2 else 0 end as tt, tanh(mom_20 - volatility_20) as fv from g0),
g2 as (select *, case when lv >= 2 and cb then 1.0 when bp = 1 then 0.85 when bp >= 2 or lv >= 1 then 0.72 when bottom_divergence > 0.3 and tt <> 0 then 0.62 when tt = -2 and bp = 0 and lv <= 0 and bottom_divergence < 0.2 then 0.25 else 0.45 end as gs, 0.50 as gf, 0.6 as gh,
  case when not coalesce(close > 0 and ma20 > 0, false) then 0.40 when close > ma20 then case when ema20 > ema60 and ema60 > ema120 then 1.0 when ema20 > ema60 then 0.72 else 0.50 end when ema20 > ema60 then 0.38 else 0.25 end as gt from g1),
g3 as (select *, least(greatest((gs + gf + gh + gt)::double / 4 / 0.55, 0.5), 2.0) as quality, coalesce(ord > 1 and (r / 10 <= -0.095 or r / 10 >= 0.095), false) or (lv <= -3 and top_divergence > 0.3) as rejected,
  case when fv is not null then greatest(least(fv, 10), -10) end as score from g2),
g4 as (select *, count(score) {over(400, 1)} as k, quantile_cont(score, 0.7) {over(400, 1)} as qb, quantile_cont(score, 0.3) {over(400, 1)} as qs from g3),
g5 as (select *, case when k >= 100 then greatest(qb, 0.12 * 0.15) else 0.12 end as buy_threshold, case when k >= 100 then least(qs, -0.35) else -0.35 end as sell_threshold, case when ma20 > 0 then (close - ma20) / ma20 else 1 end as far,
  coalesce(score > 0.12 * 0.7, false)::int + coalesce(capital_flow_score > 0.5 and capital_flow_direction = 1, false)::int + coalesce(news_score > 0.3 and news_up = 1, false)::int as systems from g4),
g5t as (select *, case when coalesce(smart_money > 0.15, false) then 'V' else '' end || case when bottom_divergence > 0.3 or top_divergence > 0.3 then 'D' else '' end || case when systems >= 2 then 'R' || systems else '' end as marks from g5),
g6 as (select *, case when marks = '' then '_T' else marks end as tag, coalesce(not rejected and score >= -0.05 and (bp >= 1 or close > ma20) and far < case when bp = 1 and lv = 1 and cb then 0.25 when bp = 6 then 0.12 else 0.30 end and (bp >= 1 or score > 0)
   and (tt <> -2 or (bp >= 1 and lv >= 1 and cb) or bottom_divergence > 0.3) and not coalesce(r / 10 <= -0.095, false) and marks <> '' and score >= buy_threshold
   and not (bp in (5, 6) and lv < 1) and not (bp = 6 and tt < 0) and not (bp = 8 and lv < 2), false) as can_buy,
  coalesce(score < sell_threshold, false) or coalesce(score < 0 and ((lv <= -1 and top_divergence > 0.3) or coalesce(close < ma60 and ma60 > 0, false) or quality < 0.55 or (score < -0.20 and quality < 0.75)), false) as can_sell,
  least(greatest(0.2 + 0.4 * quality + case when abs(smart_money) > 0.15 then 0.10 else 0 end + case when bottom_divergence > 0.3 or top_divergence > 0.3 then 0.08 else 0 end + case when vr > 1.2 and close > ma20 then 0.06 else 0 end, 0), 1) as confidence from g5t)"""


def decided(spark, sf_dir):
    """Panel with structure from divergences and window points, flows, gates, score, thresholds and decisions."""
    p = swing.window_points(FL.divergences(FA.exponential(FL.news_proxy(FL.capital_flow(prepared(spark, sf_dir))))))
    c = F.col
    low, high, kind = c("bottom_divergence") > 0.3, c("top_divergence") > 0.3, swing.first_window_point()
    sure = F.coalesce(*WINDOW_POINTS, F.lit(0.0))
    level = F.when(low, F.when(c("close") > c("ma20"), 2).otherwise(1)).when(high, F.when(c("close") < c("ma20"), -3).otherwise(-1)).when(kind > 0, F.when(sure >= 0.35, 2).otherwise(1)).otherwise(0)
    trend = F.when((c("ema20") < c("ema60")) & (c("ema60") < c("ema120")), -2).when((c("ema20") > c("ema60")) & (c("ema60") > c("ema120")), 2).otherwise(0)
    p = p.withColumn("buy_point", F.when(low, 1).otherwise(kind)).withColumn("signal_level", level).withColumn("trend_type", trend).withColumn("confirmed_buy", low | (kind > 0) & (sure >= 0.35)).withColumn("confirmed_sell", high)
    p = SG.defaults(p.withColumn("smart_money_flow", c("smart_money")).withColumn("volume_ratio_raw", c("vr")).withColumn("ret", c("r") / 10))
    graded = SG.gates()
    p = p.select("*", *[g.alias(k) for k, g in graded.items()])
    p = p.withColumn("quality", SG.gate_quality([c(k) for k in graded])).withColumn("rejected", SG.hard_reject(c("ret")) & (c("ord") > 1) | F.coalesce((c("signal_level") <= -3) & c("confirmed_sell"), F.lit(False)))
    p = p.withColumn("score", SG.assembled_score(F.tanh(c("mom_20") - c("volatility_20"))))
    buy, sell = SG.moving_thresholds(c("score"))
    p = p.drop("buy_systems").withColumn("buy_systems", SG.resonance(c("score"))[0])
    p = p.withColumn("buy_threshold", buy).withColumn("sell_threshold", sell).withColumn("confidence", SG.confidence(c("quality")))
    return SG.decide(p)


@query(f"""{DECIDE_SQL} select entity, date, {pick({'gate_structure': 'gs', 'gate_frames': 'gf', 'gate_heat': 'gh', 'gate_trend': 'gt', 'quality': 'quality', 'rejected': '=rejected'})} from g6""")
def gate_quality(spark, sf_dir):
    """Grades of the four gates, their quality and the hard rejects."""
    return rounded(decided(spark, sf_dir).select("entity", "date", "gate_structure", "gate_frames", "gate_heat", "gate_trend", "quality", "rejected"))


@query(f"""{DECIDE_SQL} select entity, date, {pick({'score': 'score', 'buy_threshold': 'buy_threshold', 'sell_threshold': 'sell_threshold', 'confidence': 'confidence', 'tag': '=tag', 'buy_point': '=bp', 'buy': '=ord > 60 and score is not null and can_buy', 'sell': '=ord > 60 and score is not null and can_sell'}, 5)} from g6""")
def score_decision(spark, sf_dir):
    """Score, moving thresholds, confidence, and the buy and sell decision of every row."""
    return rounded(decided(spark, sf_dir).select("entity", "date", "score", "buy_threshold", "sell_threshold", "confidence", "tag", "buy_point", "buy", "sell"), 5)
