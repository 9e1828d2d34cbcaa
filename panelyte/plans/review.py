"""Queries over patterns, factor quality and life cycle, and holdings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import factors as FA
from panelyte.operators import ic as IC
from panelyte.operators import patterns as P
from panelyte.plans.kernels import ex, inc, panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import FACTORS, factor_panel, ic_sql, panel_sql

B = bars_sql()
NOW, THEN = "over (partition by entity order by date rows between 9 preceding and current row)", "over (partition by entity order by date rows between 19 preceding and 10 preceding)"


@query(f"""{B}, x as (select *, avg(volume) {ex(20)} as v20, max(high) over (partition by entity order by date rows between 20 preceding and 2 preceding) as h19, avg(high - low) {inc(5)} / (close + 1e-10) as width, coalesce(ret, 0) as r,
 (max(high) {NOW} - min(low) {NOW}) / (avg(close) {NOW} + 1e-10) < 0.7 * ((max(high) {THEN} - min(low) {THEN}) / (avg(close) {THEN} + 1e-10)) as tight, avg(volume) {NOW} < 0.8 * avg(volume) {THEN} as quiet, stddev_pop(close) {NOW} / (avg(close) {NOW} + 1e-10) < 0.03 as flat,
 ord >= 60 and avg(close) {inc(20)} > avg(close) {inc(60)} as rising from b)
select entity, date, case when ord > 20 and volume > 2 * v20 then case when close > h19 then 1.0 when close > 0.98 * h19 then 0.5 else 0.0 end else 0.0 end::double as breakout, round(tanh(case when ord > 5 and abs(r) > 0.04 and width > 0.03 then -2 * r else 0.0 end), 6) as reversal,
 case when ord > 20 then case when tight and quiet and flat and rising then 1.0 when tight and (quiet or flat) then 0.4 else 0.0 end else 0.0 end::double as consolidation from x""")
def pattern_factors(spark, sf_dir):
    """Breakout, reversal and consolidation before squashing (the factor catalogue has them squashed)."""
    p = FA.prepare(panel(spark, sf_dir).withColumn("turnover", F.lit(0.0)))
    c, h, low, v = (F.col(x) for x in ("close", "high", "low", "volume"))
    return p.select("entity", "date", FA.breakout(c, h, v).alias("breakout"), F.round(FA.shape_family(p)["short_reversal"], 6).alias("reversal"), FA.consolidation(c, h, low, v).alias("consolidation"))


@query(f"""{B}, x as (select *, max(close) over (partition by entity order by date rows between 19 preceding and current row) as peak, case when ord >= 20 then avg(close) {inc(20)} end as ma, row_number() over (partition by entity order by date desc) as k from b)
select entity, date, round(close / peak - 1, 6) as fall, list_filter([case when close < peak * 0.9 then 'stop' end, case when close < ma then 'trend' end, case when ret < -0.2 then 'shock' end], lambda z: z is not null)::varchar as reasons from x where k = 1""")
def holdings_check(spark, sf_dir):
    """Latest row of each entity with the reasons to sell it."""
    p = panel(spark, sf_dir)
    c = F.col("close")
    p = p.withColumn("peak", F.max(c).over(W.incl(20))).withColumn("ma", W.sma(c, 20)).withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date")))).filter("k = 1")
    why = P.sell_reasons({"stop": c < F.col("peak") * 0.9, "trend": c < F.col("ma"), "shock": F.col("ret") < -0.2})
    return p.select("entity", "date", F.round(c / F.col("peak") - 1, 6).alias("fall"), F.concat(F.lit("["), F.array_join(why, ", "), F.lit("]")).alias("reasons"))


def _frame_sql(name: str, fast: int, slow: int) -> str:
    """Bars by week or month, their two recursive means, and the trend they give from the slow span on."""
    by = "over (partition by entity order by start)"
    mean = lambda n: f"list_reduce(list(close) {by}, lambda a, v: a + (v - a) * 2 / {n + 1}.0)"
    return f"""{name}_c as (select entity, cast(date_trunc('{name}', date) as date) as start, first(open order by date) as open, max(high) as high, min(low) as low, last(close order by date) as close, max(date) as ends from bars group by 1, 2),
    {name}_e as (select *, row_number() {by} as k, {mean(fast)} as f, {mean(slow)} as s, close - open as body, high - low as span, lag(close) {by} as c1, lag(close, 2) {by} as c2, lag(open) {by} as o1 from {name}_c),
    {name}_t as (select entity, ends, k > {slow} and f > s as up, case when k > {slow} then tanh(50 * abs(f - s) / (s + 1e-10)) else 0 end as strength, lead(ends) over (partition by entity order by ends) as next,
      case when span <= 0 or k = 1 then 0 when c1 < o1 and body > 0 and close > o1 and open < c1 then 0.8 when c1 > o1 and body < 0 and close < o1 and open > c1 then -0.8
        when least(open, close) - low > 0.6 * span and abs(body) / span < 0.3 then case when c1 < c2 then 0.6 when c1 > c2 then -0.5 else 0 end else 0 end as pattern from {name}_e)"""


_ALIGN = """case when wu and mu then (ws + ms) / 2 when not wu and not mu then -(ws + ms) / 2 when mu then 0.5 * ms - 0.3 * ws else -0.5 * ms + 0.3 * ws end"""


@query(
    f"{bars_sql('brand', 'day')}, {_frame_sql('week', 20, 60)}, {_frame_sql('month', 10, 30)}, "
    + f"""j as (select b.*, coalesce(w.up, false) as wu, coalesce(m.up, false) as mu, coalesce(w.strength, 0) as ws, coalesce(m.strength, 0) as ms, coalesce(w.pattern, 0) as pattern
    from b left join week_t w on w.entity = b.entity and b.date >= w.ends and (b.date < w.next or w.next is null) left join month_t m on m.entity = b.entity and b.date >= m.ends and (b.date < m.next or m.next is null)),
    a as (select *, greatest(least({_ALIGN}, 1), -1) as al from j),
    d as (select *, greatest(least(case when al >= 0.3 then 0.78 + 0.22 * (al - 0.3) / 0.7 when al <= -0.3 then 0.50 + 0.22 * (al + 1) / 0.7 else 0.72 + 0.06 * (al + 0.3) / 0.6 end, 1.0), 0.50) * case when (ws + ms) / 2 < 0.3 then 0.95 else 1 end
      * case when pattern > 0.3 then 1 + 0.15 * least(pattern, 1) when pattern < -0.3 then 1 - 0.15 * least(abs(pattern), 1) else 1 end as base from a)
    select entity, date, wu as week_up, mu as month_up, round(ws, 6) as week_strength, round(ms, 6) as month_strength, pattern::double as pattern, round(al, 6) as alignment, round(greatest(least(base, 1.10), 0.30), 6) as discount from d"""
)
def multi_timeframe_trend(spark, sf_dir):
    """Trends of finished weeks and months on daily rows, their alignment and the discount it puts on a score."""
    from panelyte.operators.timeframes import aligned_trends
    from panelyte.sources.panels import bars

    out = aligned_trends(bars(spark, sf_dir, "brand", "day").select("entity", "date", "open", "high", "low", "close"))
    return rounded(out.select("entity", "date", "week_up", "month_up", "week_strength", "month_strength", "pattern", "alignment", "discount"))
