"""Queries over calibration by group and state, macro states and merged levels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.operators import calibration as CA
from panelyte.operators import macro as MA
from panelyte.operators.asof import level_distances
from panelyte.plans.kernels import panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import FACTORS, REGIME_SQL, factor_panel, ic_sql, panel_sql, r6, regimes
from panelyte.sources.panels import membership, table
from panelyte.sources.store import stored

#: Floors of the registered queries: 25 brands give smaller groups than a market.
FLOORS = {"least_entities": 20, "least_rows": 100, "least_state_rows": 50}
_LEAST, _T = 8, 0.5

CALIBRATED = f"""{panel_sql()}, mem as (select distinct p_brand as entity, p_type as concept from part), {REGIME_SQL},
ps as (select p.*, regime as state from p join rg using (date)), gr as (select concept from mem join ps using (entity) group by 1 having count(distinct entity) >= 20 and count(*) >= 100),
sr as (select concept, state from mem join ps using (entity) group by 1, 2 having count(*) >= 50),
x as (select l.entity, l.date, l.factor, l.value, l.target, mem.concept, rg.regime as state from l join mem using (entity) join rg using (date) where concept in (select concept from gr) and (concept, rg.regime) in (select (concept, state) from sr)),
ic as {ic_sql('concept, state, date, factor', _LEAST, 'x')},
m0 as (select concept, state, factor, count(*) as n_dates, avg(ic) as ic_mean, stddev_pop(ic) + 1e-10 as ic_std, abs(sum(sign(round(ic, 9)))) / count(*) as stability from ic group by 1, 2, 3),
m as (select *, ic_mean / ic_std as ir, ic_mean / ic_std * sqrt(n_dates) as t, ic_mean / ic_std * (0.5 + 0.5 * stability) as combined_ir from m0 where n_dates >= 10 and ic_mean > 0 and stability >= 0.1 and abs(ic_mean / ic_std * sqrt(n_dates)) >= {_T})"""


def metrics_of(spark, sf_dir):
    p = stored(factor_panel(spark, sf_dir), "factors")
    states = regimes(p).withColumnRenamed("regime", "state")
    long = stored(CA.bridged(p.join(states, "date"), membership(spark, sf_dir), FACTORS, **FLOORS), "bridged")
    return long, CA.calibrate(long, least=_LEAST, least_t=_T)


@query(f"{CALIBRATED} select concept, state, factor, n_dates, {r6('ic_mean', 'ic_std', 'ir', 'stability', 't', 'combined_ir')} from m")
def calibration(spark, sf_dir):
    """Factors that hold in each concept and market state, after all floors."""
    return rounded(metrics_of(spark, sf_dir)[1])


@query(f"""{CALIBRATED}, rk as (select * from (select *, row_number() over (partition by concept, state order by combined_ir desc, factor) as place from m where combined_ir >= 0.02) where place <= 3),
st as (select rk.*, k.size, combined_ir / sum(combined_ir) over (partition by rk.concept, rk.state, k.size) as weight, avg(ic_mean) over (partition by rk.concept, rk.state, k.size) as avg_ic
  from rk join (select concept, state, unnest(range(1, max(place) + 1)) as size from rk group by 1, 2) k on k.concept = rk.concept and k.state = rk.state and rk.place <= k.size),
sc as (select x.concept, x.state, st.size, x.entity, x.date, x.target, sum(st.weight * x.value) as value from x join st on st.concept = x.concept and st.state = x.state and st.factor = x.factor group by all having count(*) = st.size),
ci as (select concept, state, size, avg(ic) as combined_ic, count(*) as n from {ic_sql('concept, state, size, date', _LEAST, 'sc')} group by 1, 2, 3),
wn as (select * from (select *, row_number() over (partition by concept, state order by round(combined_ic, 12) desc, size) as r from ci where n >= 10 and combined_ic > 0) where r = 1)
select st.concept, st.state, factor, place::int as place, {r6('weight', 'avg_ic')}, st.size::int as size, round(coalesce(wn.combined_ic, avg_ic), 6) as combined_ic from st left join wn on wn.concept = st.concept and wn.state = st.state where st.size = coalesce(wn.size, 1)""")
def calibrated_weights(spark, sf_dir):
    """Weight sets of one to three factors for each concept and market state."""
    long, metrics = metrics_of(spark, sf_dir)
    return rounded(CA.calibrated_weights(long, stored(metrics, "metrics"), least=_LEAST))


_MONEY = "cast(sum(cast({0} as decimal(18,2))) as double)"
MACRO = f"""with om as (select cast(date_trunc('month', o_orderdate) as date) as month, {_MONEY.format('o_totalprice')} as total, {_MONEY.format("case when o_orderstatus = 'F' then o_totalprice else 0 end")} as done, avg(o_totalprice) as mean from orders group by 1),
og as (select month, 100 * (done / nullif(lag(done, 12) over (order by month), 0) - 1) as m1, 100 * (total / nullif(lag(total, 12) over (order by month), 0) - 1) as m2, round(mean, 4) as margin from om),
lm as (select cast(date_trunc('month', l_shipdate) as date) as month, {_MONEY.format('l_extendedprice')} as credit, round(avg(l_extendedprice / l_quantity), 4) as prices from lineitem group by 1),
lr as (select cast(date_trunc('month', max(l_shipdate)) as date) as month, round(10 * avg(l_discount) * 100, 4) as rate from lineitem group by date_trunc('quarter', l_shipdate)),
mm as (select og.month, m1, m2, c.credit, margin, p.prices, last_value(lr.rate ignore nulls) over (order by og.month rows between unbounded preceding and current row) as rate from og left join lm c on c.month + interval 1 month = og.month left join lm p on p.month = og.month left join lr on lr.month = og.month),
m0 as (select *, {', '.join(f'case when count({x}) over w = 3 then avg({x}) over w end as {x}3' for x in ('credit', 'margin', 'prices'))}, m1 - lag(m1, 3) over (order by month) as accel, m1 - m2 as scissor from mm window w as (order by month rows between 2 preceding and current row)),
m1x as (select *, coalesce(credit3 - lag(credit3, 3) over o > 0, false) as credit_better, coalesce(prices3 - lag(prices3, 3) over o > 0, false) as prices_better, margin3 / nullif(lag(margin3, 3) over o, 0) - 1 as margin_change,
  coalesce(scissor > -1 and lag(scissor, 3) over o < -2, false) as turning, coalesce(rate - lag(rate, 6) over o <= -0.25, false) as easing, coalesce(rate - lag(rate, 6) over o >= 0.5, false) as tightening from m0 window o as (order by month)),
m2x as (select *, coalesce(accel > 0, false) and credit_better and coalesce(margin_change > -0.05, false) as bull, coalesce(accel < -1, false) or (not credit_better and coalesce(margin_change <= -0.05, false)) as bear from m1x)"""


@query(f"""{MACRO} select month, {r6('m1', 'm2', 'accel', 'scissor', 'margin_change', 'rate')}, turning, credit_better, prices_better, bull, bear, easing, tightening,
case when (bear or bull) and (tightening or easing) then case when bear then 'bear' else 'bull' end || '_' || case when tightening then 'bear' else 'bull' end else 'neutral' end as resonance,
case when turning and credit_better then 'bullish' when coalesce(accel > 0.5, false) and credit_better and coalesce(margin_change > -0.05, false) then 'bullish' when coalesce(accel < -1, false) and not credit_better then 'bearish' else 'neutral' end as regime,
case when accel < -2 then 'deep' when accel < -1 then 'shallow' else 'none' end as severity from m2x""")
def macro_resonance(spark, sf_dir):
    """Growth of finished and of all orders as money, shipments as credit (published a month late), mean orders as margin,
    prices by month, and a rate set on the last shipment of each quarter: states of the months they give together."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    exact = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    by = Window.partitionBy(F.lit(1)).orderBy("date")
    total = F.col("o_totalprice")
    o = orders.groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("date")).agg(exact(total).alias("total"), exact(F.when(F.col("o_orderstatus") == "F", total).otherwise(0)).alias("done"), F.round(F.avg(total), 4).alias("mean"))
    growth = lambda c: 100 * (F.try_divide(F.col(c), F.lag(c, 12).over(by)) - 1)
    o = o.select("date", growth("done").alias("m1"), growth("total").alias("m2"), "mean")
    day = F.to_date("l_shipdate")
    m = lines.groupBy(F.trunc(day, "month").alias("date")).agg(exact(F.col("l_extendedprice")).alias("credit"), F.round(F.avg(F.col("l_extendedprice") / F.col("l_quantity")), 4).alias("prices"))
    r = lines.groupBy(F.trunc(day, "quarter").alias("quarter")).agg(F.max(day).alias("date"), F.round(10 * F.avg("l_discount") * 100, 4).alias("value"))
    of = lambda df, c: df.select("date", F.col(c).alias("value"))
    series = {"month_of": (of(o.withColumn("one", F.lit(1.0)), "one"), "last"), "m1": (of(o, "m1"), "last"), "m2": (of(o, "m2"), "last"), "credit": (of(m, "credit"), "sum"), "margin": (of(o, "mean"), "mean"), "prices": (of(m, "prices"), "mean"), "rate": (r.select("date", "value"), "last")}
    p = MA.macro_states(MA.monthly(series, {"credit": 1}, ("rate",)))
    return rounded(p.select("month", "m1", "m2", "accel", "scissor", "margin_change", "rate", "turning", "credit_better", "prices_better", "bull", "bear", "easing", "tightening", "resonance", "regime", "severity"))


def _merged(x: str) -> str:
    return f"""list_reduce(list_prepend([[-1e300, 0.0]], list_transform(list_sort(list_filter({x}, lambda v: v is not null)), lambda v: [[v, 1.0]])), lambda a, b: case when (b[1][1] - a[-1][1]) / (a[-1][1] + 1e-10) > 0.03 or a[-1][2] = 0
      then list_concat(a, b) else list_concat(a[1:len(a) - 1], [[(a[-1][1] + b[1][1]) / 2, a[-1][2] + 1]]) end)"""


@query(f"""{bars_sql()}, e0 as (select *, count(*) over w as n, max(high) over l as hl, max(high) over r as hr, min(low) over l as ll, min(low) over r as lr from b window w as (partition by entity order by date rows between 5 preceding and 5 following),
  l as (partition by entity order by date rows between 5 preceding and 1 preceding), r as (partition by entity order by date rows between 1 following and 5 following)),
e1 as (select *, case when n = 11 and high > hl and high > hr then high end as top, case when n = 11 and low < ll and low < lr then low end as bottom from e0),
e2 as (select entity, date, close, list(top) over k as tops, list(bottom) over k as bottoms from e1 window k as (partition by entity order by date rows between 104 preceding and 5 preceding)),
e3 as (select entity, date, close, {_merged("coalesce(tops, [])")} as ts, {_merged("coalesce(bottoms, [])")} as bs from e2),
e4 as (select *, list_sort(list_filter(ts, lambda x: x[2] > 0 and x[1] > close))[1] as up, list_reverse_sort(list_filter(bs, lambda x: x[2] > 0 and x[1] < close))[1] as dn from e3)
select entity, date, round(coalesce((up[1] - close) / close, 0), 6) as resistance_pct, round(coalesce((close - dn[1]) / close, 0), 6) as support_pct, coalesce(up[2], 0)::int as resistance_strength, coalesce(dn[2], 0)::int as support_strength from e4""")
def merged_levels(spark, sf_dir):
    """Distance to the nearest merged level above and below, and of how many extrema it is made."""
    p = level_distances(panel(spark, sf_dir), 5, 100, 0.03)
    return rounded(p.select("entity", "date", "resistance_pct", "support_pct", "resistance_strength", "support_strength"))
