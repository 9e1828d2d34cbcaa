"""Queries over bars: resampling, window kernels, recursive kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import recursive
from panelyte.functions import windows as W
from panelyte.plans.registry import bars_sql, query
from panelyte.sources.panels import bars

DAILY, WEEKLY, MONTHLY = bars_sql("brand", "day"), bars_sql(), bars_sql("brand", "month")
BAR_COLUMNS = "entity, grp, date, open, high, low, close, volume, amount"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select([F.round(f.name, digits).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name) for f in df.schema.fields])


def panel(spark, sf_dir, by="brand", every="week") -> DataFrame:
    """Bars with ord and the one-row return."""
    df = bars(spark, sf_dir, by, every)
    return df.withColumn("ord", F.row_number().over(W.by_entity())).withColumn("ret", F.col("close") / W.lag(F.col("close")) - 1)


@query(f"{DAILY} select {BAR_COLUMNS} from bars")
def bars_daily_brand(spark, sf_dir):
    return bars(spark, sf_dir, "brand", "day")


@query(f"{WEEKLY} select {BAR_COLUMNS} from bars")
def bars_weekly_brand(spark, sf_dir):
    return bars(spark, sf_dir)


@query(f"{MONTHLY} select {BAR_COLUMNS} from bars")
def bars_monthly_brand(spark, sf_dir):
    return bars(spark, sf_dir, "brand", "month")


@query(f"{bars_sql('nation')} select {BAR_COLUMNS} from bars")
def bars_weekly_nation(spark, sf_dir):
    return bars(spark, sf_dir, "nation")


def ex(w: int) -> str:
    return f"over (partition by entity order by date rows between {w} preceding and 1 preceding)"


def inc(w: int) -> str:
    return f"over (partition by entity order by date rows between {w - 1} preceding and current row)"


def need(value: str, of: str, frame: str, w: int) -> str:
    return f"case when count({of}) {frame} = {w} then {value} end"


KERNELS_SQL = f"""{WEEKLY} select entity, date,
  round({need(f'avg(close) {inc(20)}', 'close', inc(20), 20)}, 6) as sma_20,
  round({need(f'stddev_pop(ret) {ex(20)}', 'ret', ex(20), 20)}, 6) as std_20,
  round({need(f'max(high) {ex(20)}', 'high', ex(20), 20)}, 6) as high_20,
  round({need(f'min(low) {ex(20)}', 'low', ex(20), 20)}, 6) as low_20,
  round({need(f'case when stddev_pop(ret) {ex(20)} * stddev_pop(volume) {ex(20)} > 1e-15 then covar_pop(volume, ret) {ex(20)} / (stddev_pop(ret) {ex(20)} * stddev_pop(volume) {ex(20)}) end', 'ret', ex(20), 20)}, 6) as corr_20,
  round(case when count(case when ret < 0 then ret end) {ex(20)} >= 3 then stddev_pop(case when ret < 0 then ret end) {ex(20)} end, 6) as downside_20,
  round(case when stddev_pop(case when ret < 0 then ret end) {ex(20)} > 1e-10 then stddev_pop(case when ret > 0 then ret end) {ex(20)} / stddev_pop(case when ret < 0 then ret end) {ex(20)} - 1 end, 6) as skew_ratio_20,
  count(case when ret > 0.02 then 1 end) {inc(20)} as ups_20,
  round({need(f'avg(amount) {ex(20)}', 'amount', ex(20), 20)}, 4) as adv_20,
  round({need(f'sum(ret) {inc(20)}', 'ret', inc(20), 20)}, 6) as sum_20,
  round({need(f'sum(close * volume) {inc(20)} / sum(volume) {inc(20)}', 'close', inc(20), 20)}, 6) as vwap_20,
  round(close / lag(close, 5) over (partition by entity order by date) - 1, 6) as mom_5,
  round({need(f'regr_slope(close, ord) {inc(20)}', 'close', inc(20), 20)}, 6) as slope_20
from b"""


@query(KERNELS_SQL)
def rolling_kernels(spark, sf_dir):
    p = panel(spark, sf_dir)
    c, r, v = F.col("close"), F.col("ret"), F.col("volume")
    return rounded(
        p.select(
            "entity", "date", W.sma(c, 20).alias("sma_20"), W.std(r, 20).alias("std_20"), W.highest(F.col("high"), 20).alias("high_20"), W.lowest(F.col("low"), 20).alias("low_20"),
            W.corr(r, v, 20).alias("corr_20"), W.downside(r, 20).alias("downside_20"), W.skew_ratio(r, 20).alias("skew_ratio_20"),
            F.count(F.when(r > 0.02, 1)).over(W.incl(20)).alias("ups_20"), F.round(W.full(F.avg("amount").over(W.excl(20)), F.col("amount"), W.excl(20), 20), 4).alias("adv_20"),
            W.total(r, 20).alias("sum_20"), W.vwap(c, v, 20).alias("vwap_20"), W.change(c, 5).alias("mom_5"), W.slope(c, 20).alias("slope_20"),
        )
    )


@query(f"""{WEEKLY}, m as (select *, close - lag(close) over (partition by entity order by date) as mv from b),
g as (select *, greatest(mv, 0.0) as up, greatest(-mv, 0.0) as down from (select * from m) where true),
h as (select entity, date, close, ord, case when mv is not null then up end as up, case when mv is not null then down end as down from g)
select entity, date,
 round({need(f'100 - 100 / (1 + avg(up) {inc(14)} / (avg(down) {inc(14)} + 1e-10))', 'up', inc(14), 14)}, 6) as rsi_14,
 round({need(f'avg(close) {inc(20)} + 2 * stddev_pop(close) {inc(20)}', 'close', inc(20), 20)}, 6) as bb_upper,
 round({need(f'avg(close) {inc(20)} - 2 * stddev_pop(close) {inc(20)}', 'close', inc(20), 20)}, 6) as bb_lower,
 round({need(f'(close - avg(close) {inc(20)} + 2 * stddev_pop(close) {inc(20)}) / (4 * stddev_pop(close) {inc(20)} + 1e-10)', 'close', inc(20), 20)}, 6) as bb_pos
from h""")
def bollinger_rsi(spark, sf_dir):
    p = panel(spark, sf_dir)
    c = F.col("close")
    mid, sd = W.sma(c, 20), W.std(c, 20, W.incl(20))
    moved = p.withColumn("mv", c - W.lag(c)).withColumn("up", F.when(F.col("mv").isNotNull(), F.greatest("mv", F.lit(0.0)))).withColumn("down", F.when(F.col("mv").isNotNull(), F.greatest(-F.col("mv"), F.lit(0.0))))
    return rounded(moved.select("entity", "date", W._rsi_of(F.col("up"), F.col("down"), 14).alias("rsi_14"), (mid + 2 * sd).alias("bb_upper"), (mid - 2 * sd).alias("bb_lower"), ((c - mid + 2 * sd) / (4 * sd + 1e-10)).alias("bb_pos")))


@query(f"""{WEEKLY}, t as (select *, case when ord > 1 then greatest(high - low, abs(high - lag(close) over (partition by entity order by date)), abs(low - lag(close) over (partition by entity order by date))) else high - low end as tr from b)
select entity, date, round({need(f'avg(tr) {inc(14)}', 'tr', inc(14), 14)}, 6) as atr_14, round({need(f'avg(tr) {inc(14)} / close', 'tr', inc(14), 14)}, 6) as atr_ratio,
 round({need(f'(close - min(low) {ex(20)}) / (max(high) {ex(20)} - min(low) {ex(20)} + 1e-10)', 'close', ex(20), 20)}, 6) as position_20 from t""")
def atr_position(spark, sf_dir):
    p = panel(spark, sf_dir)
    c, h, low = F.col("close"), F.col("high"), F.col("low")
    p = p.withColumn("tr", W.true_range(h, low, c))
    atr, lo, hi = W.sma(F.col("tr"), 14), W.lowest(low, 20), W.highest(h, 20)
    return rounded(p.select("entity", "date", atr.alias("atr_14"), (atr / c).alias("atr_ratio"), ((c - lo) / (hi - lo + 1e-10)).alias("position_20")))


@query(f"""{WEEKLY}, k as (select *, max(close) over (partition by entity order by date) as peak, exp(sum(ln(1 + coalesce(ret, 0))) over (partition by entity order by date)) as nav from b)
select entity, date, round(nav, 6) as nav, round(close / peak - 1, 6) as drawdown, round(min(close / peak - 1) over (partition by entity order by date), 6) as worst from k""")
def drawdown_path(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("peak", F.max("close").over(W.so_far()))
    fall = F.col("close") / F.col("peak") - 1
    nav = F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0)))).over(W.so_far()))
    return rounded(p.withColumn("drawdown", fall).select("entity", "date", nav.alias("nav"), "drawdown", F.min("drawdown").over(W.so_far()).alias("worst")))


@query(f"""{WEEKLY}, w as (select a.entity, a.date, a.ord, a.close, p.close as peak, t.close as low, p.ord as po, t.ord as too
  from b a join b p on p.entity = a.entity and p.ord between a.ord - 9 and a.ord join b t on t.entity = a.entity and t.ord between p.ord and a.ord where a.ord >= 10)
select entity, date, round(least(min(low / peak - 1), 0), 6) as max_dd_10 from w group by 1, 2""")
def rolling_drawdown(spark, sf_dir):
    p = panel(spark, sf_dir).select("entity", "date", W.max_drawdown(F.col("close"), 10).alias("max_dd_10"))
    return rounded(p.filter("max_dd_10 is not null"))


@query(f"""{WEEKLY}, f as (select *, coalesce(ret > 0, false) as up, coalesce(ret < 0, false) as down from b),
i as (select *, sum(case when up then 0 else 1 end) over (partition by entity order by date) as iu, sum(case when down then 0 else 1 end) over (partition by entity order by date) as idn from f)
select entity, date, sum(case when up then 1 else 0 end) over (partition by entity, iu order by date)::bigint as up_run, sum(case when down then 1 else 0 end) over (partition by entity, idn order by date)::bigint as down_run from i""")
def streaks(spark, sf_dir):
    p = W.run_length(W.run_length(panel(spark, sf_dir), F.col("ret") > 0, "up_run"), F.col("ret") < 0, "down_run")
    return p.select("entity", "date", "up_run", "down_run")


@query(f"""{WEEKLY} select entity, date, round(case when count(ret) {ex(100)} >= 50 then quantile_cont(ret, 0.7) {ex(100)} end, 6) as threshold, coalesce(ret > case when count(ret) {ex(100)} >= 50 then quantile_cont(ret, 0.7) {ex(100)} end, false) as above from b""")
def dynamic_threshold(spark, sf_dir):
    p = panel(spark, sf_dir).withColumn("threshold", W.quantile_before(F.col("ret"), 100, 0.7, 50))
    return rounded(p.select("entity", "date", "threshold", F.coalesce(F.col("ret") > F.col("threshold"), F.lit(False)).alias("above")))


@query(f"""{WEEKLY}, m as (select *, case when ord >= 5 then avg(close) {inc(5)} end as a, case when ord >= 20 then avg(close) {inc(20)} end as z from b),
x as (select *, coalesce(a > z and lag(a) over (partition by entity order by date) <= lag(z) over (partition by entity order by date), false) as cross_up,
  coalesce(close = max(close) over (partition by entity order by date rows between 10 preceding and current row) and ord >= 3, false) as peak,
  coalesce(count(*) over (partition by entity order by date rows between 3 preceding and 3 following) = 7
    and close > max(close) over (partition by entity order by date rows between 3 preceding and 1 preceding)
    and close > max(close) over (partition by entity order by date rows between 1 following and 3 following), false) as centred from m),
y as (select *, ord - max(case when cross_up then ord end) over (partition by entity order by date) as since, avg(case when ret < 0 then 1.0 else 0.0 end) {inc(10)} as down_share from x)
select entity, date, cross_up, since, case when cross_up or since < 5 then cast(1 - since / 5.0 as double) else 0.0::double end as fresh, peak, centred, round(cast(down_share as double), 6) as down_share,
  sum(case when (ret > 0) <> (pr > 0) then 1 else 0 end) {inc(10)}::bigint as switches
from (select *, lag(ret) over (partition by entity order by date) as pr from y)""")
def cross_events(spark, sf_dir):
    p = panel(spark, sf_dir)
    c, r = F.col("close"), F.col("ret")
    p = p.withColumn("a", W.sma(c, 5)).withColumn("z", W.sma(c, 20))
    crossed = F.coalesce((F.col("a") > F.col("z")) & (W.lag(F.col("a")) <= W.lag(F.col("z"))), F.lit(False))
    p = p.withColumn("cross_up", crossed).withColumn("since", W.since_event(F.col("cross_up"))).withColumn("pr", W.lag(r))
    fresh = F.when(F.col("since") < 5, 1 - F.col("since") / 5.0).otherwise(0.0)
    return rounded(
        p.select(
            "entity", "date", "cross_up", "since", fresh.alias("fresh"), F.coalesce(W.local_high(c, 10), F.lit(False)).alias("peak"), F.coalesce(W.centred_peak(c, 3), F.lit(False)).alias("centred"),
            F.avg(F.when(r < 0, 1.0).otherwise(0.0)).over(W.incl(10)).alias("down_share"), F.sum(F.when((r > 0) != (F.col("pr") > 0), 1).otherwise(0)).over(W.incl(10)).alias("switches"),
        )
    )


EMA_SQL = f"""with recursive {WEEKLY[5:]}, e as (
  select entity, date, ord, close, close as f, close as s from b where ord = 1
  union all select b.entity, b.date, b.ord, b.close, e.f + (b.close - e.f) * 2 / 13.0, e.s + (b.close - e.s) * 2 / 27.0 from e join b on b.entity = e.entity and b.ord = e.ord + 1),
g as (select entity, date, ord, f, s, f - s as g from e where ord = 1 union all select e.entity, e.date, e.ord, e.f, e.s, g.g + (e.f - e.s - g.g) * 2 / 10.0 from g join e on e.entity = g.entity and e.ord = g.ord + 1)
select entity, date, round(f, 4) as ema_12, round(f - s, 4) as macd, round(g, 4) as macd_signal, round(f - s - g, 4) as macd_hist from g"""


@query(EMA_SQL)
def ema_macd(spark, sf_dir):
    p = recursive.macd(recursive.smoothed(bars(spark, sf_dir).select("entity", "date", "close"), {"ema_12": ("close", 12, False)}), "close")
    return rounded(p.select("entity", "date", "ema_12", "macd", "macd_signal", "macd_hist"), 4)


@query(f"""{WEEKLY} select a.entity, a.date, round(sum(h.close * pow(1 - 2 / 11.0, a.ord - h.ord)) / sum(pow(1 - 2 / 11.0, a.ord - h.ord)), 6) as ewm_10 from b a join b h on h.entity = a.entity and h.ord <= a.ord group by 1, 2""")
def ewm_adjusted(spark, sf_dir):
    p = recursive.smoothed(bars(spark, sf_dir).select("entity", "date", "close"), {"ewm_10": ("close", 10, True)})
    return rounded(p.select("entity", "date", "ewm_10"))


@query(f"""{WEEKLY}, cal as (select unnest(generate_series(min(date), max(date), interval 7 day))::date as date from bars), en as (select entity, min(date) as lo, max(date) as hi from bars group by 1),
g as (select en.entity, cal.date from en join cal on cal.date between lo and hi)
select g.entity, g.date, last_value(close ignore nulls) over (partition by g.entity order by g.date) as close, coalesce(volume, 0) as volume, close is null as filled from g left join bars on bars.entity = g.entity and bars.date = g.date""")
def calendar_ffill(spark, sf_dir):
    from panelyte.operators.clean import complete

    return complete(bars(spark, sf_dir), 7).select("entity", "date", "close", "volume", "filled")


@query(f"""{DAILY}, k as (select entity, date, close, volume, date_trunc('month', date)::date as month from bars),
m as (select entity, month, last(close order by date) as mclose, max(date) as ends from k group by 1, 2)
select k.entity, k.date, round(k.close / (select mclose from m where m.entity = k.entity and m.ends <= k.date order by ends desc limit 1) - 1, 6) as from_month from k""")
def higher_frame_to_daily(spark, sf_dir):
    """Last monthly close whose month has ended by the day, on daily rows."""
    from panelyte.operators.asof import asof

    daily = bars(spark, sf_dir, "brand", "day").select("entity", "date", "close")
    months = daily.groupBy("entity", F.trunc("date", "month").alias("month")).agg(F.max_by("close", "date").alias("mclose"), F.max("date").alias("ends")).drop("month")
    return rounded(asof(daily, months, "entity", "date", "ends", ["mclose"]).select("entity", "date", (F.col("close") / F.col("mclose") - 1).alias("from_month")))


@query(f"""{WEEKLY} select entity, date, {', '.join(f"round(lead(close, {h}) over (partition by entity order by date) / close - 1, 6) as fwd_{h}" for h in (1, 5, 10, 20))},
 round(max(close) over (partition by entity order by date rows between current row and 20 following) / close - 1, 6) as best_20, round(min(close) over (partition by entity order by date rows between current row and 20 following) / close - 1, 6) as worst_20 from b""")
def forward_returns(spark, sf_dir):
    c, path = F.col("close"), W.by_entity().rowsBetween(0, 20)
    return rounded(panel(spark, sf_dir).select("entity", "date", *[W.ahead(c, h).alias(f"fwd_{h}") for h in (1, 5, 10, 20)], (F.max(c).over(path) / c - 1).alias("best_20"), (F.min(c).over(path) / c - 1).alias("worst_20")))


@query(f"""with d as (select distinct cast(l_shipdate as date) as date from lineitem), o as (select date, row_number() over (order by date) as ord from d)
select date, ord, (ord - 1) % 20 = 0 as rebalance, lead(date, 5) over (order by date) as plus_5, lag(date, 5) over (order by date) as minus_5, year(date) || 'Q' || quarter(date) as quarter, isodow(date)::int as weekday from o""")
def trading_calendar(spark, sf_dir):
    from panelyte.operators.clean import calendar_of
    from panelyte.sources.panels import table

    days = calendar_of(table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date")))
    by = Window.partitionBy(F.lit(1)).orderBy("date")
    return days.select("date", F.col("ord").cast("long").alias("ord"), ((F.col("ord") - 1) % 20 == 0).alias("rebalance"), F.lead("date", 5).over(by).alias("plus_5"), F.lag("date", 5).over(by).alias("minus_5"), F.concat(F.year("date").cast("string"), F.lit("Q"), F.quarter("date").cast("string")).alias("quarter"), (F.weekday("date") + 1).alias("weekday"))
