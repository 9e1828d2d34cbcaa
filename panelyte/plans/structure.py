"""Queries over swing structure, price-volume factors, macro months, learning and files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import ml, points, swing, swing_state
from panelyte.plans.kernels import ex, inc, need, panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import factor_panel
from panelyte.sources.panels import bars, table

B = bars_sql()


def known(spark, sf_dir):
    """Bars with their window points and the structure known on each."""
    p = swing.window_points(panel(spark, sf_dir).select("entity", "date", "ord", "high", "low", "close", "volume"))
    return swing_state.known_structure(p)


def pointed(spark, sf_dir):
    """Bars with first and second points and the quality of fractals."""
    from panelyte.functions.recursive import macd, smoothed

    p = macd(panel(spark, sf_dir).select("entity", "date", "ord", "high", "low", "close", "volume"), "close").drop("macd", "macd_signal")
    p = swing.window_points(smoothed(p, {"ema20": ("close", 20, False)}))
    return points.second_points(points.fractal_quality(points.first_points(swing_state.known_structure(p))))


@query(None)
def swing_strokes(spark, sf_dir):
    """Strokes with the bar on which each is final."""
    return swing_state.known_swings(known(spark, sf_dir))


@query(None)
def swing_pivots(spark, sf_dir):
    """Pivots as they became known: a row for each bar on which the last one appeared or grew."""
    return swing_state.known_pivots(known(spark, sf_dir))


@query(None)
def swing_structure(spark, sf_dir):
    """What is known on every bar: fractals, strokes, segments, the last pivot, trend type, divergence, stroke points and
    the points at pivots."""
    return rounded(known(spark, sf_dir).drop(*swing.WINDOW_POINTS, "volume"))


@query(None)
def pivot_support(spark, sf_dir):
    """Buys inside the last known pivot."""
    p = known(spark, sf_dir)
    return rounded(swing.pivot_support(p.select("entity", "date", "ord", "close"), swing_state.known_pivots(p)).select("entity", "date", "zg", "zd", "trend", "inside"))


@query(None)
def pivot_points(spark, sf_dir):
    """Nine kinds of buy points and three of sell points in one table, with their confidence."""
    return rounded(pointed(spark, sf_dir).select("entity", "date", "buy_point", "buy_confidence", "sell_point", "sell_confidence", "b3_rank", "b3_trend", "second_buy_first", "second_sell_first"))


@query(None)
def fractal_quality(spark, sf_dir):
    """Quality of bottoms and tops since they are known."""
    return rounded(pointed(spark, sf_dir).select("entity", "date", "bottom_ord", "top_ord", "bottom_q", "top_q", "bottom_quality", "top_quality"))


@query(None)
def top_fractal_volume(spark, sf_dir):
    """Volume of tops against that of the tops before them."""
    return rounded(points.top_fractal_volume(known(spark, sf_dir)).select("entity", "date", "top_ord", "top_fractal_volume"))


@query(None)
def agreeing_levels(spark, sf_dir):
    """Levels of strokes and segments that agree, strength of both sides, and the price at which to give up."""
    p = points.stop_prices(points.agreeing_levels(pointed(spark, sf_dir)))
    return rounded(p.select("entity", "date", "depleted", "stroke_buy", "stroke_sell", "signal_level", "buy_strength", "sell_strength", "confirmed_buy", "confirmed_sell", "structure_buy", "structure_sell", "stop_price", "stop_reason"))


def _b(n: int) -> str:
    return f"lag(close, {n}) over (partition by entity order by date)"


def _r(a: int, z: int = 0) -> str:
    return f"over (partition by entity order by date rows between {a} preceding and {f'{z} preceding' if z else 'current row'})"


_BACK = lambda n: f"((close - {_b(n)}) / ({_b(n)} + 1e-10))"


#: Window points by entity and date as common table expressions over b.
WINDOW_CTES = f"""w0 as (select *, case when ord > 1 then abs(close - {_b(1)}) else 0 end as step, case when ord >= 20 then avg(close) {_r(19)} end as ma20, case when ord >= 60 then avg(close) {_r(59)} end as ma60, case when ord >= 20 then avg(volume) {_r(19)} end as v20,
  coalesce(ord > 1 and {_BACK(1)} > 0.095, false) as lim, max(close) {_r(60, 1)} as h60, min(close) {_r(20)} as l21, avg(close) {_r(20)} as m21, max(close) {_r(20)} as h21, avg(volume) {_r(2)} as v3, avg(volume) {_r(7, 3)} as v5, {_BACK(1)} as b1, {_BACK(3)} as b3, {_BACK(5)} as b5, {_BACK(10)} as b10, {_BACK(60)} as b60, avg(volume) {_r(4)} as vlate, avg(volume) {_r(9, 5)} as vearly, {_b(1)} as c1, ({_b(1)} - {_b(5)}) / ({_b(5)} + 1e-10) as pre, avg(volume) {_r(20, 1)} as vb20 from b),
w1 as (select *, case when ord >= 20 then avg(step) {_r(19)} end as atr, coalesce(close < 0.99 * ma20, false)::int as under, lag(ma20, 5) over (partition by entity order by date) as ma5b, max(case when lim then ord end) {_r(4, 1)} as ho from w0),
w2 as (select *, max(under) {_r(5, 1)} = 1 as crossed, avg(atr) {_r(20, 11)} as early, avg(atr) {_r(10)} as latr from w1),
w3 as (select w2.*, h.close as hc, h.volume as hv, w2.ord - w2.ho as days, (select min(x.close) from w0 x where x.entity = w2.entity and x.ord > w2.ho and x.ord <= w2.ord) as lows, (select avg(x.volume) from w0 x where x.entity = w2.entity and x.ord > w2.ho and x.ord <= w2.ord) as pv from w2 left join w0 h on h.entity = w2.entity and h.ord = w2.ho),
w4 as (select entity, date, case when ord > 60 and (h60 - close) / h60 > 0.15 and b3 > 0.02 and l21 < 0.97 * m21 and v3 > 1.1 * v5 then least(greatest(0.30 + 0.5 * (h60 - close) / h60 + 3 * b3, 0.25), 0.7) end as v_reversal,
  case when ord > 5 and b1 > 0.02 and pre < -0.03 and (ord <= 20 or volume > vb20) then least(greatest(0.30 + 5 * b1, 0.25), 0.7) end as gap_reversal,
  case when ord > 60 and ma20 > ma60 and close > ma60 and b5 < -0.02 and abs((close - ma20) / (ma20 + 1e-10)) < 0.05 and vlate < 0.85 * vearly and b60 < 0.35
    then least(greatest(0.45 + 0.3 * least(1, 8 * (ma20 / (ma60 + 1e-10) - 1)) + 0.25 * greatest(0, -8 * b5), 0.25), 0.85) end as trend_pullback,
  case when ord > 30 and crossed and close > 0.97 * ma20 and ma20 > ma5b and b5 > 0.005 and b5 < 0.10 and volume > 0.85 * v20 and b10 < 0.18 and l21 < 0.92 * close then least(greatest(0.20 + 0.25 * least(1, 50 * (ma20 / (ma5b + 1e-10) - 1)) + 0.15 * least(1, volume / (v20 + 1e-10) - 0.9) + 2 * b5, 0.15), 0.65) end as trend_start,
  case when ord > 60 and ma20 > ma60 and (abs(close - ma20) / (ma20 + 1e-10) < 0.03 or (abs(close - ma60) / (ma60 + 1e-10) < 0.05 and close > ma60)) and h21 > 1.05 * ma20 and close > c1 and b3 > -0.01 and v3 < 0.95 * v20 then least(greatest(0.30 + 0.2 * (1 - 10 * abs(close - ma20) / (ma20 + 1e-10)) + 3, 0.20), 0.70) end as mean_pullback,
  case when ord > 40 and (coalesce(early > 0 and latr < 0.7 * early, false) or (h21 - l21) / (l21 + 1e-10) < 0.12) and volume > 1.3 * v20 and b1 > 0.01 and close > ma20 then least(greatest(0.25 + 5 * b1 + case when early > 0 and latr < 0.7 * early then 0.10 else 0 end, 0.15), 0.65) end as range_breakout,
  case when ord > 8 and days >= 1 and lows > 0.98 * hc and (days = 1 or pv < 0.7 * hv) and close > c1 then least(greatest(0.35 + 0.08 * (3 - days) - 3 * (hc - lows) / (hc + 1e-10), 0.20), 0.70) end as limit_pullback from w3)"""


@query(f"""{B}, {WINDOW_CTES}
select entity, date, {', '.join(f'round({n}, 6) as {n}' for n in ('v_reversal', 'gap_reversal', 'trend_pullback', 'trend_start', 'mean_pullback', 'range_breakout', 'limit_pullback'))}, case when v_reversal is not null or gap_reversal is not null then 1 when trend_pullback is not null then 4 when trend_start is not null then 5 when mean_pullback is not null then 6 when range_breakout is not null then 8 when limit_pullback is not null then 9 else 0 end as buy_point from w4""")
def window_buy_points(spark, sf_dir):
    """Buy points that need no pivot, with their confidence."""
    p = swing.window_points(panel(spark, sf_dir).select("entity", "date", "ord", "close", "volume"))
    return rounded(p.withColumn("buy_point", swing.first_window_point()).drop("ord", "close", "volume"))


@query(f"""{B}, t as (select *, coalesce(least(high, lag(high) over e) >= greatest(low, lag(low) over e) and lag(high) over e is not null, false) as touch from b window e as (partition by entity order by date)), i as (select *, sum(case when touch then 0 else 1 end) over (partition by entity order by date) as island from t),
z as (select entity, min(date) as start, max(date) as "end", count(*) as bars, quantile_cont(high, 0.9) as upper, quantile_cont(low, 0.1) as lower from i group by entity, island having count(*) >= 5)
select entity, start, "end", bars, round(upper, 6) as upper, round(lower, 6) as lower, case when lower > lag(upper) over (partition by entity order by start) then 1 when upper < lag(lower) over (partition by entity order by start) then -1 else 0 end as trend from z""")
def overlap_zones(spark, sf_dir):
    """Runs of overlapping bars as zones, and how each lies to the one before."""
    z = swing.overlap_zones(panel(spark, sf_dir))
    return rounded(z.withColumn("trend", swing.zone_trend(z)))


@query(None)
def boosted_scores(spark, sf_dir):
    """Predictions of ensembles that are trained anew every 100 dates on the 150 dates before."""
    features = ["mom_5", "mom_20", "vol_20", "pos_20", "vr_20"]
    p, more = ml.crossed(factor_panel(spark, sf_dir).filter("mom_20 is not null"), features, 3)
    rows = ml.prepare(p, features + more)
    return rounded(ml.rolling_retrain(rows, 100, 150, 5, seeds=(1, 2), trees=5).select("entity", "date", "prediction"))


def _n(value: str, of: str = "ret", w: int = 20) -> str:
    return need(value, of, ex(w), w)


FACTORS_SQL = f"""{B}, x as (select *, open / lag(close) over (partition by entity order by date) - 1 as gap, close / open - 1 as intra, volume / lag(volume) over (partition by entity order by date) - 1 as dv,
  close / lag(close, 10) over (partition by entity order by date) - 1 as mom10, close / lag(close, 20) over (partition by entity order by date) - 1 as mom20 from b)
select entity, date,
 round(tanh(-20 * {_n(f'stddev_pop(ret) {ex(20)}')}), 6) as volatility,
 round(atan({need(f'volume / avg(volume) {inc(20)}', 'volume', inc(20), 20)} - 1) / (pi() / 2), 6) as volume_ratio,
 round(tanh(-3 * mom20), 6) as momentum_reversal, round(tanh(5 * (mom10 - mom20)), 6) as momentum_acceleration,
 round(tanh(15 * {need(f'sum(gap) {inc(20)}', 'gap', inc(20), 20)}), 6) as overnight_ret, round(tanh(15 * {need(f'sum(intra) {inc(20)}', 'intra', inc(20), 20)}), 6) as intraday_ret,
 round(tanh(3 * {_n(f'max(ret) {ex(20)}')}), 6) as max_ret_20,
 round(tanh({_n(f'(sum(pow(ret, 3)) {ex(20)} / 20 - 3 * avg(ret) {ex(20)} * avg(ret * ret) {ex(20)} + 2 * pow(avg(ret) {ex(20)}, 3)) / pow(stddev_pop(ret) {ex(20)}, 3)')}), 5) as skewness_20,
 round(tanh(3 * (sum(case when gap > 0.01 then gap else 0 end) {inc(20)} + sum(case when gap < -0.01 then gap else 0 end) {inc(20)}) / nullif(sum(case when gap > 0.01 then gap else 0 end) {inc(20)} - sum(case when gap < -0.01 then gap else 0 end) {inc(20)}, 0)), 6) as gap_ratio,
 round(atan(mom20 / ({_n(f'stddev_pop(ret) {ex(20)}')} + 1e-6)) / (pi() / 2), 6) as return_risk_ratio,
 round(tanh(-1e10 * {need(f'avg(abs(ret) / (close * volume)) {inc(20)}', 'ret', inc(20), 20)}), 6) as illiquidity
from x"""


@query(FACTORS_SQL)
def price_volume_factors(spark, sf_dir):
    """A catalogue of squashed price and volume factors in one pass over each entity's rows."""
    p = panel(spark, sf_dir)
    c, r, v = F.col("close"), F.col("ret"), F.col("volume")
    p = p.withColumn("gap", F.col("open") / W.lag(c) - 1).withColumn("intra", c / F.col("open") - 1).withColumn("mom10", W.change(c, 10)).withColumn("mom20", W.change(c, 20))
    p = p.withColumn("cost", F.abs(r) / (c * v))
    up = F.sum(F.when(F.col("gap") > 0.01, F.col("gap")).otherwise(0.0)).over(W.incl(20))
    down = F.sum(F.when(F.col("gap") < -0.01, F.col("gap")).otherwise(0.0)).over(W.incl(20))
    from panelyte.functions.numeric import ratio, squash

    return p.select(
        "entity", "date",
        F.round(F.tanh(-20 * W.std(r, 20)), 6).alias("volatility"), F.round(squash(v / W.sma(v, 20) - 1), 6).alias("volume_ratio"),
        F.round(F.tanh(-3 * F.col("mom20")), 6).alias("momentum_reversal"), F.round(F.tanh(5 * (F.col("mom10") - F.col("mom20"))), 6).alias("momentum_acceleration"),
        F.round(F.tanh(15 * W.total(F.col("gap"), 20)), 6).alias("overnight_ret"), F.round(F.tanh(15 * W.total(F.col("intra"), 20)), 6).alias("intraday_ret"),
        F.round(F.tanh(3 * W.highest(r, 20)), 6).alias("max_ret_20"), F.round(F.tanh(W.full(F.skewness(r).over(W.excl(20)), r, W.excl(20), 20)), 5).alias("skewness_20"),
        F.round(F.tanh(3 * ratio(up + down, up - down)), 6).alias("gap_ratio"), F.round(squash(F.col("mom20") / (W.std(r, 20) + 1e-6)), 6).alias("return_risk_ratio"),
        F.round(F.tanh(-1e10 * W.full(F.avg("cost").over(W.incl(20)), r, W.incl(20), 20)), 6).alias("illiquidity"),
    )


@query("""with m as (select date_trunc('month', o_orderdate)::date as month, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as money, count(*) as n from orders group by 1),
r as (select *, money / nullif(lag(money, 12) over (order by month), 0) - 1 as yoy from m), a as (select *, yoy - lag(yoy, 3) over (order by month) as accel from r)
select month, money, round(yoy, 6) as yoy, round(accel, 6) as accel, case when yoy > 0 and accel > 0 then 'bull' when yoy < 0 and accel < 0 then 'bear' else 'mixed' end as state from a""")
def macro_months(spark, sf_dir):
    """Monthly money, growth on the year, its acceleration over three months and the state they give."""
    by = Window.partitionBy(F.lit(1)).orderBy("month")
    m = table(spark, sf_dir, "orders").groupBy(F.trunc(F.to_date("o_orderdate"), "month").alias("month")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("money"))
    m = m.withColumn("yoy", F.try_divide(F.col("money"), F.lag("money", 12).over(by)) - 1).withColumn("accel", F.col("yoy") - F.lag("yoy", 3).over(by))
    state = F.when((F.col("yoy") > 0) & (F.col("accel") > 0), "bull").when((F.col("yoy") < 0) & (F.col("accel") < 0), "bear").otherwise("mixed")
    return m.select("month", "money", F.round("yoy", 6).alias("yoy"), F.round("accel", 6).alias("accel"), state.alias("state"))


@query(f"""{B}, k as (select *, row_number() over (partition by entity order by date desc) as k from b), u as (select entity, count(*) as bars, avg(amount) filter (k <= 20) as adv, last(close order by date) as price, max(date) as last_date from k group by 1)
select entity, bars, round(adv, 4) as adv, price, last_date, bars >= 60 and price >= 2 and adv >= 100000 as tradable, last_date < (select max(date) from bars) as stale from u""")
def liquidity_universe(spark, sf_dir):
    """History, trailing mean amount, last price and freshness of each entity."""
    b = bars(spark, sf_dir)
    recent = b.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date"))))
    u = recent.groupBy("entity").agg(F.count(F.lit(1)).alias("bars"), F.avg(F.when(F.col("k") <= 20, F.col("amount"))).alias("adv"), F.max_by("close", "date").alias("price"), F.max("date").alias("last_date"))
    last = b.agg(F.max("date").alias("newest"))
    ok = (F.col("bars") >= 60) & (F.col("price") >= 2) & (F.col("adv") >= 100000)
    return u.crossJoin(F.broadcast(last)).select("entity", "bars", F.round("adv", 4).alias("adv"), "price", "last_date", ok.alias("tradable"), (F.col("last_date") < F.col("newest")).alias("stale"))
