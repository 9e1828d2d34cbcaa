"""Queries over reports and the life of a factor library."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import evaluate as EV
from panelyte.operators import ic as IC
from panelyte.operators import library as LB
from panelyte.operators import reports as RP
from panelyte.plans.desk import SIGNALS, WEIGHTS, signals, weights
from panelyte.plans.kernels import panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import FACTORS, REGIME_SQL, WALK_SQL, factor_panel, ic_sql, panel_sql, r6, regimes
from panelyte.sources.store import stored

B, P = bars_sql(), panel_sql()
LEAD = "lead({0}) over (partition by entity order by date)"


def walk(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    return IC.walk_forward(IC.rank_ic(IC.melt(p, FACTORS, "target")), p, 60, 5, 3, {"mom_5": "momentum", "mom_20": "momentum"})


@query(f"""{WALK_SQL}, al as (select count(distinct date) as d from wf) select factor, count(distinct date) as dates, round(count(distinct date) / max(d), 6) as share, round(avg(weight), 6) as mean_weight from wf, al group by 1""")
def factor_usage(spark, sf_dir):
    """How often each factor was chosen, and its mean weight."""
    return rounded(RP.usage(walk(spark, sf_dir)))


@query(f"""{P}, {REGIME_SQL}, e as (select rg.date, case when regime = 'bull' then 0.9 else 0.4 end * (1 + 0.1 * extract(month from rg.date) / 12.0)::double as exposure, q.target from rg join (select date, avg(target) as target from p group by 1) q using (date) where q.target is not null),
m as (select quantile_cont(exposure, 0.5) as med from e) select count(*) as n, round(avg(target) filter (exposure > med), 6) as high, round(avg(target) filter (exposure <= med), 6) as low, round(avg(target) filter (exposure > med) - avg(target) filter (exposure <= med), 6) as gap, round(covar_pop(exposure, target) / (stddev_pop(exposure) * stddev_pop(target)), 6) as corr from e, m""")
def position_quality(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    e = regimes(p).join(p.groupBy("date").agg(F.avg("target").alias("target")), "date")
    return rounded(RP.position_quality(e.withColumn("exposure", F.when(F.col("regime") == "bull", 0.9).otherwise(0.4) * (1 + 0.1 * F.month("date") / 12.0))))


KINDS = f"{SIGNALS}, kd as (select entity, date, ord, close, case when buy then 1 when sell then -1 else 0 end as kind from sg)"


@query(f"""{WEIGHTS.replace(P, KINDS)}, ws as (select wt.*, sc.score, lead(wt.date) over (partition by wt.entity order by wt.date) as xd from wt join sc using (entity, date) where weight > 0),
t as (select w.entity, w.date as entry_date, xd as exit_date, weight as entry_weight, score as entry_score, a.kind as entry_kind, z.kind as exit_kind, z.ord - a.ord as bars, z.close / a.close - 1 as ret from ws w left join kd a on a.entity = w.entity and a.date = w.date left join kd z on z.entity = w.entity and z.date = xd where xd is not null)
select entity, entry_date, exit_date, {r6('entry_weight', 'entry_score')}, entry_kind, exit_kind, bars, round(ret, 6) as ret, case when exit_kind < 0 then 'sell signal' when bars = 1 then 'kept' when bars > 10 then 'returned late' else 'returned' end as exit_class from t""")
def trade_reconstruction(spark, sf_dir):
    """Trades between consecutive selections of an entity with the signals of both dates."""
    s = signals(spark, sf_dir).withColumn("kind", F.when(F.col("buy"), 1).when(F.col("sell"), -1).otherwise(0))
    return rounded(RP.trades(weights(spark, sf_dir), s))


DIAG = f"""{P}, dg0 as (select *, case when mom_20 > 0.3 then 2 when mom_20 < -0.3 then -2 else 0 end as trend_type, case when mom_5 > 0.5 and pos_20 > 0.8 then 3 when mom_5 > 0.2 and pos_20 > 0.5 then 2 when mom_5 > 0 and pos_20 < 0.3 then 1 else 0 end as buy_point,
  case when mom_5 < -0.5 then 2 when mom_5 < -0.3 then 1 else 0 end as sell_point, ret * 100 as change, vr_20 as volume_ratio, case when pos_20 > 0.7 then 1 when pos_20 < 0.3 then -1 else 0 end as pivot_position, coalesce(close < lag(close, 5) over (partition by entity order by date), false) as down5 from p where mom_20 is not null and vr_20 is not null and pos_20 is not null),
dg1 as (select *, buy_point >= 2 and volume_ratio > 1.2 as confirmed_buy, sell_point = 2 and volume_ratio > 1.2 as confirmed_sell, least(abs(mom_5), 1) as strength, least(greatest(pos_20, 0), 1) as alignment, case when down5 then 1 else 0 end as stroke_direction, coalesce(pos_20 > 0.9 and mom_5 < 0, false) as top_divergence from dg0),
dg as (select *, least(greatest(case trend_type when 2 then 0.25 when -2 then -0.25 else 0 end + case when confirmed_buy then 0.35 * strength when confirmed_sell then -0.35 * strength when buy_point > 0 then 0.20 * alignment when sell_point > 0 then -0.20 * alignment else 0 end
  + 0.10 * (case when buy_point = 2 then alignment else 0 end) + case when pivot_position = 1 then 0.08 when pivot_position = -1 and trend_type >= 0 then 0.05 else 0 end + 0.05 * alignment - 0.05 * sell_point - case when top_divergence then 0.10 else 0 end, -1), 1) as composite from dg1)"""


def diagnosed(spark, sf_dir):
    """Panel with the columns of a diagnosis, taken from momentum, position and volume."""
    c = F.col
    p = factor_panel(spark, sf_dir)
    down5 = F.coalesce(c("close") < W.lag(c("close"), 5), F.lit(False))
    keep = c("mom_20").isNotNull() & c("vr_20").isNotNull() & c("pos_20").isNotNull()
    p = p.filter(keep).withColumn("down5", down5)
    buy = F.when((c("mom_5") > 0.5) & (c("pos_20") > 0.8), 3).when((c("mom_5") > 0.2) & (c("pos_20") > 0.5), 2).when((c("mom_5") > 0) & (c("pos_20") < 0.3), 1).otherwise(0)
    p = p.select(
        "*", F.when(c("mom_20") > 0.3, 2).when(c("mom_20") < -0.3, -2).otherwise(0).alias("trend_type"), buy.alias("buy_point"), F.when(c("mom_5") < -0.5, 2).when(c("mom_5") < -0.3, 1).otherwise(0).alias("sell_point"), (c("ret") * 100).alias("change"),
        c("vr_20").alias("volume_ratio"), F.when(c("pos_20") > 0.7, 1).when(c("pos_20") < 0.3, -1).otherwise(0).alias("pivot_position"), F.least(F.abs("mom_5"), F.lit(1.0)).alias("strength"), F.least(F.greatest("pos_20", F.lit(0.0)), F.lit(1.0)).alias("alignment"),
        F.when(c("down5"), 1).otherwise(0).alias("stroke_direction"), F.coalesce((c("pos_20") > 0.9) & (c("mom_5") < 0), F.lit(False)).alias("top_divergence"),
    )
    p = p.withColumn("confirmed_buy", (c("buy_point") >= 2) & (c("volume_ratio") > 1.2)).withColumn("confirmed_sell", (c("sell_point") == 2) & (c("volume_ratio") > 1.2))
    p = p.select("*", c("strength").alias("buy_strength"), c("strength").alias("sell_strength"), c("alignment").alias("buy_confidence"), c("alignment").alias("sell_confidence"), F.when(c("buy_point") == 2, c("alignment")).otherwise(0.0).alias("second_buy"), c("sell_point").alias("breakdowns"), F.lit(False).alias("pivot_breakdown"), F.lit(False).alias("depleted"), F.when(c("confirmed_buy"), 3).otherwise(0).alias("signal_level"))
    return p.withColumn("composite", RP.composite())


@query(f"""{DIAG} select entity, date, round(composite, 6) as composite, case when confirmed_buy and alignment >= 0.6 and composite >= 0.5 then 'A' when buy_point = 2 and alignment >= 0.6 and composite >= 0.4 then 'A' when buy_point >= 2 and alignment >= 0.5 and composite >= 0.3 then 'B' when buy_point = 1 and composite >= 0.1 then 'C' when composite <= -0.5 then 'D-' else 'D' end as grade,
 case when confirmed_sell or sell_point >= 1 then 'high' when top_divergence or (trend_type = -2 and pivot_position <= 0) then 'watch' else 'safe' end as risk from dg""")
def composite_diagnosis(spark, sf_dir):
    """Composite score, opportunity grade and risk class of every row."""
    return rounded(diagnosed(spark, sf_dir).select("entity", "date", "composite", RP.grade(F.col("composite")).alias("grade"), RP.risk().alias("risk")))


@query(f"""{DIAG}, ml as (select date, grp, count(*) as n, 100.0 * count(*) filter (trend_type = 2) / count(*) as up_pct, 100.0 * count(*) filter (trend_type = -2) / count(*) as down_pct, count(*) filter (buy_point = 1) as b1, count(*) filter (buy_point = 2) as b2, count(*) filter (buy_point = 3) as b3, count(*) filter (buy_point > 0) as buys, count(*) filter (sell_point > 0) as sells,
  avg(volume_ratio) as volume_ratio, avg(composite) as composite, case when count(*) filter (change > 5 and volume_ratio > 2) > 0 then 0.4 else 0 end + case when count(*) filter (change > 2 and volume_ratio > 1.5) > 1 then 0.3 else 0 end + case when count(*) filter (change > 0) * 2 > count(*) then 0.3 else 0 end as formation from dg group by 1, 2 having count(*) >= 3)
select date, grp, n, round(up_pct::double, 6) as up_pct, round(down_pct::double, 6) as down_pct, b1, b2, b3, buys, sells, {r6('volume_ratio', 'composite')}, formation::double as formation, buys - sells as net_flow, case when formation >= 0.7 and buys >= 3 then 'strong' when formation >= 0.4 and buys >= 1 then 'second' when sells > buys then 'leaving' else 'none' end as verdict,
 row_number() over (partition by date order by round(formation::double + coalesce(composite, 0) / 3, 9) desc, grp) as hot_rank from ml""")
def group_main_lines(spark, sf_dir):
    """Main-line table of each date's groups."""
    return rounded(RP.main_lines(diagnosed(spark, sf_dir)))


@query(f"""{DIAG}, lu as (select *, case when pos_20 > 1 then (pos_20 - 1) * 20 end as above_pct, lag(top_divergence) over e as pd, lag(trend_type) over e as pt, lag(pivot_position) over e as pp, lag(buy_point) over e as pb, lag(alignment) over e as pa, lag(case when stroke_direction = 1 then -1 else 1 end) over e as psd,
  sum(case when abs(mom_5) < 0.1 then 1 else 0 end) over (partition by entity order by date rows between 20 preceding and 1 preceding) as quiet, 1 - alignment as bq from dg window e as (partition by entity order by date)),
ly as (select *, [case when above_pct > 0 then {{'c': least(0.95, 0.55 + above_pct / 20 + case when volume_ratio > 1.5 then 0.15 else 0 end)::double, 'k': 0, 't': 'pivot breakout'}} end, case when pd and pt = -2 and pp <= 0 then {{'c': least(0.9, 0.55 + case when pb = 1 then 0.15 else 0 end + case when bq > 0.3 then 0.1 else 0 end)::double, 'k': -1, 't': 'divergence reversal'}} end,
  case when pb = 2 and pt >= 1 and pp <= 0 then {{'c': least(0.9, 0.60 + case when volume_ratio > 1.5 then 0.15 else 0 end + case when pa > 0 then 0.1 else 0 end)::double, 'k': -2, 't': 'second buy'}} end, case when pt = 2 and pp = 1 and pa > 0.3 then {{'c': least(0.85, 0.50 + case when volume_ratio > 2 then 0.15 else 0 end + case when buy_point >= 3 then 0.1 else 0 end)::double, 'k': -3, 't': 'trend acceleration'}} end,
  case when psd = -1 and bq > 0.25 then {{'c': least(0.8, 0.45 + 0.3 * bq + case when volume_ratio > 1.5 then 0.1 else 0 end)::double, 'k': -4, 't': 'stroke reversal'}} end, case when quiet >= 8 and volume_ratio > 1.5 then {{'c': least(0.85, 0.45 + least(quiet / 50.0, 0.25) + case when volume_ratio > 2 then 0.15 else 0 end)::double, 'k': -5, 't': 'range breakout'}} end] as xs from lu where change > 50),
lz as (select *, list_max(list_filter(xs, lambda x: x is not null)) as best from ly)
select entity, date, case when best is not null then best.t when volume_ratio > 2 then 'volume' else 'other' end as type, round(case when best is not null then best.c when volume_ratio > 2 then 0.35 else 0.2 end, 6) as confidence from lz""")
def limit_attribution(spark, sf_dir):
    """Pattern behind each surge (a move of more than 50 % on these bars)."""
    c = F.col
    d = diagnosed(spark, sf_dir)
    quiet = F.sum((F.abs("mom_5") < 0.1).cast("int")).over(W.by_entity().rowsBetween(-20, -1))
    d = d.select(
        "*", F.when(c("pos_20") > 1, (c("pos_20") - 1) * 20).alias("above_pct"), c("volume_ratio").alias("vol_spike"), W.lag(c("top_divergence")).alias("pre_divergence"), W.lag(c("trend_type")).alias("pre_trend"), W.lag(c("pivot_position")).alias("pre_position"),
        W.lag(c("buy_point")).alias("pre_buy_point"), W.lag(c("alignment")).alias("pre_alignment"), W.lag(F.when(c("stroke_direction") == 1, -1).otherwise(1)).alias("pre_direction"), quiet.alias("pre_quiet"), (1 - c("alignment")).alias("bottom_quality"),
    )
    hit = d.filter("change > 50").withColumn("found", RP.limit_type())
    return rounded(hit.select("entity", "date", "found.type", "found.confidence"))


@query(f"""{SIGNALS}, pa0 as (select *, lead(ret) over (partition by entity order by date) as nx, case when buy then 1 when sell then -1 else 0 end as direction, least(abs(mom_5), 1) as conf from sg), pa as (select *, avg(nx) over (partition by date) as mk from pa0)
select direction, (conf > 0.3)::int + (conf > 0.6)::int as band, count(*) as n, round(avg(case when nx * direction > 0 then 1.0 else 0.0 end)::double, 6) as right, round(avg(nx), 6) as mean_next, round(avg((nx - mk) * direction), 6) as excess from pa where direction <> 0 and nx is not null group by 1, 2""")
def prediction_accuracy(spark, sf_dir):
    s = signals(spark, sf_dir).withColumn("direction", F.when(F.col("buy"), 1).when(F.col("sell"), -1).otherwise(0)).withColumn("confidence", F.least(F.abs("mom_5"), F.lit(1.0)))
    return rounded(RP.accuracy(s, ["direction"], [0.3, 0.6]))


@query(f"""{SIGNALS}, cp as (select *, lead(close, 5) over e / close - 1 as later, max(buy::int) over (partition by entity order by date rows between 3 preceding and current row) as seen, max(sell::int) over (partition by entity order by date rows between 1 following and 3 following) as sold from sg window e as (partition by entity order by date))
select count(*) filter (later >= 0.5) as movers, count(*) filter (later >= 0.5 and seen = 1) as captured, count(*) filter (buy and later < 0) as false_buys, count(*) filter (sell and later > 0) as false_sells, count(*) filter (buy and sold = 1) as whipsaws, count(*) filter (buy) as buys, round(count(*) filter (later >= 0.5 and seen = 1) / nullif(count(*) filter (later >= 0.5), 0), 6) as captured_share from cp""")
def capture_report(spark, sf_dir):
    return rounded(RP.capture(signals(spark, sf_dir), 0.5))


@query(f"""{SIGNALS}, ev as (select entity, date, ord from sg where mom_20 > 0 and coalesce(lag20 <= 0, false)), hits as (select ev.entity, ev.date, b.ord - ev.ord as off from ev left join sg b on b.entity = ev.entity and b.ord between ev.ord - 3 and ev.ord + 3 and b.buy)
select entity, date, count(off) as signals, min(off) as first_offset from hits group by 1, 2""".replace(SIGNALS, SIGNALS.replace("sg as (select *,", "sg as (select *, lag(mom_20) over (partition by entity order by date) as lag20,")))
def trend_start_signals(spark, sf_dir):
    """Buys within three rows of each start of a rise."""
    s = signals(spark, sf_dir).withColumn("before", W.lag(F.col("mom_20")))
    return RP.starts_with_signals(s, (F.col("mom_20") > 0) & (F.col("before") <= 0)).select("entity", "date", "signals", F.col("first_offset").cast("long").alias("first_offset"))


@query(f"""{SIGNALS}, n as (select entity, date, ord, close, buy, min(case when sell then ord end) over (partition by entity order by ord rows between 1 following and unbounded following) as so from sg),
tr as (select s.ord - n.ord as bars, s.close / n.close - 1 as ret, lead5.l as later from n join sg s on s.entity = n.entity and s.ord = n.so left join (select entity, ord, lead(close, 5) over (partition by entity order by date) / close - 1 as l from sg) lead5 on lead5.entity = s.entity and lead5.ord = s.ord where n.buy)
select (bars > 2)::int + (bars > 5)::int + (bars > 10)::int as bin, count(*) as trips, round(avg(ret), 6) as mean_ret, round(avg(case when ret > 0 then 1.0 else 0.0 end)::double, 6) as win_rate, round(avg(later), 6) as mean_after from tr group by 1""")
def holding_durations(spark, sf_dir):
    """Round trips by holding length, with what followed the exit."""
    s = signals(spark, sf_dir)
    t = EV.round_trips(s)
    at = lambda name: s.select("entity", F.col("date").alias(name), F.col("ord").alias(f"{name}_ord"))
    t = t.join(at("bought"), ["entity", "bought"]).join(at("sold"), ["entity", "sold"]).withColumn("bars", F.col("sold_ord") - F.col("bought_ord"))
    return rounded(RP.durations(t, [2, 5, 10], s.select("entity", F.col("date").alias("sold"), W.ahead(F.col("close"), 5).alias("later"))))


@query(f"""{WEIGHTS}, alt as (select entity, date, 0.2::double as weight from (select *, row_number() over (partition by date order by mom_5 desc nulls last, entity) as place from sc) where place <= 5), ob as (select coalesce(a.date, b.date) as date, a.weight as a, b.weight as b from wt a full join alt b on a.date = b.date and a.entity = b.entity),
od as (select date, count(a) as live, count(b) as reference, count(*) filter (a is not null and b is not null) as common, count(*) filter (a is not null and b is not null) / count(*) as jaccard, sum(least(coalesce(a, 0), coalesce(b, 0))) / nullif(greatest(sum(coalesce(a, 0)), sum(coalesce(b, 0))), 0) as weight_share from ob group by 1),
oi as (select *, sum(case when jaccard < 0.5 then 0 else 1 end) over (order by date) as isl from od) select date, live, reference, common, round(jaccard, 6) as jaccard, round(weight_share, 6) as weight_share, sum(case when jaccard < 0.5 then 1 else 0 end) over (partition by isl order by date)::bigint as apart_run from oi""")
def selection_overlap(spark, sf_dir):
    """Agreement of the selections by score and by short momentum."""
    from panelyte.operators import select as S
    from panelyte.plans.desk import ranked_scores

    alt = S.top_n(ranked_scores(spark, sf_dir).withColumn("score", F.coalesce("mom_5", F.lit(-1e9))), 5).select("date", "entity", F.lit(0.2).alias("weight"))
    return rounded(RP.overlap(weights(spark, sf_dir).select("date", "entity", "weight"), alt))


@query(f"""{P}, gy as (select year(date) as w, grp as name, t.cut, avg(target) filter (mom_20 > t.cut) as m from p, (select unnest([-0.2, 0.0, 0.2, 0.5, 1.0]) as cut) t where target is not null group by 1, 2, 3), bw as (select name, w, cut::double as value from (select *, row_number() over (partition by w, name order by m desc nulls last, cut) as k from gy) where k = 1),
md as (select name, count(*) as windows, quantile_cont(value, 0.5) as median from bw group by 1) select md.name, windows, round(median, 6) as median, round(avg(case when abs(value - median) <= 0.1 * abs(median) then 1.0 else 0.0 end)::double, 6) as stable_share, avg(case when abs(value - median) <= 0.1 * abs(median) then 1.0 else 0.0 end) >= 0.5 as stable from bw join md using (name) group by 1, 2, median""")
def parameter_consensus(spark, sf_dir):
    """Best threshold of each group by year, and whether the years agree on it."""
    cuts = F.explode(F.array(*[F.lit(c) for c in (-0.2, 0.0, 0.2, 0.5, 1.0)]))
    g = factor_panel(spark, sf_dir).filter("target is not null").select("*", cuts.alias("cut")).groupBy(F.year("date").alias("w"), F.col("grp").alias("name"), "cut").agg(F.avg(F.when(F.col("mom_20") > F.col("cut"), F.col("target"))).alias("m"))
    best = g.withColumn("k", F.row_number().over(Window.partitionBy("w", "name").orderBy(F.desc_nulls_last("m"), "cut"))).filter("k = 1").select(F.col("w").alias("window"), "name", F.col("cut").alias("value"))
    return rounded(RP.consensus(best))


@query(f"""{P}, {REGIME_SQL}, sz as (select *, ntile(3) over (partition by date order by amount, entity) as size from p where target is not null and mom_20 is not null) select grp, size, mom_20 > 0 as rising, count(*) as n, round(avg(target), 6) as mean_return, round(avg(case when target > 0 then 1.0 else 0.0 end)::double, 6) as hit_rate from sz group by 1, 2, 3""")
def group_forward_stats(spark, sf_dir):
    """Forward returns by group, size tercile of the date, and sign of momentum."""
    p = factor_panel(spark, sf_dir).filter("target is not null and mom_20 is not null")
    p = p.withColumn("size", F.ntile(3).over(Window.partitionBy("date").orderBy("amount", "entity")))
    return rounded(p.groupBy("grp", "size", (F.col("mom_20") > 0).alias("rising")).agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_return"), F.avg((F.col("target") > 0).cast("double")).alias("hit_rate")))


@query(f"""{P}, {REGIME_SQL} select factor, regime, count(*) as n, round(covar_pop(value, target) / (stddev_pop(value) * stddev_pop(target)), 6) as pearson, round(avg(case when sign(value) = sign(target) then 1.0 else 0.0 end)::double, 6) as same_sign from l join rg using (date) group by 1, 2 having count(*) >= 30""")
def field_ic_scan(spark, sf_dir):
    """Pooled IC and sign agreement of every field within each regime."""
    p = factor_panel(spark, sf_dir)
    long = IC.melt(p, FACTORS, "target").join(regimes(p), "date")
    return rounded(long.groupBy("factor", "regime").agg(F.count(F.lit(1)).alias("n"), IC.pearson("value", "target").alias("pearson"), F.avg((F.signum("value") == F.signum("target")).cast("double")).alias("same_sign")).filter("n >= 30"))


METRICS = f"""{P}, ic as {ic_sql()}, mt as (select factor, date_trunc('quarter', date)::date as eval_date, avg(ic) as ic_mean, case when stddev_pop(ic) > 1e-10 then avg(ic) / stddev_pop(ic) end as ir from ic group by 1, 2 having count(*) >= 5),
mk as (select *, row_number() over (partition by factor order by eval_date) as k from mt where ir is not null),
mq as (select *, count(*) over w as n, sum(pow(2, k / 4.0) * ic_mean) over w / sum(pow(2, k / 4.0)) over w as tw_ic, sum(pow(2, k / 4.0) * ir) over w / sum(pow(2, k / 4.0)) over w as tw_ir, case when count(*) over w >= 3 then regr_slope(ic_mean, k) over w else 0 end as slope, case when count(*) over w >= 3 then regr_slope(abs(ic_mean), k) over w else 0 end as abs_slope,
  case when count(*) over w >= 2 then stddev_pop(ic_mean) over w else 0 end as volatility, lag(abs(ic_mean)) over (partition by factor order by eval_date) as before from mk window w as (partition by factor order by eval_date rows between 7 preceding and current row)),
ms as (select *, 0.5 * slope / greatest(abs(ic_mean), 0.001) + 0.3 * case when ic_mean < tw_ic then 1 else -0.5 end + 0.2 * case when volatility < 0.02 then 1 else -0.5 end as decay_score from mq),
mx as (select *, case when (n >= 3 and abs_slope < -0.003 and abs(ic_mean) < 0.02) or (n >= 2 and abs(ic_mean) < 0.5 * before) or (decay_score < -0.2 and abs(ic_mean) < 0.03) then 'decaying' when abs(ic_mean) > 0.02 and abs_slope >= -0.001 and n >= 3 then 'active' else 'candidate' end as status from ms)"""


def metrics(spark, sf_dir):
    ic = IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))
    m = ic.groupBy("factor", F.trunc("date", "quarter").alias("eval_date")).agg(F.avg("ic").alias("ic_mean"), F.stddev_pop("ic").alias("sd"), F.count(F.lit(1)).alias("k")).filter("k >= 5 and sd > 1e-10")
    return m.select("factor", "eval_date", "ic_mean", (F.col("ic_mean") / F.col("sd")).alias("ir"))


@query(f"{METRICS} select factor, eval_date, {r6('ic_mean', 'ir', 'tw_ic', 'tw_ir', 'slope', 'volatility')}, round(decay_score, 4) as decay_score, status, n from mx")
def factor_quality(spark, sf_dir):
    """Quality of each factor as of every evaluation date."""
    q = LB.quality(metrics(spark, sf_dir))
    return rounded(q.drop("abs_slope", "decay_score")).join(q.select("factor", "eval_date", F.round("decay_score", 4).alias("decay_score")), ["factor", "eval_date"])


@query(f"""{METRICS}, cs as (select *, case when n >= 3 then (0.6 * abs(tw_ic) + 0.4 * abs(ic_mean)) * case when decay_score < -0.2 then 0.7 else 1 end else abs(ic_mean) end as score, case when factor in ('mom_5', 'mom_20') then 'momentum' when factor = 'vr_20' then 'volume' else 'other' end as family from mx where abs(ic_mean) >= 0.015 and status not in ('decaying', 'retired')),
ck as (select * from (select *, row_number() over (partition by eval_date, family order by score desc, factor) as k1 from cs) where k1 <= 1), ct as (select *, row_number() over (partition by eval_date order by score desc, factor) as place from ck)
select eval_date, factor, round(score, 6) as score, case when ic_mean > 0 then 1 else -1 end as direction, family, place from ct where place <= 2""")
def library_select(spark, sf_dir):
    """Factors chosen at each evaluation by blended quality with a family cap."""
    families = spark.createDataFrame([("mom_5", "momentum"), ("mom_20", "momentum"), ("vr_20", "volume")], "factor string, family string")
    return rounded(LB.select(LB.quality(metrics(spark, sf_dir)), families, top=2, per_family=1))


@query(f"""{METRICS}, lt as (select factor, eval_date, ic_mean, slope, decay_score from (select *, row_number() over (partition by factor order by eval_date desc) as r from mx) where r = 1), rc as (select factor, list(ic_mean order by eval_date) as ics from mx group by 1),
rg as (select factor, case factor when 'mom_5' then 'candidate' when 'mom_20' then 'active' when 'vol_20' then 'decaying' when 'pos_20' then 'retired' else 'active' end as before, case when factor = 'pos_20' then date '1999-01-01' end as retired_at from lt),
st as (select rg.factor, before, eval_date, rg.retired_at, case when before = 'candidate' and len(ics) >= 3 and list_min(ics[-3:]) > 0.02 and slope >= -0.001 then 'active' when before = 'active' and decay_score < -0.3 then 'decaying' when before = 'active' and ic_mean < 0 and len(ics) >= 4 and list_max(ics[-4:]) < 0 then 'retired'
  when before = 'decaying' and decay_score > 0.1 and ic_mean > 0.02 then 'active' when before = 'decaying' and ic_mean < 0 and len(ics) >= 4 and list_max(ics[-4:]) < 0 then 'retired' when before = 'retired' and eval_date - retired_at > 180 and ic_mean > 0.02 then 'candidate' else before end as status from rg join lt using (factor) join rc using (factor))
select factor, before, status, case when status = 'retired' and before <> 'retired' then eval_date else retired_at end as retired_at from st""")
def factor_lifecycle(spark, sf_dir):
    """One step of the library's states on the latest evaluation."""
    q = LB.quality(metrics(spark, sf_dir))
    latest = q.withColumn("r", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("eval_date")))).filter("r = 1").select("factor", "eval_date", "ic_mean", "slope", "decay_score")
    recent = q.groupBy("factor").agg(F.transform(F.array_sort(F.collect_list(F.struct("eval_date", "ic_mean"))), lambda x: x["ic_mean"]).alias("ics"))
    known = F.when(F.col("factor") == "mom_5", "candidate").when(F.col("factor") == "mom_20", "active").when(F.col("factor") == "vol_20", "decaying").when(F.col("factor") == "pos_20", "retired").otherwise("active")
    registry = latest.select("factor", known.alias("status"), F.when(F.col("factor") == "pos_20", F.lit("1999-01-01").cast("date")).alias("retired_at"))
    return LB.lifecycle(registry, latest, recent)


GREEDY = f"""{P}, ic as {ic_sql()}, su as (select factor, avg(ic) / stddev_pop(ic) * abs(sum(sign(round(ic, 9)))) / count(*) as cir from ic group by 1), rk as (select * from (select *, row_number() over (order by cir desc, factor) as place from su where cir > 0) where place <= 3),
st as (select k, factor, cir as weight from rk, range(1, 4) t(k) where place <= k and k <= (select count(*) from rk)), nd as (select k, count(*) as need, list(factor order by factor) as factors from st group by 1),
sx as (select k, entity, date, target, sum(weight * value) / sum(weight) as value, count(*) as have from l join st using (factor) group by 1, 2, 3, 4), sy as (select sx.* from sx join nd using (k) where have = need)"""


@query(f"""{GREEDY}, ci as {ic_sql('k, date', 10, 'sy')}, cz as (select k, avg(ic) as m, avg(ic) / stddev_pop(ic) * abs(sum(sign(round(ic, 9)))) / count(*) as combined_ir from ci group by 1) select k::int as k, round(m, 6) as combined_ic, round(combined_ir, 6) as combined_ir, array_to_string(factors, ',') as factors from (select *, row_number() over (order by round(m, 12) desc, k) as r from cz) join nd using (k) where r = 1""")
def prefix_greedy(spark, sf_dir):
    """The prefix of the best factors whose weighted sum has the best IC."""
    long = stored(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"), "long")
    out = LB.prefix_greedy(long, IC.summarize(IC.rank_ic(long)))
    return rounded(out.withColumn("factors", F.array_join("factors", ",")))


@query(f"""{WALK_SQL}, od2 as (select date, row_number() over (order by date) as o from (select distinct date from p)), ss as (select date, list(factor order by factor) as fs from wf where date in (select date from od2 where o % 20 = 0) group by 1)
select od2.date, (select max(ss.date) from ss where ss.date < od2.date) as chosen_on, (select array_to_string(s2.fs, ',') from ss s2 where s2.date = (select max(ss.date) from ss where ss.date < od2.date)) as factors from od2""")
def selected_as_of(spark, sf_dir):
    """On each date, the set chosen at the latest earlier rebalance."""
    days = factor_panel(spark, sf_dir).select("date").distinct()
    every = days.withColumn("o", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date"))).filter("o % 20 = 0").select("date")
    out = LB.selected_as_of(days, walk(spark, sf_dir).join(every, "date", "left_semi"))
    return out.select("date", "chosen_on", F.array_join("factors", ",").alias("factors"))


@query(f"""{P}, ic as {ic_sql()}, dy as (select date, ntile(5) over (order by date) as span from (select distinct date from ic)), sp as (select factor, span, avg(ic) as m from ic join dy using (date) group by 1, 2), s as (select factor, avg(m) as mean, stddev_samp(m) as sd from sp group by 1)
select factor, {r6('mean', 'sd')}, round(abs(mean) / sd, 6) as ratio, coalesce(abs(mean) / sd >= 0.2, false) as stable from s""")
def feature_stability(spark, sf_dir):
    return rounded(LB.stability(IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))))


@query(f"""{P}, ic as {ic_sql()}, bs as (select factor, avg(ic) as base_ic from ic where date < date '1999-01-01' group by 1), nw as (select factor, avg(ic) as ic from ic where date >= date '1999-01-01' group by 1), j as (select factor, base_ic, ic, (abs(ic) - abs(base_ic)) / abs(base_ic) as change from bs join nw using (factor))
select factor, {r6('base_ic', 'ic', 'change')}, case when ic * base_ic < 0 then 'flipped' else 'weaker' end as kind from j where ic * base_ic < 0 or change < -0.2""")
def decay_alerts(spark, sf_dir):
    """Factors whose IC since 1999 flipped or fell by a fifth."""
    ic = IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))
    mean = lambda df: df.groupBy("factor").agg(F.avg("ic").alias("ic"))
    return rounded(LB.decay_alerts(mean(ic.filter("date >= '1999-01-01'")), mean(ic.filter("date < '1999-01-01'")), ["factor"]))


@query(f"""{P}, w as (select *, count(*) over (partition by date) as n from p where {' and '.join(f'{f} is not null' for f in FACTORS)}) select entity, date, {', '.join(f"round((rank() over (partition by date order by {f}) + (count(*) over (partition by date, {f}) - 1) / 2.0)::double / n, 6) as {f}_rank" for f in FACTORS)} from w where n >= 5""")
def complete_case_ranks(spark, sf_dir):
    return rounded(LB.complete_ranks(factor_panel(spark, sf_dir), FACTORS))


@query("""with c as (select distinct substr(p_brand, 7, 1) as chain, p_type as concept from part) select a.concept, array_to_string(list_sort(list(distinct b.concept)), ',') as others from c a join c b on a.chain = b.chain and a.concept <> b.concept group by 1""")
def same_chain_concepts(spark, sf_dir):
    from panelyte.sources.panels import table

    c = table(spark, sf_dir, "part").select(F.substring("p_brand", 7, 1).alias("chain"), F.col("p_type").alias("concept"))
    return RP.same_chain(c).select("concept", F.array_join("others", ",").alias("others"))


@query(f"""{DIAG} select entity, date, round(least(greatest(case when trend_type = -2 then 0.3 * t + 0.2 * r + 0.5 * d else 0.4 * t + 0.3 * r + 0.3 * d end, 0), 1.5), 6) as multiplier, case when fv is null then 0 when fv > 0.1 then 1 when fv < -0.1 then -1 else 0 end as vote from (select *,
 case when buy_point >= 2 then least(1, 0.5 + 0.25 * lv + case when trend_type = 2 then 0.15 else 0 end) when buy_point = 1 and lv >= 1 then 0.7 else 0.5 end as t, case when ex <= 0.3 then 0.6 + 0.4 * (1 - ex / 0.3) when buy_point = 1 then 0.6 else 0.3 end as r, case when sell_point >= 2 or ex > 0.4 then 0.3 when sell_point = 1 then 0.5 when trend_type = -2 then 0.4 else 1 end as d
 from (select *, case when confirmed_buy then 1 else 0 end as lv, abs(1 - alignment) as ex, (tanh(mom_20) - vol_20 + tanh(vr_20 - 1)) / 3 as fv from dg where vol_20 is not null))""")
def strategy_blend(spark, sf_dir):
    """Multiplier of the three sub-strategies and the vote of three directed factors."""
    from panelyte.operators import regime as RG
    from panelyte.operators import signals as SG

    c = F.col
    d = diagnosed(spark, sf_dir).filter("vol_20 is not null")
    m = RG.blend(F.when(c("confirmed_buy"), 1).otherwise(0), c("buy_point"), c("sell_point"), c("trend_type"), F.abs(1 - c("alignment")), F.when(c("trend_type") == -2, -1).otherwise(0))
    return rounded(d.select("entity", "date", m.alias("multiplier"), SG.vote([F.tanh("mom_20"), -c("vol_20"), F.tanh(c("vr_20") - 1)]).alias("vote")))


_T = "(abs(t) / sqrt(2.0))"
_K = f"(1 / (1 + 0.3275911 * {_T}))"
_ERF = f"(1 - {_K} * (0.254829592 + {_K} * (-0.284496736 + {_K} * (1.421413741 + {_K} * (-1.453152027 + {_K} * 1.061405429)))) * exp(-{_T} * {_T}))"


@query(f"""{P}, ic as {ic_sql()}, s as (select factor, count(*) as n_dates, avg(ic) as ic_mean, avg(ic) / stddev_pop(ic) as ir, abs(sum(sign(round(ic, 9)))) / count(*) as stability, avg(case when round(ic, 9) > 0 then 1.0 else 0.0 end)::double as hit_rate from ic group by 1),
qt as (select *, ir * sqrt(n_dates) as t from s), qp as (select *, 1 - 0.5 * (1 + {_ERF}) as p from qt)
select factor, {r6('ic_mean', 'ir', 'stability', 'hit_rate', 'p')} from qp where abs(ic_mean) > 0.001 and abs(ir) > 0.001 and p < 0.45 and greatest(hit_rate, 1 - hit_rate) >= 0.5 and stability >= 0.01 and n_dates >= 10""")
def quality_filter(spark, sf_dir):
    """Factors whose ICs pass the chain of conditions, with the one-sided p value of |t|."""
    s = IC.summarize(IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target")))
    kept = IC.passes(s, 0.001, 0.001, 0.45, 0.5, 0.01, 10)
    return rounded(kept.select("factor", "ic_mean", "ir", "stability", "hit_rate", "p"))
