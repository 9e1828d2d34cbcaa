"""Queries over regimes, groups, sentiment, selection and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import entity_code, percent
from panelyte.operators import clean as C
from panelyte.operators import evaluate as EV
from panelyte.operators import groups as G
from panelyte.operators import select as S
from panelyte.operators.flows import multiplier
from panelyte.plans.kernels import panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import REGIME_SQL, factor_panel, panel_sql, r6, regimes
from panelyte.sources.panels import bars, market, membership, table
from panelyte.sources.store import stored

B, P = bars_sql(), panel_sql()
LAGS = ", ".join(f"close / lag(close, {n}) over e - 1 as m{n}" for n in (5, 10, 20))


def ranked_scores(spark, sf_dir):
    return factor_panel(spark, sf_dir).filter("mom_20 is not null and vol_20 is not null").withColumn("score", F.col("mom_20") - F.col("vol_20"))


SCORES = f"{P}, sc as (select *, mom_20 - vol_20 as score from p where mom_20 is not null and vol_20 is not null), tn as (select * from (select *, row_number() over (partition by date order by score desc, entity) as place from sc) where place <= 5)"
WEIGHTS = f"""{SCORES}, w0 as (select *, 1 - 0.5 * (place - 1) / greatest(count(*) over (partition by date) - 1, 1) as raw, count(*) over (partition by date) as n from tn),
w1 as (select *, least(raw / sum(raw) over (partition by date), least(0.22 * (1 + greatest(0, (6 - n) / 6.0) * 1.5), 0.33))::double as w from w0),
wt as (select entity, grp, date, close, target, place, case when sum(w) over (partition by date, grp) > 0.5 then w * 0.5 / sum(w) over (partition by date, grp) else w end as weight from w1)"""


def weights(spark, sf_dir):
    return S.rank_weights(S.top_n(ranked_scores(spark, sf_dir), 5), 0.5, 0.22, 0.5, positions=6)


@query(f"{WEIGHTS} select entity, date, place, round(weight, 6) as weight from wt")
def topn_capped_weights(spark, sf_dir):
    return rounded(weights(spark, sf_dir).select("entity", "date", "place", "weight"))


@query(f"{SCORES}, iv as (select *, 1 / vol_20 as i from tn) select entity, date, round(i / sum(i) over (partition by date), 6) as weight from iv")
def risk_parity_weights(spark, sf_dir):
    return rounded(S.risk_parity(S.top_n(ranked_scores(spark, sf_dir), 5), "vol_20").select("entity", "date", "weight"))


@query(f"""{SCORES}, md as (select date, grp, quantile_cont(score, 0.5) as median, count(*) as members from sc group by 1, 2 having count(*) >= 2),
bg as (select *, row_number() over (partition by date order by median desc, grp) as gplace from md) select date, entity, grp, round(score, 6) as score, gplace from sc join bg using (date, grp) where gplace <= 2""")
def focus_groups(spark, sf_dir):
    return rounded(S.focus_groups(ranked_scores(spark, sf_dir), 2, 2).select("date", "entity", "grp", "score", "gplace"))


ORDERS = f"""{WEIGHTS}, la as (select max(date) as d from wt), ds as (select date, row_number() over (order by date desc) as k from (select distinct date from wt)),
t as (select entity, weight from wt where date = (select date from ds where k = 1)), c as (select entity, (floor(weight * 1e7 / close / 100) * 100)::bigint as qty from wt where date = (select date from ds where k = 2)),
pr as (select entity, last(close order by date) as price from b group by 1), o as (select coalesce(t.entity, c.entity) as entity, coalesce(qty, 0) as have, weight from t full join c on t.entity = c.entity),
x as (select o.entity, have, (floor(coalesce(weight, 0) * 1e7 / price / 100) * 100)::bigint as want from o join pr on pr.entity = o.entity)"""


def _orders(spark, sf_dir):
    w = weights(spark, sf_dir)
    days = w.select("date").distinct().orderBy(F.desc("date")).limit(2).withColumn("k", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("date"))))  # two dates
    w = stored(w, "weights").join(F.broadcast(days), "date")
    current = w.filter("k = 2").select("entity", (F.floor(F.col("weight") * 1e7 / F.col("close") / 100) * 100).alias("qty"))
    prices = bars(spark, sf_dir).groupBy("entity").agg(F.max_by("close", "date").alias("price"))
    return S.order_diff(w.filter("k = 1"), current, prices, 1e7), prices


@query(f"""{ORDERS}
select entity, have, want, want - have as delta, case when want > have then 'buy' when want < have then 'sell' else 'hold' end as side from x""")
def order_diff(spark, sf_dir):
    return _orders(spark, sf_dir)[0]


@query(f"""{ORDERS}, fl as (select x.*, want - have as delta, pr.price, -(want - have) * pr.price as flow from x join pr on pr.entity = x.entity),
ca as (select *, 2e6 + sum(flow) over (order by case when flow >= 0 then 0 else 1 end, flow, entity rows between unbounded preceding and current row) as cash_after from fl)
select entity, have, want, delta, case when have = 0 and want > 0 then 'enter' when have > 0 and want = 0 then 'exit' when want > have then 'raise' when want < have then 'cut' else 'keep' end as reason, round(flow, 2) as flow, round(cash_after, 2) as cash_after, flow >= 0 or cash_after >= 0 as funded from ca""")
def order_plan(spark, sf_dir):
    """Orders with their reasons, what they bring or cost, and which the cash pays for."""
    orders, prices = _orders(spark, sf_dir)
    return rounded(S.order_plan(orders, prices, 2e6).select("entity", "have", "want", "delta", "reason", "flow", "cash_after", "funded"), 2)


@query(f"""{WEIGHTS}, pr as (select date, sum(weight * target) / 5 as ret from wt where target is not null group by 1), y as (select year(date) as year, date, ret from pr),
n as (select *, exp(sum(ln(1 + ret)) over (partition by year order by date)) as nav from y), f as (select *, nav / greatest(max(nav) over (partition by year order by date), 1.0) - 1 as fall from n),
a as (select year, count(*) as n, exp(sum(ln(1 + ret))) - 1 as total, avg(ret) as m, stddev_samp(ret) as sd, min(fall) as mdd from f group by 1)
select year, n, round(total, 6) as total, round(pow(1 + total, 52.0 / n) - 1, 6) as annual, round(sd * sqrt(52.0), 6) as volatility, round(m / sd * sqrt(52.0), 6) as sharpe, round(mdd, 6) as max_drawdown,
 case when mdd <> 0 then round((pow(1 + total, 52.0 / n) - 1) / -mdd, 6) end as calmar from a""")
def perf_yearly(spark, sf_dir):
    """Performance by year of weights held for five bars, a fifth of the capital for each start."""
    r = weights(spark, sf_dir).filter("target is not null").groupBy("date").agg((F.sum(F.col("weight") * F.col("target")) / 5).alias("ret")).withColumn("year", F.year("date"))
    return rounded(EV.performance(r, ["year"]))


@query(f"""{B}, q as (select entity, quantile_cont(ret, 0.05) as var_95, quantile_cont(ret, 0.01) as var_99 from b where ret is not null group by 1)
select entity, {r6('var_95', 'var_99')}, round(avg(ret) filter (ret <= var_95), 6) as cvar_95, round(avg(ret) filter (ret <= var_99), 6) as cvar_99 from b join q using (entity) where ret is not null group by entity, var_95, var_99""")
def var_cvar(spark, sf_dir):
    return rounded(EV.tail_risk(panel(spark, sf_dir).filter("ret is not null"), ["entity"]).drop("skew"))


@query(f"{WEIGHTS} select date, count(*) as names, round(sum(weight * weight), 6) as hhi, round(sum(weight) filter (k <= 3), 6) as top3 from (select *, row_number() over (partition by date order by weight desc, entity) as k from wt) group by 1")
def concentration(spark, sf_dir):
    return rounded(EV.concentration(weights(spark, sf_dir)))


@query(f"""{WEIGHTS}, dd as (select date, lag(date) over (order by date) as before from (select distinct date from wt)), n as (select date, entity, weight as w from wt join dd using (date) where before is not null),
t as (select dd.date, entity, weight as v from dd join wt on wt.date = dd.before), m as (select coalesce(n.date, t.date) as date, w, v from n full join t on n.date = t.date and n.entity = t.entity)
select date, round(sum(abs(coalesce(w, 0) - coalesce(v, 0))) / 2, 6) as turnover, count(*) filter (v is null) as entries, count(*) filter (w is null) as exits, round(sum(abs(coalesce(w, 0) - coalesce(v, 0))) / 2 * 0.001, 8) as cost from m group by 1""")
def turnover_cost(spark, sf_dir):
    t = EV.turnover(weights(spark, sf_dir))
    return t.select("date", F.round("turnover", 6).alias("turnover"), "entries", "exits", F.round("cost", 8).alias("cost"))


@query(f"""{P}, {REGIME_SQL}, x as (select p.*, regime, coalesce(mom_20 > 0, false) as sig from p join rg using (date) where target is not null)
select regime, count(*) filter (sig) as signals, round(avg(case when target > 0 then 1.0 else 0.0 end) filter (sig), 6)::double as hit_rate, round(avg(target) filter (sig), 6) as mean_return, round(quantile_cont(target, 0.5) filter (sig), 6) as median_return,
 round(avg(target) filter (sig) - avg(target), 6) as excess, round(avg(target) filter (sig) / (stddev_samp(target) filter (sig) / sqrt(count(*) filter (sig))), 6) as t from x group by 1""")
def regime_quality(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    return rounded(EV.outcome(p.join(regimes(p), "date"), ["regime"], F.coalesce(F.col("mom_20") > 0, F.lit(False))))


@query(f"""{P}, {REGIME_SQL} select year(date) as year, count(*) filter (regime = 'bull') as bull, count(*) filter (regime = 'bear') as bear from rg group by 1""")
def regime_yearly(spark, sf_dir):
    r = regimes(factor_panel(spark, sf_dir))
    return r.groupBy(F.year("date").alias("year")).agg(F.count_if(F.col("regime") == "bull").alias("bull"), F.count_if(F.col("regime") == "bear").alias("bear"))


ROT = f"""{B}, mm as (select *, {LAGS} from b window e as (partition by entity order by date)), md as (select date, grp, quantile_cont(m5, 0.5) as a, quantile_cont(m10, 0.5) as c, quantile_cont(m20, 0.5) as d from mm group by 1, 2),
ro as (select date, grp, 0.40::double * a + 0.35::double * c + 0.25::double * d as momentum from md), rp as (select *, row_number() over (partition by date order by momentum desc, grp) as place from ro where momentum is not null)"""


def rotation_of(spark, sf_dir):
    c = F.col("close")
    return G.rotation(panel(spark, sf_dir).select("entity", "grp", "date", *[W.change(c, n).alias(f"m{n}") for n in (5, 10, 20)]), ["m5", "m10", "m20"])


@query(f"{ROT} select date, grp, round(momentum, 6) as momentum, place from rp")
def sector_rotation(spark, sf_dir):
    return rounded(rotation_of(spark, sf_dir))


@query(f"""{ROT}, t as (select date, list(grp) as now from rp where place <= 3 group by 1), l as (select *, lag(now) over (order by date) as before from t) select date, len(list_filter(now, lambda x: not list_contains(before, x)))::int as changed from l where before is not null""")
def rotation_speed(spark, sf_dir):
    return G.rank_speed(rotation_of(spark, sf_dir))


@query(f"""{B}, br as (select date, count(ret) as n, count(*) filter (ret > 0) as up, count(*) filter (ret < 0) as down, count(*) filter (ret >= 0.5) as surges from b group by 1)
select *, round(up / nullif(n, 0), 6) as up_share, case when up / nullif(n, 0) >= 0.7 then 'hot' when up / nullif(n, 0) >= 0.5 then 'warm' when up / nullif(n, 0) >= 0.3 then 'cool' else 'cold' end as state from br""")
def breadth_daily(spark, sf_dir):
    return rounded(G.breadth(panel(spark, sf_dir)))


LL = f"""{B}, rr as (select grp as concept, date, avg(ret) as ret from b where ret is not null group by 1, 2), od as (select *, dense_rank() over (order by date) as o from rr),
c as (select x.concept as leader, y.concept as follower, g.lag as lag, covar_pop(x.ret, y.ret) / (stddev_pop(x.ret) * stddev_pop(y.ret)) as corr, count(*) as n from od x cross join (select unnest([0, 1, 2, 3]) as lag) g join od y on y.o = x.o + g.lag and x.concept <> y.concept group by 1, 2, 3),
k as (select *, max(case when lag = 0 then corr end) over (partition by leader, follower) as now, row_number() over (partition by leader, follower order by corr desc, lag) as k from c where n >= 20)"""


@query(f"{LL} select leader, follower, lag, round(corr, 6) as corr, round(least(greatest((corr + 0.2) * 2.5, 0.05), 0.30), 6) as strength from k where k = 1 and lag > 0 and now >= -0.2 and corr > now + 0.05 and corr > -0.2 order by least(greatest((corr + 0.2) * 2.5, 0.05), 0.30) desc, leader, follower limit 20")
def lead_lag_edges(spark, sf_dir):
    """Edges between groups; the floor is low, as weekly returns of these groups hardly correlate."""
    r = panel(spark, sf_dir).filter("ret is not null").groupBy(F.col("grp").alias("concept"), "date").agg(F.avg("ret").alias("ret"))
    return rounded(G.lead_lag(stored(r, "returns"), 3, floor=-0.2))


_CHAIN = f"""{B}, cr as (select 'chain' as chain, cast(grp as int) as seg_ord, grp as segment, entity as concept, date, ret from b where ret is not null),
cv as (select *, greatest(case when count(*) over c > 2 then stddev_pop(ret) over c else case when count(*) over d > 3 then stddev_pop(ret) over d else 0.02 end end, 0.008) as vol from cr window c as (partition by chain, date), d as (partition by date)),
sm as (select chain, date, seg_ord, segment, avg(ret) as ret, max(vol) as vol from cv group by 1, 2, 3, 4),
cx as (select s.chain, s.date, s.segment, (a.ret - s.ret) / s.vol as z, a.seg_ord - s.seg_ord as step from sm s join sm a on a.chain = s.chain and a.date = s.date and a.seg_ord <> s.seg_ord),
cb as (select chain, date, segment, max(case when step = -1 and z > 1.5 then least(z * 0.10, 0.30) when step < -1 and z > 2.2 then least(z * 0.06, 0.18) when step > 0 and z > 2.5 then least(z * 0.06, 0.25) else 0 end) as bonus from cx group by 1, 2, 3)"""


def chain_members(p):
    return p.select(F.lit("chain").alias("chain"), F.col("grp").cast("int").alias("seg_ord"), F.col("grp").alias("segment"), F.col("entity").alias("concept"), "date", "ret")


@query(f"{_CHAIN} select date, segment, round(bonus, 6) as bonus from cb")
def chain_conduction(spark, sf_dir):
    return rounded(G.conduction(chain_members(panel(spark, sf_dir).filter("ret is not null"))).select("date", "segment", "bonus"))


_DECAY = 0.5 ** (1 / 3)


@query(f"""{_CHAIN}, mem as (select distinct p_brand as entity, p_type as concept from part), rr as (select concept, date, avg(ret) as ret from b join mem using (entity) where ret is not null group by 1, 2),
hw as (select concept, date, list_reduce(list(ret) over (partition by concept order by date), lambda a, v: a * {_DECAY!r} + v * {1 - _DECAY!r}) as warm from rr), hh as (select entity, date, avg(tanh(5 * greatest(warm, 0))) as heat from hw join mem using (concept) group by 1, 2),
z as (select hh.entity, hh.date, least(greatest(0.7 * least(greatest(heat, 0), 1) + 0.3 * tanh(1.5 * coalesce(bonus, 0)), 0), 1) as heat from hh left join (select distinct entity, grp from b) g on g.entity = hh.entity left join cb on cb.segment = g.grp and cb.date = hh.date)
select entity, date, round(heat, 6) as heat from z""")
def concept_heat(spark, sf_dir):
    """Heat of an entity's concepts with the lead of earlier chain segments, on the dates with concept returns."""
    p = stored(panel(spark, sf_dir).filter("ret is not null").select("entity", "grp", "date", "ret"), "returns")
    members = membership(spark, sf_dir)
    signals = G.conduction(chain_members(p)).select("segment", "date", "bonus")
    leads = p.select("entity", F.col("grp").alias("segment")).distinct().join(signals, "segment").select("entity", "date", "bonus")
    return rounded(G.concept_heat(G.concept_returns(p, members), members, leads))


@query("""with s as (select d.lang as industry, case when l.quality = 1 and coalesce(l.toxic, 0) = 0 then 1 when l.toxic = 1 then -1 else 0 end as sign, least(d.n_chars, 2000) / 2000.0::double * case when l.quality is null then 0.5::double else 1.0::double end as w from documents d join labels l using (doc_id)),
a as (select industry, count(*) as news, coalesce(sum(sign * w) / nullif(sum(w), 0), 0) as score from s group by 1)
select industry, news, round(score, 6) as score, round(least(greatest(1 + (case when score > 0 then 0.2 else 1 - 0.8 end) * score, 0.8), 1.2), 6) as multiplier from a""")
def sentiment_industry(spark, sf_dir):
    """Signed score of a group's texts weighted by importance and confidence, and the multiplier it gives."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    sign = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).when(F.col("toxic") == 1, -1).otherwise(0)
    w = F.least("n_chars", F.lit(2000)) / 2000.0 * F.when(F.col("quality").isNull(), 0.5).otherwise(1.0)
    s = d.groupBy(F.col("lang").alias("industry")).agg(F.count(F.lit(1)).alias("news"), F.coalesce(F.try_divide(F.sum(sign * w), F.sum(w)), F.lit(0.0)).alias("score"))
    return rounded(s.withColumn("multiplier", multiplier(F.col("score"), F.lit(0))))


@query("""select doc_id, h from (select doc_id, md5(substr(text, 1, 80)) as h, row_number() over (partition by md5(substr(text, 1, 80)) order by doc_id) as k from documents) where k = 1""")
def news_dedup(spark, sf_dir):
    """First text of each 80-character opening; the least id is found before any shuffle of texts."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.substring("text", 1, 80)).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", "h")


SIGNALS = f"{P}, sg as (select *, coalesce(mom_5 > 0 and pos_20 > 0.6, false) as buy, coalesce(mom_5 < 0 and pos_20 < 0.4, false) as sell from p)"


def signals(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    return p.withColumn("buy", F.coalesce((F.col("mom_5") > 0) & (F.col("pos_20") > 0.6), F.lit(False))).withColumn("sell", F.coalesce((F.col("mom_5") < 0) & (F.col("pos_20") < 0.4), F.lit(False)))


@query(f"""{SIGNALS}, n as (select entity, date, close, buy, min(case when sell then ord end) over (partition by entity order by ord rows between 1 following and unbounded following) as so from sg)
select n.entity, n.date as bought, s.date as sold, round(s.close / n.close - 1, 6) as ret from n join sg s on s.entity = n.entity and s.ord = n.so where n.buy""")
def trade_roundtrips(spark, sf_dir):
    return rounded(EV.round_trips(signals(spark, sf_dir)))


@query(f"""{SIGNALS}, g as (select t.cut, count(*) filter (mom_20 > t.cut) as signals, avg(target) filter (mom_20 > t.cut) as mean_return from sg, (select unnest([-0.2, 0.0, 0.2, 0.5, 1.0]) as cut) t where target is not null group by 1) select cut::double as cut, signals, round(mean_return, 6) as mean_return from g""")
def param_scan(spark, sf_dir):
    """Each threshold of a grid over the stored signals, in one aggregation."""
    cuts = F.explode(F.array(*[F.lit(c) for c in (-0.2, 0.0, 0.2, 0.5, 1.0)]))
    s = signals(spark, sf_dir).filter("target is not null").select("*", cuts.alias("cut"))
    hit = F.col("mom_20") > F.col("cut")
    return rounded(s.groupBy("cut").agg(F.count_if(hit).alias("signals"), F.avg(F.when(hit, F.col("target"))).alias("mean_return")))


@query(f"""{P}, q as (select quantile_cont(target, 0.9) as hi, quantile_cont(target, 0.1) as lo from p), x as (select p.*, case when target >= hi then 'win' when target <= lo then 'loss' end as side from p, q where target is not null and mom_20 is not null)
select round(avg(mom_20) filter (side = 'win'), 6) as win_mean, round(avg(mom_20) filter (side = 'loss'), 6) as loss_mean, round((avg(mom_20) filter (side = 'win') - avg(mom_20) filter (side = 'loss')) / stddev_samp(mom_20), 6) as effect, count(*) filter (side = 'win') as wins, count(*) filter (side = 'loss') as losses, (select round(max(abs(fa - fb)), 6) from (select sum((side = 'win')::int) over o / sum((side = 'win')::int) over () as fa, sum((side = 'loss')::int) over o / sum((side = 'loss')::int) over () as fb from x where side is not null window o as (order by mom_20 range between unbounded preceding and current row))) as ks from x""")
def winner_loser(spark, sf_dir):
    p = stored(factor_panel(spark, sf_dir).select("target", "mom_20"), "winners")
    q = p.agg(F.percentile("target", 0.9).alias("hi"), F.percentile("target", 0.1).alias("lo"))
    x = p.filter("target is not null and mom_20 is not null").crossJoin(F.broadcast(q))  # q is one row
    win, loss = F.col("target") >= F.col("hi"), F.col("target") <= F.col("lo")
    a, b = F.avg(F.when(win, F.col("mom_20"))), F.avg(F.when(loss, F.col("mom_20")))
    ks = EV.ks_distance(x.filter(win | loss), "mom_20", win)  # one row, as the other
    return rounded(x.agg(a.alias("win_mean"), b.alias("loss_mean"), ((a - b) / F.stddev_samp("mom_20")).alias("effect"), F.count_if(win).alias("wins"), F.count_if(loss).alias("losses")).crossJoin(F.broadcast(ks)))


@query(f"""{P}, {REGIME_SQL} select regime, grp, year(date) as year, grouping_id(regime, grp, year(date)) as level, count(*) as n, round(avg(target), 6) as mean_return from p join rg using (date) where target is not null group by cube (regime, grp, year(date))""")
def return_cube(spark, sf_dir):
    p = factor_panel(spark, sf_dir)
    x = p.join(regimes(p), "date").filter("target is not null").withColumn("year", F.year("date"))
    return rounded(x.cube("regime", "grp", "year").agg(F.grouping_id("regime", "grp", "year").alias("level"), F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_return")))


@query(f"""{B} select entity, count(*) as rows, min(date) as first_date, max(date) as last_date, count(*) filter (high < low or open not between low and high or close not between low and high) as bad_bars, count(*) filter (open is null) as null_open, count(*) filter (high is null) as null_high, count(*) filter (low is null) as null_low, count(*) filter (close is null) as null_close from bars group by 1""")
def bar_quality(spark, sf_dir):
    return C.quality_report(bars(spark, sf_dir))


@query(f"""{B}, q as (select entity, quantile_cont(close, 0.01) as lo, quantile_cont(close, 0.99) as hi, quantile_cont(volume, 0.99) as cap from bars group by 1) select entity, date, close, round(least(volume, cap), 6) as volume from bars join q using (entity) where close between lo and hi and open > 0""")
def trimmed_bars(spark, sf_dir):
    b = C.winsorize_volume(C.valid_bars(bars(spark, sf_dir)), 0.99)
    return C.trim_quantiles(b, ["close"], 0.01, 0.99).select("entity", "date", "close", F.round("volume", 6).alias("volume"))


@query(f"""{B}, ol as (select entity, date, close from bars where date < date '2001-06-01'), nw as (select entity, date, case when entity = 'Brand#1' then close * 1.1 else close end as close from bars where date >= date '2001-05-01'),
r as (select ol.entity, abs(ol.close - nw.close) as d, row_number() over (partition by ol.entity order by ol.date desc) as k from ol join nw using (entity, date)) select entity, max(d) > 0.01 as reload from r where k <= 3 group by 1""")
def restatement_check(spark, sf_dir):
    b = bars(spark, sf_dir)
    new = b.filter("date >= '2001-05-01'").withColumn("close", F.when(F.col("entity") == "Brand#1", F.col("close") * 1.1).otherwise(F.col("close")))
    return C.restated(b.filter("date < '2001-06-01'"), new).select("entity", "reload")


@query("""select p_partkey, lpad(p_partkey::varchar, 6, '0') as code, p_size / 100.0::double as pct, case when contains(p_type, 'STEEL') then 'metal' when contains(p_type, 'BRASS') then 'metal' when contains(p_type, 'SMALL') then 'small' else 'other' end as category from part""")
def codes_and_categories(spark, sf_dir):
    """Entity codes, percent texts and keyword categories."""
    text = F.concat(F.col("p_size").cast("string"), F.lit("%"))
    return table(spark, sf_dir, "part").select("p_partkey", entity_code(F.col("p_partkey").cast("string")).alias("code"), percent(text).alias("pct"), G.keyword_category(F.col("p_type"), [("STEEL", "metal"), ("BRASS", "metal"), ("SMALL", "small")]).alias("category"))


@query("""select s_suppkey as entity, count(*) as fills, cast(sum(case when l_returnflag = 'R' then -1 else 1 end * cast(l_extendedprice as decimal(18,2))) as double) as net, count(distinct l_partkey) as parts, max(l_quantity) as largest, mode(l_linestatus) is not null as has_mode from lineitem join supplier on l_suppkey = s_suppkey group by 1""")
def fill_summary(spark, sf_dir):
    f = table(spark, sf_dir, "lineitem")
    signed = F.when(F.col("l_returnflag") == "R", -1).otherwise(1) * F.col("l_extendedprice").cast("decimal(18,2)")
    return f.groupBy(F.col("l_suppkey").alias("entity")).agg(F.count(F.lit(1)).alias("fills"), F.sum(signed).cast("double").alias("net"), F.count_distinct("l_partkey").alias("parts"), F.max("l_quantity").alias("largest"), F.mode("l_linestatus").isNotNull().alias("has_mode"))


@query("""select event_type as entity, date_trunc('hour', ts) as start, first(value order by ts, event_id) as open, max(value) as high, min(value) as low, last(value order by ts, event_id) as close, count(*) as n from events group by 1, 2""")
def event_bars(spark, sf_dir):
    from panelyte.streaming.bars import hourly

    return hourly(table(spark, sf_dir, "events")).select("entity", "start", "open", "high", "low", "close", "n")
