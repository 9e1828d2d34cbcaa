"""Queries over cross-sections, point-in-time joins, information coefficients and selections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import compress, steps
from panelyte.operators import ic as IC
from panelyte.operators import xsec as XS
from panelyte.operators.asof import asof, level_distances
from panelyte.plans.kernels import ex, inc, panel, rounded
from panelyte.plans.registry import STATEMENTS_SQL, bars_sql, query
from panelyte.sources.panels import bars, membership, statements
from panelyte.sources.store import stored

FACTORS = ["mom_5", "mom_20", "vol_20", "pos_20", "vr_20"]
FAMILIES = {"mom_5": "momentum", "mom_20": "momentum", "vol_20": "risk", "pos_20": "position", "vr_20": "volume"}


def factor_panel(spark, sf_dir, by="brand", every="week"):
    """Bars with the factors above and the 5-bar forward return."""
    p = panel(spark, sf_dir, by, every)
    c, v = F.col("close"), F.col("volume")
    lo, hi = W.lowest(c, 20), W.highest(c, 20)
    return p.select(
        "entity", "grp", "date", "ord", "close", "volume", "amount", "ret",
        W.change(c, 5).alias("mom_5"), W.change(c, 20).alias("mom_20"), W.std(F.col("ret"), 20).alias("vol_20"),
        ((c - lo) / (hi - lo + 1e-10)).alias("pos_20"), (v / W.sma(v, 20)).alias("vr_20"), W.ahead(c, 5).alias("target"),
    )


def panel_sql(by="brand", every="week") -> str:
    return f"""{bars_sql(by, every)}, p as (select entity, grp, date, ord, close, volume, amount, ret,
      close / lag(close, 5) over (partition by entity order by date) - 1 as mom_5, close / lag(close, 20) over (partition by entity order by date) - 1 as mom_20,
      case when count(ret) {ex(20)} = 20 then stddev_pop(ret) {ex(20)} end as vol_20,
      case when count(close) {ex(20)} = 20 then (close - min(close) {ex(20)}) / (max(close) {ex(20)} - min(close) {ex(20)} + 1e-10) end as pos_20,
      case when count(volume) {inc(20)} = 20 then volume / avg(volume) {inc(20)} end as vr_20,
      lead(close, 5) over (partition by entity order by date) / close - 1 as target from b),
    long as (unpivot (select entity, grp, date, target, {', '.join(FACTORS)} from p) on {', '.join(FACTORS)} into name factor value value),
    l as (select * from long where value is not null and target is not null)"""


def ranked_sql(keys: str, source: str = "l") -> str:
    rank = lambda c: f"rank() over (partition by {keys} order by {c}) + (count(*) over (partition by {keys}, {c}) - 1) / 2.0"
    return f"(select *, cast({rank('value')} as double) as rv, cast({rank('target')} as double) as rt from {source})"


def ic_sql(keys: str = "date, factor", least: int = 10, source: str = "l") -> str:
    return f"""(select * from (select {keys}, case when stddev_pop(rv) * stddev_pop(rt) > 1e-15 then covar_pop(rv, rt) / (stddev_pop(rv) * stddev_pop(rt)) end as ic, count(*) as n
      from {ranked_sql(keys, source)} group by {keys}) where n >= {least} and ic is not null)"""


SUMMARY = "count(*) as n_dates, avg(ic) as ic_mean, stddev_pop(ic) as ic_std, avg(ic) / stddev_pop(ic) as ir, abs(sum(sign(round(ic, 9)))) / count(*) as stability"
R6 = "round({0}, 6) as {0}"


def r6(*names: str) -> str:
    return ", ".join(R6.format(n) for n in names)


@query(f"""{panel_sql()}, ic as {ic_sql()}, s as (select factor, {SUMMARY}, avg(case when round(ic, 9) > 0 then 1.0 else 0.0 end) as hit_rate from ic group by 1)
select factor, n_dates, {r6('ic_mean', 'ic_std', 'ir', 'stability')}, round(ir * sqrt(n_dates), 6) as t, round(ir * stability, 6) as combined_ir, round(hit_rate::double, 6) as hit_rate from s""")
def ic_momentum_summary(spark, sf_dir):
    return rounded(IC.summarize(IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))))


@query(f"{panel_sql()} select date, factor, round(ic, 6) as ic, n from {ic_sql()}")
def ic_by_date(spark, sf_dir):
    return rounded(IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target")))


@query(f"""{panel_sql()}, ic as {ic_sql()}, a as (select *, row_number() over (partition by factor order by date desc) - 1 as age from ic)
select factor, round(sum(pow(0.9, age) * ic) / sum(pow(0.9, age)), 6) as ic_decayed from a group by 1""")
def ic_decay_weighted(spark, sf_dir):
    return rounded(IC.decayed(IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))))


REGIME_SQL = """mk as (select date, avg(close) as mc from bars group by 1), mo as (select *, row_number() over (order by date) as mord from mk),
    rg as (select date, case when mc > avg(mc) over (order by date rows between 20 preceding and 1 preceding) then 'bull' else 'bear' end as regime from mo)"""


def regimes(p):
    """(date, regime): market mean above or below its mean of the 20 dates before."""
    from panelyte.sources.panels import market

    before = F.avg("close").over(W.excl(20))
    return market(p).select("date", F.when(F.col("close") > before, "bull").otherwise("bear").alias("regime"))


@query(f"""{panel_sql()}, mem as (select distinct p_brand as entity, p_type as concept from part), {REGIME_SQL},
x as (select l.*, mem.concept, rg.regime from l join mem using (entity) join rg using (date)), ic as {ic_sql('concept, regime, date, factor', 8, 'x')}
select concept, regime, factor, count(*) as n_dates, round(avg(ic), 6) as ic_mean, round(abs(sum(sign(round(ic, 9)))) / count(*), 6) as stability from ic group by all having count(*) >= 10""")
def ic_group_regime(spark, sf_dir):
    """IC by concept (many to many), regime and factor."""
    p = stored(factor_panel(spark, sf_dir), "factors")
    long = IC.melt(p, FACTORS, "target").join(membership(spark, sf_dir), "entity").join(regimes(p), "date")
    ic = IC.rank_ic(long, ["concept", "regime", "date", "factor"], 8)
    return rounded(ic.groupBy("concept", "regime", "factor").agg(F.count(F.lit(1)).alias("n_dates"), F.avg("ic").alias("ic_mean"), (F.abs(F.sum(F.signum(F.round("ic", 9)))) / F.count(F.lit(1))).alias("stability")).filter("n_dates >= 10"))


@query(f"""{panel_sql()}, ic as {ic_sql()}, y as (select factor, year(date) as year, ic from ic)
select factor, year, count(*) as n, round(avg(ic), 6) as ic_mean, round(avg(ic) / stddev_pop(ic), 6) as ir from y group by 1, 2""")
def ic_by_year(spark, sf_dir):
    ic = IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))
    return rounded(ic.groupBy("factor", F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_mean"), (F.avg("ic") / F.stddev_pop("ic")).alias("ir")))


@query(f"""{panel_sql()}, ic as {ic_sql()}, h as (select *, ntile(2) over (partition by factor order by date) as half from ic),
d as (select factor, avg(ic) filter (half = 1) as first_half, avg(ic) filter (half = 2) as second_half from h group by 1)
select factor, {r6('first_half', 'second_half')}, second_half < first_half - 0.02 as decayed from d""")
def ic_halves(spark, sf_dir):
    ic = IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))
    halves = ic.withColumn("half", F.ntile(2).over(Window.partitionBy("factor").orderBy("date")))
    means = halves.groupBy("factor").agg(F.avg(F.when(F.col("half") == 1, F.col("ic"))).alias("first_half"), F.avg(F.when(F.col("half") == 2, F.col("ic"))).alias("second_half"))
    return rounded(means.withColumn("decayed", F.col("second_half") < F.col("first_half") - 0.02))


@query(f"""{panel_sql()}, dn as (select factor, date, count(*) as n from l group by 1, 2), dc as (select factor, date, least(floor(coalesce(sum(n) over (partition by factor order by date rows between unbounded preceding and 1 preceding), 0) * 10 / sum(n) over (partition by factor)) + 1, 10) as chunk from dn), c as (select l.*, chunk from l join dc using (factor, date)),
k as (select factor, chunk, covar_pop(value, target) / (stddev_pop(value) * stddev_pop(target)) as c from c group by 1, 2)
select factor, round(avg(c), 6) as ic_mean, round(avg(c) / stddev_pop(c), 6) as ir from k group by 1""")
def ic_chunks(spark, sf_dir):
    """Information ratio over ten consecutive chunks of dates with about equal row counts."""
    c = IC.chunked(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))
    return rounded(c.groupBy("factor").agg(F.avg("c").alias("ic_mean"), (F.avg("c") / F.stddev_pop("c")).alias("ir")))


@query(f"""{panel_sql()} select grp, factor, round(covar_pop(value, target) / (stddev_pop(value) * stddev_pop(target)), 6) as pearson, count(*) as n from l group by 1, 2 having count(*) >= 30""")
def pooled_ic_by_group(spark, sf_dir):
    return rounded(IC.pooled_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target", ["grp"]), ["grp", "factor"]))


@query(f"""{panel_sql()}, r as {ranked_sql('date, factor')}, q as (select *, rv / max(rv) over (partition by date, factor) as pr from r),
s as (select date, factor, avg(target) filter (pr >= 0.8) - avg(target) filter (pr <= 0.2) as spread from q group by 1, 2)
select factor, round(avg(spread), 6) as spread_mean, count(spread) as n_dates from s group by 1""")
def quantile_spread(spark, sf_dir):
    s = IC.spread(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))
    return rounded(s.groupBy("factor").agg(F.avg("spread").alias("spread_mean"), F.count("spread").alias("n_dates")))


@query(f"""{panel_sql()}, dd as (select date, dense_rank() over (order by date) as k from (select distinct date from l)), r as {ranked_sql('date, factor', '(select l.* from l join dd using (date) where (k - 1) % 5 = 0)')},
c as (select a.date, a.factor as f1, b.factor as f2, case when stddev_pop(a.rv) * stddev_pop(b.rv) > 1e-15 then covar_pop(a.rv, b.rv) / (stddev_pop(a.rv) * stddev_pop(b.rv)) end as c, count(*) as n
  from r a join r b on a.entity = b.entity and a.date = b.date and a.factor < b.factor group by 1, 2, 3)
select f1, f2, round(avg(c), 6) as corr, count(*) as n_dates from c where n >= 10 and c is not null group by 1, 2""")
def factor_corr_matrix(spark, sf_dir):
    return rounded(IC.factor_correlation(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target")))


WALK_SQL = f"""{panel_sql()}, ic as {ic_sql()}, od as (select date, row_number() over (order by date) as o from (select distinct date from p)), fs as (select distinct factor from ic),
g as (select fs.factor, od.date, od.o, ic.ic from fs cross join od left join ic on ic.factor = fs.factor and ic.date = od.date),
w as (select factor, date, avg(ic) over f as ic_mean, stddev_pop(ic) over f as sd, count(ic) over f as n from g window f as (partition by factor order by o range between 65 preceding and 6 preceding)),
s as (select *, case when sd > 1e-10 then ic_mean / sd end as ir, case when factor in ('mom_5', 'mom_20') then 'momentum' else factor end as family from w where n >= 10),
k as (select *, row_number() over (partition by date, family order by abs(ir) desc, factor) as k1 from s where ir is not null),
t as (select *, row_number() over (partition by date order by abs(ir) desc, factor) as k2 from k where k1 = 1),
wf as (select date, factor, ic_mean, ir, sign(ic_mean)::int as direction, ir * ir / sum(ir * ir) over (partition by date) as weight from t where k2 <= 3)"""


@query(f"{WALK_SQL} select date, factor, {r6('ic_mean', 'ir')}, direction, round(weight, 6) as weight from wf")
def walkforward_select(spark, sf_dir):
    p = stored(factor_panel(spark, sf_dir).select("entity", "date", "target", *FACTORS), "factors")
    return rounded(IC.walk_forward(IC.rank_ic(IC.melt(p, FACTORS, "target")), p, 60, 5, 3, {"mom_5": "momentum", "mom_20": "momentum"}))


@query(f"""{WALK_SQL}, j as (select l.entity, l.date, sum(weight * direction * value) / sum(abs(weight * direction)) as score, count(*) as have from l join wf using (date, factor) group by 1, 2),
n as (select date, count(*) as need from wf group by 1) select entity, date, round(score, 6) as score from j join n using (date) where have = need""")
def combined_score(spark, sf_dir):
    """Signed weighted sum of the factors chosen walk-forward."""
    p = stored(factor_panel(spark, sf_dir).select("entity", "date", "target", *FACTORS), "factors")
    long = IC.melt(p, FACTORS, "target")
    weights = IC.walk_forward(IC.rank_ic(long), p, 60, 5, 3, {"mom_5": "momentum", "mom_20": "momentum"})
    return rounded(IC.combine(long, weights.withColumn("weight", F.col("weight") * F.col("direction"))).select("entity", "date", "score"))


@query(f"""{panel_sql()}, c as (select entity, date, mom_20 as x from p where mom_20 is not null),
r as (select *, (rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2.0) / count(*) over (partition by date) as pct from c)
select entity, date, round(pct, 6) as pct, round((x - avg(x) over (partition by date)) / case when stddev_samp(x) over (partition by date) > 0 then stddev_samp(x) over (partition by date) else 1 end, 6) as z from r""")
def pct_rank_zscore(spark, sf_dir):
    x = F.col("mom_20")
    p = factor_panel(spark, sf_dir).filter(x.isNotNull())
    return rounded(p.select("entity", "date", XS.percent_rank(x, ["date"]).alias("pct"), XS.zscore(x, ["date"]).alias("z")))


_TAIL = "sqrt(-2 * ln(least(pct, 1 - pct)))"


def _horner(x: str, cs) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


def _inverse_sql() -> str:
    from panelyte.functions.numeric import _A, _B, _C, _D

    q = "(pct - 0.5)"
    outer = f"{_horner('tail', _C)} / {_horner('tail', _D)}"
    return f"case when pct >= 1 then 3.0 else greatest(least(case when pct < 0.02425 then {outer} when pct > 0.97575 then -({outer}) else {q} * {_horner(f'({q} * {q})', _A)} / {_horner(f'({q} * {q})', _B)} end, 3.0), -3.0) end"


@query(f"""{panel_sql()}, c as (select entity, date, mom_20 as x from p where mom_20 is not null),
r as (select *, cast((rank() over (partition by date order by x) + (count(*) over (partition by date, x) - 1) / 2.0) as double) / count(*) over (partition by date) as pct from c),
t as (select *, case when pct < 1 then {_TAIL} end as tail from r) select entity, date, round({_inverse_sql()}, 6) as normal from t""")
def pct_rank_normal(spark, sf_dir):
    x = F.col("mom_20")
    p = factor_panel(spark, sf_dir).filter(x.isNotNull())
    return rounded(p.select("entity", "date", XS.rank_normal(x, ["date"]).alias("normal")))


@query(f"""{panel_sql()}, c as (select * from p where mom_20 is not null),
g as (select *, case when count(*) over (partition by date, grp) >= 3 then mom_20 - avg(mom_20) over (partition by date, grp) else 0 end as r from c),
s as (select *, avg(r) over d as rm, stddev_pop(r) over d as rs, avg(mom_20) over d as xm, stddev_pop(mom_20) over d as xs, count(*) over d as n from g window d as (partition by date))
select entity, date, round(case when n >= 10 then case when rs > 1e-10 then (r - rm) / rs * xs else r end + xm else mom_20 end, 6) as neutral from s""")
def neutralize_group(spark, sf_dir):
    p = factor_panel(spark, sf_dir).filter("mom_20 is not null")
    return rounded(XS.neutralize_group(p, "mom_20", "neutral").select("entity", "date", "neutral"))


@query(f"""{panel_sql()}, c as (select *, ln(amount) as size from p where mom_20 is not null),
s as (select *, avg(mom_20) over d as xm, avg(size) over d as sm, case when var_pop(size) over d > 1e-15 then covar_pop(mom_20, size) over d / var_pop(size) over d else 0 end as beta from c window d as (partition by date))
select entity, date, round(mom_20 - xm - beta * (size - sm), 6) as residual from s""")
def neutralize_size(spark, sf_dir):
    p = factor_panel(spark, sf_dir).filter("mom_20 is not null").withColumn("size", F.log("amount"))
    return rounded(XS.neutralize_size(p, "mom_20", "size", "residual").select("entity", "date", "residual"))


@query(f"""{panel_sql()}, g as (select date, grp, count(*) as n, avg(mom_20) as m, var_pop(mom_20) as v from p where mom_20 is not null group by 1, 2),
s as (select date, sum(n)::bigint as n, sum(n * m * m) / sum(n) - pow(sum(n * m) / sum(n), 2) as b, sum(n * v) / sum(n) as w from g group by 1)
select date, n, case when b + w <> 0 then round(b / (b + w), 6) end as share from s""")
def factor_purity(spark, sf_dir):
    return rounded(XS.purity(factor_panel(spark, sf_dir), "mom_20"))


@query(f"""{bars_sql('nation')}, {STATEMENTS_SQL}, q as (select *, revenue / lag(revenue, 4) over (partition by entity order by period) - 1 as growth, lag(revenue) over (partition by entity order by available) as previous from st),
j as (select b.entity, b.date, b.close, q.period, q.revenue, q.growth, q.previous, row_number() over (partition by b.entity, b.date order by q.available desc) as k from b left join q on q.entity = b.entity and q.available <= b.date)
select entity, date, period, revenue, round(growth, 6) as growth, previous, round(case when growth is null then 0 else tanh((least(greatest(growth, -1.0), 2.0) - 0.1) / 0.5) end, 6) as growth_score,
 cast(case when growth > 0.3 then 1.0 when growth > 0.1 then 0.6 when growth > 0 then 0.3 else 0.0 end as double) as steps from j where k = 1""")
def asof_fundamentals(spark, sf_dir):
    """Latest statement known at each bar, its growth on four quarters before and the statement before it."""
    by = Window.partitionBy("entity").orderBy("period")
    st = statements(spark, sf_dir).withColumn("growth", F.col("revenue") / F.lag("revenue", 4).over(by) - 1).withColumn("previous", F.lag("revenue").over(Window.partitionBy("entity").orderBy("available")))
    j = asof(bars(spark, sf_dir, "nation"), st, "entity", "date", "available", ["period", "revenue", "growth", "previous"])
    g = F.col("growth")
    return j.select("entity", "date", "period", "revenue", F.round(g, 6).alias("growth"), "previous", F.round(compress(g, -1.0, 2.0, 0.1, 0.5), 6).alias("growth_score"), steps(g, [(0.3, 1.0), (0.1, 0.6), (0.0, 0.3)]).alias("steps"))


@query(f"""{bars_sql()}, lv as (select entity, ord + 5 as known, high as level, 'r' as kind from (select *, count(*) over w as n, max(high) over (partition by entity order by date rows between 5 preceding and 1 preceding) as l5, max(high) over (partition by entity order by date rows between 1 following and 5 following) as r5 from b window w as (partition by entity order by date rows between 5 preceding and 5 following)) where n = 11 and high > l5 and high > r5
 union all select entity, ord + 5, low, 's' from (select *, count(*) over w as n, min(low) over (partition by entity order by date rows between 5 preceding and 1 preceding) as l5, min(low) over (partition by entity order by date rows between 1 following and 5 following) as r5 from b window w as (partition by entity order by date rows between 5 preceding and 5 following)) where n = 11 and low < l5 and low < r5)
select b.entity, b.date, round(coalesce((min(level) filter (kind = 'r' and level > close) - close) / close, 0), 6) as resistance_pct, round(coalesce((close - max(level) filter (kind = 's' and level < close)) / close, 0), 6) as support_pct
 from b left join lv on lv.entity = b.entity and lv.known <= b.ord and lv.known > b.ord - 100 group by b.entity, b.date, close""")
def support_resistance(spark, sf_dir):
    """Distance to the nearest high above and low below, of the centred extrema known on the date (the last 100 rows')."""
    return rounded(level_distances(panel(spark, sf_dir), 5, 100).select("entity", "date", "resistance_pct", "support_pct"))


@query(f"""{panel_sql()}, od as (select date, row_number() over (order by date) as o, count(*) over () as n from (select distinct date from p)), wd as (select k, case when o <= k * 20 + 60 then 'in' else 'out' end as role, date from od, range(0, 100000) t(k) where k * 20 + 80 <= n and o > k * 20 and o <= k * 20 + 80),
c as (select k, role, factor, covar_pop(value, target) / (stddev_pop(value) * stddev_pop(target)) as ic from l join wd using (date) group by 1, 2, 3),
r as (select *, row_number() over (partition by k, role order by abs(ic) desc, factor) as place from c) select k::int as k, role, factor, round(ic, 6) as ic, place::int as place from r where place <= 10""")
def in_out_of_sample(spark, sf_dir):
    """The ten factors with the greatest |IC| in each rolling window of 60 dates and on the 20 after it, a window every
    20 dates as long as the calendar lasts."""
    p = factor_panel(spark, sf_dir)
    days = p.select("date").distinct().withColumn("o", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    last = F.max("o").over(Window.partitionBy(F.lit(1)))
    spans = days.withColumn("n", last).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 80) / 20).cast("int")))).filter((F.col("n") >= 80) & (F.col("o") > F.col("k") * 20) & (F.col("o") <= F.col("k") * 20 + 80))
    spans = spans.select("k", F.when(F.col("o") <= F.col("k") * 20 + 60, "in").otherwise("out").alias("role"), "date")
    c = IC.melt(p, FACTORS, "target").join(spans, "date").groupBy("k", "role", "factor").agg(IC.pearson("value", "target").alias("ic"))
    place = F.row_number().over(Window.partitionBy("k", "role").orderBy(F.desc(F.abs("ic")), "factor"))
    return rounded(c.withColumn("place", place).filter("place <= 10"))
