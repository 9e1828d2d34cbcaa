"""Queries over periods, paths, samples, orders and audits of ICs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import ic as IC
from panelyte.operators import records as RE
from panelyte.plans.desk import WEIGHTS, weights
from panelyte.plans.kernels import panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import FACTORS, FAMILIES, SUMMARY, factor_panel, ic_sql, panel_sql, r6
from panelyte.sources.panels import table
from panelyte.sources.store import stored

P = panel_sql()


def ics(spark, sf_dir):
    return IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"))


@query(f"""{bars_sql()}, x as (select entity, date, close, {', '.join(f'lead(close, {n}) over e / close - 1 as fwd_{n}' for n in (5, 10, 20))},
  case when count(*) over w = 21 then max(close) over w / close - 1 end as path_max, case when count(*) over w = 21 then min(close) over w / close - 1 end as path_min, case when count(*) over w = 21 then stddev_pop(close) over w / close end as path_std
  from b window e as (partition by entity order by date), w as (partition by entity order by date rows between current row and 20 following))
select entity, date, {r6('fwd_5', 'fwd_10', 'fwd_20', 'path_max', 'path_min', 'path_std')} from x""")
def forward_paths(spark, sf_dir):
    """Returns over 5, 10 and 20 rows, and the highest, lowest and deviation of the path over 20."""
    return rounded(RE.forward_paths(panel(spark, sf_dir), (5, 10, 20), 20).select("entity", "date", "fwd_5", "fwd_10", "fwd_20", "path_max", "path_min", "path_std"))


@query(f"""{bars_sql()}, d as (select date, row_number() over (order by date) as o, count(*) over () as n from (select distinct date from b)) select date from d where o > 60 and o <= n - 20 and (o - 61) % 3 = 0""")
def sampled_dates(spark, sf_dir):
    """Every third date after a warm-up of 60 and before a tail of 20."""
    return RE.sampled_dates(panel(spark, sf_dir).select("date"), 3, 60, 20)


@query(f"""{P}, ic as {ic_sql()}, m as (select factor, cast(date_trunc('month', date) as date) as month, avg(ic) as ic, count(*) as n from ic group by 1, 2), k as (select *, row_number() over (partition by factor order by month) as o, row_number() over (partition by factor order by month desc) as back from m)
select factor, count(*) as months, round(avg(ic), 6) as ic_mean, round(avg(ic) / stddev_pop(ic), 6) as ir, round(regr_slope(ic, o), 8) as trend, round(avg(ic) filter (back <= 12), 6) as recent_ic, round(avg(ic) filter (back <= 12) / stddev_pop(ic) filter (back <= 12), 6) as recent_ir from k group by 1""")
def ic_by_month(spark, sf_dir):
    """Monthly ICs by factor: mean, IR, slope per month, and mean and IR of the last twelve months."""
    p = RE.periodic(ics(spark, sf_dir), "month", 12)
    return rounded(p.select("factor", F.col("periods").alias("months"), "ic_mean", "ir", "recent_ic", "recent_ir", "trend").drop("trend")).join(rounded(p.select("factor", "trend"), 8), "factor")


@query(f"""{P}, r as (select *, cast(rank() over (partition by grp, factor order by value) + (count(*) over (partition by grp, factor, value) - 1) / 2.0 as double) as rv, cast(rank() over (partition by grp, factor order by target) + (count(*) over (partition by grp, factor, target) - 1) / 2.0 as double) as rt from l),
s as (select grp, factor, covar_pop(rv, rt) / (stddev_pop(rv) * stddev_pop(rt)) as ic, count(*) as n from r group by 1, 2 having count(*) >= 30)
select grp, factor, round(ic, 6) as ic, n, row_number() over (partition by grp order by round(abs(ic), 9) desc, factor)::int as place from s""")
def pooled_rank_ic(spark, sf_dir):
    """Rank correlation over all rows of a group, factors placed by its size."""
    s = IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target", ["grp"]), ["grp", "factor"], 30)
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round(F.abs("ic"), 9)), "factor"))
    return rounded(s.withColumn("place", place).select("grp", "factor", "ic", "n", "place"))


@query(f"""{P}, ic as {ic_sql()}, s as (select factor, {SUMMARY} from ic group by 1), r as (select *, cast(rank() over (partition by date, factor order by value) + (count(*) over (partition by date, factor, value) - 1) / 2.0 as double) as rv from l),
q as (select *, rv / max(rv) over (partition by date, factor) as pr from r), d as (select date, factor, avg(target) filter (pr >= 0.8) - avg(target) filter (pr <= 0.2) as spread from q group by 1, 2), m as (select factor, avg(spread) as spread from d group by 1)
select factor, case when ic_mean > 0 then 1 else -1 end as direction, round(case when ic_mean > 0 then spread else -spread end, 6) as spread, round(abs(ir) * (0.4 + 0.3 * stability + 0.3 * least(1, greatest(0, case when ic_mean > 0 then spread else -spread end / 0.03))), 6) as combined_ir from s join m using (factor)""")
def directed_spread(spark, sf_dir):
    """A factor's direction, its spread that way, and the IR that counts both."""
    long = stored(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"), "long")
    return rounded(RE.directed(IC.summarize(IC.rank_ic(long)), IC.spread(long)))


@query(f"""{P}, o as (select date, row_number() over (order by date) as o, count(*) over () as n from (select distinct date from l)), w as (select l.*, least((o - 1) // (n // 5), 4) as win from l join o using (date)),
r as (select *, cast(rank() over (partition by win, factor order by value) + (count(*) over (partition by win, factor, value) - 1) / 2.0 as double) as rv, cast(rank() over (partition by win, factor order by target) + (count(*) over (partition by win, factor, target) - 1) / 2.0 as double) as rt from w),
c as (select factor, win, covar_pop(rv, rt) / (stddev_pop(rv) * stddev_pop(rt)) as ic from r group by 1, 2 having count(*) >= 30),
s as (select factor, avg(ic) as ic_mean, avg(ic) / (stddev_pop(ic) + 1e-10) as sharpe from c group by 1 having count(*) >= 3)
select factor, {r6('ic_mean', 'sharpe')}, round(0.7 * sharpe + 0.3 * abs(ic_mean), 6) as score, row_number() over (order by round(0.7 * sharpe + 0.3 * abs(ic_mean), 9) desc, factor)::int as place from s qualify place <= 3""")
def top_features(spark, sf_dir):
    """The three features with the best blend of stability over five spans of dates and size of IC."""
    return rounded(RE.top_features(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target"), 3))


_FAMILY = "case " + " ".join(f"when factor = '{f}' then '{k}'" for f, k in FAMILIES.items()) + " end"


@query(f"""{P}, ic as {ic_sql('grp, date, factor', 4)}, q as (select grp, factor, cast(date_trunc('quarter', date) as date) as eval_date, avg(ic) as ic_mean, count(*) as n from ic group by 1, 2, 3 having count(*) >= 5), k as (select *, {_FAMILY} as family, regexp_extract(factor, '_([0-9]+)$', 1) as suffix from q),
u as (select 'family' as kind, family as name, factor, ic_mean from k union all select 'suffix', suffix, factor, ic_mean from k union all select 'group', grp, factor, ic_mean from k)
select kind, name, count(distinct factor) as factors, count(*) as records, round(avg(ic_mean), 6) as mean_ic, round(median(ic_mean), 6) as median_ic, count(*) filter (ic_mean > 0.03) as strong, min_by(factor, (-round(best, 9), factor)) as best from (select u.*, avg(ic_mean) over (partition by kind, name, factor) as best from u) group by 1, 2""")
def metric_audit(spark, sf_dir):
    """Stored quarterly metrics by family, by suffix and by group: how many factors and records, their ICs, the best."""
    ic = IC.rank_ic(IC.melt(factor_panel(spark, sf_dir), FACTORS, "target", ["grp"]), ["grp", "date", "factor"], 4)
    q = ic.groupBy("grp", "factor", F.trunc("date", "quarter").alias("eval_date")).agg(F.avg("ic").alias("ic_mean"), F.count(F.lit(1)).alias("n")).filter("n >= 5")
    return rounded(RE.audit(stored(q, "metrics"), FAMILIES))


@query(f"""{WEIGHTS}, ds as (select date, lag(date) over (order by date) as before from (select distinct date from wt)), lk as (select wt.date, wt.entity, wt.weight, coalesce(h.entity is not null, false) as locked from wt join ds using (date) left join wt h on h.date = ds.before and h.entity = wt.entity)
select date, entity, locked, row_number() over (partition by date order by locked desc, round(weight, 9) desc, entity)::int as place from lk""")
def locked_order(spark, sf_dir):
    """Each date's entities, those held on the date before first, then by weight."""
    w = stored(weights(spark, sf_dir).select("date", "entity", "weight"), "weights")
    days = w.select("date").distinct().withColumn("before", F.lag("date").over(Window.partitionBy(F.lit(1)).orderBy("date")))
    held = w.select(F.col("date").alias("before"), "entity", F.lit(True).alias("locked"))
    p = w.join(days, "date").join(held, ["before", "entity"], "left").withColumn("locked", F.coalesce("locked", F.lit(False)))
    return RE.locked_first(p, ["date"], "locked", F.round("weight", 9)).select("date", "entity", "locked", "place")


@query("select p_partkey, p_name from (select *, row_number() over (order by md5(p_partkey::varchar || ':7'), p_partkey) as k from part) where k <= 500")
def seeded_sample(spark, sf_dir):
    """500 parts, the same for one seed whatever the files, tasks or machine."""
    return RE.seeded_sample(table(spark, sf_dir, "part"), "p_partkey", 7, 500).select("p_partkey", "p_name")
