"""Queries over universes, flags and groupings."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators import ic as IC
from panelyte.operators import universe as U
from panelyte.plans.kernels import ex, panel, rounded
from panelyte.plans.registry import bars_sql, query
from panelyte.plans.research import FACTORS, factor_panel, panel_sql
from panelyte.sources.panels import bars, membership, table

B, P = bars_sql(), panel_sql()
LISTING = """ls as (select lpad(p_partkey::varchar, 6, '0') as symbol, p_name as name, p_retailprice as close, volume, p_size * p_retailprice as cap from part left join (select l_partkey, sum(l_quantity) as volume from lineitem group by 1) on l_partkey = p_partkey)"""


def listing(spark, sf_dir):
    volume = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.sum("l_quantity").alias("volume"))
    parts = table(spark, sf_dir, "part").join(volume, "p_partkey", "left")
    return parts.select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("symbol"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("close"), "volume", (F.col("p_size") * F.col("p_retailprice")).alias("cap"))


@query(f"""with {LISTING} select symbol, name, close, volume, cap from ls where not contains(name, 'cold') and not contains(name, 'bolt') and coalesce(volume, 0) > 0 and not starts_with(symbol, '00019') and cap >= 5000 and close >= 905 and volume * close >= 20000 order by cap desc, symbol limit 50""")
def listing_universe(spark, sf_dir):
    """The 50 largest listings that pass name, prefix, volume, cap, price and amount filters."""
    return U.listed(listing(spark, sf_dir), ["cold", "bolt"], ["00019"], 5000.0, 905.0, 20000.0, 50)


@query("select distinct lpad(p_partkey::varchar, 6, '0') as symbol from part where contains(p_name, 'cold') or contains(p_name, 'bolt')")
def special_list(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 6, "0").alias("symbol"), F.col("p_name").alias("name"))
    return U.special_names(names, ["cold", "bolt"])


@query(f"""{B}, k as (select *, case when entity <> 'Brand#3' then amount end as am, row_number() over (partition by entity order by date desc) as k from bars where date <= date '2001-03-31'),
u as (select entity, count(*) as n, last(close order by date) as price, avg(am) filter (k <= 20) as mean_amount, avg(volume) filter (k <= 20) as mean_volume from k group by 1)
select entity, n, round(price, 4) as price, round(mean_amount, 4) as mean_amount, round(mean_volume, 4) as mean_volume, coalesce(n >= 60 and price >= 2 and case when mean_amount is not null then mean_amount >= case when starts_with(entity, 'Brand#1') then 100000 when starts_with(entity, 'Brand#2') then 50000 else 150000 end
 else mean_volume >= case when starts_with(entity, 'Brand#1') then 60 when starts_with(entity, 'Brand#2') then 30 else 90 end end, false) as liquid from u""")
def board_liquidity(spark, sf_dir):
    """Liquidity with a floor for each board, volume where amounts are missing, and a cut date."""
    b = bars(spark, sf_dir).withColumn("amount", F.when(F.col("entity") != "Brand#3", F.col("amount")))
    return rounded(U.liquid(b, [("Brand#1", 100000.0, 60.0), ("Brand#2", 50000.0, 30.0)], (150000.0, 90.0), "2001-03-31"), 4)


@query(f"""{B}, nm as (select distinct entity, date_trunc('year', date)::date + 100 as since, entity || case when (year(date) + substr(entity, 7)::int) % 3 = 0 then ' ST' else '' end as name from bars),
j as (select b.entity, b.date, nm.name, row_number() over (partition by b.entity, b.date order by nm.since desc) as k from b left join nm on nm.entity = b.entity and nm.since <= b.date),
t as (select b.entity, b.date, close > 800 and volume > 20 and coalesce(case when count(close * volume) {ex(20)} >= 5 then avg(close * volume) {ex(20)} end > 30000, false) as tradable, ret * 10 as ch, (high - low) / close * 10 as am from b)
select t.entity, t.date, tradable, coalesce(contains(name, 'ST'), false) as special, case when (ch >= 9.5 and am < 20) or (ch between 4.5 and 5.5 and am < 12) then 1 when (ch <= -9.5 and am < 20) or (ch between -5.5 and -4.5 and am < 12) then -1 else 0 end as limit_state
from t join j on j.entity = t.entity and j.date = t.date where k = 1""")
def tradable_rows(spark, sf_dir):
    """Tradable mask, special names as of the date, and price-limit states."""
    p = panel(spark, sf_dir)
    names = p.select("entity", F.date_add(F.trunc("date", "year"), 100).alias("since"), F.concat("entity", F.when((F.year("date") + F.substring("entity", 7, 9).cast("int")) % 3 == 0, " ST").otherwise("")).alias("name")).distinct()
    state = U.limit_state(F.col("ret") * 10, (F.col("high") - F.col("low")) / F.col("close") * 10)
    rows = p.select("entity", "date", U.tradable(F.col("close"), F.col("volume"), 800.0, 20.0, 30000.0).alias("tradable"), state.alias("limit_state"))
    return U.special_as_of(rows, names)


@query("""with m as (select distinct p_brand as entity, p_type as concept from part where not contains(p_type, 'PROMO')), s as (select concept from m group by 1 having count(*) >= 20),
l as (select entity, concept || case when concept < 'M' then 'Ⅱ' else 'Ⅲ' end as label from m where concept in (select concept from s) or concept = 'LARGE'), z as (select *, regexp_replace(label, '[ⅠⅡⅢIV]+$', '') as bare from l)
select entity, label, case when count(*) over (partition by bare) < 24 then '其他' else bare end as fine from z where label is not null""")
def supported_groups(spark, sf_dir):
    """Groups without style tags and with enough members; labels without level suffix, small ones put together."""
    m = U.without_tags(membership(spark, sf_dir), ["PROMO"])
    kept = U.supported(m, 20).unionByName(m.filter("concept = 'LARGE'")).distinct()
    labels = kept.select("entity", F.concat("concept", F.when(F.col("concept") < "M", "Ⅱ").otherwise("Ⅲ")).alias("label"))
    return U.fine_groups(labels, 24)


@query(f"""{B}, s as (select entity, case when count(ret) over w = 60 then stddev_samp(ret) over w end as s from b window w as (partition by entity order by date rows between 59 preceding and current row)),
m as (select entity, avg(s) as mean_std from s group by 1) select entity, round(mean_std, 6) as mean_std, case when mean_std is null then 'unknown' when mean_std < 0.5 then 'low' when mean_std < 0.8 then 'medium' else 'high' end as class from m""")
def volatility_classes(spark, sf_dir):
    return rounded(U.volatility_class(panel(spark, sf_dir), 0.5, 0.8))


@query(f"{P} " + " union all ".join(f"select '{c}' as name, round(avg(case when {c} is null then 1.0 else 0.0 end)::double, 6) as null_share, round(avg(case when abs({c}) > 2 then 1.0 when {c} is null then null else 0.0 end)::double, 6) as extreme_share from p" for c in FACTORS))
def column_quality(spark, sf_dir):
    """Missing and extreme shares of each factor."""
    return rounded(U.column_quality(factor_panel(spark, sf_dir), FACTORS))


@query(f"""{P}, q as (select quantile_cont(mom_20, 0.2) as a, quantile_cont(mom_20, 0.4) as b, quantile_cont(mom_20, 0.6) as c, quantile_cont(mom_20, 0.8) as d from p),
x as (select case when mom_20 is not null then (mom_20 > a)::int + (mom_20 > b)::int + (mom_20 > c)::int + (mom_20 > d)::int end as quantile, case when vol_20 is null then null else (vol_20 > 0.3)::int + (vol_20 > 0.6)::int + (vol_20 > 1.2)::int end as bin, target from p, q where abs(target) < 0.5)
select quantile, bin, count(*) as n, round(avg(target), 6) as mean_return from x group by 1, 2""")
def binned_returns(spark, sf_dir):
    """Forward returns inside (-0.5, 0.5) by quantile bin of momentum and explicit bin of volatility."""
    p = U.quantile_bins(factor_panel(spark, sf_dir), "mom_20", 5, "quantile").withColumn("bin", U.bins(F.col("vol_20"), [0.3, 0.6, 1.2]))
    p = p.withColumn("target", IC.clipped_returns(F.col("target"))).filter("target is not null")
    return rounded(p.groupBy("quantile", "bin").agg(F.count(F.lit(1)).alias("n"), F.avg("target").alias("mean_return")))


@query(f"""{P} select distinct factor, regexp_extract(factor, '^([A-Za-z]+)', 1) as family, regexp_extract(factor, '([0-9]+)', 1)::int as number, string_split(factor, '_')[-1] as suffix, count(*) over (partition by regexp_extract(factor, '^([A-Za-z]+)', 1)) as of_family from (select distinct factor from l)""")
def factor_tags(spark, sf_dir):
    """Family, number and suffix of each factor's name, and how many factors its family has."""
    from pyspark.sql import Window

    names = IC.melt(factor_panel(spark, sf_dir), FACTORS, "target").select("factor").distinct()
    family, number, suffix = U.name_tag(F.col("factor"))
    return names.select("factor", family.alias("family"), number.alias("number"), suffix.alias("suffix")).withColumn("of_family", F.count(F.lit(1)).over(Window.partitionBy("family")))


@query(f"""{B}, r as (select entity, date, close, close * (1 + ord / 1000.0::double) as adj, ord from b), kn as (select entity, date, adj / close as factor from r where ord <= 300),
n as (select entity, date, case when ord % 7 <> 0 then adj / close end as factor from r where ord > 300), a as (select * from kn union all select * from n)
select entity, date, round(last_value(factor ignore nulls) over (partition by entity order by date), 6) as factor from a""")
def appended_factors(spark, sf_dir):
    """Adjustment factors with new dates appended; a missing adjusted close carries the last factor on."""
    p = panel(spark, sf_dir)
    adjusted = p.withColumn("close", F.col("close") * (1 + F.col("ord") / 1000.0))
    known = p.filter("ord <= 300").select("entity", "date", (1 + F.col("ord") / 1000.0).alias("factor"))
    return rounded(U.append_factors(known, adjusted.filter("ord % 7 <> 0"), p))


@query(f"""{B} select date, round(avg(ret) filter (grp = '1'), 6) as "1", round(avg(ret) filter (grp = '2'), 6) as "2", round(avg(ret) filter (grp = '3'), 6) as "3", round(avg(ret) filter (grp = '4'), 6) as "4", round(avg(ret) filter (grp = '5'), 6) as "5" from b group by 1""")
def group_pivot(spark, sf_dir):
    """Mean returns, a row for each date and a column for each group."""
    return rounded(panel(spark, sf_dir).groupBy("date").pivot("grp", ["1", "2", "3", "4", "5"]).agg(F.avg("ret")))
