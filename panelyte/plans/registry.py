"""Registry of queries: a plan over the tables of a folder and, where SQL can say it, the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}

TICK = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice"
_FROM = {
    "brand": "select *, p_brand as entity, substr(p_brand, 7, 1) as grp, l_extendedprice / l_quantity as px, cast(l_shipdate as date) as day from lineitem join part on l_partkey = p_partkey",
    "nation": "select *, n_name as entity, r_name as grp, l_extendedprice / l_quantity as px, cast(l_shipdate as date) as day from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey",
}


def bars_sql(by: str = "brand", every: str = "week") -> str:
    """Common table expressions ticks and b (bars with ord); starts with `with`."""
    date = "day" if every == "day" else f"cast(date_trunc('{every}', day) as date)"
    return f"""with ticks as ({_FROM[by]}),
    bars as (select entity, grp, {date} as date, first(px order by {TICK}) as open, max(px) as high, min(px) as low, last(px order by {TICK}) as close,
      cast(sum(cast(l_quantity as decimal(18,2))) as double) as volume, cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as amount from ticks group by 1, 2, 3),
    b as (select *, row_number() over (partition by entity order by date) as ord, close / lag(close) over (partition by entity order by date) - 1 as ret from bars)"""


STATEMENTS_SQL = """st as (select *, cast(period + interval 3 month as date) + 29 as available from (
    select n_name as entity, cast(date_trunc('quarter', o_orderdate) as date) as period, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue, count(*) as orders
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2))"""


REPORTS_SQL = """rq as (select n_name as entity, cast(date_trunc('quarter', o_orderdate) as date) as period, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as revenue,
    coalesce(cast(sum(case when o_orderstatus = 'F' then cast(o_totalprice as decimal(18,2)) end) as double), 0) as done, coalesce(cast(sum(case when o_orderpriority like '1%' then cast(o_totalprice as decimal(18,2)) end) as double), 0) as urgent
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1, 2),
  rp as (select entity, period, cast(period + interval 3 month as date) + 29 as available, 30 * done / nullif(revenue, 0) as roe, 100 * (done / nullif(lag(done, 4) over e, 0) - 1) as profit_growth, 100 * (revenue / nullif(lag(revenue, 4) over e, 0) - 1) as revenue_growth,
    done / 1e6 as eps, revenue / 2e6 as bps, 100 * done / nullif(revenue, 0) as gross_margin, urgent / nullif(done, 0) as cf_to_profit from rq window e as (partition by entity order by period)),
  rh as (select *, profit_growth - lag(profit_growth) over e as pg_improve, revenue_growth - lag(revenue_growth) over e as rg_improve, count(*) over w as reports,
    list_filter(list(profit_growth) over w, lambda x: x is not null) as lp, list_filter(list(revenue_growth) over w, lambda x: x is not null) as lr from rp window e as (partition by entity order by available, period), w as (partition by entity order by available, period rows between 2 preceding and current row)),
  rd as (select *, case when reports >= 3 and len(lp) >= 3 then list_max(lp) < 0 and (lp[-1] - lp[1] < -5 or (lp[-1] - lp[1] > 5 and len(lr) >= 3 and list_max(lr) < 0)) else false end as profit_declining from rh)"""


def query(sql: str | None = None):
    """Register a plan under its function's name."""

    def add(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            ORACLES[plan.__name__] = sql
        return plan

    return add
