"""Statements as of a date: typed values, compressed factors, scores and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions.numeric import clip
from panelyte.operators.asof import asof

FIELDS = ["roe", "profit_growth", "revenue_growth", "eps", "bps", "gross_margin", "cf_to_profit"]

#: Fixed values: (least, greatest, centre, divisor) of each factor; a negative divisor makes low values good.
COMPRESS = {
    "fund_score": (0.0, 1.0, 0.5, 1 / 3), "fund_profit_growth": (-100.0, 100.0, 0.0, 1.0), "fund_revenue_growth": (-100.0, 100.0, 0.0, 1.0), "fund_roe": (-50.0, 50.0, 10.0, 20.0),
    "fund_cf_to_profit": (-5.0, 5.0, 1.0, 1.0), "fund_gross_margin": (-20.0, 80.0, 30.0, 30.0), "fund_eps": (-10.0, 10.0, 0.0, 1.0), "fund_debt_ratio": (0.0, 100.0, 50.0, -50.0),
    "fund_pg_improve": (-5.0, 5.0, 0.0, 0.5), "fund_rg_improve": (-5.0, 5.0, 0.0, 0.5), "fund_pe": (1.0, 200.0, 15.0, -30.0), "fund_pb": (0.1, 50.0, 1.5, -5.0),
}


def compressed(name: str, x: Column) -> Column:
    """tanh of the clipped and scaled value; null as 0; a factor without an entry is tanh of itself."""
    if name not in COMPRESS:
        return F.coalesce(F.tanh(x), F.lit(0.0))
    lo, hi, centre, divisor = COMPRESS[name]
    return F.coalesce(F.tanh((clip(x, lo, hi) - centre) / divisor), F.lit(0.0))


def step_score(roe: Column, profit_growth: Column, revenue_growth: Column, eps: Column) -> Column:
    """Points of four fields, as fractions, 1 at most; a missing field has none."""
    part = lambda x, bounds: F.coalesce(*[F.when(x > at, points) for at, points in bounds], F.lit(0.0))
    total = (
        part(roe, [(0.15, 0.35), (0.10, 0.25), (0.05, 0.15)]) + part(profit_growth, [(0.50, 0.30), (0.20, 0.20), (0.0, 0.10)])
        + part(revenue_growth, [(0.30, 0.20), (0.15, 0.12), (0.0, 0.05)]) + part(eps, [(1.0, 0.20), (0.5, 0.12)])
    )
    return F.least(F.lit(1.0), total)


def rank_score(roe: Column, profit_growth: Column, revenue_growth: Column, eps: Column) -> Column:
    """Ranking points of percent values: 40 for ROE, 30, 20 and 10 at most for the growths and earnings a share."""
    zero = F.lit(0.0)
    earned = F.when(eps > 0, F.least(eps * 5, F.lit(10.0))).otherwise(zero)
    return F.coalesce(F.least(roe, F.lit(40.0)), zero) + F.coalesce(F.least(profit_growth / 2, F.lit(30.0)), zero) + F.coalesce(F.least(revenue_growth / 3, F.lit(20.0)), zero) + earned


def with_history(statements: DataFrame, fields: list[str], depth: int = 3) -> DataFrame:
    """statements with last_<field>: the field in the `depth` reports known up to each (oldest first, nulls kept out)."""
    upto = Window.partitionBy("entity").orderBy("available", "period").rowsBetween(1 - depth, 0)
    return statements.select("*", *[F.collect_list(f).over(upto).alias(f"last_{f}") for f in fields], F.count(F.lit(1)).over(upto).alias("reports"))


def as_of(rows: DataFrame, statements: DataFrame, fields: list[str] = FIELDS, depth: int = 3) -> DataFrame:
    """rows (entity, date) with the fields of the latest report known on the date, the change of both growths on the
    report before (pg_improve, rg_improve) and whether profits decline; null before any report."""
    known = with_history(statements, ["profit_growth", "revenue_growth"], depth)
    before = Window.partitionBy("entity").orderBy("available", "period")
    for name, field in (("pg_improve", "profit_growth"), ("rg_improve", "revenue_growth")):
        known = known.withColumn(name, F.col(field) - F.lag(field).over(before))
    known = known.withColumn("profit_declining", declining(F.col("last_profit_growth"), F.col("last_revenue_growth"), F.col("reports")))
    return asof(rows, known, "entity", "date", "available", ["period", *fields, "pg_improve", "rg_improve", "profit_declining"])


def declining(profit: Column, revenue: Column, reports: Column, worse: float = 5.0) -> Column:
    """Three reports of falling profit (growth in percent below 0) that fall faster by more than `worse` points, or
    recover by more than that while revenue still falls in all three."""
    three = (reports >= 3) & (F.size(profit) >= 3)
    all_down = lambda a: F.forall(a, lambda x: x < 0)
    trend = F.element_at(profit, -1) - F.element_at(profit, 1)
    hollow = (trend > worse) & (F.size(revenue) >= 3) & all_down(revenue)
    return F.when(three, all_down(profit) & ((trend < -worse) | hollow)).otherwise(F.lit(False))


def factors(rows: DataFrame) -> dict[str, Column]:
    """The compressed factors of rows that have the fields (ROE and growths in percent) and close."""
    c = F.col
    score = step_score(c("roe") / 100, c("profit_growth") / 100, c("revenue_growth") / 100, c("eps"))
    raw = {
        "fund_score": score, "fund_roe": c("roe"), "fund_profit_growth": c("profit_growth") / 100, "fund_revenue_growth": c("revenue_growth") / 100, "fund_gross_margin": c("gross_margin"),
        "fund_cf_to_profit": c("cf_to_profit"), "fund_pg_improve": c("pg_improve") / 100, "fund_rg_improve": c("rg_improve") / 100,
        "fund_pe": F.when(c("eps") > 0, c("close") / c("eps")), "fund_pb": F.when(c("bps") > 0, c("close") / c("bps")),
    }
    return {name: compressed(name, x) for name, x in raw.items()}


def held_by_quarter(rows: DataFrame, min_roe: float, min_growth: float) -> DataFrame:
    """rows (entity, date, roe, profit_growth) with `qualified`: whether the entity passed both floors on its first row
    of the quarter; it keeps that until the next one."""
    first = Window.partitionBy("entity", F.trunc("date", "quarter")).orderBy("date")
    passed = F.coalesce((F.col("roe") >= min_roe) & (F.col("profit_growth") >= min_growth), F.lit(False))
    return rows.withColumn("qualified", F.first(passed).over(first))
