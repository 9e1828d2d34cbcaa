"""Panels derived from the given tables: bars by (entity, date), statements, membership, market index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIX = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ohlcv(ticks: DataFrame, keys: list[str], price: str, volume: Column, amount: Column, order: list[str]) -> DataFrame:
    """Bars of ticks: first, highest, lowest and last price in a total order, summed volume and amount (as decimals,
    so that the sums do not depend on the order of rows)."""
    at = F.struct(*order)
    exact = lambda c: F.sum(c.cast("decimal(18,2)")).cast("double")
    return ticks.groupBy(*keys).agg(
        F.min_by(price, at).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, at).alias("close"),
        exact(volume).alias("volume"), exact(amount).alias("amount"),
    )


def bars(spark: SparkSession, sf_dir: str, by: str = "brand", every: str = "week") -> DataFrame:
    """(entity, grp, date, open, high, low, close, volume, amount): lines of orders as ticks.

    by brand: entity is the brand, grp its first digit; by nation: the supplier's nation and region. every: day,
    week (its Monday) or month (its first day).
    """
    lines = table(spark, sf_dir, "lineitem").withColumn("px", F.col("l_extendedprice") / F.col("l_quantity"))
    if by == "brand":
        part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("entity"))
        ticks = lines.join(part, "l_partkey").withColumn("grp", F.substring("entity", 7, 1))
    else:
        supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
        nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        ticks = lines.join(supplier, "l_suppkey").join(nation.select("n_nationkey", F.col("n_name").alias("entity"), F.col("r_name").alias("grp")), "n_nationkey")
    day = F.to_date("l_shipdate")
    date = {"day": day, "week": F.trunc(day, "week"), "month": F.trunc(day, "month")}[every]
    return ohlcv(ticks.withColumn("date", date), ["entity", "grp", "date"], "px", F.col("l_quantity"), F.col("l_extendedprice"), SIX)


def statements(spark: SparkSession, sf_dir: str, lag_days: int = 30) -> DataFrame:
    """(entity, period, available, revenue, orders): orders of a nation's customers by quarter, known lag_days after
    its end."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity"))
    sales = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, "c_nationkey")
    period = F.trunc(F.to_date("o_orderdate"), "quarter")
    return (
        sales.groupBy("entity", period.alias("period"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))
        .withColumn("available", F.date_add(F.add_months("period", 3), lag_days - 1))
    )


def reports(spark: SparkSession, sf_dir: str, lag_days: int = 30) -> DataFrame:
    """(entity, period, available, roe, profit_growth, revenue_growth, eps, bps, gross_margin, cf_to_profit): statements
    of a nation's orders by quarter. Finished orders are its profit; growths in percent on four quarters before, null
    where there is no such quarter."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("entity"))
    sales = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, "c_nationkey")
    exact = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("o_totalprice").cast("decimal(18,2)"))).cast("double"), F.lit(0.0))
    q = sales.groupBy("entity", F.trunc(F.to_date("o_orderdate"), "quarter").alias("period")).agg(
        exact(F.lit(True)).alias("revenue"), exact(F.col("o_orderstatus") == "F").alias("done"), exact(F.col("o_orderpriority").startswith("1")).alias("urgent")
    )
    by = Window.partitionBy("entity").orderBy("period")
    growth = lambda c: 100 * (F.try_divide(F.col(c), F.lag(c, 4).over(by)) - 1)
    return q.select(
        "entity", "period", F.date_add(F.add_months("period", 3), lag_days - 1).alias("available"), F.try_divide(30 * F.col("done"), F.col("revenue")).alias("roe"), growth("done").alias("profit_growth"),
        growth("revenue").alias("revenue_growth"), (F.col("done") / 1e6).alias("eps"), (F.col("revenue") / 2e6).alias("bps"), F.try_divide(100 * F.col("done"), F.col("revenue")).alias("gross_margin"),
        F.try_divide(F.col("urgent"), F.col("done")).alias("cf_to_profit"),
    )


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity, concept): brands and the types of their parts, many to many."""
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("entity"), F.col("p_type").alias("concept")).distinct()


def market(panel: DataFrame) -> DataFrame:
    """(entity, date, close, volume): the mean close and summed volume of all entities, as one entity 'market'."""
    return panel.groupBy("date").agg(F.avg("close").alias("close"), F.sum("volume").alias("volume")).select(F.lit("market").alias("entity"), "date", "close", "volume")
