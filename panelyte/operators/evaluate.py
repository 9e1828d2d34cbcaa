"""Evaluation of return series, signals, weights and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions.numeric import ratio


def performance(returns: DataFrame, keys: list[str], periods: float = 52.0) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, deepest drawdown and Calmar ratio of (keys, date, ret)."""
    order = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = returns.withColumn("nav", F.exp(F.sum(F.log1p("ret")).over(order)))
    path = path.withColumn("fall", F.col("nav") / F.greatest(F.max("nav").over(order), F.lit(1.0)) - 1)
    out = path.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.exp(F.sum(F.log1p("ret"))) - 1).alias("total"), F.avg("ret").alias("m"), F.stddev_samp("ret").alias("sd"), F.min("fall").alias("max_drawdown"))
    annual = F.pow(1 + F.col("total"), periods / F.col("n")) - 1
    return out.select(
        *keys, "n", "total", annual.alias("annual"), (F.col("sd") * F.sqrt(F.lit(periods))).alias("volatility"),
        (ratio(F.col("m"), F.col("sd")) * F.sqrt(F.lit(periods))).alias("sharpe"), "max_drawdown", ratio(annual, -F.col("max_drawdown")).alias("calmar"),
    )


def tail_risk(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Value at risk and mean loss beyond it at 95 and 99 %, skewness."""
    q = returns.groupBy(*keys).agg(F.percentile("ret", 0.05).alias("var_95"), F.percentile("ret", 0.01).alias("var_99"), F.skewness("ret").alias("skew"))
    mean = lambda v: F.avg(F.when(F.col("ret") <= F.col(v), F.col("ret")))
    return returns.join(q, keys).groupBy(*keys, "var_95", "var_99", "skew").agg(mean("var_95").alias("cvar_95"), mean("var_99").alias("cvar_99"))


def concentration(weights: DataFrame) -> DataFrame:
    """Per date: names, Herfindahl index and the weight of the three largest (ties by entity)."""
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("weight"), "entity"))
    return weights.withColumn("k", k).groupBy("date").agg(F.count(F.lit(1)).alias("names"), F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum(F.when(F.col("k") <= 3, F.col("weight"))).alias("top3"))


def turnover(weights: DataFrame, cost: float = 0.001) -> DataFrame:
    """Per date: half the absolute change of weights since the date before, and its cost."""
    dates = weights.select("date").distinct().withColumn("before", F.lag("date").over(Window.partitionBy(F.lit(1)).orderBy("date"))).filter("before is not null")
    now = weights.join(dates, "date").select("date", "entity", F.col("weight").alias("w"))
    then = weights.withColumnRenamed("date", "before").join(dates, "before").select("date", "entity", F.col("weight").alias("v"))
    moved = now.join(then, ["date", "entity"], "full_outer")
    return moved.groupBy("date").agg((F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0)))) / 2).alias("turnover"), F.count_if(F.isnull("v")).alias("entries"), F.count_if(F.isnull("w")).alias("exits")).withColumn("cost", F.col("turnover") * cost)


def outcome(rows: DataFrame, keys: list[str], flag: Column, value: str = "target") -> DataFrame:
    """Per key: how often flag holds, the hit rate, mean and median of what follows, and the excess over all rows."""
    hit = F.when(flag, F.col(value))
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count_if(flag).alias("signals"), F.avg(F.when(flag, (F.col(value) > 0).cast("double"))).alias("hit_rate"), F.avg(hit).alias("mean_return"),
        F.percentile(hit, 0.5).alias("median_return"), (F.avg(hit) - F.avg(value)).alias("excess"), (F.avg(hit) / (F.stddev_samp(hit) / F.sqrt(F.count(hit).cast("double")))).alias("t"),
    )


def ks_distance(rows: DataFrame, value: str, side: Column, cells: int = 256) -> DataFrame:
    """One row (ks): greatest distance between the distributions of the rows with side true and false.

    Values are counted, cut into cells by approximate quantiles, and added up within cells; cell totals, `cells` rows,
    give what lies before each cell. So no task holds more than a cell's distinct values. cells is 2 or more.
    """
    counted = rows.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    edges = counted.agg(F.percentile_approx(value, F.array(*[F.lit(k / cells) for k in range(1, cells)]), 10_000).alias("edges"))
    placed = counted.crossJoin(F.broadcast(edges)).withColumn("cell", F.size(F.filter("edges", lambda e: e < F.col(value)))).drop("edges")  # one row of edges
    totals = placed.groupBy("cell").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    order = Window.partitionBy(F.lit(1)).orderBy("cell")  # a row for each cell
    before = totals.select("cell", *[F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"b{c}") for c in ("ta", "tb")], *[F.sum(c).over(Window.partitionBy(F.lit(1))).alias(f"n{c}") for c in ("ta", "tb")])
    upto = Window.partitionBy("cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    run = placed.select("cell", F.sum("a").over(upto).alias("ca"), F.sum("b").over(upto).alias("cb")).join(F.broadcast(before), "cell")
    return run.agg(F.max(F.abs((F.col("bta") + F.col("ca")) / F.col("nta") - (F.col("btb") + F.col("cb")) / F.col("ntb"))).alias("ks"))


def round_trips(signals: DataFrame) -> DataFrame:
    """Each buy row with the first later sell of its entity: (entity, bought, sold, ret)."""
    later = Window.partitionBy("entity").orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, -1)  # from the last row on, so the frame only grows
    out = F.last(F.when(F.col("sell"), F.struct("date", "close")), ignorenulls=True).over(later)
    found = signals.withColumn("out", out).filter(F.col("buy") & F.col("out").isNotNull())
    return found.select("entity", F.col("date").alias("bought"), F.col("out.date").alias("sold"), (F.col("out.close") / F.col("close") - 1).alias("ret"))
