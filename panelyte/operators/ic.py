"""Information coefficients: rank correlation of factors with forward returns, their summaries and selections.

Factors are in long form (entity, date, factor, value, target): all factors take one pass, and a rank is computed once
for each (date, group, factor).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions.numeric import normal_cdf
from panelyte.operators.xsec import average_rank


def melt(panel: DataFrame, factors: list[str], target: str, keep: list[str] = ()) -> DataFrame:
    """(entity, date, kept columns, factor, value, target) of the complete pairs."""
    long = panel.select("entity", "date", *keep, F.col(target).alias("target"), *factors).unpivot(["entity", "date", *keep, "target"], factors, "factor", "value")
    return long.filter(F.col("value").isNotNull() & F.col("target").isNotNull())


def pearson(x: str, y: str) -> Column:
    """Aggregate correlation; null where either is constant."""
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-15, F.covar_pop(x, y) / spread)


def rank_ic(long: DataFrame, keys: list[str] = ("date", "factor"), least: int = 10) -> DataFrame:
    """(keys, ic, n): Spearman correlation in each cell of `keys` with enough rows; average ranks for ties."""
    keys = list(keys)
    ranked = long.withColumn("rv", average_rank(F.col("value"), keys)).withColumn("rt", average_rank(F.col("target"), keys))
    return ranked.groupBy(*keys).agg(pearson("rv", "rt").alias("ic"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("ic").isNotNull())


def pooled_ic(long: DataFrame, keys: list[str], least: int = 30) -> DataFrame:
    """(keys, pearson, n): correlation over all rows of a cell."""
    return long.groupBy(*keys).agg(pearson("value", "target").alias("pearson"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def summarize(ic: DataFrame, keys: list[str] = ("factor",)) -> DataFrame:
    """Mean, deviation, IR, stability, t statistic, hit rate of a series of ICs."""
    mean, sd, n = F.avg("ic"), F.stddev_pop("ic"), F.count("ic")
    ir = F.when(sd > 1e-10, mean / sd)
    stability = F.abs(F.sum(F.signum(F.round("ic", 9)))) / n
    return ic.groupBy(*keys).agg(
        n.alias("n_dates"), mean.alias("ic_mean"), sd.alias("ic_std"), ir.alias("ir"), stability.alias("stability"),
        (ir * F.sqrt(n.cast("double"))).alias("t"), (ir * stability).alias("combined_ir"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("hit_rate"),
    )


def decayed(ic: DataFrame, decay: float = 0.9) -> DataFrame:
    """(factor, ic_decayed): mean weighted by decay^(dates after)."""
    age = F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("date"))) - 1
    w = F.pow(F.lit(decay), F.col("age").cast("double"))
    return ic.withColumn("age", age).groupBy("factor").agg((F.sum(w * F.col("ic")) / F.sum(w)).alias("ic_decayed"))


def spread(long: DataFrame, share: float = 0.2) -> DataFrame:
    """(date, factor, spread): mean target of the top share of ranks less that of the bottom share."""
    by = Window.partitionBy("date", "factor")
    p = average_rank(F.col("value"), ["date", "factor"])
    ranked = long.withColumn("__r", p).withColumn("p", F.col("__r") / F.max("__r").over(by))
    return ranked.groupBy("date", "factor").agg((F.avg(F.when(F.col("p") >= 1 - share, F.col("target"))) - F.avg(F.when(F.col("p") <= share, F.col("target")))).alias("spread"))


def passes(summary: DataFrame, ic_floor: float = 0.0, ir_floor: float = 0.0, p_most: float = 0.5, hit_floor: float = 0.0, stability_floor: float = 0.1, least_dates: int = 10) -> DataFrame:
    """Summaries that hold the quality conditions, with the one-sided p value of |t|."""
    p = 1 - normal_cdf(F.abs("t"))
    return summary.withColumn("p", p).filter(
        (F.abs("ic_mean") > ic_floor) & (F.abs("ir") > ir_floor) & (F.col("p") < p_most) & (F.greatest("hit_rate", 1 - F.col("hit_rate")) >= hit_floor) & (F.col("stability") >= stability_floor) & (F.col("n_dates") >= least_dates)
    )


def factor_correlation(long: DataFrame, every: int = 5, least: int = 10) -> DataFrame:
    """(f1, f2, corr, n_dates): rank correlation of two factors, averaged over every n-th date."""
    days = long.select("date").distinct().withColumn("k", F.dense_rank().over(Window.partitionBy(F.lit(1)).orderBy("date"))).filter((F.col("k") - 1) % every == 0)
    ranked = long.join(days.select("date"), "date", "left_semi").withColumn("r", average_rank(F.col("value"), ["date", "factor"]))
    a, b = ranked.select("entity", "date", F.col("factor").alias("f1"), F.col("r").alias("r1")), ranked.select("entity", "date", F.col("factor").alias("f2"), F.col("r").alias("r2"))
    by_date = a.join(b, ["entity", "date"]).filter("f1 < f2").groupBy("date", "f1", "f2").agg(pearson("r1", "r2").alias("c"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("c").isNotNull())
    return by_date.groupBy("f1", "f2").agg(F.avg("c").alias("corr"), F.count(F.lit(1)).alias("n_dates"))


def walk_forward(ic: DataFrame, calendar: DataFrame, window: int, horizon: int, top: int, families: dict[str, str], least_dates: int = 10, per_family: int = 1) -> DataFrame:
    """(date, factor, ic_mean, ir, direction, weight): factors chosen on each date from the ICs of its training window.

    The window of date t is the `window` dates that end before t - horizon, so that every forward return in it is
    known at t. ICs exist once per date; a window is a frame over date ordinals. At most per_family factors of a
    family and top in all; weights are proportional to the squared IR.
    """
    ordinals = calendar.select("date").distinct().withColumn("ord", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    frame = Window.partitionBy("factor").orderBy("ord").rangeBetween(-(horizon + window), -(horizon + 1))
    grid = ordinals.crossJoin(F.broadcast(ic.select("factor").distinct())).join(ic.select("date", "factor", "ic"), ["date", "factor"], "left")  # factors are a fixed list
    mean, sd, n = F.avg("ic").over(frame), F.stddev_pop("ic").over(frame), F.count("ic").over(frame)
    scored = grid.select("date", "factor", mean.alias("ic_mean"), F.when(sd > 1e-10, mean / sd).alias("ir"), n.alias("n")).filter((F.col("n") >= least_dates) & F.col("ir").isNotNull())
    family = F.create_map(*[F.lit(v) for kv in families.items() for v in kv])[F.col("factor")] if families else F.lit(None).cast("string")
    best = Window.partitionBy("date", "family").orderBy(F.desc(F.abs("ir")), "factor")
    first = scored.withColumn("family", F.coalesce(family, F.col("factor"))).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= per_family)
    chosen = first.withColumn("k", F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.abs("ir")), "factor"))).filter(F.col("k") <= top)
    squared = F.col("ir") * F.col("ir")
    return chosen.select("date", "factor", "ic_mean", "ir", F.signum("ic_mean").cast("int").alias("direction"), (squared / F.sum(squared).over(Window.partitionBy("date"))).alias("weight"))


def combine(long: DataFrame, weights: DataFrame, keys: list[str] = ("date",)) -> DataFrame:
    """(entity, date, target, score): sum of weight * value over the chosen factors, for rows that have all of them."""
    need = weights.groupBy(*keys).agg(F.count(F.lit(1)).alias("need"))
    joined = long.join(weights.select(*keys, "factor", "weight"), [*keys, "factor"])
    scored = joined.groupBy("entity", "date", "target").agg((F.sum(F.col("weight") * F.col("value")) / F.sum(F.abs("weight"))).alias("score"), F.count(F.lit(1)).alias("have"))
    return scored.join(need, list(keys)).filter("have = need").select("entity", "date", "target", "score")


def chunked(long: DataFrame, chunks: int = 10) -> DataFrame:
    """(factor, chunk, c): pooled correlation in consecutive chunks of a factor's dates with about equal row counts.

    Dates are dealt by their counts, a row for each date and factor, so no factor's rows are sorted in one task.
    """
    by_date = long.groupBy("factor", "date").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("factor").orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    before, total = F.coalesce(F.sum("n").over(upto), F.lit(0)), F.sum("n").over(Window.partitionBy("factor"))
    dates = by_date.select("factor", "date", F.least(F.floor(before * chunks / total) + 1, F.lit(chunks)).cast("int").alias("chunk"))
    return long.join(dates, ["factor", "date"]).groupBy("factor", "chunk").agg(pearson("value", "target").alias("c"))


def clipped_returns(x: Column, limit: float = 0.5) -> Column:
    """Forward returns inside (-limit, limit), else null."""
    return F.when(F.abs(x) < limit, x)

