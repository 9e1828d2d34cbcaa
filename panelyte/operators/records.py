"""Periods, paths, samples, orders and audits: small operators over panels and stored ICs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators.asof import asof
from panelyte.operators.ic import rank_ic


def forward_paths(rows: DataFrame, horizons: tuple[int, ...], span: int) -> DataFrame:
    """rows (entity, date, close) with fwd_{n}, the return over n rows, and path_max, path_min and path_std: the highest
    and lowest return and the deviation (as a share of the close) of the closes from the row to `span` rows later; null
    where the path is not whole."""
    c, by = F.col("close"), W.by_entity()
    path = by.rowsBetween(0, span)
    whole = lambda x: F.when((F.count(F.lit(1)).over(path) == span + 1) & (c > 0), x)
    return rows.select(
        "*", *[W.ahead(c, n).alias(f"fwd_{n}") for n in horizons],
        whole(F.max(c).over(path) / c - 1).alias("path_max"), whole(F.min(c).over(path) / c - 1).alias("path_min"), whole(F.stddev_pop(c).over(path) / c).alias("path_std"),
    )


def sampled_dates(dates: DataFrame, step: int, warm_up: int, tail: int) -> DataFrame:
    """(date): every step-th of the distinct dates after warm_up of them and before the last `tail`."""
    calendar = Window.partitionBy(F.lit(1))  # a row for each date
    d = dates.select("date").distinct().withColumn("o", F.row_number().over(calendar.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(calendar))
    return d.filter((F.col("o") > warm_up) & (F.col("o") <= F.col("n") - tail) & ((F.col("o") - warm_up - 1) % step == 0)).select("date")


def periodic(ic: DataFrame, every: str, recent: int) -> DataFrame:
    """(factor, periods, ic_mean, ir, trend, recent_ic, recent_ir) of mean ICs by period (month, quarter or year): trend is
    the slope per period, recent the last `recent` periods."""
    m = ic.groupBy("factor", F.trunc("date", every).alias("period")).agg(F.avg("ic").alias("ic"))
    o = m.withColumn("o", F.row_number().over(Window.partitionBy("factor").orderBy("period"))).withColumn("back", F.row_number().over(Window.partitionBy("factor").orderBy(F.desc("period"))))
    late = F.when(F.col("back") <= recent, F.col("ic"))
    ratio = lambda x: F.when(F.stddev_pop(x) > 1e-15, F.avg(x) / F.stddev_pop(x))
    return o.groupBy("factor").agg(F.count(F.lit(1)).alias("periods"), F.avg("ic").alias("ic_mean"), ratio(F.col("ic")).alias("ir"), F.regr_slope("ic", "o").alias("trend"), F.avg(late).alias("recent_ic"), ratio(late).alias("recent_ir"))


def directed(summary: DataFrame, spread: DataFrame, full: float = 0.03) -> DataFrame:
    """(factor, direction, spread, combined_ir): 1 for a positive mean IC, else -1; the mean spread of dates in that
    direction; |IR| times 0.4, 0.3 of the stability and 0.3 of the spread as a share of `full`."""
    mean = spread.groupBy("factor").agg(F.avg("spread").alias("spread"))
    d = summary.join(mean, "factor").withColumn("direction", F.when(F.col("ic_mean") > 0, 1).otherwise(-1))
    d = d.withColumn("spread", F.col("spread") * F.col("direction"))
    reward = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("spread") / full))
    return d.select("factor", "direction", "spread", (F.abs("ir") * (0.4 + 0.3 * F.col("stability") + 0.3 * reward)).alias("combined_ir"))


def top_features(long: DataFrame, k: int, windows: int = 5, least: int = 30, least_windows: int = 3) -> DataFrame:
    """(factor, ic_mean, sharpe, score, place): the k factors with the best 0.7 * sharpe + 0.3 * |IC| of their pooled rank
    ICs in `windows` spans of equally many dates (the last takes the rest), with `least` rows each."""
    calendar = Window.partitionBy(F.lit(1))  # a row for each date
    days = long.select("date").distinct().withColumn("o", F.row_number().over(calendar.orderBy("date"))).withColumn("n", F.count(F.lit(1)).over(calendar))
    span = F.least(F.floor((F.col("o") - 1) / F.floor(F.col("n") / windows)), F.lit(windows - 1)).alias("win")
    ic = rank_ic(long.join(days.select("date", span), "date"), ["win", "factor"], least)
    s = ic.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.avg("ic").alias("ic_mean"), (F.avg("ic") / (F.stddev_pop("ic") + 1e-10)).alias("sharpe")).filter(F.col("n") >= least_windows)
    s = s.withColumn("score", F.col("sharpe") * 0.7 + F.abs("ic_mean") * 0.3)
    return s.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc(F.round("score", 9)), "factor"))).filter(F.col("place") <= k).select("factor", "ic_mean", "sharpe", "score", "place")  # a row for each factor


def audit(metrics: DataFrame, families: dict[str, str], strong: float = 0.03) -> DataFrame:
    """(kind, name, factors, records, mean_ic, median_ic, strong, best) of stored metrics (grp, factor, ic_mean) by the
    family of the factor, the number its name ends with, and the group; best is the factor with the highest mean IC."""
    family = F.create_map(*[F.lit(x) for kv in families.items() for x in kv])[F.col("factor")] if families else F.lit(None).cast("string")
    names = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("name")) for k, v in (("family", family), ("suffix", F.regexp_extract("factor", "_([0-9]+)$", 1)), ("group", F.col("grp")))])
    each = metrics.select(F.inline(names), "factor", "ic_mean")
    per = each.groupBy("kind", "name", "factor").agg(F.avg("ic_mean").alias("own"))
    best = per.groupBy("kind", "name").agg(F.min_by("factor", F.struct(-F.round("own", 9), "factor")).alias("best"))
    total = each.groupBy("kind", "name").agg(F.count_distinct("factor").alias("factors"), F.count(F.lit(1)).alias("records"), F.avg("ic_mean").alias("mean_ic"), F.median("ic_mean").alias("median_ic"), F.count_if(F.col("ic_mean") > strong).alias("strong"))
    return total.join(best, ["kind", "name"])


def locked_first(rows: DataFrame, keys: list[str], lock: str, score: Column, tie: str = "entity") -> DataFrame:
    """rows with place within keys: locked rows before all others, then by descending score, then by the tie column."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(lock), score.desc_nulls_last(), tie)))


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """n rows by the order of a hash of key and seed: the same rows for one seed whatever the layout of the files. Each task
    keeps its own n, so nothing is sorted as a whole."""
    return rows.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")).cast("binary")), key).limit(n)


def predictions_as_of(rows: DataFrame, predictions: DataFrame, key: str = "entity") -> DataFrame:
    """rows (entity, date) with the latest prediction on or before the date; 0 before any."""
    known = predictions.select(key, F.col("date").alias("predicted"), "prediction")
    return asof(rows, known, key, "date", "predicted", ["predicted", "prediction"]).withColumn("prediction", F.coalesce("prediction", F.lit(0.0)))


def without(rows: DataFrame, names: tuple[str, ...] = (), prefixes: tuple[str, ...] = (), suffixes: tuple[str, ...] = ()) -> DataFrame:
    """rows without the columns that are known to be noise or structure: by name, or by how their name begins or ends."""
    return rows.drop(*[c for c in rows.columns if c in names or c.startswith(prefixes or ("\0",)) or c.endswith(suffixes or ("\0",))])
