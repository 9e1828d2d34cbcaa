"""Boosted-tree ensembles over panel features: crossed features, rolling retraining, saving."""

from __future__ import annotations

from itertools import combinations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelyte.operators.ic import melt, rank_ic, summarize
from panelyte.operators.xsec import percent_rank, zscore
from panelyte.sources.store import stored


def prepare(panel: DataFrame, features: list[str]) -> DataFrame:
    """Features as z-scores within date (missing as 0) in a vector, the target's rank centred on 0 as label."""
    for f in features:
        panel = panel.withColumn(f, F.coalesce(zscore(F.col(f), ["date"]), F.lit(0.0)))
    ranked = panel.withColumn("label", percent_rank(F.col("target"), ["date"]) - 0.5)
    return VectorAssembler(inputCols=features, outputCol="features").transform(ranked)


def train(rows: DataFrame, decay_days: float = 500.0, seeds: tuple[int, ...] = (1, 2, 3), depth: int = 3, trees: int = 10) -> list[GBTRegressionModel]:
    """One model per seed on the rows with a label; later rows weigh more, exp(-days before the last / decay_days)."""
    rows = rows.filter("label is not null")
    last = rows.agg(F.max("date").alias("last"))
    weighted = rows.crossJoin(F.broadcast(last)).withColumn("w", F.exp(-F.datediff("last", "date") / decay_days))  # last is one row
    return [GBTRegressor(maxDepth=depth, maxIter=trees, seed=s, subsamplingRate=0.8, weightCol="w").fit(weighted) for s in seeds]


def predict(models: list[GBTRegressionModel], rows: DataFrame) -> DataFrame:
    """rows with the models' mean prediction."""
    for k, m in enumerate(models):
        rows = m.copy().setPredictionCol(f"__p{k}").transform(rows)
    names = [f"__p{k}" for k in range(len(models))]
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return rows.withColumn("prediction", total / len(models)).drop(*names)


def importance(models: list[GBTRegressionModel], features: list[str]) -> list[tuple[str, float]]:
    """Mean importance of each feature, greatest first."""
    mean = [sum(float(m.featureImportances[i]) for m in models) / len(models) for i in range(len(features))]
    return sorted(zip(features, mean, strict=True), key=lambda x: -x[1])


def crossed(panel: DataFrame, features: list[str], top: int = 8, regime: str | None = None) -> tuple[DataFrame, list[str]]:
    """panel with the products of the percent ranks (centred on 0) of every two of the first `top` features, and with each
    of those ranks times the regime; and the names of the new columns."""
    first = features[:top]
    ranked = panel.select("*", *[(percent_rank(F.col(f), ["date"]) - 0.5).alias(f"__{f}") for f in first])
    new = {f"{a}_x_{b}": F.col(f"__{a}") * F.col(f"__{b}") for a, b in combinations(first, 2)}
    if regime:
        new |= {f"{f}_x_regime": F.col(f"__{f}") * F.col(regime) for f in first}
    return ranked.select("*", *[x.alias(n) for n, x in new.items()]).drop(*[f"__{f}" for f in first]), list(new)


def validation_ic(models: list[GBTRegressionModel], rows: DataFrame, least: int = 5) -> float:
    """Mean rank IC by date of the predictions on rows that were not trained on; 0 without a date of `least` rows."""
    scored = predict(models, rows.filter("target is not null"))
    found = summarize(rank_ic(melt(scored, ["prediction"], "target"), least=least)).first()
    return float(found["ic_mean"]) if found and found["ic_mean"] is not None else 0.0


def rolling_retrain(rows: DataFrame, every: int, window: int, horizon: int, least_ic: float = 0.03, share: float = 0.8, **options) -> DataFrame:
    """(entity, date, prediction, trained_on) of prepared rows: at every `every`-th date a new ensemble from the `window`
    dates that end before that date less `horizon`, so that every label in it is known; its first `share` trains and
    the rest validates. Below least_ic the ensemble before goes on; dates before the first have no row.

    The loop runs over retraining dates only, a few of the calendar; each fit and each prediction is distributed.
    """
    days = rows.select("date").distinct().withColumn("o", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    dealt = stored(rows.join(days, "date"), "dealt")
    last = dealt.agg(F.max("o")).first()[0] or 0
    parts, models, since = [], None, None
    for start in range(window + horizon + 1, last + 1, every):
        end, begin = start - horizon, start - horizon - window
        cut = begin + int(window * share)
        train_on = dealt.filter((F.col("o") >= begin) & (F.col("o") < cut - horizon))
        if not train_on.filter("label is not null").isEmpty():
            new = train(train_on, **options)
            if models is None or validation_ic(new, dealt.filter((F.col("o") >= cut) & (F.col("o") < end))) >= least_ic:
                models, since = new, start
        if models is not None:
            ahead = dealt.filter((F.col("o") >= start) & (F.col("o") < start + every))
            parts.append(predict(models, ahead).select("entity", "date", "prediction", F.lit(since).alias("trained_on")))
    if not parts:
        return rows.select("entity", "date", F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("int").alias("trained_on")).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def save(models: list[GBTRegressionModel], path: str) -> None:
    for k, m in enumerate(models):
        m.write().overwrite().save(f"{path.rstrip('/')}/m{k}")


def load(spark: SparkSession, path: str) -> list[GBTRegressionModel]:
    """The ensemble of save(), in its order."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return [GBTRegressionModel.load(f"{path.rstrip('/')}/{n}") for n in sorted((n for n in names if n[1:].isdigit()), key=lambda n: int(n[1:]))]
