"""Window and recursive kernels against NumPy, leakage of exclusive frames, as-of boundaries."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelyte.functions import numeric as N
from panelyte.functions import windows as W
from panelyte.functions.recursive import macd, smoothed
from panelyte.operators import clean as C
from panelyte.operators import xsec as XS
from panelyte.operators.asof import asof


def walk(seed=42, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for e in "ab":
        close = 10 + np.cumsum(rng.normal(0, 0.1, n))
        out += [(e, str(pd.Timestamp("2024-01-01").date() + pd.Timedelta(days=int(i))), float(c), float(v)) for i, (c, v) in enumerate(zip(close, rng.integers(1, 100, n), strict=True))]
    return out


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(walk(), "entity string, date string, close double, volume double").withColumn("date", F.to_date("date"))


def series(df, col):
    return {e: g.sort_values("date")[col].to_numpy(dtype=float) for e, g in df.toPandas().groupby("entity")}


def test_frames_and_deviations(bars):
    c = F.col("close")
    df = bars.select("entity", "date", "close", W.sma(c, 5).alias("sma"), W.std(c, 5).alias("std"), W.highest(c, 5).alias("hi"), W.corr(c, F.col("volume"), 10).alias("corr"), "volume", W.worst_mean(c, 10, 3).alias("worst"), W.max_drawdown(c, 8).alias("dd"))
    pdf = df.toPandas()
    for _, g in pdf.groupby("entity"):
        g = g.sort_values("date")
        x, v = g["close"].to_numpy(), g["volume"].to_numpy()
        for i in range(len(x)):
            row = g.iloc[i]
            assert np.isnan(row["sma"]) if i < 4 else abs(row["sma"] - x[i - 4 : i + 1].mean()) < 1e-9
            assert np.isnan(row["std"]) if i < 5 else abs(row["std"] - x[i - 5 : i].std()) < 1e-9
            assert np.isnan(row["hi"]) if i < 5 else row["hi"] == x[i - 5 : i].max()
            assert np.isnan(row["corr"]) if i < 10 else abs(row["corr"] - np.corrcoef(x[i - 10 : i], v[i - 10 : i])[0, 1]) < 1e-9
            assert np.isnan(row["worst"]) if i < 10 else abs(row["worst"] - np.sort(x[i - 10 : i])[:3].mean()) < 1e-9
            if i >= 7:
                w = x[i - 7 : i + 1]
                assert abs(row["dd"] - (w / np.maximum.accumulate(w) - 1).min()) < 1e-9


def test_exclusive_frames_do_not_see_their_row(bars):
    last = bars.agg(F.max("date")).first()[0]
    changed = bars.withColumn("close", F.when(F.col("date") == last, 99.0).otherwise(F.col("close")))
    for kernel in (W.std, W.highest, W.lowest):
        a, b = (series(df.select("entity", "date", kernel(F.col("close"), 5).alias("k")), "k") for df in (bars, changed))
        assert all(np.array_equal(a[e], b[e], equal_nan=True) for e in a)


def test_smoothing(bars):
    got = series(macd(smoothed(bars, {"e": ("close", 5, False), "a": ("close", 5, True)}), "close").select("entity", "date", "e"), "e")
    for e, x in series(bars, "close").items():
        assert np.allclose(got[e], pd.Series(x).ewm(span=5, adjust=False).mean())


def test_constant_and_null_series(spark):
    rows = [("a", i, 1.0, None if i % 3 else 2.0) for i in range(30)]
    df = spark.createDataFrame(rows, "entity string, date int, x double, y double")
    out = df.select(W.corr(F.col("x"), F.col("x"), 5).alias("c"), W.sma(F.col("y"), 3).alias("s"), W.std(F.col("x"), 5).alias("d")).toPandas()
    assert out["c"].isna().all() and out["s"].isna().all() and (out["d"].dropna() == 0).all()


def test_ranks_and_normal_scores(spark):
    df = spark.createDataFrame([(1, v) for v in (1.0, 1.0, 2.0, 3.0, 3.0, 3.0, None)], "date int, x double")
    got = sorted(r.p for r in df.select(XS.percent_rank(F.col("x"), ["date"]).alias("p")).collect() if r.p is not None)
    assert np.allclose(got, np.array([1.5, 1.5, 3, 5, 5, 5]) / 6)
    q = spark.range(1, 1000).select(N.normal_cdf(N.inverse_normal(F.col("id") / 1000)).alias("p"), (F.col("id") / 1000).alias("want")).toPandas()
    assert np.abs(q["p"] - q["want"]).max() < 1e-6
    assert spark.range(1).select(N.inverse_normal(F.lit(0.0)).alias("a"), N.clip(F.lit(None).cast("double"), 0, 1).alias("b")).first() == (None, None)


def test_asof_boundaries(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 2), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20), ("a", 2, 21), ("a", 9, 90), ("c", 1, 1), ("a", None, 5)], "k string, u int, v int")
    assert {(r.k, r.t): r.v for r in asof(left, right, "k", "t", "u", ["v"]).collect()} == {("a", 1): None, ("a", 2): 21, ("a", 3): 21, ("b", 2): None, ("a", None): None}
    assert {(r.k, r.t): r.v for r in asof(left, right, "k", "t", "u", ["v"], strict=True).collect()}[("a", 2)] is None


def test_runs_completion_and_upserts(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([1, 1, 0, 1, 1, 1, None, 1])], "entity string, date int, x int")
    assert [r.n for r in W.run_length(df, F.col("x") == 1, "n").orderBy("date").collect()] == [1, 2, 0, 1, 2, 3, 0, 1]
    bars = spark.createDataFrame([("a", "2024-01-05", 1.0, 2.0), ("a", "2024-01-09", 3.0, 4.0)], "entity string, date string, p double, volume double").withColumn("date", F.to_date("date"))
    bars = bars.select("entity", "date", *[F.col("p").alias(c) for c in C.PRICES], "volume", F.lit(1.0).alias("amount"))
    full = C.complete(bars, weekdays_only=True).orderBy("date").collect()
    assert [(str(r.date), r.close, r.volume, r.filled) for r in full] == [("2024-01-05", 1.0, 2.0, False), ("2024-01-08", 1.0, 0.0, True), ("2024-01-09", 3.0, 4.0, False)]
    new = bars.filter("date = '2024-01-09'").withColumn("close", F.lit(7.0))
    assert sorted(r.close for r in C.upsert(bars, new, ["entity", "date"]).collect()) == [1.0, 7.0]
