"""The factor registry: what it plans, what it leaves out, and that values do not depend on what else is wanted."""

import pytest
from pyspark.sql import functions as F

from panelyte.operators import factors as FA
from panelyte.operators.catalogue import REGISTRY
from panelyte.operators.registry import Registry
from panelyte.plans.kernels import panel


@pytest.fixture(scope="module")
def bars(spark, sf):
    rows = panel(spark, sf).drop("ret", "grp").withColumn("turnover", F.col("volume") / 100)
    return spark.createDataFrame(rows.collect(), rows.schema)


def nodes(df, word):
    return df._jdf.queryExecution().executedPlan().toString().count(word)


def test_three_factors_of_two_families_share_one_exchange(spark, bars):
    p = REGISTRY.plan(bars, ["gap_ratio", "rsi_14", "mom_x_lowvol_10_20"])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert nodes(p, "Exchange hashpartitioning(entity") == 1
        assert nodes(p, "FlatMapGroupsInPandas") == 0  # no exponential mean is made
        q = REGISTRY.plan(bars, ["ema_trend_strength", "macd_hist", "gap_ratio"])
        assert nodes(q, "FlatMapGroupsInPandas") == 1 and nodes(q, "Exchange hashpartitioning(entity") == 2  # one for the means, one for the windows
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_stages_are_as_few_as_the_depth(bars):
    stages = REGISTRY.stages(["gap_ratio", "price_ma_60", "mom_20"], bars.columns)
    assert len(stages) <= 3 and sum(s is not None for s, _ in stages) == 1
    names = {n for _, added in stages for n in added}
    assert "ema20" not in names and {"gap", "mom_20"} <= names
    assert REGISTRY.stages(["close"], bars.columns) == []
    spans = REGISTRY.stages(["ema20_above_60", "ema120"], bars.columns)
    assert [sorted(n) for s, n in spans if s is not None] == [["ema120", "ema20", "ema60"]]  # one pass for all spans


def test_values_are_those_of_the_families(bars):
    wanted = ["ma_alignment", "rsi_8", "bb_rsi_combo", "volatility_skew", "consec_limit_up", "limit_pullback_score", "trend_initiation", "V41_RSI_915", "ema20_slope"]
    got = {(r.entity, r.date): r for r in REGISTRY.plan(bars, wanted).collect()}
    p = FA.limit_pullback(FA.with_flow(FA.exponential(FA.with_volatility(FA.prepare(bars)))))
    p = p.withColumn("ma5", FA.W.sma(F.col("close"), 5)).withColumn("slope5", F.when(FA.W.lag(F.col("ma20"), 5) > 0, (F.col("ma20") - FA.W.lag(F.col("ma20"), 5)) / (FA.W.lag(F.col("ma20"), 5) + FA.EPS)))
    every = {}
    for family in (FA.trend_family, FA.oscillator_family, FA.momentum_family, FA.volume_family, FA.shape_family, FA.initiation_family):
        every |= family(p)
    whole = p.select("entity", "date", "limit_pullback_score", *[every[c].alias(c) for c in wanted if c != "limit_pullback_score"]).collect()
    assert len(whole) == len(got) > 0
    for r in whole:
        for c in wanted:
            a, b = r[c], got[r.entity, r.date][c]
            assert a == b or abs(a - b) < 1e-12


def test_registering_and_asking(spark, bars):
    mine = Registry()

    @mine.factor("up")
    def up():
        return F.col("close") - F.col("low{}".format(""))

    @mine.factor("twice_{n}")
    def twice(n):
        return F.col("up") * n

    @mine.family
    def both(rows):
        return {"x": F.col("up") + 1, "y": F.col("z") + 1}

    @mine.step(("z",), needs=("up",))
    def add_z(rows, names):
        return rows.withColumn("z", F.col("up") + 5)

    assert mine.names() == ["up", "x", "y"] and mine.get("nothing") is None and mine.get("twice_3") is not None
    assert [(s is None, n) for s, n in mine.stages(["y", "twice_3"], bars.columns)] == [(True, ["up"]), (False, ["z"]), (True, ["twice_3"]), (True, ["y"])]
    row = mine.plan(bars, ["y", "twice_3"], ("entity", "close", "low")).first()
    assert row.twice_3 == 3 * (row.close - row.low) and row.y == row.close - row.low + 6
    with pytest.raises(KeyError, match="no factor nothing"):
        mine.plan(bars, ["nothing"])
    with pytest.raises(ValueError, match="already"):
        mine.factor("up")(up)
    mine.factor("a")(lambda: F.col("b") + 1)
    mine.factor("b")(lambda: F.col("a") + 1)
    with pytest.raises(ValueError, match="a needs b needs a"):
        mine.plan(bars, ["a"])
