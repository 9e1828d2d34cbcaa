"""Learning, library steps and small operators that SQL does not reach, on small frames."""

import random

from pyspark.sql import functions as F

from panelyte.operators import evaluate as EV
from panelyte.operators import flows as FL
from panelyte.operators import fundamentals as FU
from panelyte.operators import ic as IC
from panelyte.operators import library as LB
from panelyte.operators import ml
from panelyte.operators import reports as RP
from panelyte.operators import select as S
from panelyte.operators import signals as SG
from panelyte.operators.asof import in_interval


def panel(spark, dates=60, entities=12):
    rnd = random.Random(4)
    rows = [(f"e{e}", d, x := rnd.gauss(0, 1), rnd.gauss(0, 1), 0.8 * x + rnd.gauss(0, 0.5)) for d in range(dates) for e in range(entities)]
    return spark.createDataFrame(rows, "entity string, day int, a double, b double, target double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")))


def test_rolling_retrain_learns_and_is_saved(spark, tmp_path):
    wide, more = ml.crossed(panel(spark).withColumn("regime", F.lit(1)), ["a", "b"], 2, "regime")
    assert more == ["a_x_b", "a_x_regime", "b_x_regime"]
    rows = ml.prepare(wide, ["a", "b", *more])
    out = ml.rolling_retrain(rows, 15, 30, 2, seeds=(1,), trees=4)
    scored = out.join(rows.select("entity", "date", "target"), ["entity", "date"])
    dates = [r.date for r in rows.select("date").distinct().orderBy("date").collect()]
    assert out.agg(F.min("date")).first()[0] == dates[32] and out.count() == (60 - 32) * 12
    assert scored.select(IC.pearson("prediction", "target").alias("c")).first().c > 0.5
    models = ml.train(rows, seeds=(1, 2), trees=3)
    ml.save(models, f"file://{tmp_path}/m")
    again = ml.load(spark, f"file://{tmp_path}/m")
    first, second = (sorted((r.entity, str(r.date), r.prediction) for r in ml.predict(m, rows).collect()) for m in (models, again))
    assert first == second and ml.importance(again, ["a", "b", *more])[0][0] in ("a", "a_x_regime")


def test_selected_sets_and_extension(spark):
    dates = spark.createDataFrame([(d, d) for d in range(1, 11)], "date int, ord int")
    chosen = spark.createDataFrame([(3, "f", 0.5), (3, "g", 0.5), (7, "h", 1.0)], "date int, factor string, weight double")
    got = {r.date: (r.chosen_on, r.factors) for r in LB.selected_as_of(dates.select("date"), chosen).collect()}
    assert got[3] == (None, None) and got[4] == (3, ["f", "g"]) and got[7] == (3, ["f", "g"]) and got[8] == (7, ["h"])
    whole = lambda cal: cal.select("date", F.sum("ord").over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)).orderBy("ord").rowsBetween(-2, 0)).alias("s"))
    known = whole(dates).filter("date <= 6")
    assert sorted(map(tuple, LB.extend(known, dates, whole, 2).collect())) == sorted(map(tuple, whole(dates).collect()))
    default = spark.createDataFrame([("z", 1.0)], "factor string, weight double")
    config = spark.createDataFrame([(3, "c", 1.0), (5, "c", 1.0)], "date int, factor string, weight double")
    sources = {r.date: (r.source, r.n) for r in LB.scoring_factors(chosen, config, default, dates.select("date")).groupBy("date", "source").agg(F.count("*").alias("n")).collect()}
    assert sources[3] == ("store", 2) and sources[5] == ("config", 1) and sources[1] == ("default", 1) and len(sources) == 10


def test_profit_screen(spark):
    cases = {"worse": [(-5, -1), (-20, -1), (-40, -1)], "better": [(-33, -5), (-27, 3), (-11, 4)], "hollow": [(-33, -5), (-27, -4), (-11, -3)], "mixed": [(-5, 0), (3, 0), (-40, 0)], "short": [(-5, -1), (-40, -1)]}
    rows = [(e, i, i + 1, float(p), float(r)) for e, ps in cases.items() for i, (p, r) in enumerate(ps)]
    df = spark.createDataFrame(rows, "entity string, period int, available int, profit_growth double, revenue_growth double")
    known = FU.with_history(df, ["profit_growth", "revenue_growth"]).withColumn("bad", FU.declining(F.col("last_profit_growth"), F.col("last_revenue_growth"), F.col("reports")))
    last = {r.entity: r.bad for r in known.orderBy("available").collect()}
    assert last == {"worse": True, "better": False, "hollow": True, "mixed": False, "short": False}


def test_median_exposure_of_the_rows_that_count(spark):
    """Rows without what follows, or without exposure, do not move the median between high and low."""
    rows = [(0.1, 1.0), (0.2, 3.0), (0.3, 2.0), (0.4, 6.0)]
    more = [(0.9, None), (0.8, None), (0.7, None), (None, 50.0), (None, None)]
    frame = lambda rs: spark.createDataFrame(rs, "exposure double, target double")
    got, alone = RP.position_quality(frame(rows + more)).first(), RP.position_quality(frame(rows)).first()
    assert (got.n, got.high, got.low, got.gap) == (4, 4.0, 2.0, 2.0) and got == alone
    none = RP.position_quality(frame(more)).first()
    assert none.n == 0 and none.high is None and none.low is None


def test_decisions_by_kind_of_buy_point(spark):
    rows = [(f"k{k}", 100, k, level, trend, 10.0, 9.9, 9.0, 0.2, 1.0, -0.35, False, 0.0) for k, level, trend in ((0, 0, 0), (3, 0, 1), (3, 1, 1), (3, 1, -2), (7, 1, 0), (7, 2, 0), (6, 1, 0), (6, 1, -1), (8, 1, 0))]
    names = "entity string, ord int, buy_point int, signal_level int, trend_type int, close double, ma20 double, ma60 double, score double, quality double, sell_threshold double, rejected boolean, ret double"
    got = [r.buy for r in SG.decide(SG.defaults(spark.createDataFrame(rows, names).withColumn("confirmed_buy", F.lit(True)))).collect()]
    assert got == [True, False, True, False, False, True, True, False, False]
    held = SG.defaults(spark.createDataFrame([("a", 100, 10.0, 11.0, 12.0, s, q, -0.35, rej, 0.0) for s, q, rej in ((-0.4, 1.0, False), (-0.1, 1.0, False), (0.1, 0.5, False), (-0.1, 0.5, False), (None, 1.0, False), (0.2, 1.0, True))], "entity string, ord int, close double, ma20 double, ma60 double, score double, quality double, sell_threshold double, rejected boolean, ret double"))
    out = SG.decide(held).collect()
    assert [r.sell for r in out] == [True, True, False, True, False, False] and not any(r.buy for r in out)


def test_ks_distance_by_brute_force(spark):
    rnd = random.Random(2)
    data = [(round(rnd.gauss(0, 1), 2), True) for _ in range(700)] + [(round(rnd.gauss(0.4, 1.2), 2), False) for _ in range(500)] + [(None, True)]
    a, b = sorted(x for x, s in data if s and x is not None), sorted(x for x, s in data if not s)
    want = max(abs(sum(x <= v for x in a) / len(a) - sum(x <= v for x in b) / len(b)) for v in {*a, *b})
    df = spark.createDataFrame(data, "x double, side boolean")
    assert all(abs(EV.ks_distance(df, "x", F.col("side"), cells).first().ks - want) < 1e-12 for cells in (2, 8, 256))


def test_flow_falls_back_without_amounts(spark):
    rows = [(d, None, 2.0, 1.0) for d in range(1, 9)]
    out = FL.market_flow(spark.createDataFrame(rows, "date int, net_flow double, lead_change double, index_change double")).orderBy("date").collect()
    assert [r.signal for r in out[:4]] == [0.0] * 4 and 0 < out[-1].signal < 1


def test_weights_of_tired_names_and_groups(spark):
    rows = spark.createDataFrame([("a", 0.20, 0.7, 0.10, 1.0, None), ("b", 0.20, 0.5, None, 0.5, 1.1), ("c", 0.20, 0.1, 0.01, None, None)], "entity string, w double, risk double, ic double, conf double, sent double")
    got = rows.select(S.tired(F.col("w"), F.col("risk")).alias("t"), S.ic_multiplier(F.col("ic"), F.col("conf"), F.col("sent")).alias("m")).collect()
    assert [round(r.t, 9) for r in got] == [0.05, 0.12, 0.2] and [round(r.m, 9) for r in got] == [1.5, 0.55, 0.6]


def test_resonance_counts_agreeing_systems(spark):
    rows = SG.defaults(spark.createDataFrame([(0.1, 0.6, 1, 0.4, 1), (-0.5, 0.4, -1, 0.1, -1), (0.0, 0.6, 0, 0.4, 0)], "score double, capital_flow_score double, capital_flow_direction int, news_score double, news_direction int"))
    buys, sells = SG.resonance(F.col("score"))
    assert [(r.b, r.s) for r in rows.select(buys.alias("b"), sells.alias("s")).collect()] == [(3, 0), (0, 2), (0, 0)]


def test_rows_meet_the_spans_they_lie_in(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 5), ("b", 5)], "k string, t int")
    spans = spark.createDataFrame([("a", 1, 5, "x"), ("a", 5, 9, "y"), ("c", 0, 9, "z")], "k string, lo int, hi int, name string")
    assert sorted((r.k, r.t, r.name) for r in in_interval(rows, spans, ["k"], "t", "lo", "hi").collect()) == [("a", 1, "x"), ("a", 5, "x"), ("a", 5, "y")]


def test_small_records(spark, tmp_path):
    from pyspark.sql import functions as F

    from panelyte.operators import records as RE
    from panelyte.sources import files

    (tmp_path / "alt.csv").write_text("代码,日期,买入\n600000,20240102,1.5\n600000,20240103,x\n600001,20240102,2\n")
    rows = files.read_mapped(spark, f"file://{tmp_path}/alt.csv", {"代码": "entity", "日期": "date", "买入": "bought", "缺": "sold"}, date_format="yyyyMMdd")
    assert sorted((r.entity, str(r.date), r.bought, r.sold) for r in rows.collect()) == [("600000", "2024-01-02", 1.5, None), ("600000", "2024-01-03", None, None), ("600001", "2024-01-02", 2.0, None)]
    assert {r.entity: r.n for r in files.event_history(rows.unionAll(rows)).collect()} == {"600000": 2, "600001": 1}
    log = files.History(spark, f"file://{tmp_path}/h")
    for run, ic in (("1", 0.1), ("2", 0.2), ("2", 0.3)):
        log.append(spark.createDataFrame([(ic,)], "ic double"), run)
    assert sorted((r.run, r.ic) for r in log.read().collect()) == [(1, 0.1), (2, 0.3)]
    p = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "entity string, date int")
    known = spark.createDataFrame([("a", 2, 0.5), ("a", 4, 0.7)], "entity string, date int, prediction double")
    assert {(r.entity, r.date): r.prediction for r in RE.predictions_as_of(p, known).collect()} == {("a", 1): 0.0, ("a", 5): 0.7, ("b", 3): 0.0}
    wide = spark.createDataFrame([(1, 2, 3, 4)], "entity int, x_rank int, noise int, keep int")
    assert RE.without(wide, ("noise",), (), ("_rank",)).columns == ["entity", "keep"] and RE.without(wide).columns == wide.columns
    sample = lambda n: [r.id for r in RE.seeded_sample(spark.range(1000).repartition(n), "id", 3, 20).collect()]
    assert sample(1) == sample(7) and len(set(sample(3))) == 20
    order = RE.locked_first(spark.createDataFrame([("a", False, 3.0), ("b", True, 1.0), ("c", False, None)], "entity string, lock boolean, score double"), [F.lit(1)], "lock", F.col("score"))
    assert [r.entity for r in order.orderBy("place").collect()] == ["b", "a", "c"]
