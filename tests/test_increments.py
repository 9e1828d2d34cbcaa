"""Stores that grow: two runs equal one, restated bars, repeated batches, restated sentiment."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelyte.plans.research import FACTORS, factor_panel
from panelyte.sources.increments import BarTable, ICStore, SentimentStore, latest_means


@pytest.fixture(scope="module")
def panel(spark, sf):
    rows = factor_panel(spark, sf).select("entity", "date", *FACTORS, "target")
    return spark.createDataFrame(rows.collect(), rows.schema)


def rows_of(df):
    return sorted(tuple(round(x, 10) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_two_runs_equal_one(spark, panel, tmp_path):
    days = [r.date for r in panel.select("date").distinct().orderBy("date").collect()]
    asked = []

    def spans(first, last):
        asked.append((first, last))
        return panel.filter(F.col("date").between(F.lit(first), F.lit(last)))

    calendar = lambda k: spark.createDataFrame([(d,) for d in days[:k]], "date date")
    one = ICStore(spark, f"file://{tmp_path}/one", FACTORS, 5, 20)
    assert one.update(calendar(320), spans) == 320
    two = ICStore(spark, f"file://{tmp_path}/two", FACTORS, 5, 20)
    for k in (280, 300, 300, 320):
        before = len(asked)
        added = two.update(calendar(k), spans)
        assert (added == 0) == (len(asked) == before)
    assert rows_of(two.ics()) == rows_of(one.ics()) and rows_of(two.selected()) == rows_of(one.selected())
    assert one.ics().count() > 0 and one.selected().count() > 0
    assert asked[-1][0] >= days[300 - 5 - 20]  # the last run asks for the slice that its windows need
    plan = two.ics(days[290])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "month" in plan.split("PartitionFilters")[1][:120]
    # a run that died before its ledger leaves nothing to read, and is replaced
    spark.createDataFrame([(days[0], "junk", 9.0, 1)], "date date, factor string, ic double, n long").withColumn("month", F.date_format("date", "yyyy-MM")).withColumn("run", F.lit(3)).write.mode("append").partitionBy("month", "run").parquet(f"file://{tmp_path}/two/ics")
    assert two.ics().filter("factor = 'junk'").count() == 0


def bar(entity, day, close):
    return (entity, dt.date(2024, 1, day), close, close, close, close, 1.0)


def test_restated_bars_reload_once(spark, tmp_path):
    full = {"a": [bar("a", d, 10.0 + d) for d in range(1, 8)], "b": [bar("b", d, 5.0 + d) for d in range(1, 8)]}
    asked = []

    def history(entities):
        names = [r.entity for r in entities.collect()]
        asked.append(sorted(names))
        return spark.createDataFrame([r for n in names for r in full[n]], BarTable.ROW)

    t = BarTable(spark, f"file://{tmp_path}/t", history)
    make = lambda rows: spark.createDataFrame(rows, BarTable.ROW)
    t.apply(make([bar("a", d, 20.0 + 2 * d) for d in range(1, 5)] + full["b"][:4]), 0)
    assert t.read().count() == 8 and asked[-1] == []
    second = make([bar("a", 4, 14.0), bar("a", 5, 15.0)] + full["b"][2:5] + [bar("b", 5, 10.0)])
    assert {r.entity: r.action for r in t.decide(second, 1).collect()} == {"a": "reload", "b": "append"}
    for _ in range(2):  # run twice: counts once
        t.apply(second, 1)
        got = sorted((r.entity, r.date.day, r.close) for r in t.read().collect())
        assert got == [("a", d, 10.0 + d) for d in range(1, 8)] + [("b", d, 5.0 + d) for d in range(1, 6)]
    assert asked[1:] == [["a"], ["a"]]
    third = make(full["a"][3:] + full["b"][:3])
    assert {r.entity: r.action for r in t.decide(third, 2).collect()} == {"a": "skip", "b": "skip"}
    t.apply(third, 2)
    t.apply(make([bar("a", 8, 18.0), bar("c", 1, 1.0)]), 3)
    assert t.read().filter("entity = 'a'").count() == 8 and t.read().filter("entity = 'c'").count() == 1
    assert t.read().groupBy("entity", "date").count().filter("count > 1").count() == 0


def test_restated_bars_from_a_stream(spark, tmp_path):
    t = BarTable(spark, f"file://{tmp_path}/t", lambda e: e.select("entity", F.lit("2024-01-01").cast("date").alias("date"), *[F.lit(7.0).alias(c) for c in ("open", "high", "low", "close", "volume")]))
    for n, rows in enumerate(([bar("a", 1, 1.0), bar("a", 2, 2.0)], [bar("a", 2, 2.0), bar("a", 3, 3.0)], [bar("a", 3, 9.0)])):
        spark.createDataFrame(rows, BarTable.ROW).coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        t.stream(spark.readStream.schema(BarTable.ROW).option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in"), f"file://{tmp_path}/c").awaitTermination()
        assert t.read().count() == (2, 3, 1)[n]


def test_sentiment_is_restated_by_group(spark, tmp_path):
    store, rnd, held = SentimentStore(spark, f"file://{tmp_path}/s"), random.Random(3), {}
    assert store.read().count() == store.latest_mean().count() == 0
    for batch in range(6):
        rows = [(dt.date(2024, 1, rnd.randrange(1, 9)), rnd.choice("xyz"), round(rnd.uniform(-1, 1), 4)) for _ in range(5)]
        rows = list({r[:2]: r for r in rows}.values())
        for _ in range(2):
            store.save(spark.createDataFrame([(*r, 0.5, 2) for r in rows], "date date, industry string, score double, importance double, news int"), batch)
        held |= {r[:2]: r[2] for r in rows}
        assert {(r.date, r.industry): r.score for r in store.read().collect()} == held
        first = max(d for d, _ in held) - dt.timedelta(3)
        want = {i: [s for (d, j), s in held.items() if j == i and d >= first] for i in {j for d, j in held if d >= first}}
        assert {r.industry: round(r["mean"], 9) for r in store.latest_mean(3).collect()} == {i: round(sum(s) / len(s), 9) for i, s in want.items()}
    wide = {r.date: r for r in store.pivot(dt.date(2024, 1, 3), dt.date(2024, 1, 6), ["x", "y", "z"]).collect()}
    for (d, i), s in held.items():
        if dt.date(2024, 1, 3) <= d <= dt.date(2024, 1, 6):
            assert wide[d][i] == s
    assert "PartitionFilters: [isnotnull(date" in store.read(dt.date(2024, 1, 3))._jdf.queryExecution().executedPlan().toString()


def test_latest_means_equal_a_window_after_restated_days(spark, tmp_path):
    rows, seen = [], []
    for n in range(4):
        rows.append([(f"2024-01-{d:02d}", "x", float(10 * n + d)) for d in range(1 + 2 * n, 5 + 2 * n)])
        spark.createDataFrame(rows[-1], "date string, industry string, score double").coalesce(1).write.parquet(f"file://{tmp_path}/in/{n}")
        source = spark.readStream.schema("date string, industry string, score double").option("recursiveFileLookup", "true").parquet(f"file://{tmp_path}/in")
        out = []
        q = latest_means(source, 3).writeStream.outputMode("update").foreachBatch(lambda df, i: out.extend(df.collect())).option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()  # noqa: B023
        q.awaitTermination()
        seen.append({r.industry: r["mean"] for r in out})
        kept = {d: s for batch in rows for d, _, s in batch}  # the last batch's score of a date counts
        table = spark.createDataFrame([(d, "x", s) for d, s in kept.items()], "date string, industry string, score double")
        last = table.withColumn("mean", F.avg("score").over(Window.partitionBy("industry").orderBy("date").rowsBetween(-2, 0))).orderBy(F.desc("date")).first()
        assert seen[-1] == {"x": last["mean"]}
