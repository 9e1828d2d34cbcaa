"""File readers, stores, streams, swings, selection on small hand-made frames."""

import json

from pyspark.sql import functions as F

from panelyte.operators import groups as G
from panelyte.operators import select as S
from panelyte.operators import swing
from panelyte.sources import files
from panelyte.streaming.bars import compact, hourly, latest, running_means, upsert_stream


def test_bar_files_prefer_the_first_kind(spark, tmp_path):
    head = "datetime,open,high,low,close,volume,openinterest,amount,amplitude,change_percent,change_amount,turnover_rate\n"
    for name, close in (("600000_qfq", 1.0), ("600000_hfq", 2.0), ("600001_hfq", 3.0), ("600002_none", 4.0)):
        (tmp_path / f"{name}.csv").write_text(head + f"2024-01-02,1,1,1,{close},1,0,1,0,0,0,0\n")
    assert sorted((r.entity, r.kind, r.close) for r in files.read_bars(spark, f"file://{tmp_path}").collect()) == [("600000", "qfq", 1.0), ("600001", "hfq", 3.0)]


def test_raw_bars_and_factors(spark, tmp_path):
    for kind, close in (("none", 2.0), ("qfq", 1.0), ("hfq", 4.0)):
        (tmp_path / "600000").mkdir(exist_ok=True)
        (tmp_path / "600000" / f"{kind}.csv").write_text(f"日期,开盘,收盘\n2024-01-02,1,{close}\n2024-01-03,x,\n")
    raw = files.read_raw_bars(spark, f"file://{tmp_path}")
    assert raw.filter("open is null").count() == 3 and "turnover_rate" in raw.columns
    one = files.adjustment_factors(*[raw.filter(F.col("kind") == k) for k in ("none", "qfq", "hfq")]).filter("qfq_factor is not null").first()
    assert (one.entity, one.qfq_factor, one.hfq_factor) == ("600000", 0.5, 2.0)


def test_stores_configs_and_logs(spark, tmp_path):
    store = files.MetricStore(spark, f"file://{tmp_path}/m", ["k"])
    store.save(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"))
    store.save(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"))
    assert sorted((r.k, r.v) for r in store.read().collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([("g", "2024-02-01"), ("g", "2025-02-01"), ("h", "2024-02-01")], "grp string, date string")
    config = spark.createDataFrame([("g", "2024-01-01", "2024-03-31", "f1", 0.7)], "grp string, valid_from string, valid_to string, factor string, weight double")
    base = spark.createDataFrame([("g", "f0", 1.0), ("h", "f9", 0.5)], "grp string, factor string, weight double")
    assert sorted((r.grp, r.date, r.factor) for r in files.weights_as_of(rows, config, base).collect()) == [("g", "2024-02-01", "f1"), ("g", "2025-02-01", "f0"), ("h", "2024-02-01", "f9")]
    (tmp_path / "log.txt").write_text("2024-01-02 10:00 BUY 600000 x 300 @ 1.5\nnoise\n2024-01-03 SELL 600000 300 @ 2\n")
    assert [(r.side, r.qty, r.price) for r in files.parse_trades(spark, f"file://{tmp_path}/log.txt").orderBy("date").collect()] == [("BUY", 300, 1.5), ("SELL", 300, 2.0)]
    present = spark.createDataFrame([("2024-03-31", "a"), ("2024-03-31", "b"), ("2024-06-30", "a")], "period string, kind string").withColumn("period", F.to_date("period"))
    assert [str(r.period) for r in files.missing_periods(present, "2024-01-01", "2024-09-30", 2).orderBy("period").collect()] == ["2024-06-30", "2024-09-30"]
    news = spark.createDataFrame([("t", "2024-01-01"), ("u", "2024-01-02")], "text string, date string")
    files.write_news(news, f"file://{tmp_path}/news")
    assert files.read_news(spark, f"file://{tmp_path}/news", "2024-01-02").first().text == "u"
    a, b = files.fingerprint(news).first(), files.fingerprint(news.orderBy(F.desc("date"))).first()
    assert a == b


def test_hourly_bars_from_a_stream(spark, tmp_path):
    events = [(i, f"2024-01-01T{h:02d}:{m:02d}:00", "t", float(v)) for i, (h, m, v) in enumerate([(0, 1, 5), (0, 30, 9), (0, 59, 2), (1, 5, 4), (6, 0, 1)])]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(json.dumps(dict(zip(("event_id", "ts", "event_type", "value"), e, strict=True))) for e in events))
    schema = "event_id long, ts timestamp, event_type string, value double"
    stream = spark.readStream.schema(schema).json(f"file://{tmp_path}/in")
    q = hourly(stream).writeStream.format("memory").queryName("hours").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"file://{tmp_path}/c").start()
    q.awaitTermination()
    got = {str(r.start): (r.open, r.high, r.low, r.close, r.n) for r in spark.table("hours").collect()}
    assert got["2024-01-01 00:00:00"] == (5.0, 9.0, 2.0, 2.0, 3) and "2024-01-01 06:00:00" not in got
    assert hourly(spark.read.schema(schema).json(f"file://{tmp_path}/in")).count() == 3


def test_upsert_stream_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "u").mkdir()
    for n, rows in enumerate(([(1, "a"), (2, "b")], [(2, "c"), (3, None)])):
        (tmp_path / "u" / f"{n}.json").write_text("\n".join(json.dumps({"k": k, "v": v}) for k, v in rows))
        upsert_stream(spark.readStream.schema("k int, v string").json(f"file://{tmp_path}/u"), f"file://{tmp_path}/t", f"file://{tmp_path}/c").awaitTermination()
    table = spark.read.parquet(f"file://{tmp_path}/t")
    want = [(1, "a"), (2, "c"), (3, None)]
    assert table.filter("batch = 1").count() == 2 and sorted((r.k, r.v) for r in latest(table, ["k"]).collect()) == want
    compact(table, f"file://{tmp_path}/t2", ["k"])
    assert sorted((r.k, r.v) for r in latest(spark.read.parquet(f"file://{tmp_path}/t2"), ["k"]).collect()) == want


def test_running_means_go_on_from_their_state(spark, tmp_path):
    (tmp_path / "m").mkdir()
    for n, rows in enumerate(([("a", "2024-01-01", 1.0), ("a", "2024-01-02", 3.0), ("b", "2024-01-01", 5.0)], [("a", "2024-01-02", 99.0), ("a", "2024-01-03", 2.0)])):
        (tmp_path / "m" / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("entity", "date", "value"), r, strict=True))) for r in rows))
        means = running_means(spark.readStream.schema("entity string, date date, value double").json(f"file://{tmp_path}/m"), 1.0)
        means.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.entity, str(r.date), r["mean"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", "2024-01-01", 1.0), ("a", "2024-01-02", 2.0), ("a", "2024-01-03", 2.0), ("b", "2024-01-01", 5.0)]


def test_signals_reports_statements_and_reuse(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-02", True, 0.5), ("a", "2024-02-02", False, -0.5)], "entity string, date string, buy boolean, score double").withColumn("date", F.to_date("date"))
    path = f"file://{tmp_path}/signals"
    files.write_signals(rows, path)
    files.write_signals(rows.filter("date > '2024-02-01'").withColumn("score", F.lit(9.0)), path)
    got = files.read_signals(spark, path)
    assert sorted((str(r.date), r.score, r.sell, r.factor_name) for r in got.collect()) == [("2024-01-02", 0.5, None, None), ("2024-02-02", 9.0, None, None)]
    files.write_report(rows.withColumn("tags", F.array(F.lit("x"))), f"file://{tmp_path}/r")
    assert spark.read.csv(f"file://{tmp_path}/r", header=True).filter("tags = '[\"x\"]'").count() == 2
    for period in ("20231231", "20240331"):
        (tmp_path / "st" / period).mkdir(parents=True)
        (tmp_path / "st" / period / "main.csv").write_text(f"code,eps\n1,{period[-4:]}\n2,7\n")
    (tmp_path / "st" / "20231231" / "lrb.csv").write_text("code,cost\n1,5\n")
    all_of = files.read_statements(spark, f"file://{tmp_path}/st", ["main", "lrb"], "code")
    assert sorted((r.period, r.code, r.lrb_cost) for r in all_of.collect()) == [("20231231", "1", "5"), ("20231231", "2", None), ("20240331", "1", None), ("20240331", "2", None)]
    assert files.new_statements(all_of.filter("period = '20231231'"), all_of).count() == 4
    rows.write.parquet(f"file://{tmp_path}/bars")
    scan = files.of_entities(spark, f"file://{tmp_path}/bars", ["a"], ("2024-01-01", "2024-01-31"))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert scan.count() == 1 and "EqualTo(entity,a)" in plan and "GreaterThanOrEqual(date" in plan
    first = files.reused(rows, f"file://{tmp_path}/panel", [rows])
    again = files.reused(rows.limit(0), f"file://{tmp_path}/panel", [rows.orderBy("date")])
    assert first.count() == again.count() == 2


def test_swings_alternate_and_are_known_later(spark):
    path = [0, 2, 4, 6, 8, 6, 4, 2, 0, 2, 4, 6, 8, 10, 8, 6, 4, 3]
    df = spark.createDataFrame([("a", i, float(p) + 1, float(p)) for i, p in enumerate(path)] + [("b", 0, 1.0, 0.0)], "entity string, ord int, high double, low double")
    got = swing.strokes(df).orderBy("id").collect()
    assert [(r.start_ord, r.end_ord, r.direction) for r in got] == [(4, 8, -1), (8, 13, 1)]
    assert all(r.confirmed_ord > r.end_ord for r in got)
    assert swing.merge_contained([5, 4, 6], [1, 2, 3]) == [[0, 0, 5, 1], [1, 1, 4, 2], [2, 2, 6, 3]]
    assert swing.merge_contained([5, 6, 5.5], [1, 2, 3]) == [[0, 0, 5, 1], [1, 2, 6, 3]]


def zigzag(turns):
    """Bars of one step each through the turning prices, and the bar of each turn."""
    out, at = [], []
    for a, b in zip(turns, turns[1:]):
        out += [a + (b - a) * k / 5 for k in range(5)]
        at.append(len(out) - 5)
    return [*out, float(turns[-1])], [*at, len(out)]


def test_segments_and_pivots_on_a_zigzag(spark):
    turns = [5, 20, 10, 25, 15, 30, 18, 26, 12, 24, 10, 22, 14, 40, 30, 50, 36, 60, 20]
    path, at = zigzag(turns)
    df = spark.createDataFrame([("z", i, p + 0.5, p - 0.5) for i, p in enumerate(path)], "entity string, ord int, high double, low double")
    every = swing.swings(df).collect()
    lines = sorted((r for r in every if r.kind == "stroke"), key=lambda r: r.id)
    assert [(r.start_ord, r.end_ord, r.direction) for r in lines] == [(a, b, 1 if y > x else -1) for a, b, x, y in zip(at[1:-1], at[2:-1], turns[1:], turns[2:])]
    parts = sorted((r for r in every if r.kind == "segment"), key=lambda r: r.id)
    # each segment starts with its own direction, holds three strokes at least and touches the next one
    assert all(r.parts >= 3 and r.direction == lines[sum(p.parts for p in parts[: r.id])].direction for r in parts)
    assert all(a.end_ord <= b.start_ord for a, b in zip(parts, parts[1:]))
    for r in parts:
        inside = [s for s in lines if r.start_ord <= s.start_ord and s.end_ord <= r.end_ord]
        assert (r.high, r.low) == (max(s.high for s in inside), min(s.low for s in inside))
    zones = [r for r in every if r.kind == "pivot"]
    for z in zones:
        three = [p for p in parts if p.start_ord >= z.start_ord][:3]
        assert (z.high, z.low) == (min(p.high for p in three), max(p.low for p in three)) and z.high > z.low


def test_pivots_merge_and_trend():
    part = lambda start, high, low: {"start": start, "end": start + 1, "direction": 1, "high": high, "low": low, "strokes": 3, "known": start + 2}
    zones = swing.pivot_list([part(k, h, lo) for k, (h, lo) in enumerate([(10, 5), (9, 4), (8, 6), (8, 6.5), (20, 12), (19, 11), (18, 13)])])
    assert (zones[0]["zg"], zones[0]["zd"], zones[0]["segments"]) == (8, 6, 5) and zones[-1]["zd"] == 13 and zones[-1]["trend"] == 1
    assert swing.pivot_list([part(0, 3, 1), part(1, 6, 4)]) == []


def test_structure_never_looks_at_unfinished_pivots(spark):
    path, _ = zigzag([5, 20, 10, 25, 15, 30, 18, 26, 12, 24, 10, 22, 14, 40, 30, 50, 36, 60, 20, 35, 25, 45])
    df = spark.createDataFrame([("z", i, i, p + 0.5, p - 0.5, p, float(i % 7)) for i, p in enumerate(path)], "entity string, date int, ord int, high double, low double, close double, macd double")
    rows = swing.structure(df).orderBy("ord").collect()
    zones = swing.pivots(df.select("entity", "ord", "high", "low")).orderBy("id").collect()
    for r in rows:
        done = [z for z in zones if z.end_ord <= r.ord]
        want = 0 if not done else 1 if r.close > done[-1].zg else -1 if r.close < done[-1].zd else 0
        assert r.pivot_position == want
        assert r.pivot_present == any(z.start_ord <= r.ord <= z.end_ord for z in zones)


def test_weights_are_capped_and_parity_is_equal(spark):
    chosen = spark.createDataFrame([(1, "a", "g", 1, 0.1), (1, "b", "g", 2, 0.2), (1, "c", "h", 3, 0.4)], "date int, entity string, grp string, place int, vol double")
    w = {r.entity: r.weight for r in S.rank_weights(chosen, 0.5, 0.5, 0.6).collect()}
    assert abs(w["a"] + w["b"] - 0.6) < 1e-12 and max(w.values()) <= 0.5 and abs(w["c"] - 0.5 / 2.25) < 1e-12
    few = {r.entity: r.weight for r in S.rank_weights(chosen, 0.5, 0.2, 1.0, positions=6).collect()}
    assert max(few.values()) <= 0.3 + 1e-12 and abs(few["a"] - 0.3) < 1e-12
    p = [r.weight * r.vol for r in S.risk_parity(chosen, "vol").collect()]
    assert max(p) - min(p) < 1e-9
    orders = S.order_diff(spark.createDataFrame([("a", 0.5), ("b", 0.1)], "entity string, weight double"), spark.createDataFrame([("b", 1000), ("c", 5)], "entity string, qty int"), spark.createDataFrame([("a", 10.0), ("b", 10.0), ("c", 1.0)], "entity string, price double"), 10000.0)
    assert {r.entity: (r.have, r.want, r.side) for r in orders.collect()} == {"a": (0, 500, "buy"), "b": (1000, 100, "sell"), "c": (5, 0, "sell")}
    assert [r.c for r in spark.createDataFrame([("xSTEELy",), ("z",)], "t string").select(G.keyword_category(F.col("t"), [("STEEL", "m")]).alias("c")).collect()] == ["m", "other"]
