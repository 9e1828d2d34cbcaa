"""Structure as it is known: prefixes, streams, an independent reading from whole prefixes, and points by brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from panelyte.operators import points, swing, swing_state
from panelyte.operators.swing_state import NAMES, Swings, known_structure, known_structure_stream
from panelyte.plans import QUERIES
from panelyte.plans.structure import known

BAR = "entity string, ord long, high double, low double, close double, volume double"


def walk(n, seed, scale=0.025):
    r, price, out = random.Random(seed), 100.0, []
    for i in range(n):
        price *= math.exp(r.gauss(0, scale) + 0.02 * math.sin(i / 9))
        out.append((i + 1, price * (1 + abs(r.gauss(0, 0.01))), price * (1 - abs(r.gauss(0, 0.01))), price, 1000 * math.exp(r.gauss(0, 0.4))))
    return out


def run(bars, apart=4):
    state = Swings(apart)
    return [state.step(*b) for b in bars]


def naive(bars, apart=4):
    """(strokes, segments, pivots) that a prefix settles, by passes over whole lists."""
    high, low = [b[1] for b in bars], [b[2] for b in bars]
    found = swing.fractals(swing.merge_contained(high, low)[:-1])[:-1]
    lines = swing.stroke_list(found, high, low, apart)
    parts, k = [], 0
    while True:
        way, end = (lines[k]["direction"], None) if k < len(lines) else (0, None)
        ahead = lambda s, w=way: w * s["high" if w > 0 else "low"]
        behind = lambda s, w=way: w * s["low" if w > 0 else "high"]
        for j in range(k + 3, len(lines), 2):  # counter strokes from the second on
            fresh = j - 1 > k + 2 and ahead(lines[j - 1]) > max(ahead(s) for s in lines[k + 2 : j - 1 : 2])
            if not fresh and behind(lines[j]) < behind(lines[j - 2]):
                end = j
                break
        if end is None:
            break
        own = lines[k:end]
        parts.append({"start": own[0]["start"], "end": own[-1]["end"], "high": max(s["high"] for s in own), "low": min(s["low"] for s in own), "known": 0, "direction": way})
        k = end
    return lines, parts, swing.pivot_list(parts)


@pytest.mark.parametrize("seed", range(4))
def test_known_swings_are_those_of_each_prefix(seed):
    bars = walk(420, seed, 0.02 + 0.01 * seed)
    rows = run(bars)
    for end in range(60, len(bars) + 1, 40):
        lines, parts, zones = naive(bars[:end])
        told = [r for r in rows[:end] if r["stroke_id"] is not None]
        assert [(r["stroke_start"], r["stroke_end"], r["stroke_way"]) for r in told] == [(s["start"] + 1, s["end"] + 1, s["direction"]) for s in lines]
        assert sum(r["segment_id"] is not None for r in rows[:end]) == len(parts)
        last = rows[end - 1]
        assert last["pivots"] == len(zones)
        if zones:
            z = zones[-1]
            assert (last["pivot_zg"], last["pivot_zd"], last["pivot_trend"], last["pivot_start"], last["pivot_segments"], last["pivot_level"]) == (z["zg"], z["zd"], z["trend"], z["start"] + 1, z["segments"], z["level"])
            assert last["pivot_end"] >= z["end"] + 1
    assert sum(r["stroke_id"] is not None for r in rows) > 5


def test_rows_do_not_change_with_what_comes_after(spark, sf):
    """The whole run's rows up to a bar are the rows of the prefix that ends there, on the given bars."""
    p = QUERIES["swing_structure"](spark, sf)
    whole = {(r.entity, r.ord): r for r in p.collect()}
    assert sum(r.pivots > 1 for r in whole.values()) > 0
    bars = spark.createDataFrame(p.select("entity", "date", "ord", "high", "low", "close").collect(), p.select("entity", "date", "ord", "high", "low", "close").schema)
    own = known_structure(bars)
    whole = {(r.entity, r.ord): r for r in own.collect()}
    for cut in (90, 201):
        got = known_structure(bars.filter(F.col("ord") <= cut)).collect()
        assert got and all(whole[r.entity, r.ord] == r for r in got)


def test_known_only_after_the_bars_that_settle_it():
    for seed in range(6):
        rows = run(walk(600, seed, 0.03))
        for i, r in enumerate(rows, 1):
            assert r["stroke_end"] is None or r["stroke_end"] < i - 1
            assert r["pivot_end"] is None or r["pivot_end"] < i - 1
            assert (r["top_ord"] or r["bottom_ord"] or 0) < i


def test_stream_goes_on_where_it_was(spark, tmp_path):
    bars = [(e, *b) for e, seed in (("a", 1), ("b", 2)) for b in walk(160, seed)]
    want = {(b[0], b[1]): tuple(r.values()) for e, seed in (("a", 1), ("b", 2)) for b, r in zip([(e, *b) for b in walk(160, seed)], run(walk(160, seed)), strict=True)}
    for n, (lo, hi) in enumerate(((0, 61), (55, 110), (110, 161))):  # the second batch repeats some bars
        spark.createDataFrame([b for b in bars if lo < b[1] <= hi], BAR).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        q = known_structure_stream(spark.readStream.schema(BAR).parquet(f"file://{tmp_path}/in")).writeStream.format("parquet").option("path", f"file://{tmp_path}/out{n}")
        q.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination() if n == 0 else None
        if n:
            known_structure_stream(spark.readStream.schema(BAR).parquet(f"file://{tmp_path}/in")).writeStream.format("parquet").option("path", f"file://{tmp_path}/out0").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out0").collect()
    assert len(got) == len(bars)
    for r in got:
        assert tuple(r[n] for n in NAMES) == want[r.entity, r.ord]


def test_odd_bars(spark):
    rows = [("a", k, *b[1:]) for k, b in enumerate(walk(80, 3), 1)] + [("a", 81, None, None, None, None), ("a", 82, 1.0, 1.0, 1.0, None), (None, 1, 5.0, 5.0, 5.0, 0.0)] + [("flat", k, 7.0, 7.0, 7.0, 0.0) for k in range(1, 90)]
    df = spark.createDataFrame([(*r, "x") for r in rows], BAR + ", pivots string")
    got = known_structure(df).collect()
    assert len(got) == len(rows)
    by = {(r.entity, r.ord): r for r in got}
    assert by["a", 81].stroke_direction == by["a", 80].stroke_direction and by["flat", 89].pivots == 0
    assert known_structure(df.limit(0)).collect() == []


def points_of(rows, bars):
    """Third, inside and wide points by their definitions, from pivots as rows tell them."""
    out, seen = [], {}
    for i, (r, b) in enumerate(zip(rows, bars, strict=True)):
        if r["pivot_changed"]:
            seen[r["pivot_id"]] = {"since": i, **{k: r[f"pivot_{k}"] for k in ("zg", "zd", "start", "end", "trend")}}
        found = {}
        if r["pivots"] and r["pivot_id"] in seen:
            p, (_, _, _, close, _) = seen[r["pivot_id"]], b
            off = abs(close - p["zd"]) / (p["zd"] + 1e-10)
            if i >= 60 and p["since"] < i < p["since"] + 30 and (p["zd"] <= close <= p["zg"] * 1.01 or off < 0.03) and (p["zg"] - p["zd"]) / (p["zd"] + 1e-10) > 0.03 and p["trend"] >= 0:
                found["b7_conf"] = min(0.65, max(0.20, 0.40 - off * 5))
            if r["pivots"] > 1 and p["end"] - p["start"] >= 20 and i < p["since"] + 15 and close > p["zg"]:
                found["wide_conf"] = min(0.65, max(0.25, 0.30 + (close - p["zg"]) / p["zg"] * 8))
        out.append(found)
    return out


def test_pivot_points_by_brute_force():
    kinds = dict.fromkeys(("b7_conf", "wide_conf", "b3_conf", "s3_conf", "s1_conf", "b1_conf"), 0)
    for seed in range(40):
        bars = walk(700, seed, 0.015 + 0.001 * seed)
        rows = run(bars)
        for r, want in zip(rows, points_of(rows, bars), strict=True):
            for name in ("b7_conf", "wide_conf"):
                assert r[name] == pytest.approx(want.get(name))
            for name in kinds:
                kinds[name] += r[name] is not None
    assert kinds["b7_conf"] and kinds["wide_conf"] and kinds["b3_conf"] + kinds["s3_conf"]


def test_first_points_by_divergence():
    """Two pivots down, the second with less |MACD|: a first buy below it for 20 bars; mirrored a first sell."""
    for way, closes, name in ((-1, (85.0, 84.0), "b1_conf"), (1, (111.0, 112.0), "s1_conf")):
        state = Swings()
        for k in range(60):
            state.step(k + 1, 98.0, 96.0, 97.0, 100.0)
        at = lambda bar, area, close: {"ord": bar + 1, "bar": bar, "area": area, "back": (area, close), "close": close}
        for k, (zg, zd, a, z) in enumerate([(100.0, 95.0, 0.0, 10.0), (92.0, 88.0, 10.0, 14.0)] if way < 0 else [(100.0, 95.0, 0.0, 10.0), (108.0, 104.0, 10.0, 14.0)]):
            first, last = at(10 * k, a, 97.0), at(10 * k + 9, z, 97.0 + 5 * way)
            pivot = {"id": k, "start": first, "end": last, "zg": zg, "zd": zd, "trend": way * k, "segments": 3, "touching": 3, "since": state.n - 1, "rank": 0}
            state.pivots.append(pivot)
            state.directed.append(pivot)
        state.pivot_count = 2
        out = [state.step(61 + k, c + 0.1, c - 0.1, c, 100.0) for k, c in enumerate(closes * 12)]
        divergence = min(1.0, (1 - 4 / 10) * 2)
        off = (88 - closes[0]) / closes[0] if way < 0 else (closes[0] - 108) / 108
        assert out[0]["area_divergence"] == pytest.approx(divergence, abs=1e-6)
        assert out[0][name] == pytest.approx(min(0.9, 0.35 + 0.10 + divergence * 0.3 + off * 10), abs=1e-6)
        assert sum(r[name] is not None for r in out) == 19


def after_pivot(changes, volumes=None, zg=100.0, zd=95.0):
    """Rows of bars (high, low, close) after a pivot that has just become known."""
    state = Swings()
    snap = {"ord": 1, "bar": 0, "area": 1.0, "back": (0.0, 90.0), "close": 97.0}
    for k, b in enumerate([(98, 96, 97)] * 30):
        state.step(k + 1, *map(float, b), 100.0)
    state.pivots.append({"id": 0, "start": snap, "end": snap | {"bar": 5}, "zg": zg, "zd": zd, "trend": 0, "segments": 3, "touching": 3, "since": state.n - 1, "rank": 0})
    state.pivot_count = 1
    return [state.step(31 + k, *map(float, b), v) for k, (b, v) in enumerate(zip(changes, volumes or [100.0] * len(changes), strict=True))]


def test_leave_and_return():
    out = after_pivot([(104, 101, 103), (103, 100, 101)], [200.0, 100.0])
    assert out[0]["b3_conf"] is None and out[1]["b3_conf"] == pytest.approx(0.4 + 0.04 * 8 + 0.01 * 5)
    assert after_pivot([(104, 101, 103), (103, 100, 101)], [105.0, 100.0])[1]["b3_conf"] is None  # not loud enough
    assert after_pivot([(104, 101, 103), (103, 97, 101)], [200.0, 100.0])[1]["b3_conf"] is None  # falls back into the pivot
    late = after_pivot([(104, 101, 103)] + [(106, 104, 105)] * 5 + [(103, 100, 101)], [200.0] + [100.0] * 6)
    assert all(r["b3_conf"] is None for r in late)  # comes back too late
    out = after_pivot([(94, 92, 92.5), (95, 93, 93.5)])
    assert out[1]["s3_conf"] == pytest.approx(min(0.85, 0.4 + 2.5 / 95 * 8 + 1.5 / 95 * 5))
    assert after_pivot([(94, 92, 92.5), (97, 93, 95.5)])[1]["s3_conf"] is None  # back inside


def test_quality_and_second_points_by_brute_force(spark):
    rows = [(e, d, *b) for e in ("a", "b", "c") for d, b in enumerate(walk(500, ord(e), 0.03))]
    df = spark.createDataFrame([(r[0], r[1], *map(float, r[3:]), r[2]) for r in rows], "entity string, date long, high double, low double, close double, volume double, ord long")
    df = df.withColumn("ema20", F.col("close")).withColumn("macd_hist", F.sin(F.col("ord") / 7))
    p = points.second_points(points.fractal_quality(points.first_points(swing_state.known_structure(swing.window_points(df)))))
    got = sorted(points.stop_prices(points.agreeing_levels(p)).collect(), key=lambda r: (r.entity, r.ord))
    assert len(got) == len(rows)
    best, tops, last = 0.0, [], None
    for r in got:
        if r.entity != last:
            best, tops, last = 0.0, [], r.entity
        best *= points.BOTTOM_DECAY
        if r.bottom_q is not None:
            best = max(best, r.bottom_q * points.BOTTOM_DECAY ** (r.ord - r.bottom_ord))
        if r.top_q is not None:
            tops.append((r.ord, r.top_ord, r.top_q))
        top = max((q * points.TOP_DECAY ** (r.ord - at) for told, at, q in tops if r.ord - told <= points.TOP_BARS and r.ord - at <= points.TOP_BARS), default=0.0)
        assert r.bottom_quality == pytest.approx(best, abs=1e-12) and r.top_quality == pytest.approx(top, abs=1e-12)
    bars = {(r.entity, r.ord): r for r in got}
    seconds = [r for r in got if r.second_buy_confidence is not None]
    assert seconds and any(r.second_sell_confidence is not None for r in got)
    for r in seconds:  # what a second buy promises
        first, now = bars[r.entity, r.second_buy_first], bars[r.entity, r.bottom_ord]
        assert 5 <= r.bottom_ord - r.second_buy_first < 50 and now.low > first.low * 0.98 and 0.35 <= r.second_buy_confidence <= 0.95
        crest = max(bars[r.entity, k].high for k in range(first.ord, min(first.ord + 15, r.ord + 1)))
        assert crest > first.close * 1.01 and now.close <= crest * 0.97
        assert any(x.stroke_way == 1 and x.stroke_start > first.ord and x.stroke_end < now.ord and x.ord <= r.ord for x in got if x.entity == r.entity)
    assert {r.signal_level for r in got} >= {-2, -1, 0, 1, 2}
    for r in got:
        level = r.signal_level
        assert (level >= 2) <= r.confirmed_buy and (level <= -2) <= r.confirmed_sell
        assert r.stop_price < r.close or r.stop_reason.endswith("high") or r.stop_price <= r.low


def test_every_kind_of_point_is_reached(spark, sf):
    """Window points and pivot points meet in one table on the given bars."""
    p = known(spark, sf.replace("sf0.001", "sf0.01"))
    kinds = {r.buy_point for r in points.first_points(p).select("buy_point").distinct().collect()}
    assert {0, 1} < kinds and len(kinds) >= 5


def test_top_volume_by_brute_force(spark):
    bars = walk(500, 21, 0.03)
    df = spark.createDataFrame([("a", b[0], *map(float, b[1:]), b[0]) for b in bars], BAR + ", date long")
    rows = points.top_fractal_volume(known_structure(df)).orderBy("ord").collect()
    tops, seen = [], set()
    for r in rows:
        want = 0.0
        if r.top_ord is not None:
            volume = max(b[4] for b in bars[max(0, r.top_ord - 4) : r.top_ord])
            near = [t for t in tops[-2:] if r.top_ord - t[0] < 60]
            if r.top_ord > 30 and near and r.top_ord - tops[-1][0] < 60:
                share = volume / tops[-1][2]
                want = (-0.8 if len(near) > 1 and bars[r.top_ord - 1][3] > tops[-1][1] else -0.4) if share < 0.7 else 0.5 if share > 2 else 0.0
            tops.append((r.top_ord, bars[r.top_ord - 1][3], volume))
        assert r.top_fractal_volume == want
        seen.add(want)
    assert len(seen) >= 3
