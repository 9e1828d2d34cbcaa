"""The decision on real structure, flows and reports: held against its rules in plain Python, row by row."""

import pytest

from panelyte.operators import signals as SG
from panelyte.plans import decision


@pytest.fixture(scope="module")
def rows(spark, sf):
    p = decision.decided_rows(decision.inputs(spark, sf.replace("sf0.001", "sf0.01")))
    return [r.asDict() for r in p.collect()]


def grade(rules, default):
    return next((g for ok, g in rules if ok), default)


def above(a, b):
    return a is not None and b is not None and a > b


def test_gates_vary_and_follow_their_rules(rows):
    for r in rows:
        level, point, trend, low = r["signal_level"], r["buy_point"], r["trend_type"], r["bottom_divergence"]
        begun = (low > 0.3 and r["zhongyin"] < 0.5 and trend != 0) or (r["trend_initiation"] > 0.2 and r["bottom_fractal_quality"] > 0.25 and r["bottom_fractal_vol_spike"] > 1.5)
        structure = grade(
            [(level >= 2 and r["confirmed_buy"], 1.0), (point == 1, 0.85), (point >= 2 or level >= 1, 0.72), (begun, 0.62), (r["zhongyin"] > 0.5 or r["pivot_present"] > 0.5, 0.5),
             (trend == -2 and point == 0 and level <= 0 and low < 0.2, 0.25)], 0.45)
        align, week, month = r["mtf_alignment_score"], r["weekly_trend_up"], r["monthly_trend_up"]
        frames = grade([(align > 0.35 or (week and month), 1.0), (align > 0.05 or week or month, 0.72), (align > -0.10, 0.5), (align > -0.25, 0.35)], 0.25)
        heat = grade([(r["concept_heat"] > 0.7, 1.0), (r["concept_heat"] > 0.5, 0.8), (r["concept_heat"] > 0.35, 0.6)], 0.4)
        valid = all(r[x] is not None and r[x] > 0 for x in ("close", "ma20", "ema20", "ema60"))
        up, bull = above(r["close"], r["ma20"]), above(r["ema20"], r["ema60"])
        whole = bull and above(r["ema60"], r["ema120"])
        trend_grade = grade([(valid and up and whole, 1.0), (valid and up and bull, 0.72), (valid and up, 0.5), (valid and bull, 0.38), (valid, 0.25)], 0.40)
        assert (r["gate_structure"], r["gate_frames"], r["gate_heat"], r["gate_trend"]) == (structure, frames, heat, trend_grade)
    for gate in ("gate_structure", "gate_frames", "gate_heat", "gate_trend"):
        assert len({r[gate] for r in rows}) > 1, gate
    assert len({r["buy_point"] for r in rows}) >= 6 and len({r["tag"] for r in rows}) >= 4


def decides(r):
    score, point, level, flow, entity = r["score"], r["buy_point"], r["signal_level"], r["entity_flow"], r["entity"]
    if r["ord"] <= 60 or score is None:
        return False, False
    sure = level >= 1 and r["confirmed_buy"]
    far = (r["close"] - r["ma20"]) / r["ma20"] if r["ma20"] and r["ma20"] > 0 else 1.0
    reach = 0.40 if point == 3 and sure and level >= 2 else 0.35 if point == 3 and sure else 0.30 if point == 1 and sure and level >= 2 else 0.25 if point == 1 and sure else 0.12 if point == 6 else 0.30
    found = point >= 1 or flow > 0.3
    buy = not r["rejected"] and score >= -0.05 and (found or above(r["close"], r["ma20"])) and far < reach and (found or score > 0)
    buy = buy and (r["trend_type"] != -2 or (point >= 1 and sure) or r["bottom_divergence"] > 0.3)
    tag = ("_F" if r["has_fundamental"] else "") + (r["style_regime"].replace("_", "")[:2].upper() if r["style_confidence"] > 0.3 else "") + ("V" if r["smart_money_flow"] > 0.15 else "")
    tag += ("D" if max(r["bottom_divergence"], r["top_divergence"]) > 0.3 else "") + (f"R{r['buy_systems']}" if r["buy_systems"] >= 2 else "")
    tag = tag or "_T"
    assert tag == r["tag"]
    if not entity.startswith("688"):
        factor = 0.80 if tag in SG.PREMIUM else max([1.0] + [k for part, k in SG.RESTRICTED.items() if part in tag])
        buy = buy and tag not in SG.BANNED and score >= r["buy_threshold"] * factor
    crash = r["ret"] is not None and r["ret"] <= -(0.195 if entity[:3] in ("688", "300") else 0.095)
    buy = (buy and not crash) or (flow > 0.3 and not r["rejected"] and not crash and level >= 2)
    least = SG.LEAST_LEVEL.get(point)
    if least is not None and (level < least or (point in SG.NO_FALL and r["trend_type"] < 0)):
        buy = False
    if point == 2 and r["divergence_strength"] < 0.10:
        buy = False
    broken = above(r["ma60"], r["close"]) and score < 0 and r["ma60"] > 0
    certain = (level <= -1 and r["confirmed_sell"]) or broken or (r["quality"] < 0.55 and score < 0) or (score < -0.20 and r["quality"] < 0.75)
    return bool(buy), score < r["sell_threshold"] or (score < 0 and certain)


def test_decisions_by_their_rules(rows):
    told = [(r, decides(r)) for r in rows]
    for r, (buy, sell) in told:
        assert (r["buy"], r["sell"]) == (buy, sell), (r["entity"], r["date"])
    assert sum(b for _, (b, _) in told) > 0 and sum(s for _, (_, s) in told) > 0


def test_the_quality_gate_rejects(spark):
    p = spark.createDataFrame([("688001", 0.05), ("000001", 0.05), ("000002", 0.2)], "entity string, score double")
    rows = p.selectExpr("*", "100 as ord", "0.1D as buy_threshold", "-0.35D as sell_threshold", "1.0D as quality", "false as rejected", "0.0D as ret", "10.0D as close", "9.5D as ma20", "9.0D as ma60", "2 as buy_systems", "3 as buy_point", "2 as signal_level")
    got = {r.entity: (r.tag, r.buy) for r in SG.decide(SG.defaults(rows)).collect()}
    assert got == {"688001": ("R2", True), "000001": ("R2", False), "000002": ("R2", True)}
    assert SG.decide(SG.defaults(rows), gate=False).filter("buy").count() == 3
    plain = {r.entity: (r.tag, r.buy) for r in SG.decide(SG.defaults(rows.drop("buy_systems"))).collect()}
    assert plain == {"688001": ("_T", True), "000001": ("_T", False), "000002": ("_T", False)}


def test_diagnosis_by_its_rules(spark, sf):
    """Composite scores from known structure, point by point."""
    rows = [r.asDict() for r in decision.diagnosed(spark, sf.replace("sf0.001", "sf0.01")).collect()]
    for r in rows:
        if r["confirmed_buy"]:
            trade = 0.35 * r["buy_strength"]
        elif r["confirmed_sell"]:
            trade = -0.35 * r["sell_strength"]
        else:
            trade = 0.20 * r["buy_confidence"] if r["buy_point"] > 0 else -0.20 * r["sell_confidence"] if r["sell_point"] > 0 else 0.0
        total = {2: 0.25, -2: -0.25}.get(r["trend_type"], 0.0) + trade + 0.10 * r["second_buy"] + 0.05 * r["alignment"] - 0.05 * r["breakdowns"]
        total += 0.08 if r["pivot_position"] == 1 else 0.05 if r["pivot_position"] == -1 and r["trend_type"] >= 0 else 0.0
        total += 0.05 * (r["depleted"] and r["stroke_direction"] == -1) - 0.05 * r["pivot_breakdown"] - 0.10 * r["top_divergence"]
        assert abs(r["composite"] - max(-1.0, min(1.0, total))) < 1e-12
    assert len({r["trend_type"] for r in rows}) >= 2 and len({round(r["composite"], 2) for r in rows}) > 20
