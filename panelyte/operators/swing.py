"""Swing structure of an entity's bars: merged bars, alternating fractals, strokes, segments, pivots.

Each level is recursive in the order of bars, so one grouped pass per entity finds all of them, and one more projects
them onto the bars. Every swing carries the bar on which it is known (confirmed_ord).
"""

from __future__ import annotations

from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import clip
from panelyte.operators.factors import EPS, frame, holds


def merge_contained(high: list[float], low: list[float]) -> list[list]:
    """[first bar, last bar, high, low] after bars inside their neighbour are merged in the direction of the move. The
    first two bars stay apart; the direction turns only with a bar that moves both ends one way."""
    out = [[k, k, high[k], low[k]] for k in range(min(2, len(high)))]
    if len(high) < 3:
        return out
    rising = high[1] >= high[0] if (high[1] - high[0]) * (low[1] - low[0]) <= 0 else high[1] > high[0]
    for k in range(2, len(high)):
        h, lo = high[k], low[k]
        last = out[-1]
        if (h - last[2]) * (lo - last[3]) <= 0:  # one holds the other
            pick = max if rising else min
            last[1:] = [k, pick(h, last[2]), pick(lo, last[3])]
        else:
            rising = h > last[2]
            out.append([k, k, h, lo])
    return out


def fractals(bars: list[list]) -> list[tuple[int, int, float, int]]:
    """(bar, +1 top or -1 bottom, price, bar on which it is known), alternating: of several of one kind in a row the most
    extreme one stays. A top is higher than both neighbours and the next bar falls with both ends; bottoms mirror it."""
    out: list[tuple[int, int, float, int]] = []
    for (_, _, h0, l0), (bar, _, h, lo), (_, known, h2, l2) in zip(bars, bars[1:], bars[2:], strict=False):
        kind = 1 if h > h0 and h > h2 and l2 < lo else -1 if lo < l0 and lo < l2 and h2 > h else 0
        point = (bar, kind, h if kind > 0 else lo, known)
        if kind and (not out or out[-1][1] != kind):
            out.append(point)
        elif kind and kind * point[2] > kind * out[-1][2]:
            out[-1] = point
    return out


def stroke_list(points: list[tuple], high: list[float], low: list[float], apart: int) -> list[dict]:
    """Strokes from a point to the first later one of the other kind that is `apart` bars away and on the right side of
    its price; the next stroke starts there. Where none follows, the list ends."""
    out, k = [], 0
    points = [(bar, kind, high[bar] if kind > 0 else low[bar], known) for bar, kind, _, known in points]
    while k < len(points):
        bar, kind, price, _ = points[k]
        end = next((j for j in range(k + 1, len(points)) if points[j][1] != kind and points[j][0] - bar >= apart and kind * (price - points[j][2]) > 0), None)
        if end is None:
            break
        to = points[end]
        out.append({"start": bar, "end": to[0], "direction": -kind, "high": max(high[bar], high[to[0]]), "low": min(low[bar], low[to[0]]), "known": to[3]})
        k = end
    return out


def segment_list(strokes: list[dict]) -> list[dict]:
    """Segments of three strokes or more in the first one's direction. A stroke that goes beyond the last turn extends
    the segment; a counter stroke that goes beyond the counter stroke before ends it one stroke earlier."""
    out, k = [], 0
    while k + 2 < len(strokes):
        way = strokes[k]["direction"]
        if strokes[k + 1]["direction"] == way or strokes[k + 2]["direction"] != way:
            k += 1
            continue
        ahead, against = ("high", "low") if way > 0 else ("low", "high")
        end, counter = k + 2, None
        for j in range(k, len(strokes)):
            s = strokes[j]
            if s["direction"] == way:
                if end < j and way * (s[ahead] - strokes[end][ahead]) > 0:
                    end, counter = j, None
            elif counter is not None and way * (s[against] - counter) < 0:
                end = j - 1
                break
            else:
                counter = s[against]
        part = strokes[k : end + 1]
        out.append({"start": part[0]["start"], "end": part[-1]["end"], "direction": way, "high": max(s["high"] for s in part), "low": min(s["low"] for s in part), "strokes": len(part), "known": part[-1]["known"]})
        k = end + 1
    return out


def pivot_list(segments: list[dict]) -> list[dict]:
    """Pivots: where three segments in a row overlap (zd to zg). One inside the pivot before only prolongs that; one
    wholly above or below it has a trend. Later segments that still touch a pivot prolong it."""
    out: list[dict] = []
    for k in range(len(segments) - 2):
        three = segments[k : k + 3]
        zg, zd = min(s["high"] for s in three), max(s["low"] for s in three)
        if zg <= zd:
            continue
        trend = 0
        if out:
            last = out[-1]
            if zg <= last["zg"] and zd >= last["zd"]:
                last["end"], last["known"], last["segments"] = three[2]["end"], three[2]["known"], last["segments"] + 1
                continue
            trend = 1 if zd > last["zg"] else -1 if zg < last["zd"] else 0
        touching = sum(s["high"] >= zd and s["low"] <= zg for s in segments)
        pivot = {"start": three[0]["start"], "end": three[2]["end"], "zg": zg, "zd": zd, "level": min(30, 5 + touching), "segments": 3, "trend": trend, "known": three[2]["known"]}
        out.append(pivot)
        for s in segments[k + 3 :]:
            if not (s["high"] > zd and s["low"] < zg):
                break
            pivot["end"], pivot["known"], pivot["segments"] = s["end"], s["known"], pivot["segments"] + 1
    return out


def levels_of(pdf: pd.DataFrame, apart: int) -> tuple[list[int], list[tuple], list[dict], list[dict], list[dict]]:
    pdf = pdf.dropna(subset=["high", "low"]).sort_values("ord")
    high, low = pdf["high"].tolist(), pdf["low"].tolist()
    points = fractals(merge_contained(high, low))
    lines = stroke_list(points, high, low, apart)
    parts = segment_list(lines)
    return pdf["ord"].tolist(), points, lines, parts, pivot_list(parts)


SWING = "entity string, kind string, id long, start_ord long, end_ord long, direction int, high double, low double, level int, parts int, confirmed_ord long"


def swings(df: DataFrame, apart: int = 4) -> DataFrame:
    """Strokes, segments and pivots (kind) of bars (entity, ord, high, low), numbered by entity and kind.

    high and low of a pivot are its upper and lower edge, direction its trend, parts its segments, level its strength;
    of a segment, parts are its strokes. Entities too short for a kind have none of it. Bars with a null price are left
    out. Built from the whole history: consumers as of a bar use confirmed_ord.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        ords, _, lines, parts, zones = levels_of(pdf, apart)
        entity = pdf["entity"].iloc[0]
        rows = [(entity, "stroke", n, ords[s["start"]], ords[s["end"]], s["direction"], s["high"], s["low"], 0, 1, ords[s["known"]]) for n, s in enumerate(lines)]
        rows += [(entity, "segment", n, ords[s["start"]], ords[s["end"]], s["direction"], s["high"], s["low"], 0, s["strokes"], ords[s["known"]]) for n, s in enumerate(parts)]
        rows += [(entity, "pivot", n, ords[z["start"]], ords[z["end"]], z["trend"], z["zg"], z["zd"], z["level"], z["segments"], ords[z["known"]]) for n, z in enumerate(zones)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in SWING.split(", ")])

    return df.select("entity", "ord", "high", "low").groupBy("entity").applyInPandas(run, SWING)


def strokes(df: DataFrame, apart: int = 4) -> DataFrame:
    return swings(df, apart).filter("kind = 'stroke'").select("entity", "id", "start_ord", "end_ord", "direction", "high", "low", "confirmed_ord")


def pivots(df: DataFrame, apart: int = 4) -> DataFrame:
    return swings(df, apart).filter("kind = 'pivot'").select("entity", "id", "start_ord", "end_ord", F.col("high").alias("zg"), F.col("low").alias("zd"), "level", F.col("parts").alias("segments"), F.col("direction").alias("trend"), "confirmed_ord")


BAR = "stroke_direction int, segment_direction int, top boolean, bottom boolean, pivot_present boolean, pivot_zg double, pivot_zd double, pivot_position int, trend_type int, trend_strength double, area_divergence double"


def structure(df: DataFrame, apart: int = 4) -> DataFrame:
    """bars (entity, date, ord, high, low, close, macd) with the swing each lies in, the last finished pivot's place,
    the trend type (0 none, 1 sideways, 2 up, -2 down) with its strength, and the area divergence of the last two
    directional pivots that are finished by the bar.

    Swings are those of the whole history, so a bar shows what only later bars settle (a study of the past, not a signal;
    swing_state.known_structure() says what is known). A bar only takes pivots whose end it has reached. The trend follows the last
    pivot in order that has a trend; strengths grow with pivots of one trend in a row and do not fall.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        _, points, lines, parts, zones = levels_of(pdf, apart)
        n = len(pdf)
        cols = {c.split()[0]: [0] * n for c in BAR.split(", ")}
        for name in ("top", "bottom", "pivot_present"):
            cols[name] = [False] * n
        for name in ("pivot_zg", "pivot_zd"):
            cols[name] = [None] * n
        for bar, kind, _, _ in points:
            cols["top" if kind > 0 else "bottom"][bar] = True
        for name, swing in (("stroke_direction", lines), ("segment_direction", parts)):
            for s in swing:
                cols[name][s["start"] : s["end"] + 1] = [s["direction"]] * (s["end"] + 1 - s["start"])
        for z in zones:
            span = slice(z["start"], z["end"] + 1)
            size = z["end"] + 1 - z["start"]
            cols["pivot_present"][span], cols["pivot_zg"][span], cols["pivot_zd"][span] = [True] * size, [z["zg"]] * size, [z["zd"]] * size
        strength, rises = [0.0] * n, []
        if len(zones) == 1:
            cols["trend_type"][zones[0]["end"] :] = [1] * (n - zones[0]["end"])
            strength[zones[0]["end"] :] = [0.3] * (n - zones[0]["end"])
        run_of, last = 0, 0
        for before, z in zip(zones, zones[1:], strict=False):
            run_of, last = (run_of + 1 if z["trend"] == last else 1, z["trend"]) if z["trend"] else (0, 0)
            if z["trend"]:
                cols["trend_type"][z["end"] :] = [2 * z["trend"]] * (n - z["end"])
                rises.append((z["end"], min(0.9, 0.5 + run_of * 0.15)))
            else:
                span = range(before["start"], z["end"] + 1)
                for k in span:
                    cols["trend_type"][k] = cols["trend_type"][k] or 1
        for start, value in rises:
            strength[start] = max(strength[start], value)
        cols["trend_strength"] = list(accumulate(strength, max))
        close, macd = pdf["close"].tolist(), pdf["macd"].tolist()
        area = [0.0]
        for m in macd:
            area.append(area[-1] + abs(m))
        order = sorted(range(len(zones)), key=lambda k: (zones[k]["end"], k))
        done, at, divergence = -1, 0, 0.0
        directed: list[dict] = []
        for k in range(n):
            while at < len(order) and zones[order[at]]["end"] <= k:
                done = max(done, order[at])
                z = zones[order[at]]
                if z["trend"]:
                    directed.append(z)
                    divergence = area_divergence(directed, close, area)
                at += 1
            if done >= 0:
                z = zones[done]
                cols["pivot_position"][k] = 1 if close[k] > z["zg"] else -1 if close[k] < z["zd"] else 0
            cols["area_divergence"][k] = divergence
        cols["area_divergence"] = [float(x) for x in cols["area_divergence"]]
        return pdf.assign(**cols)

    return df.groupBy("entity").applyInPandas(run, f"{schema}, {BAR}")


def area_divergence(directed: list[dict], close: list[float], area: list[float]) -> float:
    """How much smaller the summed |MACD| over the last directional pivot is than over the one before, in [0, 1]."""
    if len(directed) < 2 or len(close) < 50:
        return 0.0
    ends = [(max(0, z["start"] - 5), z["end"]) for z in directed[-2:]]
    (a1, p1), (a2, p2) = ((area[b + 1] - area[a], abs(close[b] - close[a])) for a, b in ends)
    if a1 <= 0:
        return 0.0
    share = a2 / (a1 + EPS)
    return min(1.0, (1 - share) * 2) if share < 0.85 and p2 > 0.7 * p1 else max(0.0, (1 - share) * 1.2)


#: Buy points that need no pivot, in order of precedence, and their kinds.
WINDOW_POINTS = {"v_reversal": 1, "gap_reversal": 1, "trend_pullback": 4, "trend_start": 5, "mean_pullback": 6, "range_breakout": 8, "limit_pullback": 9}


def window_points(rows: DataFrame) -> DataFrame:
    """rows (entity, date, ord, close, volume and others) with the confidence of each buy point that needs no pivot, null
    where it does not hold: V reversal and gap reversal (1), pullback in a trend (4), trend start (5), first pullback to a
    mean (6), breakout from a narrow range (8), pullback after a limit-up (9)."""
    c, v = F.col("close"), F.col("volume")
    before = lambda n: W.lag(c, n)
    back = lambda n: (c - before(n)) / (before(n) + EPS)
    i = F.col("ord") - 1
    p = rows.withColumn("step", F.when(F.col("ord") > 1, F.abs(c - before(1))).otherwise(0.0)).withColumn("ma20", W.sma(c, 20)).withColumn("ma60", W.sma(c, 60)).withColumn("v20", W.sma(v, 20))
    p = p.withColumn("atr", W.sma(F.col("step"), 20)).withColumn("limit", holds((i > 0) & (back(1) > 0.095))).withColumn("under", holds(c < F.col("ma20") * 0.99)).withColumn("run", F.sum(v).over(W.so_far()))
    last = F.last(F.when(F.col("limit"), F.struct("ord", c.alias("close"), v.alias("volume"), "run")), ignorenulls=True).over(frame(4, 1))
    p = p.withColumn("hit", last).withColumn("ma20_5", W.lag(F.col("ma20"), 5))
    high60 = F.max(c).over(W.excl(60))
    fall, bounce = (high60 - c) / high60, back(3)
    low21, mean21 = F.min(c).over(W.incl(21)), F.avg(c).over(W.incl(21))
    loud = F.avg(v).over(W.incl(3)) > F.avg(v).over(frame(7, 3)) * 1.1
    reversal = F.when(holds((i >= 60) & (fall > 0.15) & (bounce > 0.02) & (low21 < mean21 * 0.97) & loud), clip(0.30 + fall * 0.5 + bounce * 3, 0.25, 0.7))
    jump, falling = back(1), (before(1) - before(5)) / (before(5) + EPS) < -0.03
    heavy = F.when(i >= 20, v > F.avg(v).over(W.excl(20))).otherwise(True)
    gap = F.when(holds((i >= 5) & (jump > 0.02) & falling & heavy), clip(0.30 + jump * 5, 0.25, 0.7))
    ma20, ma60, v20 = F.col("ma20"), F.col("ma60"), F.col("v20")
    crossed = F.max(F.col("under").cast("int")).over(W.excl(5)) == 1
    start = (i >= 30) & crossed & (c > ma20 * 0.97) & (ma20 > F.col("ma20_5")) & (back(5) > 0.005) & (back(5) < 0.10) & (v > v20 * 0.85) & (back(10) < 0.18) & (low21 < c * 0.92)
    slope, volume = F.least(F.lit(1.0), (ma20 / (F.col("ma20_5") + EPS) - 1) * 50), F.least(F.lit(1.0), v / (v20 + EPS) - 0.9)
    started = F.when(holds(start), clip(0.20 + slope * 0.25 + volume * 0.15 + back(5) * 2, 0.15, 0.65))
    off = F.abs(c - ma20) / (ma20 + EPS)
    touch = (off < 0.03) | ((F.abs(c - ma60) / (ma60 + EPS) < 0.05) & (c > ma60))
    rally = F.max(c).over(W.incl(21)) > ma20 * 1.05
    pulled = F.when(holds((i >= 60) & (ma20 > ma60) & touch & rally & (c > before(1)) & (bounce > -0.01) & (F.avg(v).over(W.incl(3)) < v20 * 0.95)), clip(0.30 + (1 - off * 10) * 0.2 + 3.0, 0.20, 0.70))
    dip, run60 = back(5), back(60)
    drier = F.avg(v).over(W.incl(5)) < F.avg(v).over(frame(9, 5)) * 0.85
    in_trend = (i >= 60) & (ma20 > ma60) & (c > ma60) & (dip < -0.02) & (F.abs((c - ma20) / (ma20 + EPS)) < 0.05) & drier & (run60 < 0.35)
    dipped = F.when(holds(in_trend), clip(0.45 + F.least(F.lit(1.0), (ma20 / (ma60 + EPS) - 1) * 8) * 0.3 + F.greatest(F.lit(0.0), -dip * 8) * 0.25, 0.25, 0.85))
    early, later = F.avg("atr").over(frame(20, 11)), F.avg("atr").over(W.incl(11))
    narrow = (early > 0) & (later < early * 0.70)
    tight = (F.max(c).over(W.incl(21)) - low21) / (low21 + EPS) < 0.12
    broke = F.when(holds((i >= 40) & (holds(narrow) | tight) & (v > v20 * 1.3) & (jump > 0.01) & (c > ma20)), clip(0.25 + jump * 5 + F.when(holds(narrow), 0.10).otherwise(0.0), 0.15, 0.65))
    hit = F.col("hit")
    days = F.col("ord") - hit["ord"]
    lows = F.array_min(F.slice(F.collect_list(c).over(W.incl(4)), -days, days))
    quiet = F.when(days > 1, (F.col("run") - hit["run"]) / days < hit["volume"] * 0.7).otherwise(True)
    resumed = F.when(holds((i >= 8) & (days >= 1) & (lows > hit["close"] * 0.98) & quiet & (c > before(1))), clip(0.35 + (3 - days) * 0.08 - (hit["close"] - lows) / (hit["close"] + EPS) * 3, 0.20, 0.70))
    found = dict(zip(WINDOW_POINTS, (reversal, gap, dipped, started, pulled, broke, resumed), strict=True))
    return p.select(*rows.columns, *[x.alias(n) for n, x in found.items()])


def first_window_point() -> Column:
    """Kind of the first window point that holds; 0 if none."""
    return F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(k)) for n, k in WINDOW_POINTS.items()], F.lit(0))


def pivot_support(bars: DataFrame, zones: DataFrame, near: int = 30) -> DataFrame:
    """bars with inside (confidence of a buy inside the last known pivot, within `near` bars after it was known): the close
    in the zone or within 3 % of its lower edge, a zone wider than 3 %, no falling trend. zones: pivots as they became
    known (swing_state.known_pivots()); an as-of join by ordinals finds the last one of before the bar."""
    from panelyte.operators.asof import asof

    known = zones.select("entity", (F.col("known_ord") + 1).alias("known"), "id", "known_ord", "zg", "zd", "trend")
    j = asof(bars, known, "entity", "ord", "known", ["id", "known_ord", "zg", "zd", "trend"])
    c, zd, zg = F.col("close"), F.col("zd"), F.col("zg")
    off = F.abs(c - zd) / (zd + EPS)
    ok = (((c >= zd) & (c <= zg * 1.01)) | (off < 0.03)) & ((zg - zd) / (zd + EPS) > 0.03) & (F.col("trend") >= 0) & (F.col("ord") < F.col("known_ord") + near) & (F.col("ord") > 60)
    return j.withColumn("inside", F.when(holds(ok), clip(0.40 - off * 5, 0.20, 0.65))).drop("id", "known_ord")


def overlap_zones(rows: DataFrame, least: int = 5) -> DataFrame:
    """(entity, start, end, bars, upper, lower): runs of at least `least` bars of which each overlaps the one before,
    with the 90th and 10th percentile of their highs and lows as edges."""
    h, low = F.col("high"), F.col("low")
    touches = holds((F.least(h, W.lag(h)) >= F.greatest(low, W.lag(low))))
    island = F.sum((~touches).cast("int")).over(W.so_far())
    runs = rows.withColumn("island", island).groupBy("entity", "island").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("bars"), F.percentile("high", 0.9).alias("upper"), F.percentile("low", 0.1).alias("lower"))
    return runs.filter(F.col("bars") >= least).drop("island")


def zone_trend(zones: DataFrame) -> Column:
    """1 where a zone (id order) lies wholly above the one before, -1 below, else 0."""
    from pyspark.sql import Window

    by = Window.partitionBy("entity").orderBy("start")
    return F.when(F.col("lower") > F.lag("upper").over(by), 1).when(F.col("upper") < F.lag("lower").over(by), -1).otherwise(0)
