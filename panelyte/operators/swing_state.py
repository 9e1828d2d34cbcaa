"""Swing structure as it is known: an automaton that takes an entity's bars one after another and never takes back.

Nothing is reported before later bars can no longer change it. A merged bar is closed by the first bar outside it; a
fractal is known when its third merged bar is closed, and final when one of the other kind follows; strokes join final
fractals; a segment is final when a counter stroke breaks it; pivots are made of final segments and grow with later ones.
So what a row says is the same whatever comes after it, on a stream with carried state as in a batch.

The state is of fixed size but for the bars of the stroke under way and two numbers for each segment.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

EPS = 1e-10
RECENT = 5  # pivots that trends are counted over, and bars after a pivot in which it may be left

#: What the automaton adds to a bar. *_conf: confidence of a point on this bar, null where there is none.
COLUMNS = (
    "top_ord long, bottom_ord long, stroke_id long, stroke_start long, stroke_end long, stroke_from double, stroke_to double, stroke_way int, stroke_direction int, upper_direction int, segment_id long, segment_direction int, "
    "pivot_id long, pivot_start long, pivot_end long, pivot_zg double, pivot_zd double, pivot_level int, pivot_segments int, pivot_trend int, pivot_changed boolean, pivots int, pivot_position int, "
    "trend_type int, trend_strength double, area_divergence double, depleted boolean, stroke_buy int, stroke_buy_conf double, stroke_sell int, stroke_sell_conf double, "
    "b1_conf double, b3_conf double, b3_rank int, b3_trend boolean, wide_conf double, b7_conf double, s1_conf double, s3_conf double"
)
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


def depletes(bars: list[tuple], way: int) -> bool:
    """Whether a stroke's bars (high, low, ...), in fifths of three bars or more, stop making new extremes in its
    direction while their other ends give way too."""
    if len(bars) < 8:
        return False
    size = max(3, len(bars) // 5)
    parts = [bars[k : k + size] for k in range(0, len(bars), size)]
    ends = [(max(b[0] for b in p), min(b[1] for b in p)) for p in parts]
    if way > 0:
        return any(h < before[0] * 0.995 and low < before[1] for before, (h, low) in zip(ends[1:], ends[2:], strict=False))
    return any(low > before[1] * 1.005 and h > before[0] for before, (h, low) in zip(ends[1:], ends[2:], strict=False))


class Swings:
    """State of one entity. step() takes a bar and gives what is known after it."""

    def __init__(self, apart: int = 4, upper: bool = True):
        self.apart, self.n = apart, 0
        self.fast = self.slow = None
        self.area = 0.0  # sum of |MACD|
        self.before: deque = deque(maxlen=6)  # (sum of |MACD| before the bar, close) of the last bars
        self.volumes: deque = deque(maxlen=20)
        self.merged: deque = deque(maxlen=3)  # the last merged bars, the last one open: [high, low, its first bar]
        self.rising = True
        self.point: dict | None = None  # last fractal, final once one of the other kind follows
        self.anchor: dict | None = None  # where the stroke under way starts
        self.path: list[tuple] = []  # bars since the anchor: (high, low, close)
        self.path_from = 0
        self.strokes: deque = deque(maxlen=2)
        self.stroke_count = self.segment_count = self.pivot_count = 0
        self.part: dict | None = None  # the segment under way
        self.segments: deque = deque(maxlen=3)
        self.ranges: list[tuple[float, float]] = []  # low and high of every segment
        self.pivots: deque = deque(maxlen=RECENT)
        self.open: list[dict] = []
        self.directed: deque = deque(maxlen=2)
        self.rank_edge: float | None = None
        self.rank = 0
        self.trend, self.strength, self.run, self.last_way = 0, 0.0, 0, 0
        self.left_up: dict = {}
        self.left_down: dict = {}
        self.upper = Swings(1, upper=False) if upper else None
        self.now: dict = {}

    # structure

    def step(self, ord_: int, high: float, low: float, close: float, volume: float | None = None) -> dict:
        self.now = dict.fromkeys(NAMES)
        if high is not None and low is not None and close is not None:
            self._price(ord_, high, low, close)
            self._merge(high, low, {"bar": self.n, "ord": ord_, "high": high, "low": low, "close": close, "area": self.area, "back": self.before[0]})
            self._points(high, low, close, volume)
            self.volumes.append(volume or 0.0)
            self.n += 1
        return self._told()

    def _price(self, ord_: int, high: float, low: float, close: float) -> None:
        self.fast = close if self.fast is None else self.fast + (close - self.fast) * 2 / 13
        self.slow = close if self.slow is None else self.slow + (close - self.slow) * 2 / 27
        self.before.append((self.area, close))
        self.area += abs(self.fast - self.slow)
        self.path.append((high, low, close))

    def _merge(self, high: float, low: float, bar: dict) -> None:
        if self.n >= 2:
            h, lo, first = last = self.merged[-1]
            if self.n == 2:
                a = self.merged[0]
                self.rising = h >= a[0] if (h - a[0]) * (lo - a[1]) <= 0 else h > a[0]
            if (high - h) * (low - lo) <= 0:  # one holds the other
                pick = max if self.rising else min
                last[0], last[1] = pick(high, h), pick(low, lo)
                return
            self.rising = high > h
            if len(self.merged) == 3:
                self._fractal(*self.merged)
        self.merged.append([high, low, bar])

    def _fractal(self, a: list, b: list, c: list) -> None:
        kind = 1 if b[0] > a[0] and b[0] > c[0] and c[1] < b[1] else -1 if b[1] < a[1] and b[1] < c[1] and c[0] > b[0] else 0
        if not kind:
            return
        bar = b[2]
        self.now["top_ord" if kind > 0 else "bottom_ord"] = bar["ord"]
        found = bar | {"kind": kind, "price": bar["high"] if kind > 0 else bar["low"], "peak": b[0] if kind > 0 else b[1]}
        if self.point and self.point["kind"] != kind:
            self._final(self.point)
            self.point = found
        elif not self.point or kind * found["peak"] > kind * self.point["peak"]:
            self.point = found

    def _final(self, p: dict) -> None:
        a = self.anchor
        if a is None:
            self._turn(p)
        elif p["kind"] != a["kind"] and p["bar"] - a["bar"] >= self.apart and a["kind"] * (a["price"] - p["price"]) > 0:
            bars = self.path[: p["bar"] - self.path_from + 1]
            moves = [abs(y[2] - x[2]) for x, y in zip(bars, bars[1:], strict=False)]
            stroke = {
                "id": self.stroke_count, "start": a, "end": p, "way": -a["kind"], "high": max(a["high"], p["high"]), "low": min(a["low"], p["low"]),
                "depleted": depletes(bars, -a["kind"]), "bars": len(bars), "move": sum(moves) / len(moves),
                "force": abs(p["price"] - a["price"]) / (a["price"] + EPS) / max(p["bar"] - a["bar"], 1),
            }
            self.stroke_count += 1
            self.strokes.append(stroke)
            self.now |= {"stroke_id": stroke["id"], "stroke_start": a["ord"], "stroke_end": p["ord"], "stroke_from": a["price"], "stroke_to": p["price"], "stroke_way": stroke["way"]}
            self._turn(p)
            self._stroke(stroke)
            if self.upper:
                self.upper.step(stroke["id"], stroke["high"], stroke["low"], p["price"])

    def _turn(self, p: dict) -> None:
        self.path, self.path_from, self.anchor = self.path[p["bar"] - self.path_from :], p["bar"], p

    def _stroke(self, s: dict) -> None:
        g = self.part
        if g is None:
            self._begin(s)
            return
        way, k = g["way"], g["strokes"]
        ahead, against = (s["high"], s["low"]) if way > 0 else (s["low"], s["high"])
        if s["way"] == way:
            if k == 2:
                g["ahead"] = ahead
            elif k > 2 and way * (ahead - g["ahead"]) > 0:
                g["ahead"], g["counter"] = ahead, None
        elif g["counter"] is not None and way * (against - g["counter"]) < 0:
            self._segment(g)
            self._begin(s)
            return
        else:
            g["counter"] = against
        g |= {"strokes": k + 1, "end": s["end"], "high": max(g["high"], s["high"]), "low": min(g["low"], s["low"])}

    def _begin(self, s: dict) -> None:
        self.part = {"way": s["way"], "strokes": 1, "start": s["start"], "end": s["end"], "high": s["high"], "low": s["low"], "counter": None, "ahead": None}

    def _segment(self, g: dict) -> None:
        self.now["segment_id"] = self.segment_count
        self.segment_count += 1
        self.segments.append(g)
        self.ranges.append((g["low"], g["high"]))
        still = []
        for p in self.open:
            if g["high"] > p["zd"] and g["low"] < p["zg"]:
                p |= {"end": g["end"], "segments": p["segments"] + 1, "since": self.n}
                still.append(p)
        self.open = still
        last = self.pivots[-1] if self.pivots else None
        if last and g["high"] >= last["zd"] and g["low"] <= last["zg"]:
            last["touching"] += 1
        if len(self.segments) < 3:
            return
        zg, zd = min(s["high"] for s in self.segments), max(s["low"] for s in self.segments)
        if zg <= zd:
            return
        if last and zg <= last["zg"] and zd >= last["zd"]:
            last |= {"end": g["end"], "segments": last["segments"] + 1, "since": self.n}
            return
        trend = 0 if not last else 1 if zd > last["zg"] else -1 if zg < last["zd"] else 0
        touching = sum(low <= zg and high >= zd for low, high in self.ranges)
        p = {"id": self.pivot_count, "start": self.segments[0]["start"], "end": g["end"], "zg": zg, "zd": zd, "trend": trend, "segments": 3, "touching": touching, "since": self.n, "rank": 0}
        if trend > 0 and (self.rank_edge is None or zd > self.rank_edge):
            self.rank, self.rank_edge = self.rank + 1, zg
            p["rank"] = self.rank
        self.pivot_count += 1
        self.pivots.append(p)
        self.open.append(p)
        if not last:
            self.trend, self.strength = 1, 0.3
        elif trend:
            self.run, self.last_way = self.run + 1 if trend == self.last_way else 1, trend
            self.trend, self.strength = 2 * trend, max(self.strength, min(0.9, 0.5 + self.run * 0.15))
            self.directed.append(p)
        else:
            self.run = self.last_way = 0

    def divergence(self) -> float:
        """How much smaller the summed |MACD| over the last directional pivot is than over the one before, in [0, 1]."""
        if len(self.directed) < 2 or self.n < 50:
            return 0.0
        (a1, p1), (a2, p2) = ((p["end"]["area"] - p["start"]["back"][0], abs(p["end"]["close"] - p["start"]["back"][1])) for p in self.directed)
        share = a2 / (a1 + EPS)
        if a1 <= 0 or share >= 1:
            return 0.0
        return min(1.0, (1 - share) * 2) if share < 0.85 and p2 > 0.7 * p1 else (1 - share) * 1.2

    # points

    def _points(self, high: float, low: float, close: float, volume: float | None) -> None:
        self._stroke_points()
        if not self.pivots:
            return
        i, p, now = self.n, self.pivots[-1], self.now
        place = 1 if close > p["zg"] else -1 if close < p["zd"] else 0
        now["pivot_position"], now["area_divergence"] = place, self.divergence()
        self._leave_and_return(place, high, low, close, volume)
        if len(self.pivots) >= 2:
            ways = [x["trend"] for x in list(self.pivots)[1:]]
            for way, name, least in ((-1, "b1_conf", 0.10), (1, "s1_conf", 0.15)):
                count, edge = ways.count(way), p["zd"] if way < 0 else p["zg"]
                if (count >= 2 or count >= 1 and len(ways) == 1) and now["area_divergence"] > least and place == way and i < p["since"] + 20:
                    off = (p["zd"] - close) / (close + EPS) if way < 0 else (close - edge) / (edge + EPS)
                    now[name] = min(0.9, 0.35 + count * 0.10 + now["area_divergence"] * 0.3 + off * 10)
            if p["end"]["bar"] - p["start"]["bar"] >= 20 and i < p["since"] + 15 and place == 1:
                now["wide_conf"] = min(0.65, max(0.25, 0.30 + (close - p["zg"]) / p["zg"] * 8))
        off = abs(close - p["zd"]) / (p["zd"] + EPS)
        if i >= 60 and p["since"] < i < p["since"] + 30 and (p["zd"] <= close <= p["zg"] * 1.01 or off < 0.03) and (p["zg"] - p["zd"]) / (p["zd"] + EPS) > 0.03 and p["trend"] >= 0:
            now["b7_conf"] = min(0.65, max(0.20, 0.40 - off * 5))

    def _leave_and_return(self, place: int, high: float, low: float, close: float, volume: float | None) -> None:
        """Third points: a pivot is left within five bars, and the price comes back to its edge without entering."""
        i, now = self.n, self.now
        fresh = [p for p in self.pivots if p["since"] < i <= p["since"] + RECENT]
        for p in fresh:
            if p["id"] not in self.left_up and place == 1 and high > p["zg"] * 1.02:
                mean = sum(self.volumes) / len(self.volumes) if len(self.volumes) == 20 else None
                self.left_up[p["id"]] = {"p": dict(p), "bar": i, "low": low, "high": high, "volume": volume, "mean": mean, "sum": 0.0}
            if p["id"] not in self.left_down and place == -1 and close < p["zd"] * 0.98:
                self.left_down[p["id"]] = {"p": dict(p), "bar": i, "high": close, "from": close}
        for k, s in list(self.left_up.items()):
            since, zg = i - s["bar"], s["p"]["zg"]
            if since == 0:
                continue
            s["low"], s["sum"] = min(s["low"], low), s["sum"] + (volume or 0.0)
            quiet = s["mean"] is None or volume is None or (s["volume"] > s["mean"] * 1.1 and s["sum"] / since < s["volume"] * 0.85)
            if zg * 0.97 < close < zg * 1.03 and s["low"] > zg * 0.98 and now["b3_conf"] is None and quiet:
                now["b3_conf"] = min(0.85, 0.4 + (s["high"] - zg) / zg * 8 + (close - zg) / zg * 5)
                now["b3_rank"], now["b3_trend"] = s["p"]["rank"], self.rank >= 2 and s["p"]["rank"] >= 2
                del self.left_up[k]
            elif since >= 5:
                del self.left_up[k]
        for k, s in list(self.left_down.items()):
            since, zd = i - s["bar"], s["p"]["zd"]
            if since == 0:
                continue
            s["high"] = max(s["high"], close)
            if zd * 0.97 < close < zd * 1.03 and s["high"] < zd and now["s3_conf"] is None:
                now["s3_conf"] = min(0.85, 0.4 + (zd - s["from"]) / zd * 8 + (zd - close) / zd * 5)
                del self.left_down[k]
            elif since >= 3:
                del self.left_down[k]

    def _stroke_points(self) -> None:
        """Points of the stroke level, which hold while the stroke after the last final one is under way."""
        if len(self.strokes) < 2:
            return
        before, last = self.strokes
        tired = last["depleted"] or last["bars"] <= 6 and before["depleted"]
        weaker = last["force"] < before["force"] * 0.85
        buy, now = last["way"] < 0, self.now
        now["depleted"] = last["depleted"]
        beyond = last["low"] - before["low"] if buy else before["high"] - last["high"]
        name = "stroke_buy" if buy else "stroke_sell"
        if beyond < 0 and (tired or weaker or buy and 0 < last["move"] < before["move"] * 0.85):
            now[name], now[name + "_conf"] = 1, 0.65 if tired and weaker else 0.60 if buy and weaker else 0.50 if buy else 0.55
        elif beyond > 0:
            now[name], now[name + "_conf"] = 2, 0.5

    def _told(self) -> dict:
        now, p = self.now, self.pivots[-1] if self.pivots else None
        now["stroke_direction"] = -self.anchor["kind"] if self.anchor else 0
        now["upper_direction"] = -self.upper.anchor["kind"] if self.upper and self.upper.anchor else 0
        now["segment_direction"] = self.part["way"] if self.part else 0
        now["pivots"], now["trend_type"], now["trend_strength"] = self.pivot_count, self.trend, self.strength
        now["pivot_position"], now["area_divergence"] = now["pivot_position"] or 0, now["area_divergence"] or 0.0
        now["pivot_changed"] = bool(p) and p["since"] == self.n - 1
        if p:
            now |= {"pivot_id": p["id"], "pivot_start": p["start"]["ord"], "pivot_end": p["end"]["ord"], "pivot_zg": p["zg"], "pivot_zd": p["zd"]}
            now |= {"pivot_level": min(30, 5 + p["touching"]), "pivot_segments": p["segments"], "pivot_trend": p["trend"]}
        return now


def known_structure(bars: DataFrame, apart: int = 4) -> DataFrame:
    """bars (entity, ord, high, low, close, optionally volume, and any other columns) with COLUMNS, each as known on
    the bar.

    An entity's bars pass through one task in order of ord, one at a time: only the automaton is held, however long the
    history. Bars with a null price change nothing and say what was known before; a null entity is an entity. Of tied
    ords the order is that of the prices. Empty table: no rows. Columns of bars that COLUMNS names are replaced.
    """
    kept = bars.select("entity", *[c for c in bars.columns if c != "entity" and c not in NAMES])
    rows = kept.repartition("entity").sortWithinPartitions("entity", "ord", "high", "low", "close")
    volume = "volume" in kept.columns
    schema = StructType(kept.schema.fields + StructType.fromDDL(COLUMNS).fields)
    types = to_arrow_schema(StructType.fromDDL(COLUMNS))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, state = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("entity", "ord", "high", "low", "close")]
            columns.append(batch.column("volume").to_pylist() if volume else [None] * batch.num_rows)
            told = []
            for this, *bar in zip(*columns, strict=True):
                if state is None or this != entity:
                    entity, state = this, Swings(apart)
                told.append(state.step(*bar))
            added = [pa.array([t[f.name] for t in told], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *types.names])

    return rows.mapInArrow(walk, schema)


def known_structure_stream(updates: DataFrame, apart: int = 4) -> DataFrame:
    """The same columns for a stream of bars (entity, ord, high, low, close, volume), an entity's state going on from
    earlier micro-batches. Bars whose ord is not after the last one seen are repeats and are left out."""

    def step(key, frames, state):
        swings, last = pickle.loads(state.get[0]) if state.exists else (Swings(apart), None)
        rows, out = pd.concat(list(frames)).sort_values("ord"), []
        for bar in rows[["ord", "high", "low", "close", "volume"]].astype(object).where(rows.notna(), None).itertuples(index=False):
            if last is None or bar[0] > last:
                out.append((key[0], *bar, *swings.step(*bar).values()))
                last = bar[0]
        state.update((pickle.dumps((swings, last)),))
        yield pd.DataFrame(out, columns=["entity", "ord", "high", "low", "close", "volume", *NAMES])

    schema = f"entity string, ord long, high double, low double, close double, volume double, {COLUMNS}"
    return updates.groupBy("entity").applyInPandasWithState(step, schema, "swings binary", "append", GroupStateTimeout.NoTimeout)


def known_swings(structure: DataFrame) -> DataFrame:
    """(entity, id, start_ord, end_ord, direction, from_price, to_price, known_ord): each stroke once, on the bar that
    makes it final; from rows of known_structure()."""
    rows = structure.filter("stroke_id is not null")
    return rows.selectExpr("entity", "stroke_id as id", "stroke_start as start_ord", "stroke_end as end_ord", "stroke_way as direction", "stroke_from as from_price", "stroke_to as to_price", "ord as known_ord")


def known_pivots(structure: DataFrame) -> DataFrame:
    """(entity, id, start_ord, end_ord, zg, zd, level, segments, trend, known_ord): a row for each bar on which the last
    pivot appeared or grew, so that an as-of join by known_ord gives it as it was known."""
    rows = structure.filter("pivot_changed")
    return rows.selectExpr("entity", "pivot_id as id", "pivot_start as start_ord", "pivot_end as end_ord", "pivot_zg as zg", "pivot_zd as zd", "pivot_level as level", "pivot_segments as segments", "pivot_trend as trend", "ord as known_ord")
