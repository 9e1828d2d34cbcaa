"""Buy and sell points of known structure: nine kinds in one row, quality of fractals, second points, the levels that agree,
and the price at which a position is given up. Everything on a row is known on that row.

Rows come from swing_state.known_structure() over bars with ord, volume, ema20 and macd_hist.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from panelyte.functions import windows as W
from panelyte.functions.numeric import clip
from panelyte.operators.factors import EPS, frame, holds
from panelyte.operators.swing import WINDOW_POINTS

#: Half-lives: what is left of a bottom's and a top's quality after a bar, and for how many bars a top counts.
BOTTOM_DECAY, TOP_DECAY, TOP_BARS = 0.87, 0.85, 7


def first_points(rows: DataFrame) -> DataFrame:
    """rows, with the columns of swing.window_points(), with buy_point (0 none, 1 to 9), buy_confidence, sell_point (0, 1,
    3) and sell_confidence.

    Order of kinds: return to a left pivot's upper edge (3), reversals by divergence, from a deep fall or by a gap (1),
    the break of a wide pivot (3), then pullback in a trend (4), start of a trend (5), pullback to a mean (6), inside a
    pivot (7), break of a narrow range (8), pullback after a limit (9). 4 to 9 need a pivot and no sell point.
    """
    two, one = F.col("pivots") >= 2, (F.col("pivots") >= 1) & F.col("s3_conf").isNull() & F.col("s1_conf").isNull()
    order = [("b3_conf", 3, None), ("b1_conf", 1, None), ("v_reversal", 1, two), ("gap_reversal", 1, two), ("wide_conf", 3, None)]
    order += [("trend_pullback", 4, one), ("trend_start", 5, one), ("mean_pullback", 6, one), ("b7_conf", 7, one), ("range_breakout", 8, one), ("limit_pullback", 9, one)]
    found = F.coalesce(*[F.when(F.col(c).isNotNull() & (F.lit(True) if ok is None else ok), F.struct(F.lit(k).alias("kind"), F.col(c).alias("conf"))) for c, k, ok in order])
    sold = F.coalesce(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(c).alias("conf"))) for c, k in (("s3_conf", 3), ("s1_conf", 1))])
    p = rows.withColumn("__b", found).withColumn("__s", sold)
    for name, x in (("buy", "__b"), ("sell", "__s")):
        p = p.withColumn(f"{name}_point", F.coalesce(F.col(x)["kind"], F.lit(0))).withColumn(f"{name}_confidence", F.coalesce(F.col(x)["conf"], F.lit(0.0)))
    return p.drop("__b", "__s", *WINDOW_POINTS)


def _spike(x: Column) -> Column:
    """Volume against the bar before, from 0 below 1 to 1 at 3 times."""
    return F.when(x >= 3, 1.0).when(x >= 2, 0.7 + (x - 2) * 0.3).when(x >= 1.5, 0.35 + (x - 1.5) * 0.7).when(x >= 1, x * 0.35).otherwise(0.0)


def fractal_parts(rows: DataFrame) -> DataFrame:
    """rows with what each bar would be worth as a bottom or top: bottom_own and top_own without the turn of a stroke,
    macd_turn (mean histogram of six bars less that of the five before), macd_3 (mean histogram of four bars)."""
    h, low, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    by = W.by_entity()
    before = lambda x: F.lag(x).over(by)
    after = lambda x: F.lead(x).over(by)
    ends = before(c).isNotNull() & after(c).isNotNull()
    span = h - low
    depth = F.when(span > 1e-10, (F.least(before(low), after(low)) - low) / span).otherwise(0.0)
    clear = F.when((low < before(low)) & (low < after(low)), 0.5).otherwise(0.0) + F.when((h < before(h)) & (h < after(h)), 0.5).otherwise(0.0)
    many = F.coalesce(W.sma(v, 20), F.lit(0.0))
    loud = F.when(many > 0, v / many).otherwise(1.0)
    deep = F.when(F.col("ema20") > 0, (F.col("ema20") - low) / F.col("ema20")).otherwise(0.0)
    p = rows.withColumn("macd_late", F.avg("macd_hist").over(W.incl(6))).withColumn("macd_early", F.avg("macd_hist").over(frame(10, 6))).withColumn("macd_3", F.avg("macd_hist").over(W.incl(4)))
    turn = F.col("macd_late") - F.col("macd_early")
    fresh_low = (F.col("ord") > 10) & (low <= F.min(low).over(W.excl(20)) * 0.995) & (turn > 0)
    diverges = F.when(holds(fresh_low), clip(turn / (F.abs("macd_early") + EPS) * 0.5 + 0.3, 0.0, 1.0)).otherwise(0.0)
    bottom = clip(depth * 3 + clear * 0.3, 0.0, 1.0) * 0.25 + clip((loud - 0.5) / 2, 0.0, 1.0) * 0.10 + _spike(v / (before(v) + EPS)) * 0.15 + clip(deep / 0.08, 0.0, 1.0) * 0.15 + diverges * 0.20
    tall = clip((h - F.greatest(before(h), after(h))) / (span + EPS), 0.0, 1.0) * 0.6 + F.when((h > before(h)) & (h > after(h)), 0.2).otherwise(0.0) + F.when(c < h, 0.2).otherwise(0.0)
    off = F.when(F.col("ema20") > 0, F.abs(c - F.col("ema20")) / (F.col("ema20") + EPS)).otherwise(0.0)
    top = tall * 0.35 + F.least(v / (many + EPS) / 3, F.lit(1.0)) * 0.15 + F.least(off / 0.15, F.lit(1.0)) * 0.15
    return p.withColumn("bottom_own", F.when(ends, bottom)).withColumn("top_own", F.when(ends, top)).withColumn("macd_turn", turn).drop("macd_late", "macd_early")


def fractal_quality(rows: DataFrame) -> DataFrame:
    """rows with bottom_quality and top_quality in [0, 1], which decay from the fractal's bar on but show from the bar on
    which it is known, and bottom_q and top_q, the quality of a fractal where one becomes known (else null).

    A bottom has 15 % for the turn of strokes: 0.8 where the stroke under way fell at the fractal and rises once it is
    known, 0.4 where it only fell, 0.3 where it only rises. Frames start at the event: the best of all earlier events
    after decay is a running maximum of their logarithms, less the decay of the rows since.
    """
    p = fractal_parts(rows)
    at = p.select("entity", F.col("ord").alias("at"), "bottom_own", "top_own", F.col("stroke_direction").alias("was"))
    told = p.drop("bottom_own", "top_own").withColumn("at", F.coalesce("bottom_ord", "top_ord")).join(at, ["entity", "at"], "left")
    fell, rises = F.col("was") == -1, F.col("stroke_direction") == 1
    turned = F.when(fell & rises, 0.8).when(fell, 0.4).when(rises, 0.3).otherwise(0.0)
    told = told.withColumn("bottom_q", F.when(F.col("bottom_ord").isNotNull(), clip(F.coalesce("bottom_own", F.lit(0.0)) + turned * 0.15, 0.0, 1.0)))
    told = told.withColumn("top_q", F.when(F.col("bottom_ord").isNull() & F.col("top_ord").isNotNull(), F.coalesce("top_own", F.lit(0.0))))
    by = Window.partitionBy("entity").orderBy("ord")
    rate = -F.log(F.lit(BOTTOM_DECAY))
    lasting = F.max(F.when(F.col("bottom_q") > 0, F.log("bottom_q") + rate * F.col("at"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    recent = F.collect_list(F.when(F.col("top_q").isNotNull(), F.struct("at", "top_q"))).over(by.rowsBetween(-TOP_BARS, 0))
    left = F.transform(recent, lambda e: F.when(F.col("ord") - e["at"] <= TOP_BARS, e["top_q"] * F.pow(F.lit(TOP_DECAY), F.col("ord") - e["at"])).otherwise(0.0))
    quality = F.coalesce(F.exp(lasting - rate * F.col("ord")), F.lit(0.0))
    return told.withColumn("bottom_quality", quality).withColumn("top_quality", F.coalesce(F.array_max(left), F.lit(0.0))).drop("at", "was", "bottom_own", "top_own")


def top_fractal_volume(rows: DataFrame, reach: int = 60, first: int = 30) -> DataFrame:
    """rows of known_structure() with top_fractal_volume, on the bar on which a top becomes known (else 0): the largest
    volume of the top's last four bars against that of the top before it within `reach` bars. Below 0.7 times -0.8 if the
    close is above that top's and a second top lies in reach, else -0.4; above 2 times 0.5. Tops among an entity's first
    `first` bars have none."""
    about = rows.select("entity", F.col("ord").alias("top_ord"), F.struct("ord", "close", F.max("volume").over(W.incl(4)).alias("volume")).alias("top"))
    events = rows.filter("top_ord is not null").select("entity", "ord", "top_ord").join(about, ["entity", "top_ord"])
    by = Window.partitionBy("entity").orderBy("ord")
    near = lambda n: F.when(F.col("top.ord") - F.lag("top.ord", n).over(by) < reach, F.lag("top", n).over(by))
    last = near(1)
    share = F.try_divide(F.col("top.volume"), last["volume"])
    grade = F.when(share < 0.7, F.when(near(2).isNotNull() & (F.col("top.close") > last["close"]), -0.8).otherwise(-0.4)).when(share > 2.0, 0.5).otherwise(0.0)
    valued = events.select("entity", "ord", F.when(F.col("top_ord") > first, F.coalesce(grade, F.lit(0.0))).alias("top_fractal_volume"))
    return rows.join(valued, ["entity", "ord"], "left").withColumn("top_fractal_volume", F.coalesce("top_fractal_volume", F.lit(0.0)))


class Second:
    """Second points of one side of one entity: after a first point (side 1: a bottom, -1: a top) a swing the other way,
    then a fractal that stays clear of the first one's extreme. Holds the bars of the last `span` and open references."""

    def __init__(self, side: int, least_first: float, least: float, span: int = 140):
        self.side, self.least_first, self.least, self.span = side, least_first, least, span
        self.bars: dict[int, tuple] = {}
        self.refs: list[dict] = []
        self.strokes: deque = deque(maxlen=span)
        self.zone: dict | None = None
        self.last: tuple[int, float] | None = None

    def step(self, i: int, high: float, low: float, close: float, turn: float, macd: float, point: int, at: int | None, quality: float | None, stroke: tuple | None) -> tuple[float, int] | None:
        """(confidence, bar of the first point) where a second point becomes known on bar i."""
        if high is None or low is None or close is None:
            return None
        side = self.side
        edge, crest = (low, high) if side > 0 else (-high, -low)  # so that both sides look for a low of `edge`
        self.bars[i] = (edge, crest, side * close, close, side * turn if turn is not None else None, side * macd if macd is not None else None)
        self.bars.pop(i - self.span, None)
        if stroke and stroke[0] == side:
            self.strokes.append(stroke)
        if point == 1 and i > 20:
            if self.zone is None or edge < self.zone["edge"]:
                self.zone = {"at": i, "edge": edge}
        elif self.zone:
            self.refs.append(self.zone)
            self.zone = None
        self.refs = sorted((r for r in self.refs if r["at"] > i - 70 and not r.get("done")), key=lambda r: r["at"])
        if at is None or at not in self.bars:
            return None
        if side > 0:  # what is left of the fractal before counts for a bottom
            quality = max(quality, self.last[1] * BOTTOM_DECAY ** (at - self.last[0])) if self.last else quality
            self.last = (at, quality)
        found = None
        if quality >= 0.30:
            for r in self.refs:
                conf = self._follows(r, at, i, quality)
                if conf is not None and conf >= self.least:
                    r["done"], found = True, (conf, r["at"])
        edge, _, _, _, turn, _ = self.bars[at]
        if at > 40 and quality >= self.least_first and turn is not None and turn > 0 and all(abs(r["at"] - at) >= 10 for r in self.refs):
            self.refs.append({"at": at, "edge": edge})
        return found

    def _follows(self, r: dict, at: int, now: int, quality: float) -> float | None:
        side, first = self.side, self.bars.get(r["at"])
        if first is None or not r["at"] + 5 <= at < r["at"] + 50:
            return None
        edge, _, value, _, turn, macd = self.bars[at]
        crest = max(self.bars[k][1] for k in range(r["at"], min(r["at"] + 15, now + 1)) if k in self.bars)
        low, high = abs(r["edge"]), abs(crest)
        bounced = crest > first[3] * 1.01 if side > 0 else -crest < first[3] * 0.98
        clear = edge > r["edge"] - low * 0.02
        back = value <= crest - high * 0.03
        swung = any(s[1] > r["at"] and s[2] < at and s[3] > 0.01 for s in self.strokes)
        if not (bounced and clear and back and swung):
            return None
        conf = 0.30 + quality * 0.25 + (0.20 if at > 10 and turn is not None and turn > 0 else 0.0) + (0.10 if r["at"] > 5 and macd is not None and first[5] is not None and macd > first[5] else 0.0)
        if crest > r["edge"]:
            share = (crest - edge) / (crest - r["edge"])
            conf += 0.10 if 0.38 <= share <= 0.62 else 0.05 if 0.3 <= share <= 0.7 else 0.0
        return min(0.95, conf + min(0.10, (edge - r["edge"]) / (low + EPS) * 0.5))


SECOND = "second_buy_confidence double, second_buy_first long, second_sell_confidence double, second_sell_first long"


def second_points(rows: DataFrame) -> DataFrame:
    """rows of fractal_quality() and first_points() with second points (null where none), merged into buy_point and
    sell_point as kind 2 where there is no other. One ordered walk by entity that holds the bars of a bounded span."""
    p = rows.repartition("entity").sortWithinPartitions("entity", "ord")
    schema, types = StructType(p.schema.fields + StructType.fromDDL(SECOND).fields), to_arrow_schema(StructType.fromDDL(SECOND))
    names = ["entity", "ord", "high", "low", "close", "macd_turn", "macd_3", "buy_point", "sell_point", "bottom_ord", "bottom_q", "top_ord", "top_q", "stroke_way", "stroke_start", "stroke_end", "stroke_from", "stroke_to"]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entity, sides = None, None
        for batch in batches:
            told = []
            for this, i, h, low, c, turn, macd, bought, sold, b_at, b_q, t_at, t_q, way, start, end, first, last in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
                if sides is None or this != entity:
                    entity, sides = this, (Second(1, 0.30, 0.35), Second(-1, 0.45, 0.45))
                stroke = None if way is None else (way, start, end, way * (last - first) / (first + EPS))
                b = sides[0].step(i, h, low, c, turn, macd, bought, b_at if b_q is not None else None, b_q, stroke)
                s = sides[1].step(i, h, low, c, turn, macd, sold, t_at if t_q is not None else None, t_q, stroke)
                told.append((b or (None, None)) + (s or (None, None)))
            added = [pa.array(x, f.type) for x, f in zip(zip(*told, strict=True), types, strict=True)] if told else [pa.array([], f.type) for f in types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *types.names])

    p = p.mapInArrow(walk, schema)
    for side in ("buy", "sell"):
        new = F.col(f"second_{side}_confidence").isNotNull() & (F.col(f"{side}_point") == 0)
        p = p.withColumn(f"{side}_confidence", F.when(new, F.col(f"second_{side}_confidence")).otherwise(F.col(f"{side}_confidence")))
        p = p.withColumn(f"{side}_point", F.when(new, 2).otherwise(F.col(f"{side}_point")))
    return p


def structure_scores(rows: DataFrame) -> DataFrame:
    """rows with structure_buy and structure_sell in [0, 1]: the strength of points 1 to 3, more with the trend, and more
    below a pivot while the trend is not down."""
    base = lambda side: F.col(f"{side}_confidence") * 0.3 + F.when(F.col(f"{side}_point") == 1, 0.7).when(F.col(f"{side}_point") == 2, 0.5).when(F.col(f"{side}_point") == 3, 0.6)
    buy = F.coalesce(base("buy"), F.lit(0.0)) * F.when(F.col("trend_type") == 2, 1.2).otherwise(1.0)
    buy = buy * F.when((F.col("pivot_position") == -1) & (F.col("trend_type") >= 1) & (buy > 0.3), 1.15).otherwise(1.0)
    sell = F.coalesce(base("sell"), F.lit(0.0)) * F.when(F.col("trend_type") == -2, 1.2).otherwise(1.0)
    return rows.withColumn("structure_buy", clip(buy, 0.0, 1.0)).withColumn("structure_sell", clip(sell, 0.0, 1.0))


def agreeing_levels(rows: DataFrame) -> DataFrame:
    """rows with signal_level (4 strong points of strokes and segments, 3 any of both, 2 of segments, 1 of strokes alone;
    negative for sells; 0 none), buy_strength, sell_strength, confirmed_buy and confirmed_sell."""
    sb, ss = (F.coalesce(F.col(f"stroke_{x}"), F.lit(0)) > 0 for x in ("buy", "sell"))
    sbc, ssc = (F.coalesce(F.col(f"stroke_{x}_conf"), F.lit(0.0)) for x in ("buy", "sell"))
    b, s, bc, sc = F.col("buy_point") > 0, F.col("sell_point") > 0, F.col("buy_confidence"), F.col("sell_confidence")
    level = F.when(sb & b & (sbc >= 0.45) & (bc >= 0.35), 4).when(ss & s & (ssc >= 0.45) & (sc >= 0.35), -4).when(sb & b, 3).when(ss & s, -3)
    level = level.when(b & ~ss, 2).when(s & ~sb, -2).when(sb & ~s, 1).when(ss & ~b, -1).otherwise(0)
    p = structure_scores(rows).withColumn("signal_level", level)
    at = lambda k: F.col("signal_level") == k
    strength = lambda k, st, sg: F.when(at(4 * k), 0.80 + 0.10 * st + 0.10 * sg).when(at(3 * k), 0.65 + 0.15 * st + 0.15 * sg).when(at(2 * k), 0.45 + 0.25 * sg).when(at(k), 0.25 + 0.25 * st).otherwise(0.0)
    p = p.withColumn("buy_strength", strength(1, sbc, bc)).withColumn("sell_strength", strength(-1, ssc, sc))
    p = p.withColumn("confirmed_buy", (F.col("signal_level") >= 2) | (at(1) & ((F.col("structure_buy") > 0.3) | (sbc >= 0.45))))
    return p.withColumn("confirmed_sell", (F.col("signal_level") <= -2) | (at(-1) & ((F.col("structure_sell") > 0.3) | (ssc >= 0.45))))


def stop_prices(rows: DataFrame, most_loss: float = 0.07) -> DataFrame:
    """rows with stop_price and stop_reason: under the low of 60 bars or most_loss below the close for a buy, whichever is
    higher, and under the last pivot's lower edge where that lies below the close; mirrored for a sell. Rows without a
    point, and the first 20, have the loss limit alone."""
    c = F.col("close")
    near_low, near_high = F.min("low").over(W.incl(60)) * 0.995, F.max("high").over(W.incl(60)) * 1.005
    under, over = F.col("pivot_zd") * 0.995, F.col("pivot_zg") * 1.005
    buys = (F.col("ord") > 20) & ((F.col("buy_point") > 0) | (F.coalesce(F.col("stroke_buy"), F.lit(0)) > 0))
    sells = (F.col("ord") > 20) & ~buys & ((F.col("sell_point") > 0) | (F.coalesce(F.col("stroke_sell"), F.lit(0)) > 0))
    stop = F.when(buys & (under < c), F.greatest(near_low, under)).when(buys, F.greatest(near_low, c * (1 - most_loss)))
    stop = stop.when(sells & (over > c), F.least(near_high, over)).when(sells, F.least(near_high, c * (1 + most_loss))).otherwise(c * (1 - most_loss))
    why = F.when(buys & (under < c), "pivot_low").when(buys, "structure_low").when(sells & (over > c), "pivot_high").when(sells, "structure_high").otherwise("fixed")
    return rows.withColumn("stop_price", stop).withColumn("stop_reason", why)
