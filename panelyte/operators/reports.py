"""Reports on signals, selections and groups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.functions.numeric import clip, ratio
from panelyte.operators.factors import holds
from panelyte.operators.ic import pearson


def usage(chosen: DataFrame, by: str = "factor") -> DataFrame:
    """(by, dates, share, mean_weight) of chosen (date, by, weight): on how many of all dates each was used."""
    total = chosen.agg(F.count_distinct("date").alias("all_dates"))
    counted = chosen.groupBy(by).agg(F.count_distinct("date").alias("dates"), F.avg("weight").alias("mean_weight"))
    return counted.crossJoin(F.broadcast(total)).select(by, "dates", (F.col("dates") / F.col("all_dates")).alias("share"), "mean_weight")  # total is one row


def position_quality(rows: DataFrame, exposure: str = "exposure", value: str = "target") -> DataFrame:
    """One row: mean of what follows at high (above the median) and low exposure, their gap and the correlation, all over
    the rows that have both."""
    known = rows.filter(F.col(exposure).isNotNull() & F.col(value).isNotNull())
    r = known.crossJoin(F.broadcast(known.agg(F.percentile(exposure, 0.5).alias("median"))))  # one row
    high, low = F.avg(F.when(F.col(exposure) > F.col("median"), F.col(value))), F.avg(F.when(F.col(exposure) <= F.col("median"), F.col(value)))
    return r.agg(F.count(F.lit(1)).alias("n"), high.alias("high"), low.alias("low"), (high - low).alias("gap"), pearson(exposure, value).alias("corr"))


def trades(selections: DataFrame, signals: DataFrame) -> DataFrame:
    """(entity, entry_date, exit_date, entry_weight, entry_score, entry_kind, exit_kind, bars, ret, exit_class): from each
    selection of an entity (weight above 0) to its next one, with the signals' kind and close on both dates."""
    by = Window.partitionBy("entity").orderBy("date")
    steps = selections.filter("weight > 0").select("entity", "date", "weight", "score", F.lead("date").over(by).alias("exit_date")).filter("exit_date is not null")
    s = signals.select("entity", "date", "kind", "ord", "close")
    entry = steps.join(s, ["entity", "date"], "left").select("entity", F.col("date").alias("entry_date"), "exit_date", F.col("weight").alias("entry_weight"), F.col("score").alias("entry_score"), F.col("kind").alias("entry_kind"), F.col("ord").alias("o0"), F.col("close").alias("c0"))
    out = s.select("entity", F.col("date").alias("exit_date"), F.col("kind").alias("exit_kind"), F.col("ord").alias("o1"), F.col("close").alias("c1"))
    t = entry.join(out, ["entity", "exit_date"], "left").withColumn("bars", F.col("o1") - F.col("o0")).withColumn("ret", F.col("c1") / F.col("c0") - 1)
    what = F.when(F.col("exit_kind") < 0, "sell signal").when(F.col("bars") == 1, "kept").when(F.col("bars") > 10, "returned late").otherwise("returned")
    return t.select("entity", "entry_date", "exit_date", "entry_weight", "entry_score", "entry_kind", "exit_kind", "bars", "ret", what.alias("exit_class"))


def main_lines(rows: DataFrame, least: int = 3, group: str = "grp") -> DataFrame:
    """(date, group, …): trends, buy points, ladder of movers, formation score, verdict and rank of each group with
    `least` entities. rows has trend_type, buy_point, sell_point, change (percent), volume_ratio and composite."""
    one = lambda cond: F.count_if(holds(cond))
    c = F.col
    g = rows.groupBy("date", group).agg(
        F.count(F.lit(1)).alias("n"), (one(c("trend_type") == 2) * 100.0).alias("up"), (one(c("trend_type") == -2) * 100.0).alias("down"), *[one(c("buy_point") == k).alias(f"b{k}") for k in (1, 2, 3)],
        one(c("buy_point") > 0).alias("buys"), one(c("sell_point") > 0).alias("sells"), F.avg("volume_ratio").alias("volume_ratio"), F.avg("composite").alias("composite"),
        one((c("change") > 5) & (c("volume_ratio") > 2)).alias("leaders"), one((c("change") > 2) & (c("volume_ratio") > 1.5)).alias("middle"), one(c("change") > 0).alias("followers"),
    ).filter(c("n") >= least)
    form = F.when(c("leaders") > 0, 0.4).otherwise(0.0) + F.when(c("middle") > 1, 0.3).otherwise(0.0) + F.when(c("followers") / c("n") > 0.5, 0.3).otherwise(0.0)
    g = g.withColumn("formation", F.round(form, 6))
    verdict = F.when((c("formation") >= 0.7) & (c("buys") >= 3), "strong").when((c("formation") >= 0.4) & (c("buys") >= 1), "second").when(c("sells") > c("buys"), "leaving").otherwise("none")
    place = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(F.round(c("formation") + F.coalesce("composite", F.lit(0.0)) / 3, 9)), group))
    return g.select("date", group, "n", (c("up") / c("n")).alias("up_pct"), (c("down") / c("n")).alias("down_pct"), "b1", "b2", "b3", "buys", "sells", "volume_ratio", "composite", "formation", (c("buys") - c("sells")).alias("net_flow"), verdict.alias("verdict"), place.alias("hot_rank"))


def composite() -> Column:
    """Diagnosis in [-1, 1] from trend_type, confirmed_buy and _sell, buy_strength, sell_strength, buy_point, sell_point,
    buy_confidence, sell_confidence, second_buy, pivot_position, alignment, breakdowns, pivot_breakdown, top_divergence,
    depleted and stroke_direction."""
    c = F.col
    points = lambda cond, x: F.when(holds(cond), x).otherwise(0.0)
    trade = (
        F.when(holds(c("confirmed_buy")), c("buy_strength") * 0.35).when(holds(c("confirmed_sell")), c("sell_strength") * -0.35)
        .when(c("buy_point") > 0, c("buy_confidence") * 0.20).when(c("sell_point") > 0, c("sell_confidence") * -0.20).otherwise(0.0)
    )
    place = F.when(c("pivot_position") == 1, 0.08).when((c("pivot_position") == -1) & (c("trend_type") >= 0), 0.05).otherwise(0.0)
    total = (
        F.when(c("trend_type") == 2, 0.25).when(c("trend_type") == -2, -0.25).otherwise(0.0) + trade + c("second_buy") * 0.10 + place + c("alignment") * 0.05
        - c("breakdowns") * 0.05 - points(c("pivot_breakdown"), 0.05) - points(c("top_divergence"), 0.10) + points(c("depleted") & (c("stroke_direction") == -1), 0.05)
    )
    return clip(total, -1.0, 1.0)


def grade(score: Column) -> Column:
    c = F.col
    return (
        F.when(holds(c("confirmed_buy") & (c("signal_level") >= 3) & (c("buy_confidence") >= 0.6) & (score >= 0.5)), "A").when((c("second_buy") >= 0.6) & (score >= 0.4), "A")
        .when((c("buy_point") >= 2) & (c("buy_confidence") >= 0.5) & (score >= 0.3), "B").when((c("buy_point") == 1) & (score >= 0.1), "C").when(score <= -0.5, "D-").otherwise("D")
    )


def risk() -> Column:
    c = F.col
    high = holds(c("confirmed_sell")) | (c("sell_point") >= 1) | (c("breakdowns") >= 2) | holds(c("pivot_breakdown"))
    watch = holds(c("top_divergence")) | holds(c("depleted") & (c("stroke_direction") == 1)) | ((c("trend_type") == -2) & (c("pivot_position") <= 0))
    return F.when(high, "high").when(watch, "watch").otherwise("safe")


def limit_type() -> Column:
    """Struct (type, confidence) of a limit-up row: the pattern with the greatest confidence (of equal ones the first),
    from above_pct (above the pivot, percent; null without a breakout), vol_spike, and the row before's pre_divergence,
    pre_trend, pre_position, pre_buy_point, pre_alignment, pre_direction and pre_quiet (rows of consolidation), with
    bottom_quality and buy_point."""
    c = F.col
    plus = lambda cond, x: F.when(holds(cond), x).otherwise(0.0)
    loud, double = c("vol_spike") > 1.5, c("vol_spike") > 2
    rules = [
        ("pivot breakout", c("above_pct") > 0, F.least(F.lit(0.95), 0.55 + c("above_pct") / 20 + plus(loud, 0.15))),
        ("divergence reversal", (c("pre_divergence")) & (c("pre_trend") == -2) & (c("pre_position") <= 0), F.least(F.lit(0.9), 0.55 + plus(c("pre_buy_point") == 1, 0.15) + plus(c("bottom_quality") > 0.3, 0.1))),
        ("second buy", (c("pre_buy_point") == 2) & (c("pre_trend") >= 1) & (c("pre_position") <= 0), F.least(F.lit(0.9), 0.60 + plus(loud, 0.15) + plus(c("pre_alignment") > 0, 0.1))),
        ("trend acceleration", (c("pre_trend") == 2) & (c("pre_position") == 1) & (c("pre_alignment") > 0.3), F.least(F.lit(0.85), 0.50 + plus(double, 0.15) + plus(c("buy_point") >= 3, 0.1))),
        ("stroke reversal", (c("pre_direction") == -1) & (c("bottom_quality") > 0.25), F.least(F.lit(0.8), 0.45 + c("bottom_quality") * 0.3 + plus(loud, 0.1))),
        ("range breakout", (c("pre_quiet") >= 8) & loud, F.least(F.lit(0.85), 0.45 + F.least(c("pre_quiet") / 50, F.lit(0.25)) + plus(double, 0.15))),
    ]
    found = F.array_compact(F.array(*[F.when(holds(cond), F.struct(conf.alias("confidence"), F.lit(-k).alias("k"), F.lit(name).alias("type"))) for k, (name, cond, conf) in enumerate(rules)]))
    best = F.array_max(found)
    other = F.when(double, F.struct(F.lit("volume").alias("type"), F.lit(0.35).alias("confidence"))).otherwise(F.struct(F.lit("other").alias("type"), F.lit(0.2).alias("confidence")))
    return F.when(F.size(found) > 0, F.struct(best["type"].alias("type"), best["confidence"].alias("confidence"))).otherwise(other)


def accuracy(rows: DataFrame, kinds: list[str], bands: list[float]) -> DataFrame:
    """(kinds, band, n, right, mean_next, excess): how often the next row's return has the predicted sign (direction 1 or
    -1), and its mean against the mean of all rows of the date. band counts the bounds that confidence exceeds."""
    nxt = F.lead("ret").over(W.by_entity())
    r = rows.withColumn("next", nxt).withColumn("market", F.avg("next").over(Window.partitionBy("date")))
    band = reduce(lambda a, b: a + b, [(F.col("confidence") > b).cast("int") for b in bands])
    r = r.filter("direction <> 0 and next is not null").withColumn("band", band)
    gain = F.col("next") * F.col("direction")
    return r.groupBy(*kinds, "band").agg(F.count(F.lit(1)).alias("n"), F.avg((gain > 0).cast("double")).alias("right"), F.avg("next").alias("mean_next"), F.avg((F.col("next") - F.col("market")) * F.col("direction")).alias("excess"))


def capture(rows: DataFrame, move: float, ahead: int = 5, back: int = 3) -> DataFrame:
    """One row: moves (a return of `move` or more over `ahead` rows), those with a buy in the `back` rows up to their
    start, buys that lost, sells before a rise, and buys followed by a sell within `back` rows."""
    ret = W.ahead(F.col("close"), ahead)
    seen = F.max(F.col("buy").cast("int")).over(W.by_entity().rowsBetween(-back, 0))
    sold = F.max(F.col("sell").cast("int")).over(W.by_entity().rowsBetween(1, back))
    r = rows.select("*", ret.alias("later"), seen.alias("seen"), sold.alias("sold"))
    mover, buy, sell = F.col("later") >= move, F.col("buy"), F.col("sell")
    n = lambda cond: F.count_if(holds(cond))
    out = r.agg(n(mover).alias("movers"), n(mover & (F.col("seen") == 1)).alias("captured"), n(buy & (F.col("later") < 0)).alias("false_buys"), n(sell & (F.col("later") > 0)).alias("false_sells"), n(buy & (F.col("sold") == 1)).alias("whipsaws"), n(buy).alias("buys"))
    return out.withColumn("captured_share", ratio(F.col("captured").cast("double"), F.col("movers").cast("double")))


def starts_with_signals(rows: DataFrame, start: Column, near: int = 3) -> DataFrame:
    """(entity, date, signals, first_offset): rows on which start holds, with the buys at most `near` rows around and
    the offset of the earliest; an ordinal join, so nothing but the events meets."""
    marked = rows.withColumn("start", holds(start))
    events = marked.filter("start").select("entity", "date", F.col("ord").alias("at"), F.explode(F.sequence(F.col("ord") - near, F.col("ord") + near)).alias("o"))
    buys = marked.filter("buy").select("entity", F.col("ord").alias("o"), F.lit(1).alias("hit"))
    return events.join(buys, ["entity", "o"], "left").groupBy("entity", "date").agg(F.count("hit").alias("signals"), F.min(F.when(F.col("hit") == 1, F.col("o") - F.col("at"))).alias("first_offset"))


def durations(trips: DataFrame, bounds: list[int], after: DataFrame) -> DataFrame:
    """(bin, trips, mean_ret, win_rate, mean_after): round trips (entity, bars, ret, sold) by holding length; after has
    (entity, sold, later): the return that followed the exit."""
    size = reduce(lambda a, b: a + b, [(F.col("bars") > b).cast("int") for b in bounds])
    t = trips.join(after, ["entity", "sold"], "left").withColumn("bin", size)
    return t.groupBy("bin").agg(F.count(F.lit(1)).alias("trips"), F.avg("ret").alias("mean_ret"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("later").alias("mean_after"))


def overlap(live: DataFrame, reference: DataFrame, floor: float = 0.5) -> DataFrame:
    """(date, live, reference, common, jaccard, weight_share, apart_run): how far two selections (date, entity, weight)
    agree, and for how many dates in a row the share of names in common was below `floor`."""
    both = live.select("date", "entity", F.col("weight").alias("a")).join(reference.select("date", "entity", F.col("weight").alias("b")), ["date", "entity"], "full_outer")
    d = both.groupBy("date").agg(
        F.count("a").alias("live"), F.count("b").alias("reference"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count(F.lit(1)).alias("names"),
        F.sum(F.least(F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0)))).alias("shared"), F.greatest(F.sum(F.coalesce("a", F.lit(0.0))), F.sum(F.coalesce("b", F.lit(0.0)))).alias("most"),
    )
    d = d.withColumn("jaccard", F.col("common") / F.col("names")).withColumn("entity", F.lit("all"))
    return W.run_length(d, F.col("jaccard") < floor, "apart_run").select("date", "live", "reference", "common", "jaccard", ratio(F.col("shared"), F.col("most")).alias("weight_share"), "apart_run")


def consensus(best: DataFrame, tolerance: float = 0.10) -> DataFrame:
    """(name, windows, median, stable_share, stable) of best (window, name, value): the median of the windows' best
    values and whether at least half of them lie within the tolerance of it."""
    m = best.groupBy("name").agg(F.count(F.lit(1)).alias("windows"), F.percentile("value", 0.5).alias("median"))
    near = F.abs(F.col("value") - F.col("median")) <= tolerance * F.abs("median")
    s = best.join(m, "name").groupBy("name", "windows", "median").agg(F.avg(near.cast("double")).alias("stable_share"))
    return s.withColumn("stable", F.col("stable_share") >= 0.5)


def same_chain(chains: DataFrame) -> DataFrame:
    """(concept, others): the sorted concepts that share a chain with each concept of chains (chain, concept)."""
    c = chains.select("chain", "concept").distinct()
    pairs = c.join(c.withColumnRenamed("concept", "other"), "chain").filter("concept <> other")  # a chain's concepts are a small dimension
    return pairs.groupBy("concept").agg(F.sort_array(F.collect_set("other")).alias("others"))
