"""Operators over groups of entities: rotation, heat, chains, lead and lag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions.recursive import smoothed
from panelyte.operators.ic import pearson

#: Weights of the three momenta.
ROTATION = (0.40, 0.35, 0.25)


def rotation(panel: DataFrame, momenta: list[str], group: str = "grp") -> DataFrame:
    """(date, group, momentum, place): weighted median momenta of a group, 1 for the strongest."""
    medians = panel.groupBy("date", group).agg(*[F.percentile(m, 0.5).alias(m) for m in momenta])
    mixed = sum((w * F.col(m) for w, m in zip(ROTATION[1:], momenta[1:], strict=True)), ROTATION[0] * F.col(momenta[0]))
    ranked = medians.withColumn("momentum", mixed).filter("momentum is not null")
    return ranked.select("date", group, "momentum", F.row_number().over(Window.partitionBy("date").orderBy(F.desc("momentum"), group)).alias("place"))


def concept_returns(panel: DataFrame, members: DataFrame) -> DataFrame:
    """(concept, date, ret): mean return of a concept's entities."""
    return panel.join(members, "entity").groupBy("concept", "date").agg(F.avg("ret").alias("ret"))


def concept_heat(returns: DataFrame, members: DataFrame, leads: DataFrame, half_life: float = 3.0) -> DataFrame:
    """(entity, date, heat) on the dates of returns (concept, date, ret): 0.7 of the mean over an entity's concepts of
    tanh(5 * max(smoothed return, 0)) and 0.3 of tanh(1.5 * lead), where leads has (entity, date, bonus) of chain
    segments (see conduction; none counts as 0). An entity without concepts has no row: its heat is 0.5 by definition.
    """
    span = 2 / (1 - 0.5 ** (1 / half_life)) - 1
    warm = smoothed(returns, {"warm": ("ret", span, False)}, key="concept").withColumn("heat", F.tanh(5 * F.greatest("warm", F.lit(0.0))))
    own = warm.join(members, "concept").groupBy("entity", "date").agg(F.avg("heat").alias("own"))
    lead = leads.groupBy("entity", "date").agg(F.max("bonus").alias("bonus"))
    held = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    joined = own.join(lead, ["entity", "date"], "left")
    return joined.select("entity", "date", held(0.7 * held(F.col("own")) + 0.3 * F.tanh(1.5 * F.coalesce("bonus", F.lit(0.0)))).alias("heat"))


def lead_lag(returns: DataFrame, max_lag: int, key: str = "concept", least: int = 20, floor: float = 0.6, gain: float = 0.05, top: int = 20) -> DataFrame:
    """(leader, follower, lag, corr, strength) of the `top` strongest edges: pairs whose returns correlate by `floor` on
    one date and more, by `gain`, with the follower `lag` dates later. Strength = 2.5 * (corr - floor) in [0.05, 0.30].

    Keys are a small dimension and dates the scale: dates are numbered in a calendar of their own, and each lag is a
    join on the date's number that is aggregated to pairs at once.
    """
    days = returns.select("date").distinct().withColumn("o", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    ordered = returns.join(days, "date")
    a = ordered.select(F.col(key).alias("leader"), F.col("ret").alias("x"), F.col("o"), F.explode(F.sequence(F.lit(0), F.lit(max_lag))).alias("lag"))
    b = ordered.select(F.col(key).alias("follower"), F.col("ret").alias("y"), F.col("o").alias("p"))
    pairs = a.withColumn("p", F.col("o") + F.col("lag")).join(b, "p").filter("leader <> follower")
    c = pairs.groupBy("leader", "follower", "lag").agg(pearson("x", "y").alias("corr"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least) & F.col("corr").isNotNull())
    best = Window.partitionBy("leader", "follower")
    c = c.withColumn("now", F.max(F.when(F.col("lag") == 0, F.col("corr"))).over(best)).withColumn("k", F.row_number().over(best.orderBy(F.desc("corr"), "lag")))
    found = c.filter((F.col("k") == 1) & (F.col("lag") > 0) & (F.col("now") >= floor) & (F.col("corr") > F.col("now") + gain) & (F.col("corr") > floor))
    found = found.select("leader", "follower", "lag", "corr", F.least(F.greatest((F.col("corr") - floor) * 2.5, F.lit(0.05)), F.lit(0.30)).alias("strength"))
    return found.orderBy(F.desc("strength"), "leader", "follower").limit(top)


#: Fixed values: (levels between segments, spread in deviations that counts, points a deviation, most points).
NEXT, SKIP, BACK = (1.5, 0.10, 0.30), (2.2, 0.06, 0.18), (2.5, 0.06, 0.25)


def conduction(concepts: DataFrame, floor: float = 0.008, other: float = 0.02) -> DataFrame:
    """(chain, date, segment, bonus): the most that segments running ahead of a segment promise it.

    concepts has (chain, seg_ord, segment, concept, date, ret). Spreads of segments' mean returns are counted in the
    deviation of the chain's concept returns of the date (of all concepts where the chain has under three; `other` where
    there are under four; `floor` at least). Neighbours before a segment count from 1.5, earlier ones from 2.2, later
    ones from 2.5 deviations on.
    """
    chain, date = Window.partitionBy("chain", "date"), Window.partitionBy("date")
    n, own, wide = F.count(F.lit(1)), F.stddev_pop("ret").over(chain), F.when(F.count(F.lit(1)).over(date) > 3, F.stddev_pop("ret").over(date)).otherwise(other)
    v = concepts.withColumn("vol", F.greatest(F.when(n.over(chain) > 2, own).otherwise(wide), F.lit(floor)))
    s = v.groupBy("chain", "date", "seg_ord", "segment").agg(F.avg("ret").alias("ret"), F.max("vol").alias("vol"))
    ahead = s.select("chain", "date", F.col("seg_ord").alias("ao"), F.col("ret").alias("ar"))
    pairs = s.join(ahead, ["chain", "date"]).filter("seg_ord <> ao").withColumn("z", (F.col("ar") - F.col("ret")) / F.col("vol")).withColumn("step", F.col("seg_ord") - F.col("ao"))
    z = F.col("z")
    earned = lambda rule: F.when(z > rule[0], F.least(z * rule[1], F.lit(rule[2]))).otherwise(0.0)
    points = F.when(F.col("step") == 1, earned(NEXT)).when(F.col("step") > 1, earned(SKIP)).otherwise(earned(BACK))
    return pairs.groupBy("chain", "date", "segment").agg(F.max(points).alias("bonus"))


def breadth(panel: DataFrame) -> DataFrame:
    """Per date: advances, declines, limit moves, their ratios and the state of the market."""
    up, down = F.count_if(F.col("ret") > 0), F.count_if(F.col("ret") < 0)
    out = panel.groupBy("date").agg(F.count("ret").alias("n"), up.alias("up"), down.alias("down"), F.count_if(F.col("ret") >= 0.5).alias("surges"))
    share = F.try_divide(F.col("up").cast("double"), F.col("n").cast("double"))
    return out.withColumn("up_share", share).withColumn("state", F.when(F.col("up_share") >= 0.7, "hot").when(F.col("up_share") >= 0.5, "warm").when(F.col("up_share") >= 0.3, "cool").otherwise("cold"))


def rank_speed(places: DataFrame, top: int = 3, group: str = "grp") -> DataFrame:
    """(date, changed): how many of a date's top groups were not there on the date before."""
    tops = places.filter(F.col("place") <= top).groupBy("date").agg(F.sort_array(F.collect_set(group)).alias("now"))
    before = F.lag("now").over(Window.partitionBy(F.lit(1)).orderBy("date"))
    return tops.withColumn("before", before).filter("before is not null").select("date", F.size(F.array_except("now", "before")).alias("changed"))


def keyword_category(text: Column, table: list[tuple[str, str]], default: str = "other") -> Column:
    """Category of the first keyword, in the table's order, that text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(word)), F.lit(category)) for word, category in table], F.lit(default))


__all__ = ["breadth", "concept_heat", "concept_returns", "conduction", "keyword_category", "lead_lag", "rank_speed", "rotation"]
