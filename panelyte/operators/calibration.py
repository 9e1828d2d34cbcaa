"""Calibration of factors by group and market state: which factors hold in each, and with what weights.

Entities belong to many groups, so a row counts in each of its groups. Every heavy step is keyed by (group, state, date,
factor): a group with a third of all rows is spread over its dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyte.operators.ic import melt, rank_ic


def bridged(panel: DataFrame, members: DataFrame, factors: list[str], target: str = "target", state: str = "state", group: str = "concept", least_entities: int = 20, least_rows: int = 100, least_state_rows: int = 50) -> DataFrame:
    """(group, state, entity, date, factor, value, target): the complete pairs of panel (entity, date, state, target and
    factors) once for each group of members (entity, group), for the groups with least_entities in the panel and
    least_rows rows, and their states with least_state_rows rows. Rows without a state are in no state; rows of an
    entity without a group in none."""
    pairs = members.select("entity", group).distinct()
    counted = panel.groupBy("entity", state).agg(F.count(F.lit(1)).alias("n")).join(pairs, "entity")  # a row for each entity and state
    groups = counted.groupBy(group).agg(F.countDistinct("entity").alias("entities"), F.sum("n").alias("rows"))
    groups = groups.filter((F.col("entities") >= least_entities) & (F.col("rows") >= least_rows)).select(group)
    states = counted.groupBy(group, state).agg(F.sum("n").alias("rows")).filter((F.col("rows") >= least_state_rows) & F.col(state).isNotNull()).select(group, state)
    kept = pairs.join(groups, group, "left_semi")
    return melt(panel, factors, target, [state]).join(kept, "entity").join(states, [group, state], "left_semi")


def calibrate(long: DataFrame, group: str = "concept", state: str = "state", least: int = 10, least_dates: int = 10, least_stability: float = 0.1, least_t: float = 1.5) -> DataFrame:
    """(group, state, factor, n_dates, ic_mean, ic_std, ir, stability, t, combined_ir) of the factors whose ICs over
    dates with `least` rows have a positive mean, least_stability, |t| of least_t and least_dates dates; combined_ir is the
    IR times the mean of 1 and the stability."""
    ic = rank_ic(long, [group, state, "date", "factor"], least)
    mean, sd, n = F.avg("ic"), F.stddev_pop("ic") + 1e-10, F.count(F.lit(1))
    s = ic.groupBy(group, state, "factor").agg(n.alias("n_dates"), mean.alias("ic_mean"), sd.alias("ic_std"), (F.abs(F.sum(F.signum(F.round("ic", 9)))) / n).alias("stability"))
    s = s.withColumn("ir", F.col("ic_mean") / F.col("ic_std")).withColumn("t", F.col("ir") * F.sqrt(F.col("n_dates").cast("double")))
    s = s.filter((F.col("n_dates") >= least_dates) & (F.col("ic_mean") > 0) & (F.col("stability") >= least_stability) & (F.abs("t") >= least_t))
    return s.withColumn("combined_ir", F.col("ir") * (0.5 + 0.5 * F.col("stability")))


def calibrated_weights(long: DataFrame, metrics: DataFrame, group: str = "concept", state: str = "state", most: int = 3, floor: float = 0.02, least: int = 10, least_dates: int = 10) -> DataFrame:
    """(group, state, factor, place, weight, size, avg_ic, combined_ic): a weight set for each group and state.

    Of the best 1 to `most` factors by combined IR (from `floor` on; ties by name), weighted by it, the number whose
    weighted mean has the best mean IC over rows that have all of them wins, where that is positive over least_dates
    dates (ties: the fewer); else the best factor alone, with its own IC. All candidate sets of all groups are scored in
    one pass; nothing is collected."""
    keys = [group, state]
    best = Window.partitionBy(*keys).orderBy(F.desc("combined_ir"), "factor")
    ranked = metrics.filter(F.col("combined_ir") >= floor).withColumn("place", F.row_number().over(best)).filter(F.col("place") <= most).select(*keys, "factor", "place", "combined_ir", "ic_mean")
    ranked = ranked.withColumn("all", F.max("place").over(Window.partitionBy(*keys)))
    sets = ranked.withColumn("size", F.explode(F.sequence("place", "all"))).drop("all")
    of_set = Window.partitionBy(*keys, "size")
    sets = sets.withColumn("weight", F.col("combined_ir") / F.sum("combined_ir").over(of_set)).withColumn("avg_ic", F.avg("ic_mean").over(of_set))
    joined = long.join(sets.select(*keys, "size", "factor", "weight"), [*keys, "factor"])
    scored = joined.groupBy(*keys, "size", "entity", "date", "target").agg(F.sum(F.col("weight") * F.col("value")).alias("value"), F.count(F.lit(1)).alias("have")).filter("have = size")
    ic = rank_ic(scored, [*keys, "size", "date"], least).groupBy(*keys, "size").agg(F.avg("ic").alias("combined_ic"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy(F.desc(F.round("combined_ic", 12)), "size")
    won = ic.filter((F.col("n") >= least_dates) & (F.col("combined_ic") > 0)).withColumn("r", F.row_number().over(order)).filter("r = 1").select(*keys, F.col("size").alias("won"), "combined_ic")
    out = sets.join(won, keys, "left").filter(F.col("size") == F.coalesce("won", F.lit(1)))
    return out.select(*keys, "factor", "place", "weight", "size", "avg_ic", F.coalesce("combined_ic", "avg_ic").alias("combined_ic"))
