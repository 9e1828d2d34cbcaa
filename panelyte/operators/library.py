"""Life of a factor library: quality over evaluation dates, selection, state changes, combinations, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyte.operators.asof import asof
from panelyte.operators.ic import combine, rank_ic, summarize

#: Fallbacks for a missing state column.


def quality(metrics: DataFrame, lookback: int = 8, half_life: float = 4.0, active: float = 0.02) -> DataFrame:
    """metrics (factor, eval_date, ic_mean, ir) with the quality of each factor over its last `lookback` evaluations:
    tw_ic and tw_ir (half-life weights), slope, abs_slope, volatility, decay_score, status and n."""
    w = Window.partitionBy("factor").orderBy("eval_date").rowsBetween(1 - lookback, 0)
    order = Window.partitionBy("factor").orderBy("eval_date")
    m = metrics.withColumn("k", F.row_number().over(order))
    weight = F.pow(F.lit(2.0), F.col("k") / half_life)  # of a fixed origin: shares are the same as from the row
    ic, size, k = F.col("ic_mean"), F.abs("ic_mean"), F.col("k").cast("double")
    n = F.count(F.lit(1)).over(w)
    q = m.select(
        "*", n.alias("n"), (F.sum(weight * ic).over(w) / F.sum(weight).over(w)).alias("tw_ic"), (F.sum(weight * F.col("ir")).over(w) / F.sum(weight).over(w)).alias("tw_ir"),
        F.when(n >= 3, F.regr_slope(ic, k).over(w)).otherwise(0.0).alias("slope"), F.when(n >= 3, F.regr_slope(size, k).over(w)).otherwise(0.0).alias("abs_slope"),
        F.when(n >= 2, F.stddev_pop(ic).over(w)).otherwise(0.0).alias("volatility"), F.lag(size).over(order).alias("before"),
    )
    c = F.col
    decay = 0.5 * (c("slope") / F.greatest(size, F.lit(0.001))) + 0.3 * F.when(ic < c("tw_ic"), 1.0).otherwise(-0.5) + 0.2 * F.when(c("volatility") < 0.02, 1.0).otherwise(-0.5)
    q = q.withColumn("decay_score", decay)
    falling = ((c("n") >= 3) & (c("abs_slope") < -0.003) & (size < 0.02)) | ((c("n") >= 2) & (size < c("before") * 0.5)) | ((c("decay_score") < -0.2) & (size < 0.03))
    status = F.when(falling, "decaying").when((size > active) & (c("abs_slope") >= -0.001) & (c("n") >= 3), "active").otherwise("candidate")
    return q.withColumn("status", status).drop("k", "before")


def select(qualities: DataFrame, families: DataFrame, top: int = 3, per_family: int = 2, least: float = 0.015) -> DataFrame:
    """(eval_date, factor, score, direction, family, place): factors of each date with an |IC| of `least` that do not
    decay, by 0.6 of the weighted and 0.4 of the latest |IC| (0.7 of that with a poor decay score; the latest alone
    with under three evaluations), at most per_family of a family. families has (factor, family)."""
    size = F.abs("ic_mean")
    long = (F.abs("tw_ic") * 0.6 + size * 0.4) * F.when(F.col("decay_score") < -0.2, 0.7).otherwise(1.0)
    c = qualities.filter((size >= least) & ~F.col("status").isin("decaying", "retired")).withColumn("score", F.when(F.col("n") >= 3, long).otherwise(size)).join(families, "factor", "left")
    c = c.withColumn("family", F.coalesce("family", F.lit("other"))).withColumn("direction", F.when(F.col("ic_mean") > 0, 1).otherwise(-1))
    inside = Window.partitionBy("eval_date", "family").orderBy(F.desc("score"), "factor")
    c = c.withColumn("k", F.row_number().over(inside)).filter(F.col("k") <= per_family)
    place = F.row_number().over(Window.partitionBy("eval_date").orderBy(F.desc("score"), "factor"))
    return c.withColumn("place", place).filter(F.col("place") <= top).select("eval_date", "factor", "score", "direction", "family", "place")


def scoring_factors(chosen: DataFrame, config: DataFrame, default: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, factor, weight, source) for each date: the stored choice, else the configuration, else the default."""
    sources = [("store", chosen.select("date", "factor", "weight")), ("config", config.select("date", "factor", "weight")), ("default", dates.crossJoin(F.broadcast(default.select("factor", "weight"))))]  # default is a short list
    tagged = [rows.withColumn("source", F.lit(name)).withColumn("k", F.lit(k)) for k, (name, rows) in enumerate(sources)]
    every = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).join(dates, "date", "left_semi")
    first = F.min("k").over(Window.partitionBy("date"))
    return every.withColumn("first", first).filter("k = first").select("date", "factor", "weight", "source")


def lifecycle(registry: DataFrame, latest: DataFrame, recent: DataFrame, promotion: int = 3, retirement: int = 4, active: float = 0.02, revival_days: int = 180) -> DataFrame:
    """registry (factor, status, retired_at) one step on: latest has (factor, eval_date, ic_mean, slope, decay_score),
    recent (factor, ics: latest ICs, oldest first). The result has status, before and retired_at."""
    c = F.col
    j = registry.withColumnRenamed("status", "before").join(latest, "factor", "left").join(recent, "factor", "left")
    last = lambda k: F.slice("ics", -k, k)
    enough = lambda k: F.size("ics") >= k
    promoted = enough(promotion) & F.forall(F.when(enough(promotion), last(promotion)), lambda x: x > active) & (c("slope") >= -0.001)
    lost = (c("ic_mean") < 0) & enough(retirement) & F.forall(F.when(enough(retirement), last(retirement)), lambda x: x < 0)
    revived = (F.datediff("eval_date", "retired_at") > revival_days) & (c("ic_mean") > active)
    new = (
        F.when((c("before") == "candidate") & promoted, "active").when((c("before") == "active") & (c("decay_score") < -0.3), "decaying").when((c("before") == "active") & lost, "retired")
        .when((c("before") == "decaying") & (c("decay_score") > 0.1) & (c("ic_mean") > active), "active").when((c("before") == "decaying") & lost, "retired")
        .when((c("before") == "retired") & revived, "candidate").otherwise(c("before"))
    )
    j = j.withColumn("status", new)
    return j.select("factor", "before", "status", F.when((c("status") == "retired") & (c("before") != "retired"), c("eval_date")).otherwise(c("retired_at")).alias("retired_at"))


def prefix_greedy(long: DataFrame, summary: DataFrame, keys: list[str] = (), most: int = 3, least: int = 10) -> DataFrame:
    """(keys, k, combined_ic, combined_ir, factors): of the best 1 to `most` factors by combined IR (ties by name),
    weighted by it, the number whose weighted sum has the best combined IC (ties: the smaller). Factors with a
    combined IR at or below 0 are left out. All prefixes are candidate weight sets in one pass."""
    keys = list(keys)
    order = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc("combined_ir"), "factor")
    ranked = summary.filter("combined_ir > 0").withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    sets = ranked.withColumn("k", F.explode(F.sequence(F.col("place"), F.lit(most)))).withColumn("have", F.count(F.lit(1)).over(Window.partitionBy(*keys, "k"))).filter("have = k")
    sets = sets.select(*keys, "k", "factor", F.col("combined_ir").alias("weight"))
    need = sets.groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("need"), F.sort_array(F.collect_list("factor")).alias("factors"))
    joined = long.join(F.broadcast(sets), [*keys, "factor"])  # at most `most` * (most + 1) / 2 rows a key
    scored = joined.groupBy(*keys, "k", "entity", "date", "target").agg((F.sum(F.col("weight") * F.col("value")) / F.sum("weight")).alias("value"), F.count(F.lit(1)).alias("have"))
    scored = scored.join(need.drop("factors"), [*keys, "k"]).filter("have = need")
    s = summarize(rank_ic(scored, [*keys, "k", "date"], least), [*keys, "k"])
    best = Window.partitionBy(*(keys or [F.lit(1)])).orderBy(F.desc(F.round("ic_mean", 12)), "k")
    return s.withColumn("r", F.row_number().over(best)).filter("r = 1").join(need, [*keys, "k"]).select(*keys, "k", F.col("ic_mean").alias("combined_ic"), F.col("combined_ir"), "factors")


def selected_as_of(dates: DataFrame, chosen: DataFrame) -> DataFrame:
    """(date, chosen_on, factors, weights) for each date: the set chosen on the latest earlier date; null before any."""
    sets = chosen.groupBy(F.col("date").alias("chosen_on")).agg(F.sort_array(F.collect_list(F.struct("factor", "weight"))).alias("set")).withColumn("key", F.lit(1))
    j = asof(dates.withColumn("key", F.lit(1)), sets, "key", "date", "chosen_on", ["chosen_on", "set"], strict=True)
    return j.select("date", "chosen_on", F.col("set.factor").alias("factors"), F.col("set.weight").alias("weights"))


def extend(known: DataFrame, dates: DataFrame, compute, lookback: int) -> DataFrame:
    """known (date, …) and the rows that compute(dates slice) adds for dates it lacks.

    compute gets the calendar rows (date, ord) from `lookback` dates before the first new one on, which is all that a
    window over date ordinals needs; only the new dates' rows are kept.
    """
    new = dates.join(known.select("date").distinct(), "date", "left_anti")
    first = new.agg(F.min("ord").alias("first"))
    part = dates.crossJoin(F.broadcast(first)).filter(F.col("ord") >= F.col("first") - lookback).drop("first")  # one row
    return known.unionByName(compute(part).join(new.select("date"), "date", "left_semi").select(known.columns))


def decay_alerts(now: DataFrame, baseline: DataFrame, keys: list[str], drop: float = 0.20) -> DataFrame:
    """(keys, base_ic, ic, change, kind) where the IC of now (keys, ic) changed its sign against the baseline (keys, ic) or
    lost more than `drop` of its size."""
    j = now.join(baseline.select(*keys, F.col("ic").alias("base_ic")), keys)
    change = (F.abs("ic") - F.abs("base_ic")) / F.abs("base_ic")
    kind = F.when(F.col("ic") * F.col("base_ic") < 0, "flipped").when(change < -drop, "weaker")
    return j.filter(F.abs("base_ic") > 0).withColumn("change", change).withColumn("kind", kind).filter("kind is not null").select(*keys, "base_ic", "ic", "change", "kind")


def stability(ic: DataFrame, windows: int = 5, least: float = 0.2) -> DataFrame:
    """(factor, mean, sd, ratio, stable) over `windows` consecutive spans of dates with equally many: mean of the spans'
    mean ICs against their deviation."""
    dates = ic.select("date").distinct().withColumn("span", F.ntile(windows).over(Window.partitionBy(F.lit(1)).orderBy("date")))
    spans = ic.join(dates, "date").groupBy("factor", "span").agg(F.avg("ic").alias("m"))
    s = spans.groupBy("factor").agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("sd"))
    r = F.when(F.col("sd") > 1e-10, F.abs("mean") / F.col("sd"))
    return s.withColumn("ratio", r).withColumn("stable", F.coalesce(F.col("ratio") >= least, F.lit(False)))


def complete_ranks(panel: DataFrame, factors: list[str], least: int = 5) -> DataFrame:
    """(entity, date, <factor>_rank): percent ranks within date among the rows that have all factors, on dates with
    `least` of them; other rows have no rank and no row here."""
    from functools import reduce

    from panelyte.operators.xsec import percent_rank

    whole = panel.filter(reduce(lambda a, b: a & b, [F.col(f).isNotNull() for f in factors])).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("date"))).filter(F.col("__n") >= least)
    return whole.select("entity", "date", *[percent_rank(F.col(f), ["date"]).alias(f"{f}_rank") for f in factors])


__all__ = ["combine", "complete_ranks", "decay_alerts", "extend", "lifecycle", "prefix_greedy", "quality", "scoring_factors", "select", "selected_as_of", "stability"]
