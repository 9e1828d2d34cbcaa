"""As-of joins: the last right row at or before a left row's time, per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], strict: bool = False) -> DataFrame:
    """left with the values of the latest right row whose right_time <= left_time (< with strict); null before any.

    One sort of both sides by (key, time) carries the last right row forward: no range join and no row explosion.
    Of right rows at one time the greatest (by values) counts. Rows of left with a null time get nulls.
    """
    row = F.struct(*values)
    cols = left.columns
    events = right.filter(F.col(right_time).isNotNull()).groupBy(F.col(key).alias("__key"), F.col(right_time).alias("__t")).agg(F.max(row).alias("__row"))
    # at one time, right rows come first where they count and last where they must not
    events = events.select("__key", "__t", F.lit(1 if strict else -1).alias("__side"), "__row", F.lit(None).cast(left.select(F.struct(*cols).alias("s")).schema["s"].dataType).alias("__left"))
    lefts = left.select(F.col(key).alias("__key"), F.col(left_time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(events.schema["__row"].dataType).alias("__row"), F.struct(*cols).alias("__left"))
    order = Window.partitionBy("__key").orderBy(F.col("__t").asc_nulls_first(), "__side").rowsBetween(Window.unboundedPreceding, 0)
    joined = events.unionByName(lefts).withColumn("__row", F.last("__row", ignorenulls=True).over(order)).filter("__side = 0")
    return joined.select(*[F.col(f"__left.`{c}`").alias(c) for c in cols], *[F.col(f"__row.`{v}`").alias(v) for v in values])


def merged_levels(levels: Column, tolerance: float) -> Column:
    """array<struct<level, strength>> of an array of prices: in ascending order, a price within tolerance of the merged
    level before it moves that to the middle of both and adds to its strength."""
    start = F.expr("cast(array() as array<struct<level: double, strength: int>>)")

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        apart = last.isNull() | ((x - last["level"]) / (last["level"] + 1e-10) > tolerance)
        new = F.struct(F.when(apart, x).otherwise((last["level"] + x) / 2).alias("level"), F.when(apart, 1).otherwise(last["strength"] + 1).alias("strength"))
        return F.concat(F.when(apart, acc).otherwise(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))), F.array(new))

    return F.aggregate(F.array_sort(levels), start, add)


def level_distances(bars: DataFrame, side: int, memory: int, tolerance: float | None = None) -> DataFrame:
    """bars (entity, date, ord, high, low, close) with resistance_pct and support_pct: how far the close is from the
    least high above it and the greatest low below it, of the unique extrema of `side` rows on both sides; 0 without.
    With a tolerance, levels near one another are merged first, and resistance_strength and support_strength say of how
    many each is made.

    A level counts from the row on which it is known (`side` rows later) and for `memory` rows: a frame of bounded
    length, so there is no join of rows with an entity's levels and no look ahead.
    """
    from panelyte.functions import windows as W

    by = W.by_entity()
    around, before, after = by.rowsBetween(-side, side), by.rowsBetween(-side, -1), by.rowsBetween(1, side)
    whole = F.count(F.lit(1)).over(around) == 2 * side + 1
    high, low = F.col("high"), F.col("low")
    top = F.when(whole & (high > F.greatest(F.max(high).over(before), F.max(high).over(after))), high)
    bottom = F.when(whole & (low < F.least(F.min(low).over(before), F.min(low).over(after))), low)
    marked = bars.withColumn("top", top).withColumn("bottom", bottom)
    known = by.rowsBetween(-(side + memory - 1), -side)
    c = F.col("close")
    marked = marked.withColumn("tops", F.collect_list("top").over(known)).withColumn("bottoms", F.collect_list("bottom").over(known))
    if tolerance is not None:
        marked = marked.withColumn("tops", merged_levels(F.col("tops"), tolerance)).withColumn("bottoms", merged_levels(F.col("bottoms"), tolerance))
        marked = marked.withColumn("above", F.array_min(F.filter("tops", lambda x: x["level"] > c))).withColumn("below", F.array_max(F.filter("bottoms", lambda x: x["level"] < c)))
        out = marked.withColumn("resistance_pct", F.coalesce((F.col("above.level") - c) / c, F.lit(0.0))).withColumn("support_pct", F.coalesce((c - F.col("below.level")) / c, F.lit(0.0)))
        out = out.withColumn("resistance_strength", F.coalesce("above.strength", F.lit(0))).withColumn("support_strength", F.coalesce("below.strength", F.lit(0)))
        return out.drop("top", "bottom", "tops", "bottoms", "above", "below")
    above, below = F.array_min(F.filter("tops", lambda x: x > c)), F.array_max(F.filter("bottoms", lambda x: x < c))
    out = marked.withColumn("resistance_pct", F.coalesce((above - c) / c, F.lit(0.0))).withColumn("support_pct", F.coalesce((c - below) / c, F.lit(0.0)))
    return out.drop("top", "bottom", "tops", "bottoms")


def in_interval(df: DataFrame, spans: DataFrame, key: list[str], time: str, start: str, end: str) -> DataFrame:
    """df joined to the spans (same keys, start <= time <= end)."""
    return df.join(spans, [df[k] == spans[k] for k in key] + [df[time] >= spans[start], df[time] <= spans[end]]).drop(*[spans[k] for k in key])
