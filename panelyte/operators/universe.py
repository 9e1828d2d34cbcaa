"""Universes: listing filters, liquidity by board, special names, tradable rows, price limits, groups with support."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelyte.functions import windows as W
from panelyte.operators.asof import asof

#: Words that mark an entity under special treatment or on its way out.
SPECIAL = ("ST", "退市")


def any_of(text: Column, words: list[str]) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words], F.lit(False)), F.lit(False))


def special_names(listing: DataFrame, words: list[str] = SPECIAL) -> DataFrame:
    """(symbol) of the entities whose name holds one of the words."""
    return listing.filter(any_of(F.col("name"), words)).select("symbol").distinct()


def listed(listing: DataFrame, words: list[str] = SPECIAL, prefixes: list[str] = (), min_cap: float = 0.0, min_price: float = 0.0, min_amount: float = 0.0, most: int | None = None) -> DataFrame:
    """Rows of listing (symbol, name, close, volume, cap) that pass every filter; with `most`, those of the greatest cap
    (ties by symbol). A null volume counts as 0; rows with a null cap or price fail a floor on it."""
    volume = F.coalesce("volume", F.lit(0.0))
    ok = ~any_of(F.col("name"), words) & (volume > 0)
    for p in prefixes:
        ok = ok & ~F.col("symbol").startswith(p)
    for value, least in ((F.col("cap"), min_cap), (F.col("close"), min_price), (volume * F.col("close"), min_amount)):
        ok = ok & (value >= least) if least > 0 else ok
    kept = listing.filter(ok)
    return kept if most is None else kept.orderBy(F.desc("cap"), "symbol").limit(most)


def liquid(bars: DataFrame, floors: list[tuple[str, float, float]], other: tuple[float, float], until: str | None = None, min_price: float = 2.0, least: int = 60, rows: int = 20) -> DataFrame:
    """(entity, n, price, mean_amount, mean_volume, liquid) from bars up to `until`: enough rows, a last price at the
    floor or above, and the mean amount of the last rows at its board's floor (mean volume where amounts are missing).
    floors has (prefix of the entity, least amount, least volume)."""
    b = bars if until is None else bars.filter(F.col("date") <= F.lit(until).cast("date"))
    last = b.withColumn("k", F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("date"))))
    recent = F.col("k") <= rows
    u = last.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.max_by("close", "date").alias("price"), F.avg(F.when(recent, F.col("amount"))).alias("mean_amount"), F.avg(F.when(recent, F.col("volume"))).alias("mean_volume"))
    pick = lambda i: F.coalesce(*[F.when(F.col("entity").startswith(p), F.lit(v[i])) for p, *v in floors], F.lit(other[i]))
    enough = F.when(F.col("mean_amount").isNotNull(), F.col("mean_amount") >= pick(0)).otherwise(F.col("mean_volume") >= pick(1))
    return u.withColumn("liquid", F.coalesce((F.col("n") >= least) & (F.col("price") >= min_price) & enough, F.lit(False)))


def special_as_of(rows: DataFrame, names: DataFrame, words: list[str] = SPECIAL) -> DataFrame:
    """rows (entity, date) with `special`: whether the entity's name as of the date (names: entity, since, name) holds
    one of the words; false before any name."""
    j = asof(rows, names, "entity", "date", "since", ["name"])
    return j.withColumn("special", any_of(F.col("name"), words)).drop("name")


def tradable(price: Column, volume: Column, least_price: float = 2.0, least_volume: float = 100.0, least_value: float = 5e6, rows: int = 20) -> Column:
    """Price and volume above their floors and the mean traded value of the rows before (five at least) above its own."""
    frame, value = W.excl(rows), price * volume
    mean = F.when(F.count(value).over(frame) >= 5, F.avg(value).over(frame))
    return F.coalesce((price > least_price) & (volume > least_volume) & (mean > least_value), F.lit(False))


def limit_state(change: Column, amplitude: Column) -> Column:
    """1 at an upper price limit, -1 at a lower one, else 0: moves of 9.5 % in a range under 20 %, or of 4.5 to 5.5 % in
    a range under 12 %; a missing range counts as wide."""
    width = F.coalesce(amplitude, F.lit(99.0))
    up = ((change >= 9.5) & (width < 20)) | (change.between(4.5, 5.5) & (width < 12))
    down = ((change <= -9.5) & (width < 20)) | (change.between(-5.5, -4.5) & (width < 12))
    return F.when(up, 1).when(down, -1).otherwise(0)


def without_tags(members: DataFrame, words: list[str], concept: str = "concept") -> DataFrame:
    """members without the concepts whose name holds one of the words."""
    return members.filter(~any_of(F.col(concept), words))


def supported(members: DataFrame, least: int, group: str = "concept") -> DataFrame:
    """members of the groups that have at least `least` of them."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") >= least)
    return members.join(sizes.select(group), group, "left_semi")


def fine_groups(entities: DataFrame, least: int, other: str = "其他", suffix: str = r"[ⅠⅡⅢIV]+$") -> DataFrame:
    """entities (entity, label) with `fine`: the label without its level suffix; groups below `least` become `other`."""
    bare = F.regexp_replace("label", suffix, "")
    size = F.count(F.lit(1)).over(Window.partitionBy("bare"))
    return entities.withColumn("bare", bare).withColumn("fine", F.when(F.col("label").isNull() | (size < least), F.lit(other)).otherwise(F.col("bare"))).drop("bare")


def volatility_class(bars: DataFrame, low: float, high: float, rows: int = 60) -> DataFrame:
    """(entity, mean_std, class): the mean of an entity's rolling deviations of returns, against two thresholds."""
    s = bars.withColumn("s", W.full(F.stddev_samp("ret").over(W.incl(rows)), F.col("ret"), W.incl(rows), rows)).groupBy("entity").agg(F.avg("s").alias("mean_std"))
    return s.withColumn("class", F.when(F.col("mean_std").isNull(), "unknown").when(F.col("mean_std") < low, "low").when(F.col("mean_std") < high, "medium").otherwise("high"))


def column_quality(rows: DataFrame, columns: list[str], extreme: float = 2.0) -> DataFrame:
    """(name, null_share, extreme_share) of each column: how often it is missing and how often beyond the extreme."""
    parts = [F.struct(F.lit(c).alias("name"), F.avg(F.isnull(c).cast("double")).alias("null_share"), F.avg((F.abs(c) > extreme).cast("double")).alias("extreme_share")) for c in columns]
    return rows.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def bins(x: Column, edges: list[float]) -> Column:
    """Number of the half-open bin (edges[k-1], edges[k]] that x falls into, 0 at or below the first edge."""
    return sum(((x > e).cast("int") for e in edges[1:]), (x > edges[0]).cast("int"))


def quantile_bins(rows: DataFrame, x: str, parts: int, out: str) -> DataFrame:
    """rows with the bin (0 to parts - 1) of x by its quantiles over all rows; equal cut points count once."""
    cuts = rows.agg(F.array_sort(F.array_distinct(F.percentile(x, F.array(*[F.lit(k / parts) for k in range(1, parts)])))).alias("cuts"))
    return rows.crossJoin(F.broadcast(cuts)).withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter("cuts", lambda c: F.col(x) > c)))).drop("cuts")  # one row of cut points


def name_tag(name: Column) -> tuple[Column, Column, Column]:
    """(family, number, suffix) of a factor's name: letters up to the first underscore or digit, the first number, and
    what follows its last underscore."""
    number = F.regexp_extract(name, r"(\d+)", 1)
    return F.regexp_extract(name, r"^([A-Za-z]+)", 1), F.when(number != "", number.cast("int")), F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", -1)).otherwise("")


def append_factors(known: DataFrame, adjusted: DataFrame, raw: DataFrame) -> DataFrame:
    """known (entity, date, factor) with a row for each new date: adjusted close / raw close (entity, date, close), and
    the last known factor where the adjusted close is missing. Known dates stay as they are."""
    new = raw.join(known.select("entity", "date"), ["entity", "date"], "left_anti").select("entity", "date", F.col("close").alias("r"))
    new = new.join(adjusted.select("entity", "date", F.col("close").alias("a")), ["entity", "date"], "left").select("entity", "date", F.try_divide(F.col("a"), F.col("r")).alias("factor"))
    both = known.select("entity", "date", "factor").unionByName(new)
    return both.withColumn("factor", F.last("factor", ignorenulls=True).over(W.so_far()))
