"""Window kernels over one entity's ordered rows. incl(w) ends with the row, excl(w) with the row before.

Kernels take a panel with `entity` and `date`. A kernel is null until its frame is full (`full`), so short histories
never look like values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from panelyte.functions.numeric import clip, ratio

def by_entity() -> WindowSpec:
    """An entity's rows by date (made when asked for: a window needs a session)."""
    return Window.partitionBy("entity").orderBy("date")


def so_far() -> WindowSpec:
    return by_entity().rowsBetween(Window.unboundedPreceding, 0)


def incl(w: int) -> WindowSpec:
    return by_entity().rowsBetween(1 - w, 0)


def excl(w: int) -> WindowSpec:
    return by_entity().rowsBetween(-w, -1)


def full(value: Column, over: Column, frame: WindowSpec, w: int) -> Column:
    """value where all w rows of the frame have `over`."""
    return F.when(F.count(over).over(frame) == w, value)


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_entity())


def change(x: Column, n: int = 1) -> Column:
    """x / x n rows before - 1; null where that is not positive."""
    before = lag(x, n)
    return F.when(before > 0, x / before - 1)


def ahead(x: Column, n: int) -> Column:
    """Return over the next n rows."""
    return F.when(x > 0, F.lead(x, n).over(by_entity()) / x - 1)


def sma(x: Column, w: int) -> Column:
    return full(F.avg(x).over(incl(w)), x, incl(w), w)


def std(x: Column, w: int, frame: WindowSpec | None = None) -> Column:
    """Population deviation, by default of the rows before."""
    frame = frame or excl(w)
    return full(F.stddev_pop(x).over(frame), x, frame, w)


def highest(x: Column, w: int) -> Column:
    return full(F.max(x).over(excl(w)), x, excl(w), w)


def lowest(x: Column, w: int) -> Column:
    return full(F.min(x).over(excl(w)), x, excl(w), w)


def total(x: Column, w: int, frame: WindowSpec | None = None) -> Column:
    frame = frame or incl(w)
    return full(F.sum(x).over(frame), x, frame, w)


def corr(x: Column, y: Column, w: int) -> Column:
    """Pearson correlation of the w rows before, clipped; null where either is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x).over(excl(w)) * F.stddev_pop(y).over(excl(w))
    return full(F.when(spread > 1e-15, clip(F.covar_pop(x, y).over(excl(w)) / spread, -1.0, 1.0)), x, excl(w), w)


def rsi(close: Column, w: int) -> Column:
    move = close - lag(close)
    up, down = F.greatest(move, F.lit(0.0)), F.greatest(-move, F.lit(0.0))
    return _rsi_of(up, down, w)


def _rsi_of(up: Column, down: Column, w: int) -> Column:
    return full(100 - 100 / (1 + F.avg(up).over(incl(w)) / (F.avg(down).over(incl(w)) + 1e-10)), up, incl(w), w)


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = lag(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))


def downside(r: Column, w: int) -> Column:
    """Deviation of the negative returns of the w rows before, where there are three or more."""
    bad = F.when(r < 0, r)
    return F.when(F.count(bad).over(excl(w)) >= 3, F.stddev_pop(bad).over(excl(w)))


def skew_ratio(r: Column, w: int) -> Column:
    """Deviation of the gains over that of the losses, less 1."""
    up, down = F.stddev_pop(F.when(r > 0, r)).over(excl(w)), F.stddev_pop(F.when(r < 0, r)).over(excl(w))
    return F.when(down > 1e-10, up / down - 1)


def worst_mean(x: Column, w: int, k: int) -> Column:
    """Mean of the k smallest of the w rows before."""
    least = F.slice(F.array_sort(F.collect_list(x).over(excl(w))), 1, k)
    return full(F.aggregate(least, F.lit(0.0), lambda a, v: a + v) / k, x, excl(w), w)


def max_drawdown(x: Column, w: int) -> Column:
    """Deepest fall from a running peak within the w rows up to this one."""
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc: Column, v: Column) -> Column:
        peak = F.greatest(acc["peak"], v)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], v / peak - 1).alias("worst"))

    return full(F.aggregate(F.collect_list(x).over(incl(w)), start, step, lambda a: a["worst"]), x, incl(w), w)


def run_length(df: DataFrame, flag: Column, name: str) -> DataFrame:
    """df with the number of rows in a row, this one included, on which flag held (0 where it does not)."""
    island = F.sum((~F.coalesce(flag, F.lit(False))).cast("int")).over(so_far())
    marked = df.withColumn("__flag", F.coalesce(flag, F.lit(False))).withColumn("__island", island)
    inside = Window.partitionBy("entity", "__island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn(name, F.sum(F.col("__flag").cast("int")).over(inside)).drop("__flag", "__island")


def since_event(flag: Column) -> Column:
    """Rows since flag last held (0 on its row), null before; needs `ord`."""
    return F.col("ord") - F.last(F.when(flag, F.col("ord")), ignorenulls=True).over(so_far())


def quantile_before(x: Column, w: int, p: float, least: int) -> Column:
    """Quantile of up to w rows before, where at least `least` have a value."""
    return F.when(F.count(x).over(excl(w)) >= least, F.percentile(x, p).over(excl(w)))


def vwap(price: Column, volume: Column, w: int) -> Column:
    return full(ratio(F.sum(price * volume).over(incl(w)), F.sum(volume).over(incl(w))), price * volume, incl(w), w)


def slope(y: Column, w: int) -> Column:
    """Least-squares slope per row over the w rows up to this one; needs `ord`."""
    return full(F.regr_slope(y, F.col("ord").cast("double")).over(incl(w)), y, incl(w), w)


def local_high(x: Column, back: int) -> Column:
    return (x == F.max(x).over(by_entity().rowsBetween(-back, 0))) & (F.count(x).over(by_entity().rowsBetween(-back, 0)) >= 3)


def centred_peak(x: Column, k: int) -> Column:
    """The only maximum of k rows on both sides; known k rows later."""
    around = by_entity().rowsBetween(-k, k)
    others = F.greatest(F.max(x).over(by_entity().rowsBetween(-k, -1)), F.max(x).over(by_entity().rowsBetween(1, k)))
    return (F.count(x).over(around) == 2 * k + 1) & (x > others)
