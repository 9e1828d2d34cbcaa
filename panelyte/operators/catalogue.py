"""The factor catalogue as one registry: bars (entity, date, ord, open, high, low, close, volume, turnover, and amount
where a factor needs it) to any set of its factors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelyte.functions import recursive
from panelyte.functions import windows as W
from panelyte.operators import factors as FA
from panelyte.operators.factors import EPS, momentum
from panelyte.operators.registry import Registry

REGISTRY = Registry()
_MOVES = ("r", "dc", "dv", "gap", "intra", "amp", "tr", "vr")


def _with_moves(rows: DataFrame) -> DataFrame:
    """prepare() with the columns that rows has beside the bars, but for those that it would name twice."""
    taken = [c for c in rows.columns if c in {"ma20", "ma60", *[f"mom_{n}" for n in (3, 5, 10, 20, 30)]}]
    renamed = rows.withColumnsRenamed({c: f"__{c}" for c in taken})
    return FA.prepare(renamed).select(*[F.col(f"__{c}").alias(c) if c in taken else c for c in rows.columns], *_MOVES)


@REGISTRY.step(_MOVES, needs=("ord", "open", "high", "low", "close", "volume"))
def moves(rows: DataFrame, names: list[str]) -> DataFrame:
    """One-row moves; those that nobody reads are pruned from the plan."""
    return _with_moves(rows)


@REGISTRY.step(r"ema[0-9]+|macd|macd_signal|macd_hist", needs=("close",))
def exponential_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    """The wanted means and MACD columns in one grouped pass."""
    spans = {n: int(n[3:]) for n in names if n.startswith("ema")}
    return recursive.exponential_pass(rows, "close", spans, macd=len(spans) < len(names))


@REGISTRY.step(("limit_run", "flow", "residual"), needs=("r", "volume"))
def flow_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return FA.with_flow(rows).select(*rows.columns, "limit_run", "flow", "residual")


@REGISTRY.step(("place", "prev"), needs=("close", "open", "high", "low", "vr"))
def place_columns(rows: DataFrame, names: list[str]) -> DataFrame:
    return FA.with_place(rows).select(*rows.columns, "place", "prev")


@REGISTRY.step(("limit_pullback_score",), needs=("ord", "dc", "close", "high", "volume"))
def pullback_column(rows: DataFrame, names: list[str]) -> DataFrame:
    return FA.limit_pullback(rows).select(*rows.columns, "limit_pullback_score")


for _family in (FA.trend_family, FA.oscillator_family, FA.momentum_family, FA.volume_family, FA.shape_family, FA.initiation_family):
    REGISTRY.family(lambda rows, f=_family: {k: v for k, v in f(rows).items() if k not in ("volatility_5", "volatility_10", "volatility_20", *[f"mom_{n}" for n in (3, 5, 10, 20, 30)])})


@REGISTRY.factor("mom_{n}")
def _momentum(n: int) -> Column:
    return momentum(F.col("close"), n)


@REGISTRY.factor("volatility_{n}")
def _volatility(n: int) -> Column:
    return W.std(F.col("r"), n)


@REGISTRY.factor("ma{n}")
def _mean(n: int) -> Column:
    return W.sma(F.col("close"), n)


@REGISTRY.factor("slope5")
def _slope5() -> Column:
    before = W.lag(F.col("ma20"), 5)
    return F.when(before > 0, (F.col("ma20") - before) / (before + EPS))


@REGISTRY.factor("ret_{n}")
def _back(n: int) -> Column:
    """Return over n rows."""
    return F.col("close") / W.lag(F.col("close"), n) - 1


@REGISTRY.factor("atr_ratio_{n}")
def _atr_ratio(n: int) -> Column:
    return W.sma(F.col("tr"), n) / (F.col("close") + EPS)


@REGISTRY.factor("ln_cap")
def _ln_cap() -> Column:
    """Size: the value that trades for 100 percent of turnover, its logarithm squashed; 0 where nothing trades."""
    value = F.col("amount") / (F.col("turnover") / 100)
    return F.when((F.col("amount") > 0) & (F.col("turnover") > 0.001), F.tanh(F.log(F.greatest(value, F.lit(1e6))) / 10 - 0.5)).otherwise(0.0)
