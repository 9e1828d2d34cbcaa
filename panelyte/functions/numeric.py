"""Scalar Column functions: safe ratios, squashing, normal distribution, text-to-value parsing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or either is null."""
    return F.try_divide(a, b)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x held within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def clean(x: Column) -> Column:
    """NaN and infinities as null: ranks, comparisons and means then leave them out."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def squash(x: Column) -> Column:
    """Arc tangent scaled to (-1, 1)."""
    return F.atan(x) / F.lit(math.pi / 2)


def percent(text: Column) -> Column:
    """'12.3%' as 0.123; what is no number is null."""
    return F.rtrim(F.trim(text), F.lit("%")).try_cast("double") / 100


def entity_code(text: Column) -> Column:
    """The first run of six digits; a shorter all-digit code is padded with zeros."""
    found = F.regexp_extract(text, r"(\d{6})", 1)
    return F.when(found != "", found).when(F.trim(text).rlike(r"^\d{1,6}$"), F.lpad(F.trim(text), 6, "0"))


def erf(x: Column) -> Column:
    """Abramowitz-Stegun 7.1.26; absolute error below 1.5e-7. Its five coefficients."""
    t = 1 / (1 + 0.3275911 * F.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / math.sqrt(2)))


# Coefficients of Acklam's rational approximation of the inverse normal distribution.
_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)


def _poly(x: Column, coefficients) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for 0 < p < 1, else null."""
    low, q = 0.02425, p - 0.5
    tail = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    outer = _poly(tail, _C) / _poly(tail, _D)
    middle = q * _poly(q * q, _A) / _poly(q * q, _B)
    return F.when((p <= 0) | (p >= 1), None).when(p < low, outer).when(p > 1 - low, -outer).otherwise(middle)


def compress(x: Column, lo: float, hi: float, shift: float, scale: float) -> Column:
    """Clip, shift, scale and tanh; null as 0."""
    return F.coalesce(F.tanh((clip(x, lo, hi) - shift) / scale), F.lit(0.0))


def steps(x: Column, bounds: list[tuple[float, float]]) -> Column:
    """Points of the first bound that x exceeds, else 0; null as 0."""
    out = F.when(x > bounds[0][0], bounds[0][1])
    for at, points in bounds[1:]:
        out = out.when(x > at, points)
    return out.otherwise(0.0)
