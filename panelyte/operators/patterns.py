"""Sell reasons of held entities. Price and volume patterns are in factors.py."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sell_reasons(reasons: dict[str, Column]) -> Column:
    """Array of the names whose condition holds, in the given order; a null condition does not hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in reasons.items()]))
