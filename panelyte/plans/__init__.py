"""Registered queries and the SQL they are held against."""

from panelyte.plans import decision, desk, factors, kernels, mining, records, reports, research, review, signals, state, structure, universe  # noqa: F401
from panelyte.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
