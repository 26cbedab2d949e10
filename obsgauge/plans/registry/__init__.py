"""Registered queries, each next to the SQL that states the same result.

The SQL only serves as a second opinion: the Spark side is written with the
operators of this package and shares no text with it.
"""

from obsgauge.plans.registry import base, grade, history, intake, score, spend, stored, stream  # noqa: F401  (registers on import)
from obsgauge.plans.registry.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "base"]
