"""The registered queries on the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from . import aggregates, credit, encoders, models, ordered, rows, selectors  # noqa: F401
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
