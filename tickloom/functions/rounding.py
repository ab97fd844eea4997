"""Rounding in plain arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def whole(c: Column) -> Column:
    """The nearest whole number, halves away from zero, as ``F.round`` gives it; no negative zero.

    ``F.round`` takes every double through its decimal digits. A price that several filters and columns are made of is
    computed once for each of them, as the planner merges projections, so this has to be cheap.
    """
    a = F.abs(c)
    f = F.floor(a)
    near = F.signum(c) * (f + F.when(a - f >= 0.5, 1).otherwise(0))
    return F.when(a < 1e12, near).otherwise(F.round(c)) + F.lit(0.0)
