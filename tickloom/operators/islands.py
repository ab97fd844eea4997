"""Gaps-and-islands: merged intervals, runs of a condition, gap-broken segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timecols import micros
from tickloom.operators.slicing import DAY, Running, openings, running


def interval_islands(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    *,
    max_gap_s: float = 0.0,
    tie: Sequence[Column] = (),
    island: str = "island_start",
    width_s: int = DAY * 30,
) -> DataFrame:
    """Label intervals so that those overlapping, touching or within the gap share one.

    The label is the start of the island's first interval.  An interval opens a
    new island when it begins after the running maximum end plus the gap.
    """
    order = [micros(end), *tie]
    seen = running(df, keys, micros(start), {"_reach": Running("max", F.col(end), exclusive=True)}, tie=order, width_s=width_s)
    opens = F.col("_reach").isNull() | (micros(start) > micros("_reach") + F.lit(int(max_gap_s * 1_000_000)))
    return running(
        seen, keys, micros(start), {island: Running("last", F.when(opens, F.col(start)))}, tie=order, width_s=width_s
    ).drop("_reach")


def step_islands(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    breaks: Column,
    *,
    carry: dict[str, Column],
    tie: Sequence[Column] = (),
    island: str = "island_start",
    width_s: int = DAY * 30,
) -> DataFrame:
    """Label rows by runs; ``breaks`` may use the previous row's ``carry`` columns.

    The first row of a key (where the comparison is null) starts a run.
    """
    return openings(df, keys, time, {island: F.coalesce(breaks, F.lit(True))}, carry, tie=tie, width_s=width_s)
