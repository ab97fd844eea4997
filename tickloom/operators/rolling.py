"""Bounded look-back windows over bars, split into overlapping time chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

CHUNK, OWN = "_chunk", "_own"


def with_halo(df: DataFrame, us: Column, chunk_s: int, back_s: int) -> DataFrame:
    """Repeat the last ``back_s`` seconds of each chunk at the head of the next.

    A frame reaching at most ``back_s`` back is then exact inside (key, chunk), so
    one market's long history spreads over many tasks.  Keep ``_own`` rows after.
    """
    if back_s > chunk_s:
        raise ValueError("the look-back must fit in one chunk")
    w = F.lit(chunk_s * 1_000_000)
    here = F.floor(us / w).cast("long")
    near_end = (here + 1) * w - us <= F.lit(back_s * 1_000_000)
    own = F.struct(here.alias(CHUNK), F.lit(True).alias(OWN))
    copy = F.struct((here + 1).alias(CHUNK), F.lit(False).alias(OWN))
    both = F.when(near_end, F.array(own, copy)).otherwise(F.array(own))
    return df.select("*", F.explode(both).alias("_h")).select(*df.columns, f"_h.{CHUNK}", f"_h.{OWN}")


def chunk_window(keys: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def owned(df: DataFrame) -> DataFrame:
    return df.filter(F.col(OWN)).drop(CHUNK, OWN)


def dense_grid(df: DataFrame, keys: Sequence[str], time: str, step_s: int) -> DataFrame:
    """Every bucket between a key's first and last observed one."""
    step = F.lit(step_s * 1_000_000)
    span = df.groupBy(*keys).agg(F.unix_micros(F.min(time)).alias("_a"), F.unix_micros(F.max(time)).alias("_b"))
    return span.select(*keys, F.explode(F.sequence("_a", "_b", step)).alias("_g")).select(*keys, F.timestamp_micros("_g").alias(time))
