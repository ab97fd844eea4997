"""Repeated rows: fold them into one row with a count, and unfold again."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

COPIES = "_copies"


def folded(df: DataFrame) -> DataFrame:
    """Distinct rows and how often each occurs."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias(COPIES))


def unfolded(df: DataFrame) -> DataFrame:
    """Each row as often as its count says."""
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(COPIES)))).drop("_copy", COPIES)
