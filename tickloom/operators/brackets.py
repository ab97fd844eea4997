"""Returns inside brackets around settlement and their placebo half an hour later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timecols import cluster_key, plus_seconds
from tickloom.operators.ranges import rows_in_windows

BRACKETS = (-10, -5, -1, 1, 5, 10)


def bracket_side(ts: Column, settlement: Column) -> Column:
    return F.when(ts < settlement, "pre").when(ts > settlement, "post").otherwise("settlement_instant")


def bracket_windows(settlements: DataFrame, time: str, *, brackets=BRACKETS, unit_s: int = 60, control_s: int = 1800) -> DataFrame:
    """Event and control windows per settlement and bracket."""
    x = settlements.select("*", F.explode(F.array(*[F.lit(b) for b in brackets])).alias("bracket"))
    width = F.abs("bracket") * unit_s
    parts = []
    for kind, shift in (("event", 0), ("control", control_s)):
        at = plus_seconds(time, shift)
        before = F.col("bracket") < 0
        parts.append(F.struct(F.lit(kind).alias("kind"), F.when(before, plus_seconds(at, -width)).otherwise(at).alias("a"), F.when(before, at).otherwise(plus_seconds(at, width)).alias("z")))
    return x.select("*", F.explode(F.array(*parts)).alias("w")).select(*settlements.columns, F.col("bracket").cast("long").alias("bracket"), "w.kind", "w.a", "w.z")


def bracket_returns(windows: DataFrame, bars: DataFrame, time: str, bucket_s: int = 3600) -> DataFrame:
    """First open to last close of bars closing strictly inside, event next to control."""
    b = bars.filter((F.col("open") > 0) & (F.col("close") > 0)).select("market", "time_close", "open", "close")
    hit = rows_in_windows(windows, b, ["market"], "a", "z", "time_close", bucket_s=bucket_s, include_start=False, include_end=False)
    keys = [c for c in windows.columns if c not in ("kind", "a", "z")]
    per = hit.groupBy(*keys, "kind").agg(F.ln(F.max_by("close", "time_close") / F.min_by("open", "time_close")).alias("ret"), F.count(F.lit(1)).alias("bars"))
    of = lambda k, c: F.max(F.when(F.col("kind") == k, F.col(c)))
    out = per.groupBy(*keys).agg(of("event", "ret").alias("event_return"), of("control", "ret").alias("baseline_return"), of("event", "bars").alias("event_bars"), of("control", "bars").alias("baseline_bars"))
    return out.filter("event_return is not null and baseline_return is not null").withColumn("cluster_key", cluster_key("market", time))
