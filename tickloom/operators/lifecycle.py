"""Lifecycle signals on daily panels, their event backtest and survivorship."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.timecols import plus_seconds
from tickloom.operators.asof import asof_join

YEAR = 365 * 86_400


def features(panel: DataFrame) -> DataFrame:
    """Age, 3-session return and trailing 7-session median notional (one row per market and day)."""
    w = Window.partitionBy("market").orderBy("time_open")
    ntl = F.col("volume") * F.col("close")
    x = panel.select("market", F.col("time_open").alias("date"), "time_open", "close", ntl.alias("ntl"))
    x = x.select(
        "market", "date", "close", "ntl", F.min("date").over(Window.partitionBy("market")).alias("first_date"), F.max("date").over(Window.partitionBy("market")).alias("last_date"),
        (F.col("close") / F.lag("close", 3).over(w) - 1).alias("ret3"),
        F.when(F.count("ntl").over(w.rowsBetween(-7, -1)) == 7, F.percentile("ntl", 0.5).over(w.rowsBetween(-7, -1))).alias("liq7_usd"),
    )
    return x.withColumn("age_days", F.datediff("date", "first_date").cast("long"))


def eligible(f: DataFrame, *, age_min: int, age_max: int, floor_usd: float, censor: Column | None = None) -> DataFrame:
    out = f.filter((F.col("age_days") >= age_min) & (F.col("age_days") < age_max) & (F.col("liq7_usd") >= floor_usd))
    return out if censor is None else out.filter(F.col("first_date") != censor)


def with_median_residual(f: DataFrame) -> DataFrame:
    """3-session return minus the same day's cross-sectional median."""
    m = F.percentile("ret3", 0.5).over(Window.partitionBy("date"))
    return f.withColumn("residual", F.col("ret3") - m)


def _select_deepest(signals: DataFrame, longs: Column) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("date", longs).orderBy("signal_value", "market"))
    return signals.withColumn("selected", longs & (r == 1))


def raw_signals(f: DataFrame, threshold: float = -0.08, **kw) -> DataFrame:
    """Long after a fall beyond the threshold, short after the mirror rise."""
    s = eligible(f, **kw).filter(F.abs("ret3") >= abs(threshold))
    s = s.select("*", F.when(F.col("ret3") <= threshold, 1).otherwise(-1).cast("long").alias("side"), F.col("ret3").alias("signal_value"))
    return _select_deepest(s, F.col("side") == 1)


def residual_signals(f: DataFrame, threshold: float = -0.08, **kw) -> DataFrame:
    """Long where the residual return is below the threshold."""
    s = eligible(with_median_residual(f), **kw).withColumn("signal_value", F.col("residual")).filter(F.col("signal_value") <= threshold)
    return _select_deepest(s.withColumn("side", F.lit(1).cast("long")), F.lit(True))


def event_backtest(signals: DataFrame, opens: DataFrame, *, tolerance_s: float = 6 * 3600, hold_s: float = 86_400, cost_bp: float = 20.0) -> DataFrame:
    """Next open after the signal day, the open a holding period later, net bps.

    ``entry_px`` or ``exit_px`` stay null where no open came within the tolerance.
    """
    o = opens.select("market", F.col("time_open").alias("ts"), F.col("open").alias("px"))
    s = signals.withColumn("signal_ts", plus_seconds("date", 86_400))
    e = asof_join(s, o, ["market"], "signal_ts", "ts", ["px"], direction="forward", prefix="e_", max_age_s=tolerance_s, width_s=YEAR)
    e = e.select(*s.columns, F.when(~F.col("e_stale"), F.col("e_obs_time")).alias("entry_ts"), F.col("e_px").alias("entry_px"))
    e = e.withColumn("exit_target", plus_seconds("entry_ts", hold_s))
    x = asof_join(e.filter("entry_ts is not null"), o, ["market"], "exit_target", "ts", ["px"], direction="forward", prefix="x_", max_age_s=tolerance_s, width_s=YEAR)
    x = x.select(*e.columns, F.when(~F.col("x_stale"), F.col("x_obs_time")).alias("exit_ts"), F.col("x_px").alias("exit_px"))
    both = x.unionByName(e.filter("entry_ts is null"), allowMissingColumns=True)
    return both.withColumn("net_bp", F.col("side") * (F.col("exit_px") / F.col("entry_px") - 1) * 1e4 - F.lit(cost_bp)).drop("exit_target")


def top_one_per_day(events: DataFrame, size: Column) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("date").orderBy(size.desc(), "market"))
    return events.withColumn("_r", r).filter("_r = 1").drop("_r")


def spans(panel: DataFrame) -> DataFrame:
    w = Window.partitionBy("market").orderBy("time_open")
    g = panel.select("market", "time_open", "close", "volume", F.datediff("time_open", F.lag("time_open", 1).over(w)).alias("gap"))
    return g.groupBy("market").agg(
        F.min("time_open").alias("first"), F.max("time_open").alias("last"), F.count(F.lit(1)).alias("rows"), F.max("gap").cast("long").alias("max_gap"),
        F.percentile(F.col("volume") * F.col("close"), 0.5).alias("median_ntl"),
    )


def death_bucket(days: Column, died: Column) -> Column:
    return F.when(days <= 7, "<=7d").when(days <= 21, "8-21d").when(died, ">21d, died").otherwise("survived")
