"""Event windows: padding, merging, same-clock baselines, cascade anatomy, legs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tickloom.functions.timecols import MICROS, micros, plus_seconds
from tickloom.operators.asof import asof_join
from tickloom.operators.islands import interval_islands
from tickloom.operators.fantree import before, first_reaching, node_extremes, range_extremes, ranked
from tickloom.operators.ranges import range_totals
from tickloom.operators.slicing import DAY, Running, running
from tickloom.session import materialize


def padded_windows(events: DataFrame, pad_s: float = 1800) -> DataFrame:
    return events.select("*", plus_seconds("start_time", -pad_s).alias("w_start"), plus_seconds("end_time", pad_s).alias("w_end"))


def merge_windows(events: DataFrame, pad_s: float = 1800) -> DataFrame:
    """Padded events merged where they overlap or touch; numbered per market.

    The window count per market is small next to its ticks (one row per merged
    burst), so the numbering window is over summaries only.
    """
    lab = interval_islands(padded_windows(events, pad_s), ["market"], "w_start", "w_end")
    merged = lab.groupBy("market", "island_start").agg(
        F.max("w_end").alias("end"), F.max(F.col("rate_multiple") * F.col("displacement_multiple")).alias("burst_strength"),
        F.transform(F.array_sort(F.collect_list(F.struct("start_time", "end_time", "event_id"))), lambda e: e["event_id"]).alias("event_ids"),
    )
    n = F.row_number().over(Window.partitionBy("market").orderBy("island_start"))
    return merged.select(
        F.format_string("%s-W%04d", F.col("market"), n).alias("pair_id"), "market", F.col("island_start").alias("start"), "end",
        "event_ids", "burst_strength",
    )


def coverage_windows(ticks: DataFrame) -> DataFrame:
    """First hour to the end of the last hour seen per market."""
    h = F.date_trunc("hour", "time_exchange")
    return ticks.groupBy("market").agg(F.min(h).alias("cover_start"), (F.max(h) + F.expr("interval 1 hour")).alias("cover_end"))


def baseline_candidates(windows: DataFrame, coverage: DataFrame) -> DataFrame:
    """Same clock time and length on other days, inside coverage, free of events.

    Candidates grow with (windows x days covered); contamination is a bucketed
    range anti-join against the event windows themselves.
    """
    c = windows.join(coverage, "market")
    days = F.greatest(F.lit(1), F.datediff("cover_end", "cover_start") + 1)
    shifted = c.select(
        "*", F.explode(F.sequence(F.lit(1), days)).alias("distance")
    ).select("*", F.explode(F.array(-F.col("distance"), F.col("distance"))).alias("shift")).select(
        "pair_id", "market", "start", "end", "burst_strength", "distance", "shift",
        plus_seconds("start", F.col("shift") * 86_400).alias("b_start"), plus_seconds("end", F.col("shift") * 86_400).alias("b_end"),
        "cover_start", "cover_end",
    ).filter((F.col("b_start") >= F.col("cover_start")) & (F.col("b_end") <= F.col("cover_end"))).drop("cover_start", "cover_end")
    width = DAY * MICROS
    bucket = lambda a, b: F.explode(F.sequence(F.floor(micros(a) / width).cast("long"), F.floor(micros(b) / width).cast("long")))
    busy = windows.select("market", F.col("start").alias("x_start"), F.col("end").alias("x_end"), bucket("start", "end").alias("_b"))
    dirty = (
        shifted.select("pair_id", "market", "shift", "b_start", "b_end", bucket("b_start", "b_end").alias("_b"))
        .join(busy, ["market", "_b"]).filter((F.col("b_start") <= F.col("x_end")) & (F.col("x_start") <= F.col("b_end")))
        .select("pair_id", "shift").distinct()
    )
    return shifted.join(dirty, ["pair_id", "shift"], "left_anti")


def match_baselines(windows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Nearest free day per window, earlier on ties, no baseline used twice.

    The choice is greedy in start order, hence sequential per market and clock
    neighbourhood: only windows whose clock intervals overlap can compete for a
    baseline, so the groups are (market, connected clock range), not markets.
    """
    clock = F.pmod(micros("start"), F.lit(DAY * MICROS))
    w = windows.select("market", "pair_id", clock.alias("c0"), (clock + micros("end") - micros("start")).alias("c1"))
    # candidates keep their clock time, so overlaps in time imply overlaps on the
    # clock; wrap past midnight joins the first and last range of the day
    ts = lambda c: F.timestamp_micros(c)
    lab = interval_islands(w.select("*", ts(F.col("c0")).alias("a"), ts(F.col("c1")).alias("b")), ["market"], "a", "b", island="zone")
    wraps = lab.groupBy("market").agg(F.max("c1").alias("_m"), F.min("zone").alias("_z0"), F.max("zone").alias("_z1"))
    zone = lab.join(wraps, "market").select(
        "pair_id", F.when((F.col("zone") == F.col("_z1")) & (F.col("_m") >= DAY * MICROS), F.col("_z0")).otherwise(F.col("zone")).alias("zone")
    )
    schema = "pair_id string, market string, start timestamp, end timestamp, burst_strength double, shift long, b_start timestamp, b_end timestamp"

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "distance", "shift"])
        begins, ends = pdf["b_start"].to_numpy("datetime64[us]"), pdf["b_end"].to_numpy("datetime64[us]")
        used_a, used_b, rows = np.empty(0, "datetime64[us]"), np.empty(0, "datetime64[us]"), []
        for at in pdf.reset_index(drop=True).groupby("start", sort=True).indices.values():
            clash = ((begins[at][:, None] <= used_b) & (used_a <= ends[at][:, None])).any(axis=1)
            free = at[~clash]
            if len(free):
                used_a, used_b = np.append(used_a, begins[free[0]]), np.append(used_b, ends[free[0]])
                rows.append(free[0])
        out = pdf.iloc[rows]
        return out[["pair_id", "market", "start", "end", "burst_strength", "shift", "b_start", "b_end"]]

    return candidates.join(zone, "pair_id").groupBy("market", "zone").applyInPandas(pick, schema)


def legs(pairs: DataFrame) -> DataFrame:
    """Two rows per pair: the event window and its baseline."""
    leg = lambda t, a, b: F.struct(F.lit(t).alias("window_type"), F.col(a).alias("window_start"), F.col(b).alias("window_end"))
    return pairs.select(
        "pair_id", "market", F.explode(F.array(leg("forced-flow", "start", "end"), leg("baseline", "b_start", "b_end"))).alias("l")
    ).select("pair_id", "market", "l.*")


def pairs_from_legs(rows: DataFrame) -> DataFrame:
    of = lambda t, c: F.max(F.when(F.col("window_type") == t, F.col(c)))
    return rows.groupBy("pair_id", "market").agg(
        of("forced-flow", "window_start").alias("start"), of("forced-flow", "window_end").alias("end"),
        of("baseline", "window_start").alias("b_start"), of("baseline", "window_end").alias("b_end"),
    )


def matched_pairs(rows: DataFrame) -> DataFrame:
    """Keep rows of pairs present on both legs."""
    both = rows.groupBy("pair_id").agg(
        F.max((F.col("window_type") == "forced-flow").cast("int")).alias("a"), F.max((F.col("window_type") == "baseline").cast("int")).alias("b")
    ).filter((F.col("a") + F.col("b")) == 2).select("pair_id")
    return rows.join(both, "pair_id", "left_semi")


def cascade_anatomy(events: DataFrame, micro: DataFrame, depth: DataFrame, *, pre_s: float = 60, reversion_s: float = 1800, width_s: int = DAY) -> DataFrame:
    """Pre-event mean, adverse extreme, overshoot, half reversion and depth walked.

    No (event, tick) pairs are made: the mean is a difference of running totals, the
    extreme is read from nodes over ranked ticks, and the first tick back across the
    half-way target is found by going down those nodes.
    """
    ecols = events.columns
    ticks = micro.select("market", F.col("time_exchange").alias("time"), "microprice").filter("time is not null and microprice is not null")
    points = ranked(ticks, ["market"], "time", width_s=width_s)
    bounds = {"pre": (plus_seconds("start_time", -pre_s), F.col("start_time"), True, False)}
    mean = range_totals(events, points, ["market"], "time", bounds, {"n": F.lit(1), "px": F.col("microprice")}, width_s=width_s)
    us = micros("time")
    nodes, levels = node_extremes(points, ["market"], F.struct(F.col("microprice").alias("px"), us.alias("at")), F.struct(F.col("microprice").alias("px"), (-us).alias("at")))
    inside = before(events.select("event_id", "market", "start_time", "end_time"), points, ["market"], micros("start_time"), "a", width_s=width_s)
    inside = before(inside, points, ["market"], micros("end_time"), "b", through=True, width_s=width_s)
    seen = range_extremes(inside, nodes, levels, ["market"], "event_id")
    sell = F.col("direction") == "SELL"
    j = mean.join(seen, "event_id", "left")
    count, px = F.coalesce(F.col("pre_n"), F.lit(0.0)), F.when(sell, F.col("low.px")).otherwise(F.col("high.px"))
    at = F.timestamp_micros(F.when(sell, F.col("low.at")).otherwise(-F.col("high.at")))
    j = j.select(*ecols, F.when(count > 0, F.col("pre_px") / count).alias("pre_event_microprice_mean"), count.cast("long").alias("pre_event_observation_count"), px.alias("_px"), at.alias("_at"))
    mean_, ext = F.col("pre_event_microprice_mean"), F.col("_px")
    over = F.when(mean_.isNotNull() & ext.isNotNull(), F.greatest(F.lit(0.0), F.when(sell, mean_ - ext).otherwise(ext - mean_)))
    o = materialize(j.select(
        *ecols, "pre_event_microprice_mean", "pre_event_observation_count", over.alias("overshoot_price"), (over / mean_ * 10_000).alias("overshoot_bps"),
        F.when(over.isNotNull(), F.col("_at")).alias("overshoot_time"),
    ), "overshoot")
    half = F.col("overshoot_price") / 2
    target = F.when(sell, F.col("pre_event_microprice_mean") - half).otherwise(F.col("pre_event_microprice_mean") + half)
    hunt = o.filter(F.col("overshoot_price") > 0).select("event_id", "market", sell.alias("sell"), target.alias("target"), "overshoot_time", plus_seconds("end_time", reversion_s).alias("_limit"))
    hunt = before(before(hunt, points, ["market"], micros("overshoot_time"), "a", width_s=width_s), points, ["market"], micros("_limit"), "b", through=True, width_s=width_s)
    reaches = F.when(F.col("sell"), F.col("high.px") >= F.col("target")).otherwise(F.col("low.px") <= F.col("target"))
    first = first_reaching(hunt.drop("overshoot_time", "_limit"), nodes, levels, ["market"], "event_id", reaches)
    back = first.join(o.select("event_id", "market"), "event_id").join(points.select("market", "r", F.col("time").alias("_back")), ["market", "r"]).select("event_id", "_back")
    out = o.join(back, "event_id", "left").join(depth_walk(events, depth), "event_id", "left")
    return out.select(
        *o.columns,
        ((micros("_back") - micros("overshoot_time")) / F.lit(float(MICROS))).alias("reversion_half_life_seconds"),
        (F.coalesce(F.col("overshoot_price") > 0, F.lit(False)) & F.col("_back").isNull()).alias("reversion_censored"),
        F.coalesce(F.col("overshoot_price") <= 0, F.lit(False)).alias("zero_overshoot"),
        ((micros("end_time") - micros("start_time")) / F.lit(float(MICROS))).alias("duration_seconds"),
        "depth_snapshot_time", "depth_levels_consumed", "depth_size_consumed", "depth_size_available", "depth_size_shortfall",
    )


def depth_walk(events: DataFrame, depth: DataFrame) -> DataFrame:
    """Walk the latest depth known at the event start until its size is absorbed.

    ``depth`` holds full snapshots (market, time_exchange, side, level, price, size).
    """
    times = depth.select("market", F.col("time_exchange").alias("depth_snapshot_time")).distinct()
    e = events.select("event_id", "market", "start_time", "direction", "aggressor_size")
    known = asof_join(e, times, ["market"], "start_time", "depth_snapshot_time", ["depth_snapshot_time"], prefix="d_").drop("d_obs_time").filter(
        F.col("d_depth_snapshot_time").isNotNull()
    )
    side = F.when(F.col("direction") == "SELL", "bid").otherwise("ask")
    rows = known.withColumn("side", side).join(
        depth.withColumnRenamed("time_exchange", "d_depth_snapshot_time"), ["market", "d_depth_snapshot_time", "side"], "left"
    )
    w = Window.partitionBy("event_id").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # levels of one snapshot
    before = F.coalesce(F.sum("size").over(w), F.lit(0.0))
    take = F.greatest(F.lit(0.0), F.least(F.col("size"), F.col("aggressor_size") - before))
    return rows.withColumn("_take", take).groupBy("event_id").agg(
        F.max("d_depth_snapshot_time").alias("depth_snapshot_time"), F.count_if(F.col("_take") > 0).alias("depth_levels_consumed"),
        F.coalesce(F.sum("_take"), F.lit(0.0)).alias("depth_size_consumed"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("depth_size_available"),
        F.max("aggressor_size").alias("_want"),
    ).select("*", F.greatest(F.lit(0.0), F.col("_want") - F.col("depth_size_consumed")).alias("depth_size_shortfall")).drop("_want")
