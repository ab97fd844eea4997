"""Offset-quote harvesting, basis events and exits on minute bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.rows import COPIES, folded, unfolded
from tickloom.functions.timecols import MICROS, micros, plus_seconds
from tickloom.operators.asof import asof_join
from tickloom.operators.ranges import rows_in_windows
from tickloom.operators.slicing import lagged
from tickloom.session import materialize

MONTH = 30 * 86_400


def cooldown(candidates: DataFrame, keys: Sequence[str], time: str, cooldown_s: float) -> DataFrame:
    """Keep a candidate only when the last *kept* one is at least that old.

    A pause of a whole cooldown frees the next candidate whatever came before; such heads are kept. Every candidate points to the
    first one that its own choice would allow, and the kept ones are those that pointers reach from a head. They are found by
    pointer doubling: after k rounds of joins all within 2**k steps are known, so a dense run of any length takes the logarithm
    of its kept candidates in rounds, and no run is ever gathered. Of candidates that share an instant the smallest row is kept.
    """
    if cooldown_s <= 0:
        return candidates
    by, us = [*keys, time], int(cooldown_s * MICROS)
    rest = [c for c in candidates.columns if c not in by]
    nodes = materialize(candidates.filter(F.col(time).isNotNull()).select(*by).distinct(), "candidates")
    seen = lagged(nodes, list(keys), micros(time), {"_pt": F.col(time)}, width_s=MONTH)
    head = F.coalesce(micros(time) - micros("_pt") >= us, F.lit(True))
    at = materialize(seen.select(*by, head.alias("_head")), "heads")
    probes = nodes.select(*by, F.timestamp_micros(micros(time) + us).alias("_probe"))
    ahead = asof_join(probes, at.select(*keys, F.col(time).alias("_to"), "_head"), list(keys), "_probe", "_to", ["_to", "_head"], direction="forward", prefix="n", width_s=MONTH)
    # A pointer to a head is not needed: the head is kept anyway.
    jump = materialize(ahead.filter("n_to is not null and not n_head").select(*by, F.col("n_to").alias("_to")), "jumps")
    kept = at.filter("_head").select(*by)
    while not jump.isEmpty():
        kept = materialize(kept.unionByName(kept.join(jump, by).select(*keys, F.col("_to").alias(time))), "kept")
        further = jump.select(*keys, F.col(time).alias("_to"), F.col("_to").alias("_further"))
        jump = materialize(jump.join(further, [*keys, "_to"]).select(*by, F.col("_further").alias("_to")), "jumps")
    first = candidates.groupBy(*by).agg(F.min(F.struct(*rest)).alias("_row")) if rest else nodes
    return first.join(kept, by).select(*[F.col(f"_row.`{c}`").alias(c) if c in rest else F.col(c) for c in candidates.columns])


def trailing_reference(bars: DataFrame, *, rows: int = 5, recency_s: float = 1800) -> DataFrame:
    """Median of the previous bars' medians, where the last bar is recent enough."""
    w = Window.partitionBy("market").orderBy("bar")
    prev = F.lag("bar", 1).over(w)
    ref = F.percentile("med", 0.5).over(w.rowsBetween(-rows, -1))
    full = (F.count("med").over(w.rowsBetween(-rows, -1)) == rows) & (micros("bar") - micros(prev) <= int(recency_s * MICROS))
    return bars.withColumn("ref", F.when(full, ref))


def forward_price(events: DataFrame, bars: DataFrame, time: str, horizons: Mapping[str, float], tolerance_s: float, price: str = "med") -> DataFrame:
    """Price of the first bar in ``[t+h, t+h+tolerance]`` per horizon, as columns."""
    h = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(v)).alias("s")) for k, v in horizons.items()]))
    p = folded(events).select("*", h.alias("_h")).select("*", plus_seconds(time, F.col("_h.s")).alias("_probe"))
    j = asof_join(p, bars.select("market", "bar", price), ["market"], "_probe", "bar", [price], direction="forward", prefix="f_", max_age_s=tolerance_s, width_s=MONTH)
    return unfolded(j.groupBy(*events.columns, COPIES).agg(*[F.max(F.when(F.col("_h.k") == k, F.col(f"f_{price}"))).alias(f"px_{k}") for k in horizons]))


def harvest_fills(bars: DataFrame, deltas_bps: Sequence[float], *, cooldown_s: float = 3600, horizons: Mapping[str, float], tolerance_s: float = 600, recency_s: float = 1800) -> DataFrame:
    """Quotes at ``ref`` plus or minus delta, filled when a bar trades strictly through."""
    r = trailing_reference(bars, recency_s=recency_s).filter("ref is not null")
    side = lambda s: F.struct(F.lit(s).alias("side"))
    x = r.select("*", F.explode(F.array(*[F.lit(float(d)) for d in deltas_bps])).alias("delta_bps")).select("*", F.explode(F.array(side("bid"), side("ask"))).alias("_s"))
    d = F.col("delta_bps") / 10_000
    bid = F.col("_s.side") == "bid"
    x = x.select("market", F.col("_s.side").alias("side"), "delta_bps", F.col("bar").alias("fill_time"), F.when(bid, F.col("ref") * (1 - d)).otherwise(F.col("ref") * (1 + d)).alias("fill_px"), "ref", "lo", "hi")
    x = x.filter(F.when(F.col("side") == "bid", F.col("lo") < F.col("fill_px")).otherwise(F.col("hi") > F.col("fill_px"))).drop("lo", "hi")
    kept = cooldown(x, ["market", "side", "delta_bps"], "fill_time", cooldown_s)
    m = forward_price(kept, bars, "fill_time", horizons, tolerance_s)
    mark = lambda c: F.when(F.col("side") == "bid", F.col(c) - F.col("fill_px")).otherwise(F.col("fill_px") - F.col(c)) / F.col("fill_px") * 1e4
    return m.select(*kept.columns, *[mark(f"px_{k}").alias(f"markout_{k}_bps") for k in horizons])


def executable_exit(fills: DataFrame, quotes: DataFrame, *, after_s: float = 1800, max_age_s: float = 300) -> DataFrame:
    """Crossing the last fresh two-sided quote a while after each fill."""
    p = fills.withColumn("_t", plus_seconds("fill_time", after_s))
    q = quotes.select("market", "time_exchange", "best_bid_px", "best_bid_sx", "best_ask_px", "best_ask_sx")
    j = asof_join(p, q, ["market"], "_t", "time_exchange", ["best_bid_px", "best_bid_sx", "best_ask_px", "best_ask_sx"], prefix="q_", max_age_s=max_age_s)
    b, a = F.col("q_best_bid_px"), F.col("q_best_ask_px")
    ok = F.coalesce((b > 0) & (a > b), F.lit(False))
    buy = F.col("side") == "bid"
    px = F.when(buy, b).otherwise(a)
    mark = F.when(buy, px - F.col("fill_px")).otherwise(F.col("fill_px") - px) / F.col("fill_px") * 1e4
    depth = px * F.coalesce(F.when(buy, F.col("q_best_bid_sx")).otherwise(F.col("q_best_ask_sx")), F.lit(0.0))
    return j.select(*fills.columns, F.when(ok, mark).alias("exec_markout_bps"), F.when(ok, depth).alias("exit_touch_depth_usd"), F.when(ok, (a - b) / ((a + b) / 2) * 1e4).alias("exit_spread_bps"))


def passive_exit(fills: DataFrame, bars: DataFrame, quotes: DataFrame, *, window_s: float = 3600, max_age_s: float = 300, max_spread_bps: float = 200, maker_bp: float = 1.5, taker_bp: float = 4.5, bucket_s: int = 3600) -> DataFrame:
    """Rest at the full or half reversal for the window, else cross the bid at its end."""
    pol = lambda n, c: F.struct(F.lit(n).alias("policy"), c.alias("target"))
    f = fills.select("*", F.explode(F.array(pol("full", F.col("ref")), pol("half", F.col("ref") * (1 - F.col("delta_bps") / 2e4)))).alias("_p")).select(*fills.columns, "_p.policy", "_p.target", plus_seconds("fill_time", window_s).alias("_end"))
    hit = rows_in_windows(f, bars.select("market", "bar", "hi"), ["market"], "fill_time", "_end", "bar", bucket_s=bucket_s, include_start=False).filter(F.col("hi") > F.col("target"))
    k = ["market", "side", "delta_bps", "fill_time", "policy"]
    first = hit.groupBy(*k).agg(F.min("bar").alias("filled_at"))
    j = f.join(first, k, "left")
    q = asof_join(j, quotes.select("market", "time_exchange", "best_bid_px", "best_ask_px"), ["market"], "_end", "time_exchange", ["best_bid_px", "best_ask_px"], prefix="q_", max_age_s=max_age_s)
    b, a = F.col("q_best_bid_px"), F.col("q_best_ask_px")
    ok = F.coalesce((b > 0) & (a > b) & ((a - b) / ((a + b) / 2) * 1e4 <= max_spread_bps), F.lit(False))
    passive = F.col("filled_at").isNotNull()
    gain = lambda px: (px - F.col("fill_px")) / F.col("fill_px") * 1e4 - F.lit(maker_bp)
    return q.select(
        *k, F.when(passive, "passive").when(ok, "crossed").otherwise("na").alias("mode"),
        F.when(passive, gain(F.col("target")) - maker_bp).when(ok, gain(b) - taker_bp).alias("net_bps"),
    )


def move_class(toward: Column, size: Column, middle: str = "flat", fraction: float = 0.25) -> Column:
    """Whether a move went with (confirmed), against (opposed) or neither."""
    return F.when(toward >= F.lit(fraction) * size, "confirmed").when(toward <= -F.lit(fraction) * size, "opposed").otherwise(middle)


def oracle_at(df: DataFrame, oracle_bars: DataFrame, time: str, name: str, max_age_s: float = 600) -> DataFrame:
    j = asof_join(df, oracle_bars.select("market", "bar", "oracle_px"), ["market"], time, "bar", ["oracle_px"], prefix="_o_", max_age_s=max_age_s, width_s=MONTH)
    return j.select(*df.columns, F.col("_o_oracle_px").alias(name))


def basis_series(bars: DataFrame, oracle_bars: DataFrame, *, max_age_s: float = 600, scale_guard: float = 0.30) -> DataFrame:
    """Log price over oracle in bps; wrong-scale and uncovered bars are null."""
    j = oracle_at(bars, oracle_bars, "bar", "oracle_px", max_age_s)
    ok = F.abs(F.col("med") / F.col("oracle_px") - 1) <= scale_guard
    return j.withColumn("basis_bps", F.when(ok, F.ln(F.col("med") / F.col("oracle_px")) * 1e4))


def fresh_crosses(series: DataFrame, value: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows at or beyond a threshold whose previous row was inside it."""
    w = Window.partitionBy("market").orderBy("bar")
    x = series.withColumn("_p", F.lag(value, 1).over(w)).select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    v = F.col(value)
    return x.filter((F.abs(v) >= F.col("threshold")) & (F.abs("_p") < F.col("threshold"))).withColumn("gap_sign", F.when(v > 0, 1).otherwise(-1).cast("long")).drop("_p")


def basis_events(bars: DataFrame, oracle_bars: DataFrame, thresholds: Sequence[float], horizons: Mapping[str, float], *, cooldown_s: float = 3600, pre_s: float = 1800, tolerance_s: float = 600, max_age_s: float = 600) -> DataFrame:
    """Fresh basis gaps, thinned, classed by the oracle's move, with convergence PnL."""
    s = basis_series(bars, oracle_bars, max_age_s=max_age_s).select("market", "bar", "med", "basis_bps")
    ev = cooldown(fresh_crosses(s, "basis_bps", thresholds), ["market", "threshold", "gap_sign"], "bar", cooldown_s)
    ev = oracle_at(ev, oracle_bars, "bar", "_now", max_age_s).withColumn("_pre_t", plus_seconds("bar", -pre_s))
    ev = oracle_at(ev, oracle_bars, "_pre_t", "_pre", max_age_s).filter("_now is not null and _pre is not null")
    toward = (F.col("_now") - F.col("_pre")) / F.col("_pre") * 1e4 * F.col("gap_sign")
    ev = ev.select("market", "threshold", "gap_sign", "bar", "med", "basis_bps", move_class(toward, F.abs("basis_bps")).alias("cls"))
    m = forward_price(ev, bars.withColumnRenamed("med", "fmed"), "bar", horizons, tolerance_s, "fmed")
    return m.select(*[c for c in ev.columns if c != "med"], *[(-F.col("gap_sign") * F.ln(F.col(f"px_{k}") / F.col("med")) * 1e4).alias(f"pnl_{k}") for k in horizons])


def oracle_conditioned_fills(fills: DataFrame, oracle_bars: DataFrame, *, pre_s: float = 1800, max_age_s: float = 600, scale_guard: float = 0.30) -> DataFrame:
    f = oracle_at(fills, oracle_bars, "fill_time", "_now", max_age_s).withColumn("_pt", plus_seconds("fill_time", -pre_s))
    f = oracle_at(f, oracle_bars, "_pt", "_pre", max_age_s).filter("_now is not null and _pre is not null")
    f = f.filter(F.abs(F.col("fill_px") / F.col("_now") - 1) <= scale_guard)
    move = (F.col("_now") - F.col("_pre")) / F.col("_pre") * 1e4
    toward = F.when(F.col("side") == "bid", -move).otherwise(move)
    return f.select(*fills.columns, move.alias("oracle_move_bps"), toward.alias("toward_bps"), move_class(toward, F.col("delta_bps"), "perp_only").alias("cls"))
