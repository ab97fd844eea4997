"""Touch-episode passive fills and their markouts.

A quote joins a side whenever that side's touch price or displayed size changes
and rests until it fills, the touch changes or a one-sided row ends both sides.  A
trade fills it by printing through the price, or when the volume printed at the
price since joining exceeds the displayed size.  Trades sharing an instant with a
top-of-book row are ambiguous and never count.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.rows import COPIES, folded, unfolded
from tickloom.functions.timecols import cluster_key, micros, plus_seconds
from tickloom.operators.asof import Source, asof_join, asof_many, require_match, with_staleness
from tickloom.operators.quotes import L1, microprices, two_sided
from tickloom.operators.sessions import label_sessions, study_segment
from tickloom.operators.slicing import DAY, Running, openings, running

HORIZONS = {"1s": 1, "5s": 5, "30s": 30, "2m": 120, "10m": 600}
MAKER_FEE_BPS = 1.5


def touch_episodes(l1: DataFrame, *, width_s: int = DAY) -> DataFrame:
    """Per top-of-book row: the quote resting on each side and when it joined."""
    base = l1.select("market", "time_exchange", two_sided().alias("ok"), *L1)
    fresh = ~F.coalesce(F.col("p_ok"), F.lit(False))

    def changed(px: str, sx: str) -> Column:
        return F.col("ok") & (fresh | (F.col(px) != F.col(f"p_{px}")) | (F.col(sx) != F.col(f"p_{sx}")))

    joined = openings(
        base, ["market"], "time_exchange",
        {"buy_join": changed("best_bid_px", "best_bid_sx"), "sell_join": changed("best_ask_px", "best_ask_sx")},
        {f"p_{c}": F.col(c) for c in ("ok", *L1)},
        width_s=width_s,
    )
    keep = lambda c: F.when(F.col("ok"), F.col(c))
    return joined.select(
        "market", "time_exchange",
        keep("best_bid_px").alias("buy_px"), keep("best_bid_sx").alias("buy_sx"), keep("buy_join").alias("buy_join"),
        keep("best_ask_px").alias("sell_px"), keep("best_ask_sx").alias("sell_sx"), keep("sell_join").alias("sell_join"),
    )


def touch_fills(l1: DataFrame, trades: DataFrame, *, width_s: int = DAY) -> DataFrame:
    """One fill at most per quote episode (an upper bound on real passive fills)."""
    state = touch_episodes(l1, width_s=width_s)
    t = trades.filter(F.col("price").isNotNull() & F.col("base_amount").isNotNull()).select(
        "market", "time_exchange", "seq", "price", "base_amount"
    )
    seen = asof_join(
        t, state, ["market"], "time_exchange", "time_exchange",
        ["buy_px", "buy_sx", "buy_join", "sell_px", "sell_sx", "sell_join"], width_s=width_s,
    ).filter(F.col("obs_time") < F.col("time_exchange"))
    side = lambda s: F.struct(
        F.lit(s).alias("side"), F.col(f"{s}_px").alias("px"), F.col(f"{s}_sx").alias("sx"), F.col(f"{s}_join").alias("join_time")
    )
    rel = F.when(F.col("side") == "buy", F.col("px") - F.col("price")).otherwise(F.col("price") - F.col("px"))
    cand = (
        seen.select("market", "time_exchange", "seq", "price", "base_amount", F.explode(F.array(side("buy"), side("sell"))).alias("q"))
        .select("market", "time_exchange", "seq", "price", "base_amount", "q.*")
        .filter(F.col("join_time").isNotNull())
        .withColumn("rel", rel)
        .filter(F.col("rel") >= 0)  # prints on the far side can neither fill nor queue
    )
    cum = running(
        cand, ["market", "side", "join_time"], micros("time_exchange"),
        {"at_price": Running("sum", F.when(F.col("rel") == 0, F.col("base_amount")))},
        tie=[F.col("seq")], width_s=width_s,
    ).withColumn("at_price", F.coalesce("at_price", F.lit(0.0)))
    hit = cum.filter((F.col("rel") > 0) | (F.col("at_price") > F.col("sx")))
    first = hit.groupBy("market", "side", "join_time").agg(
        F.min_by(
            F.struct("time_exchange", "px", "price", "base_amount", "sx", "at_price"), F.struct("time_exchange", "seq")
        ).alias("f")
    )
    return first.select(
        "market",
        F.col("f.time_exchange").alias("fill_time"),
        "join_time",
        "side",
        F.col("f.px").alias("fill_price"),
        F.col("f.price").alias("filling_print_price"),
        F.col("f.base_amount").alias("filling_print_size"),
        F.col("f.sx").alias("queue_ahead"),
        F.col("f.at_price").alias("at_price_cumulative"),
        F.when(F.col("f.base_amount") > F.col("f.sx"), "sweep").otherwise("trickle").alias("size_bucket"),
    )


def gross_bps(sign: Column, observed: Column, fill: Column) -> Column:
    return sign * (observed - fill) / fill * F.lit(10_000.0)


def funding_bps(sign: Column, rate: Column, seconds: Column | float) -> Column:
    s = seconds if isinstance(seconds, Column) else F.lit(float(seconds))
    return sign * rate * (s / F.lit(3600.0)) * F.lit(10_000.0)


def fill_markouts(
    fills: DataFrame,
    l1: DataFrame,
    funding: DataFrame,
    *,
    horizons: Mapping[str, int] = HORIZONS,
    maker_fee_bps: float = MAKER_FEE_BPS,
    max_quote_age_s: float = 60.0,
    exchange: str = "XNYS",
    width_s: int = DAY,
) -> DataFrame:
    """Gross and net markouts of each fill at every horizon, with staleness flags.

    All probes (entry and horizons) share one as-of pass.  Funding is the latest
    rate known at the fill and is held over the horizon; a fill with no known rate
    is an error.
    """
    if not horizons or any(s <= 0 for s in horizons.values()):
        raise ValueError("horizons must be positive")
    fcols = fills.columns
    labels = F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("s")) for k, v in [("entry", 0), *horizons.items()]])
    probes = folded(fills).select("*", F.explode(labels).alias("_h")).select("*", plus_seconds("fill_time", F.col("_h.s")).alias("_target"))
    seen = asof_many(
        probes,
        {"": Source(microprices(l1), "time_exchange", ["microprice"]), "f_": Source(funding, "time_exchange", ["funding_rate"])},
        ["market"], "_target", width_s=width_s,
    )
    seen = with_staleness(seen, "_target", "obs_time", ["microprice"], max_quote_age_s, "stale")
    entry = F.col("_h.label") == "entry"
    wide = seen.groupBy(*fcols, COPIES).agg(
        F.max(F.when(entry, F.col("stale"))).alias("_es"),
        F.max(F.when(entry, F.col("f_funding_rate"))).alias("_rate"),
        *[F.max(F.when(F.col("_h.label") == k, F.col("microprice"))).alias(f"_m_{k}") for k in horizons],
        *[F.max(F.when(F.col("_h.label") == k, F.col("stale"))).alias(f"_s_{k}") for k in horizons],
    )
    wide = unfolded(wide).withColumn("funding_hourly_rate", require_match(F.col("_rate"), "no funding rate known by fill time"))
    sign = F.when(F.col("side") == "buy", F.lit(1.0)).otherwise(F.lit(-1.0))
    out = []
    for k, s in horizons.items():
        stale = F.col("_es") | F.col(f"_s_{k}")
        seen_px = F.when(~stale, F.col(f"_m_{k}"))
        gross = gross_bps(sign, seen_px, F.col("fill_price"))
        drift = funding_bps(sign, F.col("funding_hourly_rate"), s)
        out += [
            seen_px.alias(f"microprice_{k}"),
            gross.alias(f"gross_markout_{k}_bps"),
            drift.alias(f"funding_drift_{k}_bps"),
            (gross - F.lit(maker_fee_bps) - drift).alias(f"net_markout_{k}_bps"),
            stale.alias(f"stale_{k}"),
        ]
    labelled = label_sessions(wide, "fill_time", exchange, "_session")
    return labelled.select(
        *fcols,
        study_segment(F.col("_session")).alias("segment"),
        F.hour("fill_time").cast("long").alias("hour_of_day"),
        cluster_key("market", "fill_time").alias("cluster_key"),
        F.lit(float(maker_fee_bps)).alias("maker_fee_bps"),
        "funding_hourly_rate",
        *out,
    )


def with_default_rate(funding: DataFrame, markets: DataFrame, start: Column) -> DataFrame:
    """Prepend an explicit zero rate at ``start`` where a history begins later or is empty."""
    first = funding.groupBy("market").agg(F.min("time_exchange").alias("_first"))
    late = (
        markets.select("market").distinct().join(first, "market", "left")
        .filter(F.col("_first").isNull() | (F.col("_first") > start))
        .select("market", start.alias("time_exchange"), F.lit(0.0).alias("funding_rate"))
    )
    return funding.select("market", "time_exchange", "funding_rate").unionByName(late)
