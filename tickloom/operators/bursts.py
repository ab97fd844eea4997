"""Burst ("forced-flow") detection over dense directional buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.timecols import micros
from tickloom.operators.bars import closes, directional_bars, repeated_wallets
from tickloom.operators.islands import interval_islands
from tickloom.operators.rolling import chunk_window, dense_grid, owned, with_halo
from tickloom.operators.slicing import DAY, Running, running

HISTORY = 60
RATE_MULTIPLE = 3.0
SIGMA_MULTIPLE = 3.0


def baselines(trades: DataFrame, *, bucket_s: int = 60, history: int = HISTORY, chunk_s: int | None = None) -> DataFrame:
    """Dense (market, bucket) rows with both sides' counts and trailing baselines.

    The grid is bounded by clock time, not by tick volume.  Closes are carried
    forward over silent buckets; baselines use the ``history`` buckets strictly
    before the current one, and are null until that many exist.
    """
    chunk_s = chunk_s or max(DAY * 30, bucket_s * history * 4)
    bars = directional_bars(trades, bucket_s)
    counts = bars.groupBy("market", "bucket").pivot("taker_side", ["BUY", "SELL"]).agg(F.sum("trade_count"))
    per = closes(trades, bucket_s).join(counts, ["market", "bucket"], "left")
    grid = dense_grid(per, ["market"], "bucket", bucket_s).join(per, ["market", "bucket"], "left").select(
        "market", "bucket", "close", F.coalesce("BUY", F.lit(0)).alias("n_buy"), F.coalesce("SELL", F.lit(0)).alias("n_sell")
    )
    filled = running(grid, ["market"], micros("bucket"), {"close": Running("last", F.col("close"))}, width_s=chunk_s)
    halo = with_halo(filled, micros("bucket"), chunk_s, (history + 2) * bucket_s)
    w = chunk_window(["market"], ["bucket"])
    back = w.rowsBetween(-history, -1)
    prev = F.lag("close", 1).over(w)
    rets = halo.select("*", prev.alias("prev_close"), F.coalesce(F.ln(F.col("close") / prev), F.lit(0.0)).alias("ret"))
    full = F.count(F.lit(1)).over(back) == history
    return owned(
        rets.select(
            "market", "bucket", "close", "prev_close", "ret", "n_buy", "n_sell", "_chunk", "_own",
            F.when(full, F.percentile("n_buy", 0.5).over(back)).alias("med_buy"),
            F.when(full, F.percentile("n_sell", 0.5).over(back)).alias("med_sell"),
            F.when(full, F.stddev_pop("ret").over(back)).alias("sigma"),
        )
    )


def burst_candidates(
    trades: DataFrame, *, bucket_s: int = 60, history: int = HISTORY,
    rate_multiple: float = RATE_MULTIPLE, sigma_multiple: float = SIGMA_MULTIPLE,
) -> DataFrame:
    """Buckets passing both thresholds; ``abstained`` marks zero baselines."""
    base = baselines(trades, bucket_s=bucket_s, history=history)
    rows = directional_bars(trades, bucket_s).join(repeated_wallets(trades, bucket_s), ["market", "bucket", "taker_side"], "inner")
    sell = F.col("taker_side") == "SELL"
    adverse = F.when(sell, F.col("min_price")).otherwise(F.col("max_price"))
    move = F.ln(adverse / F.col("prev_close"))
    c = rows.join(base, ["market", "bucket"], "inner").select(
        "market", "bucket", "start_time", "end_time", F.col("taker_side").alias("direction"), "aggressor_size", "wallets", "trade_count",
        F.when(sell, F.col("med_sell")).otherwise(F.col("med_buy")).alias("trailing_median_trade_rate"),
        F.when(sell, -move).otherwise(move).alias("price_displacement"),
        F.col("sigma").alias("trailing_return_sigma"),
    )
    med, sig = F.col("trailing_median_trade_rate"), F.col("trailing_return_sigma")
    hit = (F.col("trade_count") >= rate_multiple * med) & (F.col("price_displacement") >= sigma_multiple * sig)
    return c.filter(med.isNotNull() & sig.isNotNull() & hit).select(
        "*", ((med == 0) | (sig == 0)).alias("abstained"),
        F.when(med != 0, F.col("trade_count") / med).alias("rate_multiple"),
        F.when(sig != 0, F.col("price_displacement") / sig).alias("displacement_multiple"),
    )


def merge_adjacent(candidates: DataFrame, max_gap_s: float = 60.0) -> DataFrame:
    """Join same-direction bursts whose gap is small; baselines stay the first one's."""
    k = ["market", "direction"]
    lab = interval_islands(candidates, k, "start_time", "end_time", max_gap_s=max_gap_s)
    first = F.struct("start_time", "end_time")
    g = lab.groupBy(*k, "island_start").agg(
        F.max("end_time").alias("end_time"), F.sum("aggressor_size").alias("aggressor_size"),
        F.sum("trade_count").alias("trade_count"),
        F.min_by("trailing_median_trade_rate", first).alias("trailing_median_trade_rate"),
        F.max("price_displacement").alias("price_displacement"),
        F.min_by("trailing_return_sigma", first).alias("trailing_return_sigma"),
        F.max("rate_multiple").alias("rate_multiple"), F.max("displacement_multiple").alias("displacement_multiple"),
    )
    # Wallets meet as single values, each once: only the distinct ones of an event come together, as they are its result.
    each = lab.select(*k, "island_start", F.explode("wallets").alias("_w")).distinct()
    named = each.groupBy(*k, "island_start").agg(F.array_sort(F.collect_list("_w")).alias("wallets"))
    wallets = F.coalesce("wallets", F.array().cast(lab.schema["wallets"].dataType)).alias("wallets")
    return g.join(named, [*k, "island_start"], "left").select(
        "market", F.col("island_start").alias("start_time"), "end_time", "direction", "aggressor_size", wallets,
        F.lit("proxy").alias("trigger_source"), F.lit("proxy-tagged").alias("tag_label"), "trade_count",
        "trailing_median_trade_rate", "price_displacement", "trailing_return_sigma", "rate_multiple", "displacement_multiple",
    )


def burst_events(trades: DataFrame, *, merge_gap_s: float = 60.0, **kw) -> DataFrame:
    c = burst_candidates(trades, **kw).filter(~F.col("abstained"))
    return merge_adjacent(c, merge_gap_s)


def abstentions(candidates: DataFrame) -> DataFrame:
    a = candidates.filter("abstained")
    return a.groupBy("market").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("trailing_median_trade_rate") == 0).alias("zero_baseline_rate"),
        F.count_if(F.col("trailing_return_sigma") == 0).alias("zero_return_sigma"),
    )
