"""Twin-venue spreads: series, costs, episodes, half-spreads, pair metrics, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timecols import MICROS, floor_to, micros
from tickloom.operators import bootstrap as bs
from tickloom.operators.lookups import strict_lookup
from tickloom.operators.quotes import half_spread_bps
from tickloom.operators.stats import lag_pairs, run_lengths

APR_HOURS = 24.0 * 365.0


def pair_series(pairs: DataFrame, series: DataFrame, time: str, value: str) -> DataFrame:
    """Both legs' values at shared times, for the listed pairs only."""
    k = ["underlier", "market_a", "market_b"]
    leg = lambda x: series.select(F.col("market").alias(f"market_{x}"), F.col(time).alias("time"), F.col(value).alias(f"{value}_{x}"))
    a = pairs.select(*k).join(leg("a"), "market_a")
    return a.join(leg("b"), ["market_b", "time"]).select(*k, "time", f"{value}_a", f"{value}_b")


def pair_key() -> Column:
    return F.concat_ws("~", "market_a", "market_b")


def with_cluster(df: DataFrame) -> DataFrame:
    return df.select("*", F.concat_ws("|", pair_key(), F.date_format(floor_to("time", 6 * 3600), "yyyy-MM-dd'T'HH:mm:ss")).alias("cluster_key"))


def differential(pairs: DataFrame, funding: DataFrame) -> DataFrame:
    d = pair_series(pairs, funding, "time_exchange", "funding_rate")
    diff = (F.col("funding_rate_a") - F.col("funding_rate_b")) * APR_HOURS
    return with_cluster(d.select("underlier", "market_a", "market_b", "time", diff.alias("diff_apr"), F.abs(diff).alias("abs_diff_apr")))


def basis(pairs: DataFrame, candles: DataFrame) -> DataFrame:
    """Log price ratio less its pair median."""
    k = ["underlier", "market_a", "market_b"]
    b = pair_series(pairs, candles.filter(F.col("close") > 0), "time_open", "close").withColumn("log_price_ratio", F.ln(F.col("close_a") / F.col("close_b")))
    m = b.groupBy(*k).agg(F.percentile("log_price_ratio", 0.5).alias("_m"))
    return with_cluster(b.join(m, k).select(*k, "time", "log_price_ratio", (F.col("log_price_ratio") - F.col("_m")).alias("basis"), F.abs(F.col("log_price_ratio") - F.col("_m")).alias("abs_basis")))


def round_trip_costs(pairs: DataFrame, fees: DataFrame, half_spreads: DataFrame) -> DataFrame:
    """Maker (rest, no spread) and taker (cross, both legs) costs of entry and exit."""
    dex = lambda m: F.split(F.col(m), ":")[0]
    x = pairs.select("underlier", "market_a", "market_b")
    for s in ("a", "b"):
        x = strict_lookup(x.withColumn("dex", dex(f"market_{s}")), fees, "dex", ["effective_maker_bps", "effective_taker_bps"]).withColumnsRenamed(
            {"effective_maker_bps": f"maker_{s}", "effective_taker_bps": f"taker_{s}"}).drop("dex")
        x = strict_lookup(x.withColumn("market", F.col(f"market_{s}")), half_spreads, "market", ["half_spread_bps"]).withColumnRenamed("half_spread_bps", f"half_{s}").drop("market")
    c = F.col
    return x.select(
        "underlier", "market_a", "market_b", (2.0 * (c("maker_a") + c("maker_b"))).alias("maker_bps"),
        (2.0 * (c("taker_a") + c("taker_b") + c("half_a") + c("half_b"))).alias("taker_bps"),
    )


def breakeven_apr(cost_bps: Column, horizon_hours: Column) -> Column:
    return cost_bps / 10_000.0 * APR_HOURS / horizon_hours


def episodes(series: DataFrame, threshold: Column, keys: list[str]) -> DataFrame:
    """Contiguous hourly runs above a threshold."""
    return run_lengths(series, F.col("abs_diff_apr") > threshold, keys=keys, time="time", contiguous=(micros("time") - micros("_pt")) == 3600 * MICROS)


def half_spreads(quotes: DataFrame, segment_s: int = 3600) -> DataFrame:
    """Median of the hourly segments' median half-spreads."""
    ok = (F.col("best_bid_px") > 0) & (F.col("best_ask_px") > 0) & (F.col("best_ask_px") >= F.col("best_bid_px"))
    seg = quotes.filter(ok).groupBy("market", floor_to("time_exchange", segment_s).alias("segment")).agg(F.percentile(half_spread_bps(), 0.5).alias("m"))
    return seg.groupBy("market").agg(F.percentile("m", 0.5).alias("half_spread_bps"), F.count(F.lit(1)).alias("segments"))


def spread_table(markets: DataFrame, measured: DataFrame, class_members: list[str]) -> DataFrame:
    """Measured half-spread, else twice the class median; every class member must be measured."""
    cls = measured.filter(F.col("market").isin(*class_members)).agg(F.percentile("half_spread_bps", 0.5).alias("_m"), F.count(F.lit(1)).alias("_n"))
    short = F.raise_error(F.lit("missing spread books for class members")).cast("double")
    fallback = F.when(F.col("_n") == len(class_members), 2.0 * F.col("_m")).otherwise(short)
    j = markets.select("market").distinct().join(measured, "market", "left").crossJoin(F.broadcast(cls))  # one row
    return j.select(
        "market", F.coalesce("half_spread_bps", fallback).alias("half_spread_bps"),
        F.when(F.col("half_spread_bps").isNotNull(), "measured").otherwise("assumed_2x_class_median").alias("spread_source"),
    )


def pair_metrics(diff: DataFrame, base: DataFrame, costs: DataFrame, horizon_hours: float) -> DataFrame:
    """Differential, episode and basis statistics per pair, with intervals."""
    k = ["underlier", "market_a", "market_b"]
    c = costs.select(*k, "maker_bps", "taker_bps", breakeven_apr(F.col("maker_bps"), F.lit(horizon_hours)).alias("maker_apr"), breakeven_apr(F.col("taker_bps"), F.lit(horizon_hours)).alias("taker_apr"))
    d = diff.join(c, k)
    over = lambda t: (F.col("abs_diff_apr") > F.col(t)).cast("double")
    a = bs.bootstrap_many(d, k, "cluster_key", {"n": F.lit(1), "x": F.col("abs_diff_apr"), "m": over("maker_apr"), "t": over("taker_apr")}, {
        "mean_abs_diff_apr": bs.mean_stat, "pct_gt_maker": lambda s: s["m"] / s["n"], "pct_gt_taker": lambda s: s["t"] / s["n"]}).withColumnsRenamed({"n": "n_funding_hours", "G": "funding_G"}).drop("low_cluster")
    x = F.col("basis")
    v = bs.bootstrap_many(base, k, "cluster_key", {"n": F.lit(1), "x": x, "xx": x * x}, {"basis_vol": bs.std_stat}).withColumnsRenamed({"n": "n_basis_hours", "G": "basis_G"}).drop("low_cluster")
    q = diff.groupBy(*k).agg(F.percentile("abs_diff_apr", 0.95).alias("p95_abs_diff_apr"))
    r = base.groupBy(*k).agg(F.percentile("abs_basis", 0.95).alias("basis_p95"))
    e = episodes(d, F.col("maker_apr"), k).groupBy(*k).agg(F.count(F.lit(1)).alias("maker_n_episodes"), F.percentile("hours", 0.5).alias("maker_median_episode_hours"))
    j = a.join(v, k).join(q, k).join(r, k).join(c, k).join(e, k, "left")
    ret = F.col("p95_abs_diff_apr") * horizon_hours / APR_HOURS
    return j.select("*", F.coalesce("maker_n_episodes", F.lit(0)).alias("_e"), ret.alias("p95_horizon_return"), F.when(ret > 0, F.col("basis_p95") / ret).alias("basis_to_return")).drop("maker_n_episodes").withColumnRenamed("_e", "maker_n_episodes")


def first_failed_gate(episodes_n: Column, median_hours: Column, twice_horizon: float, ratio: Column) -> Column:
    return (
        F.when(episodes_n == 0, "never-reaches-breakeven").when(median_hours <= twice_horizon, "duration").when(ratio > 1.0, "basis").otherwise("survives")
    )


def half_life_ci(diff: DataFrame, keys: list[str], **kw) -> DataFrame:
    """AR(1) half-life of the absolute differential; adjacency is fixed before resampling."""
    p = lag_pairs(diff, "abs_diff_apr", 1, keys=keys, time="time", max_step_s=3600)
    x, y = F.col("lag_value"), F.col("abs_diff_apr")
    return bs.bootstrap_many(p, keys, "cluster_key", {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "xy": x * y}, {"half_life": bs.half_life_stat}, **kw)
