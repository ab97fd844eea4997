"""Bars and feed statistics from ticks (single-shuffle partial/final aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.timecols import cluster_key, floor_to, micros
from tickloom.operators.quotes import spread_bps, two_sided

TRADE_ORDER = ("time_exchange", "seq")


def clean_trades(trades: DataFrame) -> DataFrame:
    """Rows usable for flow statistics: time, positive price, size and a known side."""
    return trades.filter(
        F.col("time_exchange").isNotNull() & (F.col("price") > 0) & F.col("base_amount").isNotNull()
        & F.col("taker_side").isin("BUY", "SELL")
    )


def ohlcv(trades: DataFrame, every_s: int) -> DataFrame:
    order = F.struct(*TRADE_ORDER)
    return trades.groupBy("market", floor_to("time_exchange", every_s).alias("bar")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("base_amount").alias("volume"),
    )


def open_close_bars(trades: DataFrame, every_s: int = 60, extra: tuple[str, ...] = ()) -> DataFrame:
    """Trade-time bars: first/last price with the instants they printed."""
    order = F.struct(*TRADE_ORDER)
    return trades.filter(F.col("price") > 0).groupBy("market", *extra, floor_to("time_exchange", every_s).alias("bar")).agg(
        F.min("time_exchange").alias("time_open"), F.max("time_exchange").alias("time_close"),
        F.min_by("price", order).alias("open"), F.max_by("price", order).alias("close"),
        F.min(order).alias("first_key"), F.max(order).alias("last_key"),
    )


def merge_open_close(partials: DataFrame) -> DataFrame:
    """Bars of one bucket coming from several files, merged."""
    return partials.groupBy("market", "bar").agg(
        F.min("time_open").alias("time_open"), F.max("time_close").alias("time_close"),
        F.min_by("open", "first_key").alias("open"), F.max_by("close", "last_key").alias("close"),
    )


def median_bars(trades: DataFrame, every_s: int = 60) -> DataFrame:
    """Low, high, exact median and count per bucket over the whole bucket.

    (A per-file merge would have to average medians; here the median is exact.)
    """
    return trades.groupBy("market", floor_to("time_exchange", every_s).alias("bar")).agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"), F.percentile("price", 0.5).alias("med"),
        F.count("price").alias("n"),
    )


def last_oracle_bars(oracle: DataFrame, every_s: int = 60) -> DataFrame:
    order = F.struct("time_exchange", "seq")
    return oracle.groupBy("market", floor_to("time_exchange", every_s).alias("bar")).agg(
        *[F.max_by(c, order).alias(c) for c in ("oracle_px", "mark_px", "external_perp_px")], F.count(F.lit(1)).alias("updates")
    )


def directional_bars(trades: DataFrame, every_s: int = 60, extra: tuple[str, ...] = ()) -> DataFrame:
    """Per (market, bucket, side): count, size, price range, first and last print."""
    return clean_trades(trades).groupBy("market", *extra, floor_to("time_exchange", every_s).alias("bucket"), "taker_side").agg(
        F.count(F.lit(1)).alias("trade_count"), F.sum("base_amount").alias("aggressor_size"),
        F.min("time_exchange").alias("start_time"), F.max("time_exchange").alias("end_time"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )


def repeated_wallets(trades: DataFrame, every_s: int = 60, extra: tuple[str, ...] = (), at_least: int = 2) -> DataFrame:
    """Wallets seen at least twice in a (market, bucket, side)."""
    keys = ["market", *extra, "bucket", "taker_side"]
    seen = (
        clean_trades(trades).filter(F.coalesce(F.col("user_taker"), F.lit("")) != "")
        .groupBy("market", *extra, floor_to("time_exchange", every_s).alias("bucket"), "taker_side", "user_taker").count()
        .filter(F.col("count") >= at_least)
    )
    return seen.groupBy(*keys).agg(F.sort_array(F.collect_set("user_taker")).alias("wallets"))


def merge_directional(partials: DataFrame) -> DataFrame:
    """Merge partial directional bars; wallet sets are united."""
    keys = ["market", "bucket", "taker_side"]
    sums = partials.groupBy(*keys).agg(
        F.sum("trade_count").alias("trade_count"), F.sum("aggressor_size").alias("aggressor_size"),
        F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time"),
        F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
    )
    wallets = (
        partials.select(*keys, F.explode("wallets").alias("w")).filter(F.coalesce(F.col("w"), F.lit("")) != "").distinct()
        .groupBy(*keys).agg(F.sort_array(F.collect_list("w")).alias("wallets"))
    )
    return sums.join(wallets, keys, "left").withColumn("wallets", F.coalesce("wallets", F.array().cast("array<string>")))


def closes(trades: DataFrame, every_s: int = 60) -> DataFrame:
    return clean_trades(trades).groupBy("market", floor_to("time_exchange", every_s).alias("bucket")).agg(
        F.max_by("price", F.struct(*TRADE_ORDER)).alias("close")
    )


def quote_census(l1_with_segment: DataFrame, hours: int = 6) -> DataFrame:
    """Uptime, spread and depth as numerators and denominators per segment and block."""
    ok = two_sided()
    spread = F.when(ok, spread_bps())
    depth = F.when(ok, F.col("best_bid_sx") + F.col("best_ask_sx"))
    return l1_with_segment.groupBy("market", "segment", cluster_key("market", "time_exchange", hours).alias("cluster_key")).agg(
        F.sum(ok.cast("double")).alias("uptime_num"), F.count(F.lit(1)).alias("uptime_den"),
        F.coalesce(F.sum(spread), F.lit(0.0)).alias("spread_num"), F.count(spread).alias("spread_den"),
        F.coalesce(F.sum(depth), F.lit(0.0)).alias("depth_num"), F.count(depth).alias("depth_den"),
    )


def latency_census(trades: DataFrame, hours: int = 6, limits_ms: tuple[int, ...] = (500, 1000, 5000)) -> DataFrame:
    ms = (micros("time_received") - micros("time_exchange")) / F.lit(1000.0)
    t = trades.filter(F.col("time_received").isNotNull() & F.col("time_exchange").isNotNull()).withColumn("_ms", ms)
    share = lambda c: F.sum(c.cast("double"))
    return t.groupBy("market", cluster_key("market", "time_exchange", hours).alias("cluster_key")).agg(
        F.sum("_ms").alias("latency_num"), F.count(F.lit(1)).alias("latency_den"), share(F.col("_ms") < 0).alias("negative_num"),
        *[share(F.col("_ms") <= v).alias(f"le{v}_num") for v in limits_ms],
    )


def exact_matches(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Multiset intersection size per identical row of two feeds."""
    left = a.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_a"))
    right = b.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_b"))
    return left.join(right, keys, "inner").withColumn("matched", F.least("n_a", "n_b"))


def aligned_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Absolute difference in bps of mean prices at instants both feeds share."""
    left = a.groupBy(*keys).agg(F.avg("price").alias("p_a"))
    right = b.groupBy(*keys).agg(F.avg("price").alias("p_b"))
    return left.join(right, keys, "inner").withColumn("abs_diff_bps", F.abs(F.col("p_b") - F.col("p_a")) / F.col("p_a") * 10_000)


def overlap_clusters(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per cluster: rows, distinct instants, exact matches and aligned differences."""
    def counts(df: DataFrame, rows: str, times: str) -> DataFrame:
        per_time = df.groupBy("market", "cluster_key", "time_exchange").agg(F.count(F.lit(1)).alias("n"))
        return per_time.groupBy("market", "cluster_key").agg(F.sum("n").alias(rows), F.count(F.lit(1)).alias(times))

    k = ["market", "cluster_key"]
    exact = exact_matches(a, b, [*k, "time_exchange", "price", "base_amount"]).groupBy(*k).agg(F.sum("matched").alias("exact"))
    aligned = aligned_differences(a, b, [*k, "time_exchange"]).groupBy(*k).agg(
        F.count(F.lit(1)).alias("aligned_n"), F.sum("abs_diff_bps").alias("price_diff_sum")
    )
    parts = counts(a, "n_a", "t_a").join(counts(b, "n_b", "t_b"), k, "full").join(exact, k, "left").join(aligned, k, "left")
    zero = {"n_a": 0, "t_a": 0, "n_b": 0, "t_b": 0, "exact": 0, "aligned_n": 0, "price_diff_sum": 0.0}
    return parts.fillna(zero)


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def overlap_agreement(clusters: DataFrame) -> DataFrame:
    s = {c: F.sum(c) for c in ("n_a", "n_b", "t_a", "t_b", "exact", "aligned_n", "price_diff_sum")}
    most, times = F.greatest(s["n_a"], s["n_b"]), F.greatest(s["t_a"], s["t_b"])
    return clusters.groupBy("market").agg(
        ratio(F.least(s["n_a"], s["n_b"]), most).alias("count_ratio"), ratio(s["exact"], most).alias("exact_ratio"),
        ratio(s["aligned_n"], times).alias("time_ratio"), ratio(s["price_diff_sum"], s["aligned_n"]).alias("price_diff_bps"),
    )


def drop_older_era(older: DataFrame, newer: DataFrame) -> DataFrame:
    """On (market, day) pairs the newer era covers, its rows replace the older ones."""
    day = F.to_date("time_exchange")
    covered = newer.select("market", day.alias("_day")).distinct()
    kept = older.withColumn("_day", day).join(covered, ["market", "_day"], "left_anti").drop("_day")
    return kept.unionByName(newer, allowMissingColumns=True)


def effective_spread(trades: DataFrame, group_s: int, minute_s: int = 60, floor_bp: float = -50.0, at_least: int = 2) -> DataFrame:
    """Median over minutes of the mean BUY price minus the mean SELL price, in bps."""
    per = (
        trades.groupBy("market", floor_to("time_exchange", group_s).alias("period"), floor_to("time_exchange", minute_s).alias("minute"))
        .pivot("taker_side", ["BUY", "SELL"]).agg(F.avg("price"))
        .filter(F.col("BUY").isNotNull() & F.col("SELL").isNotNull())
        .withColumn("gap_bp", (F.col("BUY") - F.col("SELL")) / ((F.col("BUY") + F.col("SELL")) / 2) * 10_000)
        .filter(F.col("gap_bp") > floor_bp)
    )
    return per.groupBy("market", "period").agg(F.percentile("gap_bp", 0.5).alias("spread_bp"), F.count(F.lit(1)).alias("minutes")).filter(
        F.col("minutes") >= at_least
    )


def premium_by_minute(oracle: DataFrame, last_minutes: int = 10) -> DataFrame:
    """Mean and median premium for each of the last minutes before settlement."""
    m = F.minute("time_exchange") - 60
    p = (
        oracle.filter((F.col("oracle_px") > 0) & (F.col("mark_px") > 0))
        .select("market", m.cast("long").alias("minute_to_settlement"), (F.col("mark_px") / F.col("oracle_px") - 1).alias("premium"))
        .filter(F.col("minute_to_settlement").between(-last_minutes, -1))
    )
    k = ["market", "minute_to_settlement"]  # few groups over the whole history: no value map per group
    mean = p.groupBy(*k).agg(F.avg("premium").alias("mean_premium"), F.count(F.lit(1)).alias("n"))
    return mean.join(exact_quantiles(p, k, "premium", {"median_premium": 0.5}), k)


def signed_notional() -> Column:
    return F.when(F.col("taker_side") == "BUY", 1.0).otherwise(-1.0) * F.col("base_amount") * F.col("price")


def wallet_windows(trades: DataFrame) -> DataFrame:
    """Repeat wallets around settlement (:50-:10) and around the :30 placebo."""
    minute = F.minute("time_exchange")
    late, early = minute >= 50, minute < 10
    settle = late | early
    hour = F.date_trunc("hour", "time_exchange")
    tagged = trades.filter(settle | minute.between(20, 39)).select(
        "market", "user_taker", "signed_notional",
        F.when(settle, "settlement").otherwise("baseline").alias("window_kind"),
        F.when(late, hour + F.expr("interval 1 hour")).otherwise(hour).alias("settlement_time"),
        F.when(late | minute.between(20, 29), "pre").otherwise("post").alias("phase"),
    )
    pre, post = F.col("phase") == "pre", F.col("phase") == "post"
    flow = F.col("signed_notional")
    return (
        tagged.groupBy("market", "settlement_time", "user_taker", "window_kind")
        .agg(
            F.count_if(pre).alias("trade_count_pre"), F.count_if(post).alias("trade_count_post"),
            F.coalesce(F.sum(F.when(pre, flow)), F.lit(0.0)).alias("signed_notional_pre"),
            F.coalesce(F.sum(F.when(post, flow)), F.lit(0.0)).alias("signed_notional_post"),
        )
        .filter(F.col("trade_count_pre") + F.col("trade_count_post") >= 2)
        .withColumn("short_open_then_close", (F.col("signed_notional_pre") < 0) & (F.col("signed_notional_post") > 0))
    )


def wallet_window_events(wallets: DataFrame) -> DataFrame:
    k = ["market", "settlement_time"]
    by = wallets.groupBy(*k, "window_kind").agg(
        F.sum("signed_notional_pre").alias("pre_signed_notional"), F.sum("signed_notional_post").alias("post_signed_notional"),
        F.count(F.lit(1)).alias("repeat_wallets"), F.avg(F.col("short_open_then_close").cast("double")).alias("short_open_close_share"),
    )
    base = by.filter(F.col("window_kind") == "baseline").select(*k, F.col("short_open_close_share").alias("baseline_short_open_close_share"))
    return by.filter(F.col("window_kind") == "settlement").drop("window_kind").join(base, k, "left").withColumn(
        "short_open_close_share_difference", F.col("short_open_close_share") - F.col("baseline_short_open_close_share")
    )


def wallet_days(trades: DataFrame, wallet: str = "user_taker") -> DataFrame:
    """Dollar volume, signed flow and trade count per wallet and UTC day."""
    dv = F.col("price") * F.col("base_amount")
    buy = F.col("taker_side") == "BUY"
    return (
        trades.filter(F.coalesce(F.col(wallet), F.lit("")) != "")
        .groupBy("market", F.to_date("time_exchange").alias("date"), wallet)
        .agg(
            F.sum(dv).alias("dollar_vol"), F.coalesce(F.sum(F.when(buy, dv)), F.lit(0.0)).alias("buy_dv"),
            F.coalesce(F.sum(F.when(~buy, dv)), F.lit(0.0)).alias("sell_dv"), F.count(F.lit(1)).alias("trades"),
        )
    )


def first_partition_wins(files: DataFrame) -> DataFrame:
    """Of files covering the same (market, partition), keep the first path."""
    w = Window.partitionBy("market", "partition").orderBy("path")
    return files.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r")
