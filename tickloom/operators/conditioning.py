"""Funding and oracle state around events: exposure, hazards, wallet bridges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.timecols import MICROS, cluster_key, micros, plus_seconds
from tickloom.operators.asof import asof_join
from tickloom.operators.ranges import range_totals

APR_FACTOR = 24.0 * 365.0
H6_US = 6 * 3600 * MICROS
LOW_BUCKET, HIGH_BUCKET = "negative", "ge_100pct"


def apr(rate: Column | str) -> Column:
    return (F.col(rate) if isinstance(rate, str) else rate) * F.lit(24.0) * F.lit(365.0)


def funding_bucket(rate: Column | str) -> Column:
    """Bucket an hourly rate by its simple annualised value."""
    a = apr(rate)
    return (
        F.when(a < 0, LOW_BUCKET).when(a < 0.25, "0_to_25pct").when(a < 1.0, "25_to_100pct").when(a.isNotNull(), HIGH_BUCKET)
    )


def funding_state(mean_apr: Column) -> Column:
    return (
        F.when(mean_apr.isNull(), "unavailable").when(mean_apr < 0, "negative").when(mean_apr < 0.25, "0%-25%")
        .when(mean_apr < 1.0, "25%-100%").otherwise(">=100%")
    )


def causal_buckets(funding: DataFrame, times: DataFrame, time: str = "conditioning_time", *, strict: bool = True) -> DataFrame:
    """Latest same-market settlement known at each time, and its bucket.

    ``strict`` fails where no settlement is known; otherwise rate and bucket are null there.
    """
    hit = asof_join(times, funding, ["market"], time, "time_exchange", ["funding_rate"])
    if strict:
        message = F.concat(F.lit("no funding settlement of "), F.coalesce("market", F.lit("an unnamed market")), F.lit(" known by "), F.col(time).cast("string"))
        hit = hit.withColumn("funding_rate", F.when(F.col("obs_time").isNull(), F.raise_error(message).cast("double")).otherwise(F.col("funding_rate")))
    return hit.select(
        *times.columns, F.col("obs_time").alias("funding_settlement_time"), "funding_rate",
        apr("funding_rate").alias("annualized_rate"), funding_bucket("funding_rate").alias("funding_bucket"),
    )


def exposure_panel(funding: DataFrame, events: DataFrame, start: Column, end: Column, *, strict: bool = True) -> DataFrame:
    """Time each rate was held inside [start, end), cut at UTC six-hour blocks.

    One row per hour and market feeds the ``lead``: bounded by clock time. ``strict`` fails for a market whose first settlement
    comes after ``start``; otherwise its panel begins there.
    """
    w = Window.partitionBy("market").orderBy("time_exchange")
    rate = F.col("funding_rate")
    if strict:
        unknown = F.lag("time_exchange", 1).over(w).isNull() & (F.col("time_exchange") > start)
        message = F.concat(F.lit("no funding settlement of "), F.coalesce("market", F.lit("an unnamed market")), F.lit(" known by the start of the window"))
        rate = F.when(unknown, F.raise_error(message).cast("double")).otherwise(rate)
    held = funding.select("market", rate.alias("funding_rate"), F.col("time_exchange").alias("a"), F.lead("time_exchange", 1).over(w).alias("b"))
    a = F.greatest(F.col("a"), start)
    b = F.least(F.coalesce("b", end), end)
    clipped = held.select("market", "funding_rate", micros(a).alias("a"), micros(b).alias("b")).filter(F.col("a") < F.col("b"))
    first = F.col("a") - F.pmod(F.col("a"), F.lit(H6_US))
    blocks = clipped.select("*", F.explode(F.sequence(first, F.col("b") - 1, F.lit(H6_US))).alias("k"))
    cut = blocks.select(
        "market", "funding_rate", F.timestamp_micros("k").alias("block_start"),
        F.timestamp_micros(F.greatest("a", "k")).alias("interval_start"),
        F.timestamp_micros(F.least(F.col("b"), F.col("k") + H6_US)).alias("interval_end"),
    )
    counted = range_totals(
        cut, events, ["market"], "start_time",
        {"event": (F.col("interval_start"), F.col("interval_end"), True, False)}, {"count": F.lit(1)},
    )
    return counted.select(
        "market", "block_start", "interval_start", "interval_end", "funding_rate", apr("funding_rate").alias("annualized_rate"),
        funding_bucket("funding_rate").alias("funding_bucket"),
        ((micros("interval_end") - micros("interval_start")) / F.lit(3600.0 * MICROS)).alias("exposure_hours"),
        F.col("event_count").cast("long").alias("event_count"), cluster_key("market", "block_start").alias("cluster_key"),
    )


def hazard_table(conditioning: DataFrame, events: DataFrame, horizon_s: int = 86_400) -> DataFrame:
    """P(same-market event in (t, t+horizon]) per funding bucket."""
    c = range_totals(
        conditioning, events, ["market"], "start_time",
        {"event": (F.col("conditioning_time"), plus_seconds("conditioning_time", horizon_s), False, True)}, {"n": F.lit(1)},
    )
    hit = F.col("event_n") > 0
    return c.groupBy("funding_bucket").agg(
        F.count(F.lit(1)).alias("conditioning_observations"), F.count_if(hit).alias("event_within_horizon_count"),
        F.avg(hit.cast("double")).alias("probability_event_within_horizon"),
    ).select("*", F.lit(horizon_s / 3600.0).alias("hazard_horizon_hours"), (F.col("probability_event_within_horizon") >= 0.9).alias("coverage_saturated"))


COHORTS: Mapping[str, tuple[tuple[str, ...] | None, str | None]] = {
    "high_apr_buy": ((HIGH_BUCKET,), "BUY"),
    "low_apr_buy": ((LOW_BUCKET, "0_to_25pct"), "BUY"),
    "high_apr_sell": ((HIGH_BUCKET,), "SELL"),
    "proxy_population": (None, None),
}


def wallet_appearances(events: DataFrame) -> DataFrame:
    return events.select("market", "start_time", "direction", "funding_bucket", F.explode("wallets").alias("wallet"))


def wallet_bridge(events: DataFrame, window_end: Column, min_forward_s: int = 86_400, width_s: int = 86_400 * 30) -> DataFrame:
    """First appearance per (cohort, wallet) and the strictly later one, if any.

    ``censored`` marks wallets first seen too late for a full forward window.
    """
    seen = wallet_appearances(events)
    tests = []
    for name, (buckets, side) in COHORTS.items():
        ok = F.lit(True)
        if buckets:
            ok = ok & F.col("funding_bucket").isin(*buckets)
        if side:
            ok = ok & (F.col("direction") == side)
        tests.append(F.when(ok, F.lit(name)))
    first = (
        seen.select("*", F.explode(F.array_compact(F.array(*tests))).alias("cohort")).groupBy("cohort", "wallet")
        .agg(F.min(F.struct("start_time", "market")).alias("f"))
        .select("cohort", "wallet", F.col("f.start_time").alias("cohort_time"), F.col("f.market").alias("cohort_market"))
    )
    # per-wallet forward match: a busy wallet's history is cut by time like any key
    at = seen.groupBy("wallet", "start_time").agg(F.min("market").alias("later_market"))
    hit = asof_join(first, at, ["wallet"], "cohort_time", "start_time", ["later_market"], direction="forward", strict=True, width_s=width_s)
    return hit.select(
        "cohort", "wallet", "cohort_market", "cohort_time",
        (micros("cohort_time") > micros(window_end) - F.lit(min_forward_s * MICROS)).alias("censored"),
        F.col("obs_time").isNotNull().alias("appeared_later"), F.col("obs_time").alias("later_time"), "later_market",
    )


def bridge_summary(detail: DataFrame) -> DataFrame:
    """Fractions per cohort side by side, and the 1.96-standard-error test."""
    ok = ~F.col("censored")
    per = detail.groupBy("cohort").agg(
        F.count_if(ok).alias("n"), F.count_if(ok & F.col("appeared_later")).alias("later"), F.count_if(F.col("censored")).alias("cens")
    ).withColumn("frac", F.when(F.col("n") > 0, F.col("later") / F.col("n")))
    of = lambda c, v: F.max(F.when(F.col("cohort") == c, F.col(v)))
    wide = per.agg(
        of("high_apr_buy", "n").alias("high_n"), of("high_apr_buy", "later").alias("high_later"), of("high_apr_buy", "cens").alias("high_censored"),
        of("high_apr_buy", "frac").alias("high_fraction"), of("low_apr_buy", "n").alias("low_n"), of("low_apr_buy", "frac").alias("low_fraction"),
        of("high_apr_sell", "n").alias("sell_n"), of("high_apr_sell", "frac").alias("sell_fraction"),
        of("proxy_population", "n").alias("population_n"), of("proxy_population", "frac").alias("population_fraction"),
    )
    p, q = F.col("high_fraction"), F.col("low_fraction")
    se = F.sqrt(p * (1 - p) / F.col("high_n") + q * (1 - q) / F.col("low_n"))
    noise = F.when((F.col("high_n") > 0) & (F.col("low_n") > 0), F.abs(p - q) <= 1.96 * se).otherwise(F.lit(False))
    return wide.select("*", (p - q).alias("high_minus_low"), (~F.coalesce(noise, F.lit(False))).alias("funding_specific_linkage"))


def trailing_funding(events: DataFrame, funding: DataFrame, hours: int = 24) -> DataFrame:
    """Mean annualised rate over ``[start-hours, start)`` and its state."""
    t = range_totals(
        events, funding, ["market"], "time_exchange",
        {"f": (plus_seconds("start_time", -hours * 3600), F.col("start_time"), True, False)},
        {"n": F.lit(1), "rate": F.col("funding_rate")},
    )
    a = F.when(F.col("f_n") > 0, apr(F.col("f_rate") / F.col("f_n")))
    return t.select(*events.columns, a.alias("trailing_mean_apr"), funding_state(a).alias("funding_state"), F.col("f_n").cast("long").alias("funding_observations"))


def oracle_regime(events: DataFrame, oracle: DataFrame, pad_s: int = 1800) -> DataFrame:
    """Oracle updates by class in the padded event window, and the regime they imply."""
    is_ = lambda v: (F.col("update_class") == v).cast("double")
    t = range_totals(
        events, oracle, ["market"], "time_exchange",
        {"o": (plus_seconds("start_time", -pad_s), plus_seconds("end_time", pad_s), True, True)},
        {"dep": is_("Deployer"), "fb": is_("Fallback")},
    )
    total = F.col("o_dep") + F.col("o_fb")
    return t.select(
        *events.columns, F.col("o_dep").cast("long").alias("oracle_deployer_updates"), F.col("o_fb").cast("long").alias("oracle_fallback_updates"),
        F.when(total > 0, F.col("o_fb") / total).alias("oracle_fallback_frequency"),
        F.when(total == 0, "unavailable").when(F.col("o_fb") > 0, "fallback-present").otherwise("deployer-only").alias("oracle_regime"),
        total.cast("long").alias("oracle_observations"),
    )
