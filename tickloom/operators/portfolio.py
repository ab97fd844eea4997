"""Scheduled cross-sectional portfolios: signals, targets, accounting, summaries.

Schedules and panels are bounded by clock time (rebalances x markets); candles and
funding are only met through as-of passes and running totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.timecols import MICROS, cluster_key, micros, plus_seconds
from tickloom.operators.bootstrap import panel_ci
from tickloom.operators.asof import Source, asof_join, asof_many
from tickloom.operators.ranges import range_totals, rows_in_windows
from tickloom.operators.ranking import tails
from tickloom.operators.slicing import lagged
from tickloom.session import materialize

WEEK_S = 7 * 86_400
H6 = 6 * 3600 * MICROS


def schedule(markets: DataFrame, start: Column, stop: Column, hours: int) -> DataFrame:
    """(market, rebalance_time, end_time) on hours divisible by the period."""
    step = hours * 3600 * MICROS
    hour = 3600 * MICROS
    first = micros(start)
    aligned = F.ceil(F.ceil(first / hour) * hour / step).cast("long") * step
    last = micros(stop) - step
    ok = markets.select("market").distinct().filter(aligned <= last)
    return ok.select("market", F.explode(F.sequence(aligned, last, F.lit(step))).alias("_t")).select(
        "market", F.timestamp_micros("_t").alias("rebalance_time"), F.timestamp_micros(F.col("_t") + step).alias("end_time")
    )


def price_known(slots: DataFrame, candles: DataFrame, max_age_s: float = 1.0) -> DataFrame:
    """Slots whose market printed a close within the last second."""
    c = candles.select("market", "time_close", F.col("close").alias("known_close"))
    hit = asof_join(slots, c, ["market"], "rebalance_time", "time_close", ["known_close"], max_age_s=max_age_s, width_s=30 * 86_400)
    return hit.filter(~F.col("stale")).select(*slots.columns)


def trailing_signal(slots: DataFrame, funding: DataFrame, *, lookback_s: int = WEEK_S, min_observations: int = 168) -> DataFrame:
    """Mean rate over ``(t-lookback, t]``, only with a full enough history."""
    t = F.col("rebalance_time")
    r = range_totals(slots, funding, ["market"], "time_exchange", {"w": (plus_seconds(t, -lookback_s), t, False, True)},
                     {"n": F.lit(1), "rate": F.col("funding_rate")}, width_s=30 * 86_400)
    return r.filter(F.col("w_n") >= min_observations).select(*slots.columns, (F.col("w_rate") / F.col("w_n")).alias("signal"))


def position_targets(signals: DataFrame, style: str) -> DataFrame:
    """Gross-one weights per rebalance; needs at least two signals.

    ``short`` sells the top tenth, ``long_short`` halves that and buys the bottom
    tenth, ``long_top`` buys the top tenth, ``long_universe`` buys everything.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy("rebalance_time"))
    s = signals.withColumn("_n", n).filter(F.col("_n") >= 2)
    if style == "long_universe":
        return s.withColumn("position", F.lit(1.0) / F.col("_n")).drop("_n")
    t = tails(s, ["rebalance_time"], "signal", "market")
    size = F.count(F.lit(1)).over(Window.partitionBy("rebalance_time", "tail"))
    t = t.withColumn("_k", size)
    high, low = F.col("tail") == "high", F.col("tail") == "low"
    if style == "short":
        out = t.filter(high).withColumn("position", -1.0 / F.col("_k"))
    elif style == "long_top":
        out = t.filter(high).withColumn("position", 1.0 / F.col("_k"))
    elif style == "long_short":
        out = t.withColumn("position", F.when(low, 0.5 / F.col("_k")).otherwise(-0.5 / F.col("_k")))
    else:
        raise ValueError(f"unknown style {style!r}")
    return out.drop("_n", "_k", "tail")


def with_two_closes(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """Markets with two real closes strictly inside the period; never filled."""
    c = candles.filter(F.col("close").isNotNull()).select("market", "time_open")
    r = range_totals(slots, c, ["market"], "time_open", {"w": (F.col("rebalance_time"), F.col("end_time"), False, False)}, {"n": F.lit(1)}, width_s=30 * 86_400)
    return r.filter(F.col("w_n") >= 2).select(*slots.columns)


def _eligible(slots: DataFrame, candles: DataFrame) -> DataFrame:
    c = candles.select("market", "time_open", "time_close", "close")
    return rows_in_windows(
        slots, c, ["market"], "rebalance_time", "end_time", "time_close", bucket_s=86_400
    ).filter(F.col("time_open") > F.col("rebalance_time"))


def strictly_after_return(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """First to last close of candles opening after the rebalance and closed by the end."""
    k = ["market", "rebalance_time", "end_time"]
    return _eligible(slots.select(*k), candles).groupBy(*k).agg(
        F.min_by("close", "time_close").alias("_a"), F.max_by("close", "time_close").alias("_b"), F.count(F.lit(1)).alias("closes")
    ).filter("closes >= 2").select(*k, "closes", (F.col("_b") / F.col("_a") - 1).alias("period_return"))


def price_blocks(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """Per slot and UTC six-hour block: return relative to the entry close, completeness.

    A slot without any eligible candle yields one empty, incomplete block.
    """
    k = ["market", "rebalance_time", "end_time"]
    rows = _eligible(slots.select(*k), candles)
    edge = F.ceil(micros("time_close") / H6).cast("long") * H6
    per = rows.select(*k, "time_close", "close", F.least(edge, micros("end_time")).alias("_edge")).groupBy(*k, "_edge").agg(
        F.min_by("close", "time_close").alias("_first"), F.max_by("close", "time_close").alias("_last"), F.max("time_close").alias("_tc")
    )
    whole = per.groupBy(*k).agg(F.min_by("_first", "_edge").alias("entry"), F.max("_tc").alias("last_close"))
    base = slots.select(*k).join(whole, k, "left").select(
        "*", F.coalesce(micros("end_time") - micros("last_close") <= MICROS, F.lit(False)).alias("complete")
    ).select("*", F.when(F.col("complete"), micros("end_time")).otherwise(micros("last_close")).alias("_stop"))
    t0 = micros("rebalance_time")
    first_edge = (F.floor(t0 / H6).cast("long") + 1) * H6
    inner = F.when(first_edge < F.col("_stop"), F.sequence(first_edge, F.col("_stop") - 1, F.lit(H6))).otherwise(F.array().cast("array<bigint>"))
    starts = F.when(F.col("_stop") > t0, F.concat(F.array(t0), inner)).otherwise(F.array(t0))
    blocks = base.select(*k, "entry", "complete", "_stop", F.explode(starts).alias("_a")).select(
        "*", F.least((F.floor(F.col("_a") / H6).cast("long") + 1) * H6, micros("end_time")).alias("_edge")
    )
    w = Window.partitionBy(*k).orderBy("_a")
    j = blocks.join(per.select(*k, "_edge", "_last"), [*k, "_edge"], "left").select(
        "*", F.last("_last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_px")
    )
    j = j.select("*", F.lag("_px", 1).over(w).alias("_prior"))
    none = F.col("entry").isNull()
    out = j.filter(none | F.col("_px").isNotNull())
    return out.select(
        *k, F.timestamp_micros("_a").alias("block_start"),
        F.timestamp_micros(F.when(none, F.col("_a")).otherwise(F.least(F.col("_edge"), F.col("_stop")))).alias("block_end"),
        F.when(none, F.lit(0.0)).otherwise((F.col("_px") - F.coalesce("_prior", "entry")) / F.col("entry")).alias("price_return"), "complete",
    )


def pre_rebalance_return(slots: DataFrame, candles: DataFrame, lookback_s: int = WEEK_S) -> DataFrame:
    """Last over first close in ``(t-lookback, t]``, minus one; null with under two."""
    c = candles.select("market", "time_close", "close")
    w = 30 * 86_400
    a = asof_join(slots, c, ["market"], "rebalance_time", "time_close", ["close"], prefix="l_", width_s=w)
    a = a.withColumn("_from", plus_seconds("rebalance_time", -lookback_s))
    b = asof_join(a, c, ["market"], "_from", "time_close", ["close"], prefix="f_", direction="forward", strict=True, width_s=w)
    return b.select(*slots.columns, F.when(F.col("f_obs_time") < F.col("l_obs_time"), F.col("l_close") / F.col("f_close") - 1).alias("pre_rebalance_return"))


def turnover_cost(turnover: Column, fee_bps: Column, half_spread_bps: Column) -> Column:
    return F.abs(turnover) * (fee_bps + half_spread_bps) / F.lit(10_000.0)


def loss_path(pre: Column) -> Column:
    return F.when(pre.isNull(), "unknown_pre_history").when(pre < 0, "pre_rebalance_drop").otherwise("forward_squeeze")


def ledger(targets: DataFrame, candles: DataFrame, funding: DataFrame, costs: DataFrame, hours: int) -> DataFrame:
    """Accounting rows per strategy, rebalance, market and six-hour block.

    The prior position is the previous period's target where its coverage held to
    the end; it depends on that one period only, so a join on the schedule (not a
    recursion) finds it.  ``targets``: strategy, market, rebalance_time, end_time,
    position, signal; ``costs``: market, fee_bps, half_spread_bps.
    """
    k = ["market", "rebalance_time", "end_time"]
    blocks = price_blocks(targets.select(*k).distinct(), candles)
    held = blocks.groupBy(*k).agg(F.max("complete").alias("complete"))
    step = hours * 3600
    survived = targets.join(held.filter("complete").select(*k), k, "left_semi").select(
        "strategy", "market", plus_seconds("rebalance_time", step).alias("rebalance_time"), F.col("position").alias("prior_position")
    )
    # a period after the last scheduled one is never opened
    open_periods = targets.select("strategy", "rebalance_time").distinct()
    last = open_periods.groupBy("strategy").agg(F.max("rebalance_time").alias("_last"))
    survived = survived.join(last, "strategy").filter(F.col("rebalance_time") <= F.col("_last")).drop("_last")
    now = targets.select("strategy", "market", "rebalance_time", "position", "signal")
    touched = now.join(survived, ["strategy", "market", "rebalance_time"], "full").select(
        "strategy", "market", "rebalance_time", plus_seconds("rebalance_time", step).alias("end_time"),
        F.coalesce("position", F.lit(0.0)).alias("position"), F.coalesce("prior_position", F.lit(0.0)).alias("prior_position"), "signal",
    )
    pre = pre_rebalance_return(touched.filter("position < 0").select("market", "rebalance_time").distinct(), candles)
    j = touched.join(blocks, k, "left").join(pre, ["market", "rebalance_time"], "left")
    flat = F.col("position") == 0
    j = j.select(
        "strategy", *k, "position", "prior_position", "signal",
        F.when(flat, F.col("rebalance_time")).otherwise(F.col("block_start")).alias("block_start"),
        F.when(flat, F.col("rebalance_time")).otherwise(F.col("block_end")).alias("block_end"),
        F.when(flat, F.lit(0.0)).otherwise(F.col("price_return")).alias("price_return"),
        (flat | F.col("complete")).alias("coverage_complete_for_hold"), "pre_rebalance_return",
    ).distinct()
    w = Window.partitionBy("strategy", *k).orderBy("block_start")
    first = F.row_number().over(w) == 1
    last_block = F.lead("block_start", 1).over(w).isNull()
    j = j.select("*", first.alias("_f"), last_block.alias("_l")).join(costs, "market")
    paid = range_totals(
        j.select("market", "block_start", "block_end").distinct(), funding, ["market"], "time_exchange",
        {"p": (F.col("block_start"), F.col("block_end"), False, True)}, {"rate": F.col("funding_rate")}, width_s=30 * 86_400,
    )
    j = j.join(paid, ["market", "block_start", "block_end"])
    turn = F.when(F.col("_f"), F.col("position") - F.col("prior_position")).otherwise(F.lit(0.0))
    fee, hs = F.col("fee_bps"), F.col("half_spread_bps")
    exit_cost = F.when((F.col("position") != 0) & ~F.col("coverage_complete_for_hold") & F.col("_l"), turnover_cost(F.col("position"), fee, hs)).otherwise(F.lit(0.0))
    cost = turnover_cost(turn, fee, hs) + exit_cost
    fund = -F.col("position") * F.col("p_rate")
    price = F.col("position") * F.col("price_return")
    return j.select(
        "strategy", *k, "block_start", "block_end", "position", "prior_position", turn.alias("turnover"), "signal",
        fund.alias("funding_pnl"), price.alias("price_pnl"), (-cost).alias("cost_pnl"), (fund + price - cost).alias("net_pnl"),
        F.when(F.col("position") < 0, F.col("pre_rebalance_return")).alias("pre_rebalance_return"),
        F.when(F.col("position") < 0, loss_path(F.col("pre_rebalance_return"))).alias("price_loss_path"),
        cluster_key("market", "block_start").alias("cluster_key"),
        ((micros("block_end") - micros("block_start")) / F.lit(3600.0 * MICROS)).alias("period_hours"), "coverage_complete_for_hold",
    )


def period_returns(rows: DataFrame) -> DataFrame:
    return rows.groupBy("strategy", "rebalance_time", "end_time").agg(*[F.sum(c).alias(c) for c in ("funding_pnl", "price_pnl", "cost_pnl", "net_pnl")])


def equity_curve(periods: DataFrame, value: str = "net_pnl", *, peak_from_zero: bool = False, window: int = 30) -> DataFrame:
    """Equity, running peak, drawdown and rolling Sharpe per strategy.

    One row per rebalance.  The peak starts at zero or at the first value; periods
    per year come from the upper median step between rebalances.
    """
    w = Window.partitionBy("strategy").orderBy("rebalance_time")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    steps = periods.select("strategy", ((micros("rebalance_time") - F.lag(micros("rebalance_time"), 1).over(w)) / F.lit(float(MICROS))).alias("dt")).filter("dt is not null")
    ppy = upper_median(steps, ["strategy"], "dt").select("strategy", (F.lit(365.0 * 86_400) / F.col("upper_median")).alias("ppy"))
    e = periods.select("strategy", "rebalance_time", F.col(value).alias("ret"), F.sum(value).over(upto).alias("equity"))
    peak = F.max("equity").over(upto)
    if peak_from_zero:
        peak = F.greatest(F.lit(0.0), peak)
    r = w.rowsBetween(-(window - 1), 0)
    sd = F.stddev_samp("ret").over(r)
    j = e.select("*", peak.alias("peak"), F.when((F.row_number().over(w) >= window) & (sd > 0), F.avg("ret").over(r) / sd).alias("_s")).join(ppy, "strategy", "left")
    return j.select("strategy", "rebalance_time", "ret", "equity", "peak", (F.col("equity") - F.col("peak")).alias("drawdown"), (F.col("_s") * F.sqrt("ppy")).alias("rolling_sharpe"))


def upper_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Element ``n // 2`` of the sorted values (steps of one schedule), at any group size."""
    return exact_quantiles(df, keys, value, {"upper_median": 0.5}, upper=True)


def strategy_summary(rows: DataFrame, periods_per_year: float = 365.0) -> DataFrame:
    """Totals, Sharpe, drawdown, extremes, loss paths and days lost per strategy."""
    p = period_returns(rows)
    curve = equity_curve(p, peak_from_zero=True).groupBy("strategy").agg(
        F.least(F.lit(0.0), F.min("drawdown")).alias("max_drawdown"), F.least(F.lit(0.0), F.min("equity")).alias("cumulative_min"),
        F.greatest(F.lit(0.0), F.max("equity")).alias("cumulative_max"),
    )
    sd = F.stddev_samp("net_pnl")
    tot = p.groupBy("strategy").agg(
        F.sum("net_pnl").alias("net_total_return"), F.sum("funding_pnl").alias("funding_pnl"), F.sum("price_pnl").alias("price_pnl"), F.sum("cost_pnl").alias("cost_pnl"),
        F.when(sd > 0, F.avg("net_pnl") / sd * F.sqrt(F.lit(periods_per_year))).alias("sharpe"), F.count(F.lit(1)).alias("rebalance_count"),
        F.min_by(F.struct("price_pnl", "rebalance_time"), F.struct("price_pnl", "rebalance_time")).alias("_w"),
    )
    held = F.col("position") != 0
    short = F.col("position") < 0
    loss = lambda path: F.coalesce(-F.sum(F.when(short & (F.col("price_pnl") < 0) & (F.col("price_loss_path") == path), F.col("price_pnl"))), F.lit(0.0))
    r = rows.groupBy("strategy").agg(
        (F.coalesce(F.sum(F.when(held, F.col("period_hours"))), F.lit(0.0)) / 24).alias("market_days_entered"),
        F.min_by(F.struct("price_pnl", "market", "block_start"), F.when(short, F.struct("price_pnl", "market", "block_start"))).alias("_s"),
        loss("pre_rebalance_drop").alias("pre_drop_price_loss"), loss("forward_squeeze").alias("forward_squeeze_price_loss"), loss("unknown_pre_history").alias("unknown_price_loss"),
    )
    per = rows.filter(held).groupBy("strategy", "rebalance_time", "end_time", "market").agg(F.sum("period_hours").alias("_h"), F.min("coverage_complete_for_hold").alias("_c"))
    lost = F.greatest(F.lit(0.0), (micros("end_time") - micros("rebalance_time")) / F.lit(3600.0 * MICROS) - F.col("_h")) / 24
    m = per.groupBy("strategy").agg(F.coalesce(F.sum(F.when(~F.col("_c"), lost)), F.lit(0.0)).alias("market_days_lost"))
    names = rows.filter(held).select("strategy", "market").distinct().groupBy("strategy").agg(F.count(F.lit(1)).alias("markets_entered"))
    j = tot.join(curve, "strategy").join(r, "strategy").join(m, "strategy", "left").join(names, "strategy", "left")
    classified = F.col("pre_drop_price_loss") + F.col("forward_squeeze_price_loss")
    return j.select(
        "strategy", "net_total_return", "funding_pnl", "price_pnl", "cost_pnl", "sharpe", "max_drawdown", "cumulative_min", "cumulative_max",
        F.col("_w.price_pnl").alias("worst_period_price_pnl"), F.col("_w.rebalance_time").alias("worst_period_time"),
        F.col("_s.price_pnl").alias("worst_short_price_pnl"), F.col("_s.market").alias("worst_short_market"),
        "rebalance_count", "markets_entered", "market_days_entered", "market_days_lost",
        "pre_drop_price_loss", "forward_squeeze_price_loss", "unknown_price_loss",
        F.when(classified > 0, F.col("pre_drop_price_loss") / classified).alias("pre_drop_loss_fraction"),
    )


def strategy_intervals(rows: DataFrame, periods_per_year: float = 365.0, **kw) -> DataFrame:
    """Total return and Sharpe ratio per strategy with block-bootstrap intervals.

    Periods are drawn within their clock hour and length, so that a draw keeps the
    calendar of the strategy.
    """
    hold = (micros("end_time") - micros("rebalance_time")) / F.lit(3600.0 * MICROS)
    p = materialize(rows.groupBy("strategy", "rebalance_time", "end_time").agg(F.sum("net_pnl").alias("net")).select(
        "strategy", F.hour("rebalance_time").alias("hour"), hold.alias("hold"), "rebalance_time", F.col("rebalance_time").alias("slot"), "net"), "periods")
    sharpe = lambda c: F.when(F.stddev_samp(c) > 0, F.avg(c) / F.stddev_samp(c) * F.sqrt(F.lit(periods_per_year)))
    own = lambda stat, name: panel_ci(p, ["strategy"], ["hour", "hold"], "slot", "net", "rebalance_time", stat, **kw).select(
        "strategy", F.col("point").alias(name), F.col("ci_low").alias(f"{name}_ci_low"), F.col("ci_high").alias(f"{name}_ci_high"), *(["G", "low_cluster"] if name == "net_return" else []))
    out = own(F.sum, "net_return").join(own(sharpe, "sharpe"), "strategy")
    return out.withColumn("return_ci_includes_zero", (F.col("net_return_ci_low") <= 0) & (F.col("net_return_ci_high") >= 0))


def hedge_beta(candles: DataFrame, rebalances: DataFrame, target: str, basket: Sequence[str], *, lookback_s: int = 30 * 86_400, min_observations: int = 24) -> DataFrame:
    """OLS beta of the target's log returns on an equal-weight basket's, per rebalance.

    The wide frame has one row per candle time, whatever the number of ticks. Its returns and the sums behind each slope are
    taken in slices of time: a window's sums are differences of running totals at its ends.
    """
    names, month = [target, *basket], 30 * 86_400
    wide = candles.filter(F.col("market").isin(*names)).groupBy(F.lit("basket").alias("panel"), "time_open").pivot("market", names).agg(F.max("close"))
    prev = lagged(wide, ["panel"], micros("time_open"), {"_pt": F.col("time_open"), **{f"_p{i}": F.col(n) for i, n in enumerate(names)}}, width_s=month)
    logs = [F.ln(F.col(n)) - F.ln(F.col(f"_p{i}")) for i, n in enumerate(names)]
    x = sum(logs[1:], F.lit(0.0)) / len(basket)
    obs = prev.select("panel", "time_open", "_pt", logs[0].alias("y"), x.alias("x")).filter("x is not null and y is not null")
    # Both ends of a return lie in the window: those whose earlier end is before it are the ones up to its first return.
    slots = rebalances.select("rebalance_time").distinct().select(F.lit("basket").alias("panel"), "rebalance_time", plus_seconds("rebalance_time", -lookback_s).alias("_a"))
    products = {"n": F.lit(1), "x": F.col("x"), "y": F.col("y"), "xx": F.col("x") * F.col("x"), "xy": F.col("x") * F.col("y")}
    ended = range_totals(slots, obs, ["panel"], "time_open", {"e": (F.col("_a"), F.col("rebalance_time"), True, False)}, products, width_s=month)
    split = obs.filter("_pt is not null")
    # A return over the window's start ends inside it but begins before: at most one, found from its end.
    over = asof_join(slots, split.select("panel", "time_open", "_pt", "x", "y"), ["panel"], "_a", "time_open", ["_pt", "x", "y"], direction="forward", prefix="o_", width_s=month)
    cut = (F.col("o__pt") < F.col("_a")) & (F.col("o_obs_time") < F.col("rebalance_time"))
    off = lambda c: F.when(cut, c).otherwise(0.0)
    j = ended.join(over.select("rebalance_time", *[off(c).alias(f"_o{k}") for k, c in {"n": F.lit(1.0), "x": F.col("o_x"), "y": F.col("o_y"), "xx": F.col("o_x") * F.col("o_x"), "xy": F.col("o_x") * F.col("o_y")}.items()]), "rebalance_time")
    n, sx, sy, sxx, sxy = (F.col(f"e_{k}") - F.col(f"_o{k}") for k in ("n", "x", "y", "xx", "xy"))
    spread = sxx - sx * sx / n
    out = j.filter(n >= min_observations).select("rebalance_time", n.cast("long").alias("n"), F.when(spread > 0, (sxy - sx * sy / n) / spread).alias("beta"))
    return out.filter(F.col("beta").isNotNull())


def decile_funding_pnl(slots: DataFrame, funding: DataFrame, side: str, lookback_s: int = WEEK_S) -> DataFrame:
    """Funding-only PnL of one tail per period; signal window ``[t-lookback, t]``, paid ``(t, end]``."""
    t, e = F.col("rebalance_time"), F.col("end_time")
    r = range_totals(slots, funding, ["market"], "time_exchange", {"s": (plus_seconds(t, -lookback_s), t, True, True), "p": (t, e, False, True)},
                     {"n": F.lit(1), "rate": F.col("funding_rate")}, width_s=30 * 86_400).filter("s_n > 0")
    r = r.select("market", "rebalance_time", "end_time", (F.col("s_rate") / F.col("s_n")).alias("signal"), F.col("p_rate").alias("paid"))
    pick = tails(r, ["rebalance_time"], "signal", "market").filter(F.col("tail") == ("high" if side == "short" else "low"))
    sign = 1.0 if side == "short" else -1.0
    return pick.groupBy("rebalance_time", "end_time").agg((F.lit(sign) * F.sum("paid") / F.count(F.lit(1))).alias("pnl"), F.count(F.lit(1)).alias("selected"))


def paired_difference(periods: DataFrame, a: str, b: str) -> DataFrame:
    cols = ("net_pnl", "funding_pnl", "price_pnl", "cost_pnl")
    side = lambda s, x: periods.filter(F.col("strategy") == s).select("rebalance_time", *[F.col(c).alias(f"{x}_{c}") for c in cols])
    return side(a, "a").join(side(b, "b"), "rebalance_time").select("*", *[(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(f"diff_{c}") for c in cols])


def tape_return(slots: DataFrame, candles: DataFrame) -> DataFrame:
    """Equal-weight mean of trailing returns known at each rebalance."""
    return pre_rebalance_return(slots, candles).groupBy("rebalance_time").agg(F.avg("pre_rebalance_return").alias("trailing_tape"))


def gate(targets: DataFrame, tape: DataFrame) -> DataFrame:
    """Drop the cross-section of rebalances where the tape is at or above zero."""
    off = tape.filter(F.col("trailing_tape") >= 0).select("rebalance_time")
    return targets.join(off, "rebalance_time", "left_anti")


def day_clustered_t(df: DataFrame, keys: Sequence[str], day: Column, value: str) -> DataFrame:
    """Mean of daily means and its t statistic."""
    daily = df.groupBy(*keys, day.alias("_d")).agg(F.avg(value).alias("_m")).filter(F.col("_m").isNotNull())
    sd = F.stddev_samp("_m")
    return daily.groupBy(*keys).agg(
        F.avg("_m").alias("mean"), F.when((F.count(F.lit(1)) >= 2) & (sd > 0), F.avg("_m") / sd * F.sqrt(F.count(F.lit(1)))).alias("t"), F.count(F.lit(1)).alias("days")
    )
