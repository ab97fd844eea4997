"""Portfolio construction, accounting and strategy summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timecols import micros, plus_seconds
from tickloom.operators import conditioning as cn, portfolio as pf
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.registry import query
from tickloom.session import materialize

MIN_OBS = 100


def study_of(t: Tables):
    """From a full week of history and the hour after it to the end of the feed."""
    return t.span[0] + F.expr("interval 7 days 1 hour"), t.span[1]


def slots_of(t: Tables, hours: int = 24):
    return pf.schedule(t.trades.select("market"), *study_of(t), hours)


def signals_of(t: Tables):
    return pf.trailing_signal(pf.price_known(slots_of(t), t.candles_1h), t.funding, min_observations=MIN_OBS)


def targets_of(t: Tables, styles=("short", "long_short", "long_top", "long_universe")):
    s = materialize(signals_of(t), "signals")
    out = None
    for style in styles:
        p = pf.position_targets(s, style).select(F.lit(style).alias("strategy"), "market", "rebalance_time", "end_time", "position", "signal")
        out = p if out is None else out.unionByName(p)
    return out


def costs_of(t: Tables):
    """Fee and half-spread per market (a small dimension)."""
    code = F.length("market")
    return t.trades.select("market").distinct().select("market", (F.lit(4.5) + code / F.lit(10.0)).alias("fee_bps"), (code / F.lit(4.0)).alias("half_spread_bps"))


def ledger_of(t: Tables):
    return materialize(pf.ledger(materialize(targets_of(t), "targets"), t.candles_1h, t.funding, costs_of(t), 24), "ledger")


_SLOTS = """SELECT market, r AS rebalance_time, r + INTERVAL {h} HOUR AS end_time FROM (SELECT DISTINCT market, unnest(generate_series(CAST(to_timestamp(ceil(epoch(t0 + INTERVAL 169 HOUR) / {s}) * {s}) AT TIME ZONE 'UTC' AS TIMESTAMP), t1 - INTERVAL {h} HOUR, INTERVAL {h} HOUR)) AS r FROM trades, feed)"""
add_view("slots", _SLOTS.format(h=24, s=86_400), "trades feed")
add_view("signals", f"""SELECT s.*, (SELECT avg(funding_rate) FROM funding f WHERE f.market = s.market AND f.time_exchange > s.rebalance_time - INTERVAL 7 DAY AND f.time_exchange <= s.rebalance_time) AS signal FROM slots s
    WHERE EXISTS (SELECT 1 FROM candles_1h c WHERE c.market = s.market AND c.time_close <= s.rebalance_time AND c.time_close >= s.rebalance_time - INTERVAL 1 SECOND)
    AND (SELECT count(*) FROM funding f WHERE f.market = s.market AND f.time_exchange > s.rebalance_time - INTERVAL 7 DAY AND f.time_exchange <= s.rebalance_time) >= {MIN_OBS}""", "slots funding candles_1h")
add_view("targets", """WITH r AS (SELECT *, count(*) OVER (PARTITION BY rebalance_time) AS n, row_number() OVER (PARTITION BY rebalance_time ORDER BY signal, market) AS lo FROM signals), k AS (SELECT *, ceil(n / 10.0) AS c FROM r WHERE n >= 2)
    SELECT 'short' AS strategy, market, rebalance_time, end_time, (-1.0::DOUBLE / c) AS position, signal FROM k WHERE lo > n - c UNION ALL SELECT 'long_top', market, rebalance_time, end_time, 1.0::DOUBLE / c, signal FROM k WHERE lo > n - c
    UNION ALL SELECT 'long_universe', market, rebalance_time, end_time, 1.0::DOUBLE / n, signal FROM k UNION ALL SELECT 'long_short', market, rebalance_time, end_time, CASE WHEN lo <= c THEN 0.5::DOUBLE / c ELSE -0.5::DOUBLE / c END, signal FROM k WHERE lo > n - c OR lo <= c""", "signals")
add_view("elig", "SELECT s.market, s.rebalance_time, s.end_time, c.time_close, c.close FROM slots s JOIN candles_1h c ON c.market = s.market AND c.time_open > s.rebalance_time AND c.time_close <= s.end_time", "slots candles_1h")
add_view("blocks", """WITH w AS (SELECT market, rebalance_time, end_time, arg_min(close, time_close) AS entry, max(time_close) AS lc FROM elig GROUP BY 1, 2, 3),
    b AS (SELECT s.market, s.rebalance_time, s.end_time, w.entry, coalesce(s.end_time - lc <= INTERVAL 1 SECOND, false) AS complete, CASE WHEN s.end_time - lc <= INTERVAL 1 SECOND THEN s.end_time ELSE lc END AS stop FROM slots s LEFT JOIN w USING (market, rebalance_time, end_time)),
    x AS (SELECT b.*, rebalance_time + to_hours(u.h::INT) AS bs FROM b, (VALUES (0), (6), (12), (18)) u(h) WHERE entry IS NOT NULL AND rebalance_time + to_hours(u.h::INT) < stop),
    y AS (SELECT *, least(bs + INTERVAL 6 HOUR, stop) AS be FROM x),
    z AS (SELECT y.*, (SELECT arg_max(close, time_close) FROM elig e WHERE e.market = y.market AND e.rebalance_time = y.rebalance_time AND e.time_close <= y.be) AS px FROM y)
    SELECT market, rebalance_time, end_time, bs AS block_start, be AS block_end, (px - coalesce(lag(px) OVER (PARTITION BY market, rebalance_time ORDER BY bs), entry)) / entry AS price_return, complete FROM z WHERE px IS NOT NULL
    UNION ALL SELECT market, rebalance_time, end_time, rebalance_time, rebalance_time, 0.0, false FROM b WHERE entry IS NULL""", "slots elig")
add_view("pre_ret", """SELECT s.market, s.rebalance_time, CASE WHEN count(c.close) >= 2 THEN arg_max(c.close, c.time_close) / arg_min(c.close, c.time_close) - 1 END AS pre_rebalance_return
    FROM slots s LEFT JOIN candles_1h c ON c.market = s.market AND c.time_close > s.rebalance_time - INTERVAL 7 DAY AND c.time_close <= s.rebalance_time GROUP BY 1, 2""", "slots candles_1h")
add_view("ledger", """WITH held AS (SELECT market, rebalance_time, bool_or(complete) AS complete FROM blocks GROUP BY 1, 2), l AS (SELECT strategy, max(rebalance_time) AS mx FROM targets GROUP BY 1),
    sv AS (SELECT t.strategy, t.market, t.rebalance_time + INTERVAL 24 HOUR AS rebalance_time, t.position AS prior_position FROM targets t JOIN held h USING (market, rebalance_time) JOIN l USING (strategy) WHERE h.complete AND t.rebalance_time + INTERVAL 24 HOUR <= mx),
    tc AS (SELECT strategy, market, rebalance_time, coalesce(position, 0) AS position, coalesce(prior_position, 0) AS prior_position, signal FROM targets FULL JOIN sv USING (strategy, market, rebalance_time)),
    j AS (SELECT tc.*, rebalance_time + INTERVAL 24 HOUR AS end_time, b.block_start, b.block_end, b.price_return, b.complete AS cc FROM tc JOIN blocks b USING (market, rebalance_time) WHERE position <> 0
      UNION ALL SELECT *, rebalance_time + INTERVAL 24 HOUR, rebalance_time, rebalance_time, 0.0, true FROM tc WHERE position = 0),
    k AS (SELECT *, row_number() OVER w = 1 AS f, lead(block_start) OVER w IS NULL AS la, 4.5::DOUBLE + length(market) / 10.0::DOUBLE + length(market) / 4.0::DOUBLE AS bps FROM j WINDOW w AS (PARTITION BY strategy, market, rebalance_time ORDER BY block_start)),
    m AS (SELECT k.*, CASE WHEN f THEN position - prior_position ELSE 0.0 END AS turnover, -position * coalesce((SELECT sum(funding_rate) FROM funding x WHERE x.market = k.market AND x.time_exchange > k.block_start AND x.time_exchange <= k.block_end), 0) AS funding_pnl, position * price_return AS price_pnl FROM k),
    n AS (SELECT *, abs(turnover) * bps / 10000 + CASE WHEN position <> 0 AND NOT cc AND la THEN abs(position) * bps / 10000 ELSE 0 END AS cost FROM m)
    SELECT n.strategy, n.market, n.rebalance_time, n.end_time, block_start, block_end, position, prior_position, turnover, signal, funding_pnl, price_pnl, -cost AS cost_pnl, funding_pnl + price_pnl - cost AS net_pnl,
      CASE WHEN position < 0 THEN p.pre_rebalance_return END AS pre_rebalance_return, CASE WHEN position >= 0 THEN NULL WHEN p.pre_rebalance_return IS NULL THEN 'unknown_pre_history' WHEN p.pre_rebalance_return < 0 THEN 'pre_rebalance_drop' ELSE 'forward_squeeze' END AS price_loss_path,
      n.market || '|' || strftime(time_bucket(INTERVAL '6 hours', block_start), '%Y-%m-%dT%H:%M:%S') AS cluster_key, (epoch_us(block_end) - epoch_us(block_start)) / 3.6e9::DOUBLE AS period_hours, cc AS coverage_complete_for_hold
    FROM n LEFT JOIN pre_ret p ON p.market = n.market AND p.rebalance_time = n.rebalance_time""", "targets blocks pre_ret funding")
add_view("periods", "SELECT strategy, rebalance_time, end_time, sum(funding_pnl) AS funding_pnl, sum(price_pnl) AS price_pnl, sum(cost_pnl) AS cost_pnl, sum(net_pnl) AS net_pnl FROM ledger GROUP BY 1, 2, 3", "ledger")


def rr(*cols: str) -> str:
    return "* REPLACE (" + ", ".join(f"round({c}, 6) AS {c}" for c in cols) + ")"


@query("T14_rebalance_schedule", _SLOTS.format(h=8, s=28_800), "trades feed")
def _(t: Tables):
    return slots_of(t, 8)


@query("W7_trailing_range_mean", "SELECT market, rebalance_time, round(signal * 1e4, 6) AS signal_bps FROM signals", "signals")
def _(t: Tables):
    return signals_of(t).select("market", "rebalance_time", (F.col("signal") * 1e4).alias("signal_bps"))


@query("T15_position_targets", "SELECT strategy, market, rebalance_time, end_time, round(position, 6) AS position, round(signal * 1e4, 6) AS signal_bps FROM targets", "targets")
def _(t: Tables):
    return targets_of(t).withColumn("signal_bps", F.col("signal") * 1e4).drop("signal")


@query("T16_tradable_now", """SELECT s.market, s.rebalance_time FROM slots s WHERE EXISTS (SELECT 1 FROM candles_1h c WHERE c.market = s.market AND c.time_close <= s.rebalance_time AND c.time_close >= s.rebalance_time - INTERVAL 1 SECOND)
    AND (SELECT count(*) FROM candles_1h c WHERE c.market = s.market AND c.time_open > s.rebalance_time AND c.time_open < s.end_time) >= 2""", "slots candles_1h")
def _(t: Tables):
    return pf.with_two_closes(pf.price_known(slots_of(t), t.candles_1h), t.candles_1h).select("market", "rebalance_time")


@query("T17_strictly_after_return", "SELECT market, rebalance_time, end_time, count(*) AS closes, round(arg_max(close, time_close) / arg_min(close, time_close) - 1, 6) AS period_return FROM elig GROUP BY 1, 2, 3 HAVING count(*) >= 2", "elig")
def _(t: Tables):
    return pf.strictly_after_return(slots_of(t), t.candles_1h)


@query("T17_price_blocks", f"SELECT {rr('price_return')} FROM blocks", "blocks")
def _(t: Tables):
    return pf.price_blocks(slots_of(t), t.candles_1h)


@query("T18_portfolio_ledger", f"SELECT {rr('position', 'prior_position', 'turnover', 'signal', 'funding_pnl', 'price_pnl', 'cost_pnl', 'net_pnl', 'pre_rebalance_return', 'period_hours')} FROM ledger", "ledger")
def _(t: Tables):
    return ledger_of(t)


@query("W19_pre_rebalance_return", """SELECT market, rebalance_time, round(pre_rebalance_return, 6) AS pre_rebalance_return, CASE WHEN pre_rebalance_return IS NULL THEN 'unknown_pre_history' WHEN pre_rebalance_return < 0 THEN 'pre_rebalance_drop' ELSE 'forward_squeeze' END AS label FROM pre_ret""", "pre_ret")
def _(t: Tables):
    r = pf.pre_rebalance_return(slots_of(t).select("market", "rebalance_time"), t.candles_1h)
    return r.withColumn("label", pf.loss_path(F.col("pre_rebalance_return")))


@query("F9_turnover_cost", "SELECT strategy, market, rebalance_time, round(sum(abs(turnover) * (4.5::DOUBLE + length(market) / 10.0::DOUBLE + length(market) / 4.0::DOUBLE) / 10000), 6) AS cost FROM ledger GROUP BY 1, 2, 3", "ledger")
def _(t: Tables):
    return ledger_of(t).join(costs_of(t), "market").groupBy("strategy", "market", "rebalance_time").agg(
        F.sum(pf.turnover_cost(F.col("turnover"), F.col("fee_bps"), F.col("half_spread_bps"))).alias("cost"))


@query("A66_period_returns", f"SELECT {rr('funding_pnl', 'price_pnl', 'cost_pnl', 'net_pnl')} FROM periods", "periods")
def _(t: Tables):
    return pf.period_returns(ledger_of(t))


@query("W9_equity_drawdown", """WITH e AS (SELECT strategy, rebalance_time, net_pnl AS ret, sum(net_pnl) OVER (PARTITION BY strategy ORDER BY rebalance_time) AS equity, row_number() OVER (PARTITION BY strategy ORDER BY rebalance_time) AS rn FROM periods),
    p AS (SELECT *, max(equity) OVER (PARTITION BY strategy ORDER BY rebalance_time) AS peak, avg(ret) OVER r AS m, stddev_samp(ret) OVER r AS sd FROM e WINDOW r AS (PARTITION BY strategy ORDER BY rebalance_time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT strategy, rebalance_time, round(ret, 6) AS ret, round(equity, 6) AS equity, round(peak, 6) AS peak, round(equity - peak, 6) AS drawdown, round(CASE WHEN rn >= 10 AND sd > 0 THEN m / sd * sqrt(365) END, 6) AS rolling_sharpe FROM p""", "periods")
def _(t: Tables):
    return pf.equity_curve(pf.period_returns(ledger_of(t)), window=10)


@query("W20_upper_median_step", """WITH d AS (SELECT market, (epoch_us(time_exchange) - epoch_us(lag(time_exchange) OVER (PARTITION BY market ORDER BY time_exchange))) / 1e6 AS dt FROM funding), s AS (SELECT market, list_sort(list(dt)) AS v FROM d WHERE dt IS NOT NULL GROUP BY 1)
    SELECT market, v[len(v) // 2 + 1]::DOUBLE AS upper_median FROM s""", "funding")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("market").orderBy("time_exchange")
    us = F.unix_micros("time_exchange")
    d = t.funding.select("market", ((us - F.lag(us, 1).over(w)) / F.lit(1e6)).alias("dt")).filter("dt is not null")
    return pf.upper_median(d, ["market"], "dt")


@query("A49_strategy_summary", """WITH c AS (SELECT *, sum(net_pnl) OVER (PARTITION BY strategy ORDER BY rebalance_time) AS eq FROM periods), d AS (SELECT *, eq - greatest(0, max(eq) OVER (PARTITION BY strategy ORDER BY rebalance_time)) AS dd FROM c),
    t AS (SELECT strategy, sum(net_pnl) AS net, sum(funding_pnl) AS fp, sum(price_pnl) AS pp, sum(cost_pnl) AS cp, avg(net_pnl) / stddev_samp(net_pnl) * sqrt(365) AS sh, least(0, min(dd)) AS mdd, least(0, min(eq)) AS cmin, greatest(0, max(eq)) AS cmax, arg_min((price_pnl, rebalance_time), (price_pnl, rebalance_time)) AS w, count(*) AS n FROM d GROUP BY 1),
    r AS (SELECT strategy, sum(period_hours) FILTER (position <> 0) / 24 AS mde, min((price_pnl, market, block_start)) FILTER (position < 0) AS s, coalesce(-sum(price_pnl) FILTER (price_pnl < 0 AND price_loss_path = 'pre_rebalance_drop'), 0) AS a, coalesce(-sum(price_pnl) FILTER (price_pnl < 0 AND price_loss_path = 'forward_squeeze'), 0) AS b,
      coalesce(-sum(price_pnl) FILTER (price_pnl < 0 AND price_loss_path = 'unknown_pre_history'), 0) AS u, count(DISTINCT market) FILTER (position <> 0) AS me FROM ledger GROUP BY 1),
    q AS (SELECT strategy, sum(lost) AS l FROM (SELECT strategy, rebalance_time, market, CASE WHEN NOT bool_and(coverage_complete_for_hold) THEN greatest(0, 24 - sum(period_hours)) / 24 ELSE 0 END AS lost FROM ledger WHERE position <> 0 GROUP BY 1, 2, 3) GROUP BY 1)
    SELECT strategy, round(net, 6) AS net_total_return, round(fp, 6) AS funding_pnl, round(pp, 6) AS price_pnl, round(cp * 1e4, 6) AS cost_bps, round(sh, 6) AS sharpe, round(mdd, 6) AS max_drawdown, round(cmin, 6) AS cumulative_min, round(cmax, 6) AS cumulative_max, round(w[1], 6) AS worst_period_price_pnl, w[2] AS worst_period_time,
      round(s[1], 6) AS worst_short_price_pnl, s[2] AS worst_short_market, n AS rebalance_count, me AS markets_entered, round(mde, 6) AS market_days_entered, round(l, 6) AS market_days_lost, round(a, 6) AS pre_drop_price_loss, round(b, 6) AS forward_squeeze_price_loss, round(u, 6) AS unknown_price_loss,
      round(CASE WHEN a + b > 0 THEN a / (a + b) END, 6) AS pre_drop_loss_fraction FROM t JOIN r USING (strategy) JOIN q USING (strategy)""", "periods")
def _(t: Tables):
    return pf.strategy_summary(ledger_of(t)).select("*", (F.col("cost_pnl") * 1e4).alias("cost_bps")).drop("cost_pnl")


@query("A49_strategy_intervals", """WITH n AS (SELECT strategy, hour(rebalance_time) AS h, (epoch(end_time) - epoch(rebalance_time)) / 3600 AS hold, rebalance_time, sum(net_pnl) AS net FROM ledger GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY strategy, h, hold ORDER BY rebalance_time) - 1 AS i, count(*) OVER (PARTITION BY strategy, h, hold) AS m, count(*) OVER (PARTITION BY strategy) AS G FROM n),
    p AS (SELECT strategy, h, hold, draw, ('0x' || substr(md5(concat_ws('|', 0, draw, strftime(rebalance_time, '%Y-%m-%d %H:%M:%S'))), 1, 8))::BIGINT % m AS i FROM r, range(2000) d(draw) WHERE G >= 5),
    v AS (SELECT p.strategy, draw, sum(r.net) AS s, CASE WHEN stddev_samp(r.net) > 0 THEN avg(r.net) / stddev_samp(r.net) * sqrt(365) END AS sh FROM p JOIN r USING (strategy, h, hold, i) GROUP BY 1, 2),
    q AS (SELECT strategy, quantile_cont(s, 0.025) AS sl, quantile_cont(s, 0.975) AS su, quantile_cont(sh, 0.025) AS hl, quantile_cont(sh, 0.975) AS hu FROM v GROUP BY 1),
    a AS (SELECT strategy, sum(net) AS s, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt(365) END AS sh, count(*) AS G FROM n GROUP BY 1)
    SELECT strategy, round(s, 6) AS net_return, round(sl, 6) AS net_return_ci_low, round(su, 6) AS net_return_ci_high, round(sh, 6) AS sharpe, round(hl, 6) AS sharpe_ci_low, round(hu, 6) AS sharpe_ci_high, G, G < 5 AS low_cluster, sl <= 0 AND su >= 0 AS return_ci_includes_zero FROM a LEFT JOIN q USING (strategy)""", "ledger")
def _(t: Tables):
    return pf.strategy_intervals(ledger_of(t))


@query("A51_monthly_and_splits", """WITH a AS (SELECT p.*, (SELECT avg(pre_rebalance_return) FROM pre_ret x WHERE x.rebalance_time = p.rebalance_time) AS tape FROM periods p)
    SELECT strategy, 'month' AS split, strftime(rebalance_time, '%Y-%m') AS part, count(*) AS n, round(sum(net_pnl), 6) AS net_pnl FROM a GROUP BY ALL UNION ALL SELECT strategy, 'half', CASE WHEN epoch_us(rebalance_time) * 2 < epoch_us(t0) + epoch_us(t1) + 608400000000 THEN 'H1' ELSE 'H2' END AS part, count(*), round(sum(net_pnl), 6) FROM a, feed GROUP BY strategy, part
    UNION ALL SELECT strategy, 'tape', CASE WHEN tape >= 0 THEN 'up_tape' ELSE 'down_tape' END, count(*), round(sum(net_pnl), 6) FROM a GROUP BY ALL""", "periods pre_ret feed")
def _(t: Tables):
    tape = pf.tape_return(slots_of(t).select("market", "rebalance_time"), t.candles_1h)
    p = pf.period_returns(ledger_of(t)).join(tape, "rebalance_time", "left")
    part = lambda s, c: F.struct(F.lit(s).alias("split"), c.alias("part"))
    cells = F.array(part("month", F.date_format("rebalance_time", "yyyy-MM")), part("half", F.when(micros("rebalance_time") * 2 < sum(F.unix_micros(x) for x in study_of(t)), "H1").otherwise("H2")),
                    part("tape", F.when(F.col("trailing_tape") >= 0, "up_tape").otherwise("down_tape")))
    return p.select("strategy", "net_pnl", F.explode(cells).alias("c")).groupBy("strategy", "c.split", "c.part").agg(F.count(F.lit(1)).alias("n"), F.sum("net_pnl").alias("net_pnl"))


@query("A51_gain_paths", """SELECT l.strategy, CASE WHEN p.pre_rebalance_return IS NULL THEN 'unknown' WHEN p.pre_rebalance_return < 0 THEN 'bounce_after_drop' ELSE 'continued_squeeze' END AS gain_path, round(sum(price_pnl), 6) AS price_pnl
    FROM ledger l LEFT JOIN pre_ret p USING (market, rebalance_time) WHERE position > 0 AND price_pnl > 0 GROUP BY 1, 2""", "ledger pre_ret")
def _(t: Tables):
    l = ledger_of(t).filter("position > 0").drop("pre_rebalance_return")
    pre = pf.pre_rebalance_return(l.select("market", "rebalance_time").distinct(), t.candles_1h)
    r = F.col("pre_rebalance_return")
    path = F.when(r.isNull(), "unknown").when(r < 0, "bounce_after_drop").otherwise("continued_squeeze")
    return l.join(pre, ["market", "rebalance_time"], "left").filter("price_pnl > 0").groupBy("strategy", path.alias("gain_path")).agg(F.sum("price_pnl").alias("price_pnl"))


@query("J22_paired_strategies", """SELECT count(*) AS n, round(sum(a.net_pnl - b.net_pnl) * 1e4, 6) AS net_bps, round(sum(a.funding_pnl - b.funding_pnl) * 1e4, 6) AS funding_bps, round(sum(a.price_pnl - b.price_pnl) * 1e4, 6) AS price_bps, round(sum(a.cost_pnl - b.cost_pnl) * 1e4, 6) AS cost_bps, round(corr(a.net_pnl, b.net_pnl), 6) AS corr
    FROM periods a JOIN periods b USING (rebalance_time) WHERE a.strategy = 'long_top' AND b.strategy = 'long_universe'""", "periods")
def _(t: Tables):
    d = pf.paired_difference(pf.period_returns(ledger_of(t)), "long_top", "long_universe")
    return d.agg(F.count(F.lit(1)).alias("n"), *[(F.sum(f"diff_{c}_pnl") * 1e4).alias(f"{c}_bps") for c in ("net", "funding", "price", "cost")], F.corr("a_net_pnl", "b_net_pnl").alias("corr"))


@query("T19_hedge_beta", """WITH w AS (SELECT time_open, max(close) FILTER (market = 'click') AS a, max(close) FILTER (market = 'view') AS b, max(close) FILTER (market = 'error') AS c FROM candles_1h WHERE market IN ('click', 'view', 'error') GROUP BY 1),
    r AS (SELECT time_open, lag(time_open) OVER o AS pt, ln(a) - ln(lag(a) OVER o) AS y, (ln(b) - ln(lag(b) OVER o) + ln(c) - ln(lag(c) OVER o)) / 2 AS x FROM w WINDOW o AS (ORDER BY time_open)), s AS (SELECT DISTINCT rebalance_time FROM slots)
    SELECT rebalance_time, count(*) AS n, round(regr_slope(y, x), 6) AS beta FROM s JOIN r ON r.time_open < rebalance_time AND r.pt >= rebalance_time - INTERVAL 7 DAY WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1 HAVING count(*) >= 48""", "candles_1h slots")
def _(t: Tables):
    return pf.hedge_beta(t.candles_1h, slots_of(t), "click", ["view", "error"], lookback_s=7 * 86400, min_observations=48)


@query("T20_decile_funding_pnl", """WITH s AS (SELECT s.market, s.rebalance_time, s.end_time, (SELECT avg(funding_rate) FROM funding f WHERE f.market = s.market AND f.time_exchange BETWEEN s.rebalance_time - INTERVAL 7 DAY AND s.rebalance_time) AS g,
      coalesce((SELECT sum(funding_rate) FROM funding f WHERE f.market = s.market AND f.time_exchange > s.rebalance_time AND f.time_exchange <= s.end_time), 0) AS paid FROM slots s), r AS (SELECT *, row_number() OVER (PARTITION BY rebalance_time ORDER BY g DESC, market DESC) AS rn, ceil(count(*) OVER (PARTITION BY rebalance_time) / 10.0) AS k FROM s WHERE g IS NOT NULL)
    SELECT rebalance_time, end_time, round(sum(paid) / count(*), 6) AS pnl, count(*) AS selected FROM r WHERE rn <= k GROUP BY 1, 2""", "slots funding")
def _(t: Tables):
    return pf.decile_funding_pnl(slots_of(t), t.funding, "short")


@query("T28_risk_gate", """SELECT strategy, market, rebalance_time, round(position, 6) AS position FROM targets t WHERE (SELECT avg(pre_rebalance_return) FROM pre_ret x WHERE x.rebalance_time = t.rebalance_time) < 0""", "targets pre_ret")
def _(t: Tables):
    tape = pf.tape_return(slots_of(t).select("market", "rebalance_time"), t.candles_1h)
    return pf.gate(targets_of(t), tape).select("strategy", "market", "rebalance_time", "position")
