"""Bars, feed statistics, wallets and bursts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timecols import cluster_key
from tickloom.operators import bars as b, bursts as bu
from tickloom.operators.fills import study_segment
from tickloom.operators.sessions import label_sessions
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.q_fills import _LOC, _SEG, l1_of
from tickloom.plans.registry import query

H6 = 6 * 3600
_B6 = "time_bucket(INTERVAL '6 hours', time_exchange)"
_CK = "market || '|' || strftime(time_bucket(INTERVAL '6 hours', time_exchange), '%Y-%m-%dT%H:%M:%S')"


@query("A1_ohlcv_bars", """SELECT market, time_bucket(INTERVAL '5 minutes', time_exchange) AS bar, round(arg_min(price, (time_exchange, seq)), 6) AS open,
    round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (time_exchange, seq)), 6) AS close, sum(base_amount) AS volume
    FROM trades GROUP BY 1, 2""", "trades")
def _(t: Tables):
    return b.ohlcv(t.trades, 300)


@query("A2_open_close_bars", """SELECT market, time_bucket(INTERVAL '1 hour', time_exchange) AS bar, min(time_exchange) AS time_open, max(time_exchange) AS time_close,
    round(arg_min(price, (time_exchange, seq)), 6) AS open, round(arg_max(price, (time_exchange, seq)), 6) AS close FROM trades GROUP BY 1, 2""", "trades")
def _(t: Tables):
    return b.open_close_bars(t.trades, 3600).drop("first_key", "last_key")


@query("A3_partial_bar_merge", """SELECT market, time_bucket(INTERVAL '6 hours', time_exchange) AS bar, min(time_exchange) AS time_open, max(time_exchange) AS time_close,
    round(arg_min(price, (time_exchange, seq)), 6) AS open, round(arg_max(price, (time_exchange, seq)), 6) AS close FROM trades GROUP BY 1, 2""", "trades")
def _(t: Tables):
    parts = b.open_close_bars(t.trades.withColumn("file", F.col("event_id") % 4), H6, ("file",))
    return b.merge_open_close(parts)


@query("A4_median_bars", f"""SELECT market, {_B6} AS bar, round(min(price), 6) AS lo, round(max(price), 6) AS hi,
    round(quantile_cont(price, 0.5), 6) AS med, count(*) AS n FROM trades GROUP BY 1, 2""", "trades")
def _(t: Tables):
    return b.median_bars(t.trades, H6)


@query("A5_last_oracle_bars", f"""SELECT market, {_B6} AS bar, round(arg_max(oracle_px, (time_exchange, seq)), 6) AS oracle_px, round(arg_max(mark_px, (time_exchange, seq)), 6) AS mark_px,
    round(arg_max(external_perp_px, (time_exchange, seq)), 6) AS external_perp_px, count(*) AS updates FROM oracle GROUP BY 1, 2""", "oracle")
def _(t: Tables):
    return b.last_oracle_bars(t.oracle, H6)


_DIR = f"""SELECT market, {_B6} AS bucket, taker_side, count(*) AS trade_count, sum(base_amount) AS aggressor_size, min(time_exchange) AS start_time,
    max(time_exchange) AS end_time, min(price) AS min_price, max(price) AS max_price FROM trades GROUP BY 1, 2, 3"""
_WAL = f"""SELECT market, bucket, taker_side, list(user_taker ORDER BY user_taker) AS wallets FROM (SELECT market, {_B6} AS bucket, taker_side, user_taker
    FROM trades GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) GROUP BY 1, 2, 3"""
add_view("directional", _DIR, "trades")
add_view("wallets", _WAL, "trades")


@query("A6_directional_bars", "SELECT * REPLACE (round(min_price, 6) AS min_price, round(max_price, 6) AS max_price) FROM directional", "directional")
def _(t: Tables):
    return b.directional_bars(t.trades, H6)


@query("A7_repeated_wallets", "SELECT * REPLACE (array_to_string(wallets, ',') AS wallets) FROM wallets", "wallets")
def _(t: Tables):
    return b.repeated_wallets(t.trades, H6)


@query("A8_merge_partial_flow", f"""WITH w AS (SELECT market, bucket, taker_side, string_agg(DISTINCT user_taker, ',' ORDER BY user_taker) AS wallets FROM
      (SELECT market, {_B6} AS bucket, taker_side, user_taker FROM trades GROUP BY 1, 2, 3, 4, event_id % 2 HAVING count(*) >= 2) GROUP BY 1, 2, 3)
    SELECT d.* REPLACE (round(min_price, 6) AS min_price, round(max_price, 6) AS max_price), coalesce(w.wallets, '') AS wallets
    FROM directional d LEFT JOIN w USING (market, bucket, taker_side)""", "directional")
def _(t: Tables):
    tr = t.trades.withColumn("file", F.col("event_id") % 2)
    k = ["market", "file", "bucket", "taker_side"]
    parts = b.directional_bars(tr, H6, ("file",)).join(b.repeated_wallets(tr, H6, ("file",)), k, "left")
    return b.merge_directional(parts)


_HIST = 12
add_view("grid", f"""WITH per AS (SELECT market, {_B6} AS bucket, arg_max(price, (time_exchange, seq)) AS close,
      count(*) FILTER (taker_side = 'BUY') AS n_buy, count(*) FILTER (taker_side = 'SELL') AS n_sell FROM trades GROUP BY 1, 2),
    span AS (SELECT market, unnest(generate_series(min(bucket), max(bucket), INTERVAL 6 HOUR)) AS bucket FROM per GROUP BY market),
    f AS (SELECT market, bucket, last_value(close IGNORE NULLS) OVER (PARTITION BY market ORDER BY bucket) AS close,
      coalesce(n_buy, 0) AS n_buy, coalesce(n_sell, 0) AS n_sell FROM span LEFT JOIN per USING (market, bucket)),
    r AS (SELECT *, lag(close) OVER w AS prev_close, coalesce(ln(close / lag(close) OVER w), 0.0::DOUBLE) AS ret, row_number() OVER w AS rn
      FROM f WINDOW w AS (PARTITION BY market ORDER BY bucket))
    SELECT market, bucket, close, prev_close, ret, n_buy, n_sell,
      CASE WHEN rn > {_HIST} THEN quantile_cont(n_buy::DOUBLE, 0.5) OVER w END AS med_buy, CASE WHEN rn > {_HIST} THEN quantile_cont(n_sell::DOUBLE, 0.5) OVER w END AS med_sell,
      CASE WHEN rn > {_HIST} THEN stddev_pop(ret) OVER w END AS sigma
    FROM r WINDOW w AS (PARTITION BY market ORDER BY bucket ROWS BETWEEN {_HIST} PRECEDING AND 1 PRECEDING)""", "trades")
add_view("candidates", """SELECT d.market, d.bucket, start_time, end_time, taker_side AS direction, aggressor_size, wallets, trade_count,
      CASE WHEN taker_side = 'SELL' THEN med_sell ELSE med_buy END AS trailing_median_trade_rate,
      CASE WHEN taker_side = 'SELL' THEN -ln(min_price / prev_close) ELSE ln(max_price / prev_close) END AS price_displacement, sigma AS trailing_return_sigma
    FROM directional d JOIN wallets USING (market, bucket, taker_side) JOIN grid USING (market, bucket)""", "directional wallets grid")
add_view("bursts", f"""WITH c AS (SELECT *, trade_count / trailing_median_trade_rate AS rate_multiple, price_displacement / trailing_return_sigma AS displacement_multiple
      FROM candidates WHERE trailing_median_trade_rate > 0 AND trailing_return_sigma > 0
      AND trade_count >= 1.1 * trailing_median_trade_rate AND price_displacement >= 0.4 * trailing_return_sigma),
    m AS (SELECT *, max(end_time) OVER (PARTITION BY market, direction ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_time > reach + INTERVAL 3 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY market, direction ORDER BY start_time, end_time) AS island FROM m)
    SELECT market, min(start_time) AS start_time, max(end_time) AS end_time, direction, sum(aggressor_size) AS aggressor_size,
      list_sort(list_distinct(flatten(list(wallets)))) AS wallets, 'proxy' AS trigger_source, 'proxy-tagged' AS tag_label, sum(trade_count)::BIGINT AS trade_count,
      arg_min(trailing_median_trade_rate, start_time) AS trailing_median_trade_rate, max(price_displacement) AS price_displacement,
      arg_min(trailing_return_sigma, start_time) AS trailing_return_sigma, max(rate_multiple) AS rate_multiple, max(displacement_multiple) AS displacement_multiple
    FROM i GROUP BY market, direction, island""", "candidates")
BURST = dict(bucket_s=H6, history=_HIST, rate_multiple=1.1, sigma_multiple=0.4)
_BURST_R = ", ".join(f"round({c}, 6) AS {c}" for c in ("trailing_median_trade_rate", "price_displacement", "trailing_return_sigma", "rate_multiple", "displacement_multiple"))


def bursts_of(t: Tables):
    return bu.burst_events(t.trades, merge_gap_s=3 * 3600, **BURST)


@query("W1_trailing_median_counts", "SELECT market, bucket, n_buy, n_sell, med_buy, med_sell FROM grid", "grid")
def _(t: Tables):
    return bu.baselines(t.trades, bucket_s=H6, history=_HIST).select("market", "bucket", "n_buy", "n_sell", "med_buy", "med_sell")


@query("W2_trailing_sigma", "SELECT market, bucket, round(ret, 6) AS ret, round(sigma, 6) AS sigma FROM grid", "grid")
def _(t: Tables):
    return bu.baselines(t.trades, bucket_s=H6, history=_HIST).select("market", "bucket", "ret", "sigma")


@query("W14_forward_fill", "SELECT market, bucket, round(close, 6) AS close, round(prev_close, 6) AS prev_close FROM grid", "grid")
def _(t: Tables):
    return bu.baselines(t.trades, bucket_s=H6, history=_HIST).select("market", "bucket", "close", "prev_close")


@query("T11_burst_events", f"SELECT * REPLACE (array_to_string(wallets, ',') AS wallets, {_BURST_R}) FROM bursts", "bursts")
def _(t: Tables):
    return bursts_of(t)


@query("A9_merge_adjacent", """SELECT direction, count(*) AS events, sum(trade_count)::BIGINT AS trades, sum(aggressor_size) AS size, min(start_time) AS first_start, max(end_time) AS last_end
    FROM bursts GROUP BY direction""", "bursts")
def _(t: Tables):
    return bursts_of(t).groupBy("direction").agg(
        F.count(F.lit(1)).alias("events"), F.sum("trade_count").alias("trades"), F.sum("aggressor_size").alias("size"),
        F.min("start_time").alias("first_start"), F.max("end_time").alias("last_end"))


@query("A11_quote_census", f"""WITH x AS (SELECT *, {_SEG.format(hol='off-hours-weekday')} AS segment, best_bid_px > 0 AND best_bid_sx > 0 AND best_ask_px > 0 AND best_ask_sx > 0 AND best_bid_px <= best_ask_px AS ok
      FROM (SELECT *, {_LOC.format(t='time_exchange')} AS loc FROM l1))
    SELECT market, segment, {_CK} AS cluster_key, count(*) FILTER (ok)::DOUBLE AS uptime_num, count(*) AS uptime_den,
      round(coalesce(sum((best_ask_px - best_bid_px) / ((best_bid_px + best_ask_px) / 2) * 10000) FILTER (ok), 0), 6) AS spread_num, count(*) FILTER (ok) AS spread_den,
      coalesce(sum(best_bid_sx + best_ask_sx) FILTER (ok), 0) AS depth_num, count(*) FILTER (ok) AS depth_den FROM x GROUP BY 1, 2, 3""", "l1")
def _(t: Tables):
    seg = label_sessions(l1_of(t), "time_exchange", "XNYS", "_s").withColumn("segment", study_segment(F.col("_s")))
    return b.quote_census(seg)


@query("A12_latency_census", f"""SELECT market, {_CK} AS cluster_key, sum(ms) AS latency_num, count(*) AS latency_den, count(*) FILTER (ms < 0)::DOUBLE AS negative_num,
    count(*) FILTER (ms <= 500)::DOUBLE AS le500_num, count(*) FILTER (ms <= 1000)::DOUBLE AS le1000_num, count(*) FILTER (ms <= 5000)::DOUBLE AS le5000_num
    FROM (SELECT *, (epoch_us(time_received) - epoch_us(time_exchange)) / 1000.0::DOUBLE AS ms FROM trades) GROUP BY 1, 2""", "trades")
def _(t: Tables):
    return b.latency_census(t.trades)


def feeds(t: Tables):
    """Two overlapping recordings of the same prints, each missing some."""
    base = t.trades.select("event_id", "market", "time_exchange", "price", "base_amount", cluster_key("market", "time_exchange").alias("cluster_key"))
    a = base.filter(F.col("event_id") % 5 != 0)
    bb = base.filter(F.col("event_id") % 7 != 0).withColumn("price", F.when(F.col("event_id") % 11 == 0, F.col("price") + 0.5).otherwise(F.col("price")))
    return a, bb


add_view("feed_a", f"SELECT *, {_CK} AS cluster_key FROM trades WHERE event_id % 5 <> 0", "trades")
add_view("feed_b", f"SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN price + 0.5 ELSE price END AS price), {_CK} AS cluster_key FROM trades WHERE event_id % 7 <> 0", "trades")
add_view("overlap", """WITH ca AS (SELECT market, cluster_key, count(*) AS n_a, count(DISTINCT time_exchange) AS t_a FROM feed_a GROUP BY 1, 2),
    cb AS (SELECT market, cluster_key, count(*) AS n_b, count(DISTINCT time_exchange) AS t_b FROM feed_b GROUP BY 1, 2),
    ex AS (SELECT market, cluster_key, sum(least(x.n, y.n)) AS exact FROM (SELECT market, cluster_key, time_exchange, price, base_amount, count(*) AS n FROM feed_a GROUP BY ALL) x
      JOIN (SELECT market, cluster_key, time_exchange, price, base_amount, count(*) AS n FROM feed_b GROUP BY ALL) y USING (market, cluster_key, time_exchange, price, base_amount) GROUP BY 1, 2),
    al AS (SELECT market, cluster_key, count(*) AS aligned_n, sum(abs(y.p - x.p) / x.p * 10000) AS price_diff_sum FROM (SELECT market, cluster_key, time_exchange, avg(price) AS p FROM feed_a GROUP BY ALL) x
      JOIN (SELECT market, cluster_key, time_exchange, avg(price) AS p FROM feed_b GROUP BY ALL) y USING (market, cluster_key, time_exchange) GROUP BY 1, 2)
    SELECT market, cluster_key, coalesce(n_a, 0) AS n_a, coalesce(t_a, 0) AS t_a, coalesce(n_b, 0) AS n_b, coalesce(t_b, 0) AS t_b, coalesce(exact, 0)::BIGINT AS exact,
      coalesce(aligned_n, 0) AS aligned_n, coalesce(price_diff_sum, 0) AS price_diff_sum
    FROM ca FULL JOIN cb USING (market, cluster_key) LEFT JOIN ex USING (market, cluster_key) LEFT JOIN al USING (market, cluster_key)""", "feed_a feed_b")


@query("J16_multiset_match", """SELECT market, sum(n_a)::BIGINT AS n_a, sum(n_b)::BIGINT AS n_b, sum(least(n_a, n_b))::BIGINT AS matched FROM
    (SELECT market, time_exchange, price, base_amount, count(*) AS n_a FROM feed_a GROUP BY ALL) JOIN
    (SELECT market, time_exchange, price, base_amount, count(*) AS n_b FROM feed_b GROUP BY ALL) USING (market, time_exchange, price, base_amount) GROUP BY market""", "feed_a feed_b")
def _(t: Tables):
    a, bb = feeds(t)
    m = b.exact_matches(a, bb, ["market", "time_exchange", "price", "base_amount"])
    return m.groupBy("market").agg(*[F.sum(c).alias(c) for c in ("n_a", "n_b", "matched")])


@query("J17_aligned_price_diff", """SELECT market, count(*) AS n, round(avg(abs(y.p - x.p) / x.p * 10000), 6) AS mean_abs_bps FROM
    (SELECT market, time_exchange, avg(price) AS p FROM feed_a GROUP BY ALL) x JOIN (SELECT market, time_exchange, avg(price) AS p FROM feed_b GROUP BY ALL) y USING (market, time_exchange) GROUP BY market""", "feed_a feed_b")
def _(t: Tables):
    a, bb = feeds(t)
    return b.aligned_differences(a, bb, ["market", "time_exchange"]).groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.avg("abs_diff_bps").alias("mean_abs_bps"))


@query("A13_overlap_clusters", "SELECT * REPLACE (round(price_diff_sum, 6) AS price_diff_sum) FROM overlap", "overlap")
def _(t: Tables):
    return b.overlap_clusters(*feeds(t))


@query("A14_overlap_agreement", """SELECT market, round(least(sum(n_a), sum(n_b)) / greatest(sum(n_a), sum(n_b)), 6) AS count_ratio, round(sum(exact) / greatest(sum(n_a), sum(n_b)), 6) AS exact_ratio,
    round(sum(aligned_n) / greatest(sum(t_a), sum(t_b)), 6) AS time_ratio, round(sum(price_diff_sum) / sum(aligned_n), 6) AS price_diff_bps FROM overlap GROUP BY market""", "overlap")
def _(t: Tables):
    return b.overlap_agreement(b.overlap_clusters(*feeds(t)))


@query("A15_distinct_counts", "SELECT market, count(DISTINCT user_taker) AS wallets, count(DISTINCT date_trunc('day', time_exchange)) AS days, count(DISTINCT date_trunc('hour', time_exchange)) AS hours FROM trades GROUP BY market", "trades")
def _(t: Tables):
    # two-level: distinct pairs first, so that no market's whole set meets in one task
    d = lambda c, n: t.trades.select("market", c.alias("_x")).distinct().groupBy("market").agg(F.count(F.lit(1)).alias(n))
    return d(F.col("user_taker"), "wallets").join(d(F.to_date("time_exchange"), "days"), "market").join(d(F.date_trunc("hour", "time_exchange"), "hours"), "market")


@query("A35_premium_decay", """SELECT market, (minute(time_exchange) - 60)::BIGINT AS minute_to_settlement, round(avg(mark_px / oracle_px - 1), 6) AS mean_premium,
    round(quantile_cont(mark_px / oracle_px - 1, 0.5), 6) AS median_premium, count(*) AS n FROM oracle WHERE minute(time_exchange) >= 50 GROUP BY 1, 2""", "oracle")
def _(t: Tables):
    return b.premium_by_minute(t.oracle)


# coarser wallets, so that some trade twice around one settlement
def wallet_trades(t: Tables):
    return t.trades.withColumn("user_taker", (F.col("user_taker").cast("long") % 3).cast("string")).withColumn("signed_notional", b.signed_notional())


add_view("wallet_windows", """WITH x AS (SELECT *, minute(time_exchange) AS m, date_trunc('hour', time_exchange) AS h,
      (user_taker::BIGINT % 3)::VARCHAR AS w, CASE WHEN taker_side = 'BUY' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END * base_amount * price AS f FROM trades),
    y AS (SELECT market, w AS user_taker, f, CASE WHEN m >= 50 OR m < 10 THEN 'settlement' ELSE 'baseline' END AS window_kind,
      CASE WHEN m >= 50 THEN h + INTERVAL 1 HOUR ELSE h END AS settlement_time, m >= 50 OR m BETWEEN 20 AND 29 AS pre FROM x WHERE m >= 50 OR m < 10 OR m BETWEEN 20 AND 39)
    SELECT market, settlement_time, user_taker, window_kind, count(*) FILTER (pre) AS trade_count_pre, count(*) FILTER (NOT pre) AS trade_count_post,
      coalesce(sum(f) FILTER (pre), 0) AS signed_notional_pre, coalesce(sum(f) FILTER (NOT pre), 0) AS signed_notional_post,
      coalesce(sum(f) FILTER (pre), 0) < 0 AND coalesce(sum(f) FILTER (NOT pre), 0) > 0 AS short_open_then_close FROM y GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""", "trades")
add_view("wallet_events", """WITH g AS (SELECT market, settlement_time, window_kind, sum(signed_notional_pre) AS pre_signed_notional, sum(signed_notional_post) AS post_signed_notional,
      count(*) AS repeat_wallets, avg(short_open_then_close::INT::DOUBLE) AS share FROM wallet_windows GROUP BY 1, 2, 3)
    SELECT s.market, s.settlement_time, s.pre_signed_notional, s.post_signed_notional, s.repeat_wallets, s.share AS short_open_close_share, b.share AS baseline_short_open_close_share,
      s.share - b.share AS short_open_close_share_difference FROM g s LEFT JOIN g b ON s.market = b.market AND s.settlement_time = b.settlement_time AND b.window_kind = 'baseline' WHERE s.window_kind = 'settlement'""", "wallet_windows")


@query("A36_wallet_windows", """SELECT * REPLACE (round(pre_signed_notional, 6) AS pre_signed_notional, round(post_signed_notional, 6) AS post_signed_notional, round(short_open_close_share, 6) AS short_open_close_share,
    round(baseline_short_open_close_share, 6) AS baseline_short_open_close_share, round(short_open_close_share_difference, 6) AS short_open_close_share_difference) FROM wallet_events""", "wallet_events")
def _(t: Tables):
    return b.wallet_window_events(b.wallet_windows(wallet_trades(t)))


@query("A37_wallet_days", """SELECT market, strftime(time_exchange, '%Y-%m-%d') AS date, user_taker, round(sum(price * base_amount), 6) AS dollar_vol,
    round(coalesce(sum(price * base_amount) FILTER (taker_side = 'BUY'), 0), 6) AS buy_dv, round(coalesce(sum(price * base_amount) FILTER (taker_side = 'SELL'), 0), 6) AS sell_dv, count(*) AS trades FROM trades GROUP BY 1, 2, 3""", "trades")
def _(t: Tables):
    return b.wallet_days(t.trades)


@query("A48_effective_spread", """WITH g AS (SELECT market, time_bucket(INTERVAL '1 day', time_exchange) AS period, time_bucket(INTERVAL '1 hour', time_exchange) AS minute,
      avg(price) FILTER (taker_side = 'BUY') AS b, avg(price) FILTER (taker_side = 'SELL') AS s FROM trades GROUP BY 1, 2, 3),
    x AS (SELECT *, (b - s) / ((b + s) / 2) * 10000 AS gap FROM g WHERE b IS NOT NULL AND s IS NOT NULL)
    SELECT market, period, round(quantile_cont(gap, 0.5), 6) AS spread_bp, count(*) AS minutes FROM x WHERE gap > -50 GROUP BY 1, 2 HAVING count(*) >= 2""", "trades")
def _(t: Tables):
    return b.effective_spread(t.trades, 86400, 3600)


@query("S12_era_dedup", """WITH n AS (SELECT event_id, market, time_exchange, price FROM trades WHERE event_id % 2 = 0 AND day(time_exchange) % 3 = 0),
    o AS (SELECT event_id, market, time_exchange, price FROM trades WHERE event_id % 2 = 1)
    SELECT event_id, market, time_exchange, round(price, 6) AS price FROM n UNION ALL SELECT event_id, market, time_exchange, round(price, 6) FROM o
    WHERE (market, date_trunc('day', time_exchange)) NOT IN (SELECT (market, date_trunc('day', time_exchange)) FROM n)""", "trades")
def _(t: Tables):
    x = t.trades.select("event_id", "market", "time_exchange", "price")
    new = x.filter((F.col("event_id") % 2 == 0) & (F.dayofmonth("time_exchange") % 3 == 0))
    return b.drop_older_era(x.filter(F.col("event_id") % 2 == 1), new)


@query("P6_trade_cleaning", "SELECT market, taker_side, count(*) AS n FROM trades WHERE price > 0 AND event_id % 9 <> 0 GROUP BY 1, 2", "trades")
def _(t: Tables):
    dirty = t.trades.withColumn("price", F.when(F.col("event_id") % 9 != 0, F.col("price")))
    return b.clean_trades(dirty).groupBy("market", "taker_side").agg(F.count(F.lit(1)).alias("n"))
