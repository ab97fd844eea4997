"""As-of, range, twin, lookup and conditioning joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timecols import plus_seconds
from tickloom.operators import bars as b, conditioning as cn, eventwindows as ew, lookups as lk, spreads as sp
from tickloom.operators.asof import asof_join, require_match
from tickloom.operators.fills import study_segment, with_default_rate
from tickloom.operators.quotes import microprices
from tickloom.operators.ranges import hours_touched, range_totals, rows_in_windows
from tickloom.operators.sessions import label_sessions
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.q_fills import l1_of
from tickloom.plans.registry import query


def rates_of(t: Tables):
    return with_default_rate(t.funding, t.trades, t.span[0])


@query("J1_asof_value", """SELECT t.event_id, t.market, t.time_exchange, m.time_exchange AS obs_time, round(m.microprice, 6) AS microprice
    FROM trades t ASOF LEFT JOIN micro m ON t.market = m.market AND t.time_exchange + INTERVAL 30 MINUTE >= m.time_exchange""", "trades micro")
def _(t: Tables):
    p = t.trades.select("event_id", "market", "time_exchange", plus_seconds("time_exchange", 1800).alias("target"))
    return asof_join(p, microprices(l1_of(t)), ["market"], "target", "time_exchange", ["microprice"]).drop("target")


@query("J2_asof_with_staleness", """SELECT t.event_id, t.market, t.time_exchange, m.time_exchange AS obs_time,
    CASE WHEN m.time_exchange >= t.time_exchange - INTERVAL 5 MINUTE THEN round(m.microprice, 6) END AS microprice,
    coalesce(m.time_exchange < t.time_exchange - INTERVAL 5 MINUTE, true) AS stale
    FROM trades t ASOF LEFT JOIN micro m ON t.market = m.market AND t.time_exchange >= m.time_exchange""", "trades micro")
def _(t: Tables):
    p = t.trades.select("event_id", "market", "time_exchange")
    return asof_join(p, microprices(l1_of(t)), ["market"], "time_exchange", "time_exchange", ["microprice"], max_age_s=300)


@query("J3_asof_required", "SELECT t.event_id, t.market, round(r.funding_rate * 1e4, 6) AS rate_bps FROM trades t ASOF JOIN rates r ON t.market = r.market AND t.time_exchange >= r.time_exchange", "trades rates")
def _(t: Tables):
    p = t.trades.select("event_id", "market", "time_exchange")
    j = asof_join(p, rates_of(t), ["market"], "time_exchange", "time_exchange", ["funding_rate"])
    return j.select("event_id", "market", (require_match(F.col("funding_rate"), "no funding rate known") * 1e4).alias("rate_bps"))


@query("J4_asof_forward_tolerance", """SELECT s.event_id, s.market, s.end_time, CASE WHEN c.time_open <= s.end_time + INTERVAL 1 HOUR THEN c.time_open END AS next_open_time,
    CASE WHEN c.time_open <= s.end_time + INTERVAL 1 HOUR THEN round(c.open, 6) END AS next_open FROM shocks s ASOF LEFT JOIN candles_1h c ON s.market = c.market AND s.end_time <= c.time_open""", "shocks candles_1h")
def _(t: Tables):
    p = t.shocks.select("event_id", "market", "end_time")
    j = asof_join(p, t.candles_1h, ["market"], "end_time", "time_open", ["open"], direction="forward", max_age_s=3600)
    return j.select("event_id", "market", "end_time", F.when(~F.col("stale"), F.col("obs_time")).alias("next_open_time"), F.col("open").alias("next_open"))


@query("J5_forward_within_tolerance", """SELECT s.event_id, o.off AS offset_minutes, CASE WHEN c.time_open <= s.start_time + to_minutes(o.off + 90) THEN round(c.close, 6) END AS price
    FROM shocks s CROSS JOIN (VALUES (30), (240), (1440)) o(off) ASOF LEFT JOIN candles_1h c ON s.market = c.market AND s.start_time + to_minutes(o.off) <= c.time_open""".replace("o.off AS", "o.off::BIGINT AS"), "shocks candles_1h")
def _(t: Tables):
    p = t.shocks.select("event_id", "market", "start_time", F.explode(F.array(F.lit(30), F.lit(240), F.lit(1440))).alias("offset_minutes"))
    p = p.select("event_id", "market", "offset_minutes", plus_seconds("start_time", F.col("offset_minutes") * 60).alias("probe"))
    j = asof_join(p, t.candles_1h, ["market"], "probe", "time_open", ["close"], direction="forward", max_age_s=90 * 60)
    return j.select("event_id", "offset_minutes", F.col("close").alias("price"))


@query("J6_nearest_within_gap", """WITH x AS (SELECT s.event_id, f.time_exchange AS obs_time, f.funding_rate, abs(epoch_us(f.time_exchange) - epoch_us(s.start_time)) / 1e6 AS gap,
      row_number() OVER (PARTITION BY s.event_id ORDER BY abs(epoch_us(f.time_exchange) - epoch_us(s.start_time)), f.time_exchange) AS rn FROM shocks s JOIN funding f USING (market))
    SELECT event_id, CASE WHEN gap <= 2700 THEN obs_time END AS obs_time, CASE WHEN gap <= 2700 THEN round(funding_rate * 1e4, 6) END AS rate_bps, CASE WHEN gap <= 2700 THEN round(gap::DOUBLE, 6) END AS gap_s FROM x WHERE rn = 1""", "shocks funding")
def _(t: Tables):
    p = t.shocks.select("event_id", "market", "start_time")
    j = lk.nearest_join(p, t.funding, ["market"], "start_time", "time_exchange", ["funding_rate"], 0.75 * 3600)
    return j.select("event_id", "obs_time", (F.col("funding_rate") * 1e4).alias("rate_bps"), "gap_s")


_BUCKET = "CASE WHEN {r} * 24 * 365 < 0 THEN 'negative' WHEN {r} * 24 * 365 < 0.25 THEN '0_to_25pct' WHEN {r} * 24 * 365 < 1.0 THEN '25_to_100pct' ELSE 'ge_100pct' END"
add_view("conditioned", f"""SELECT t.market, t.conditioning_time, r.time_exchange AS funding_settlement_time, r.funding_rate, r.funding_rate * 24 * 365 AS annualized_rate, {_BUCKET.format(r='r.funding_rate')} AS funding_bucket
    FROM (SELECT market, time_open AS conditioning_time FROM candles_1h) t ASOF JOIN rates r ON t.market = r.market AND t.conditioning_time >= r.time_exchange""", "candles_1h rates")


def conditioned(t: Tables):
    return cn.causal_buckets(rates_of(t), t.candles_1h.select("market", F.col("time_open").alias("conditioning_time")))


@query("J7_causal_conditioning", "SELECT * REPLACE (round(funding_rate, 6) AS funding_rate, round(annualized_rate, 6) AS annualized_rate) FROM conditioned", "conditioned")
def _(t: Tables):
    return conditioned(t)


@query("J8_interval_counts", """SELECT s.event_id, (SELECT count(*) FROM trades t WHERE t.market = s.market AND t.time_exchange > s.start_time AND t.time_exchange <= s.start_time + INTERVAL 6 HOUR) AS after_n,
    (SELECT count(*) FROM trades t WHERE t.market = s.market AND t.time_exchange >= s.start_time - INTERVAL 24 HOUR AND t.time_exchange < s.start_time) AS before_n,
    round((SELECT coalesce(sum(base_amount), 0) FROM trades t WHERE t.market = s.market AND t.time_exchange >= s.start_time - INTERVAL 24 HOUR AND t.time_exchange < s.start_time), 6) AS before_size,
    (SELECT count(*) FROM trades t WHERE t.market = s.market AND t.time_exchange BETWEEN s.start_time - INTERVAL 30 MINUTE AND s.end_time + INTERVAL 30 MINUTE) AS padded_n FROM shocks s""", "shocks trades")
def _(t: Tables):
    s, e = F.col("start_time"), F.col("end_time")
    r = range_totals(t.shocks.select("event_id", "market", "start_time", "end_time"), t.trades, ["market"], "time_exchange", {
        "after": (s, plus_seconds(s, 6 * 3600), False, True), "before": (plus_seconds(s, -86400), s, True, False),
        "padded": (plus_seconds(s, -1800), plus_seconds(e, 1800), True, True)}, {"n": F.lit(1), "size": F.col("base_amount")})
    return r.select("event_id", F.col("after_n").cast("long").alias("after_n"), F.col("before_n").cast("long").alias("before_n"), "before_size", F.col("padded_n").cast("long").alias("padded_n"))


@query("J9_rows_in_windows", """SELECT s.event_id, t.seq, t.time_exchange, round(t.price, 6) AS price FROM shocks s JOIN trades t ON t.market = s.market
    AND t.time_exchange BETWEEN s.start_time - INTERVAL 1 HOUR AND s.end_time + INTERVAL 1 HOUR""", "shocks trades")
def _(t: Tables):
    w = t.shocks.select("event_id", "market", plus_seconds("start_time", -3600).alias("a"), plus_seconds("end_time", 3600).alias("z"))
    return rows_in_windows(w, t.trades.select("market", "seq", "time_exchange", "price"), ["market"], "a", "z", "time_exchange", pairs_per_task=4_000_000).select("event_id", "seq", "time_exchange", "price")


@query("J10_hours_touched", "SELECT event_id, unnest(generate_series(date_trunc('hour', start_time), date_trunc('hour', end_time), INTERVAL 1 HOUR)) AS hour FROM shocks", "shocks")
def _(t: Tables):
    return hours_touched(t.shocks, "start_time", "end_time").select("event_id", "hour")


@query("P11_window_overlap", """SELECT a.event_id AS left_id, b.event_id AS right_id FROM shocks a JOIN shocks b ON a.market = b.market AND a.event_id < b.event_id AND a.start_time <= b.end_time AND b.start_time <= a.end_time""", "shocks")
def _(t: Tables):
    # of two windows that meet the later one starts inside the earlier, so each pair is found once; ids decide equal starts
    w = t.shocks.select("market", F.col("event_id").alias("x"), "start_time", "end_time")
    starts = t.shocks.select("market", F.col("event_id").alias("y"), F.col("start_time").alias("s"))
    hit = rows_in_windows(w, starts, ["market"], "start_time", "end_time", "s").filter("x <> y and (start_time < s or x < y)")
    return hit.select(F.least("x", "y").alias("left_id"), F.greatest("x", "y").alias("right_id"))


@query("J11_twin_series", """SELECT a.market AS market_a, b.market AS market_b, a.time_exchange, round((a.funding_rate - b.funding_rate) * 24 * 365, 6) AS differential_apr
    FROM funding a JOIN funding b ON a.time_exchange = b.time_exchange AND a.market < b.market""", "funding")
def _(t: Tables):
    m = t.trades.select("market").distinct()  # the pair list is a small dimension
    pairs = m.select(F.lit("ALL").alias("underlier"), F.col("market").alias("market_a")).join(m.select(F.col("market").alias("market_b")), F.col("market_a") < F.col("market_b"))
    d = sp.pair_series(pairs, t.funding, "time_exchange", "funding_rate")
    return d.select("market_a", "market_b", F.col("time").alias("time_exchange"), cn.apr(F.col("funding_rate_a") - F.col("funding_rate_b")).alias("differential_apr"))


ALIASES = {"NATION_7": "NATION_1", "NATION_9": "NATION_2"}
_MK = """SELECT r_name || ':' || n_name AS market, r_name AS dex, CASE n_name WHEN 'NATION_7' THEN 'NATION_1' WHEN 'NATION_9' THEN 'NATION_2' ELSE n_name END AS underlier
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON true WHERE (s_suppkey + r_regionkey) % 2 = 0 GROUP BY ALL"""
add_view("markets_dim", _MK)


def markets_dim(t: Tables):
    """Coins listed on several venues (from supplier and nation)."""
    r, n, s = t.raw("region"), t.raw("nation"), t.raw("supplier")
    listed = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name").crossJoin(F.broadcast(r))  # five regions
    listed = listed.filter((F.col("s_suppkey") + F.col("r_regionkey")) % 2 == 0)
    return listed.select(F.concat_ws(":", "r_name", "n_name").alias("market"), F.col("r_name").alias("dex"), lk.underlier(F.col("n_name"), ALIASES).alias("underlier")).distinct()


@query("J12_twin_pairs", """SELECT a.underlier, a.market AS market_a, b.market AS market_b FROM markets_dim a JOIN markets_dim b ON a.underlier = b.underlier AND a.market < b.market AND a.dex <> b.dex""", "markets_dim")
def _(t: Tables):
    return lk.twin_pairs(markets_dim(t)).select("underlier", "market_a", "market_b")


@query("F11_underlier_alias", "SELECT market, underlier FROM markets_dim", "markets_dim")
def _(t: Tables):
    return markets_dim(t).select("market", "underlier")


@query("J13_one_to_one_join", """SELECT s_suppkey, s_name, n, round(total, 6) AS total FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS total FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey""")
def _(t: Tables):
    agg = t.raw("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total"))
    return lk.join_one_to_one(t.raw("supplier").select("s_suppkey", "s_name"), agg, ["s_suppkey"])


@query("J14_semi_join", """SELECT market, count(*) AS n FROM trades WHERE (market, date_trunc('hour', time_exchange)) IN (SELECT (market, date_trunc('hour', start_time)) FROM shocks) GROUP BY market""", "trades shocks")
def _(t: Tables):
    h = t.shocks.select("market", F.date_trunc("hour", "start_time").alias("h")).distinct()
    return t.trades.withColumn("h", F.date_trunc("hour", "time_exchange")).join(h, ["market", "h"], "left_semi").groupBy("market").agg(F.count(F.lit(1)).alias("n"))


@query("J15_anti_join", """SELECT market, count(*) AS n FROM trades WHERE (market, date_trunc('hour', time_exchange)) NOT IN (SELECT (market, date_trunc('hour', start_time)) FROM shocks) GROUP BY market""", "trades shocks")
def _(t: Tables):
    h = t.shocks.select("market", F.date_trunc("hour", "start_time").alias("h")).distinct()
    return t.trades.withColumn("h", F.date_trunc("hour", "time_exchange")).join(h, ["market", "h"], "left_anti").groupBy("market").agg(F.count(F.lit(1)).alias("n"))


@query("U3_set_ops", """SELECT market, h, 'both' AS kind FROM (SELECT market, date_trunc('hour', time_exchange) AS h FROM trades INTERSECT SELECT market, date_trunc('hour', start_time) FROM shocks)
    UNION ALL SELECT market, h, 'missing' FROM (SELECT market, date_trunc('hour', time_exchange) AS h FROM trades EXCEPT SELECT market, date_trunc('hour', start_time) FROM shocks)""", "trades shocks")
def _(t: Tables):
    # hours first: they are few, rows are folded to them before any shuffle
    a = t.trades.select("market", F.date_trunc("hour", "time_exchange").alias("h")).distinct()
    h = t.shocks.select("market", F.date_trunc("hour", "start_time").alias("h")).distinct()
    return a.intersect(h).withColumn("kind", F.lit("both")).unionByName(a.subtract(h).withColumn("kind", F.lit("missing")))


@query("J18_strict_lookup", "SELECT s_suppkey, n_name, round(s_acctbal / 100, 6) AS fee_bps FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t: Tables):
    dim = t.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return lk.strict_lookup(t.raw("supplier"), dim, "s_nationkey", ["n_name"]).select("s_suppkey", "n_name", (F.col("s_acctbal") / 100).alias("fee_bps"))


@query("J20_in_list", "SELECT market, count(*) AS n, round(sum(price), 6) AS total FROM trades WHERE market IN ('click', 'view') AND user_taker IN (SELECT w FROM (SELECT unnest(wallets) AS w FROM shocks)) GROUP BY market", "trades shocks")
def _(t: Tables):
    w = t.shocks.select(F.explode("wallets").alias("user_taker")).distinct()
    return t.trades.filter(F.col("market").isin("click", "view")).join(w, "user_taker", "left_semi").groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


add_view("exposure", f"""WITH h AS (SELECT market, funding_rate, time_exchange AS a, lead(time_exchange) OVER (PARTITION BY market ORDER BY time_exchange) AS b FROM rates),
    c AS (SELECT market, funding_rate, greatest(a, t0) AS a, least(coalesce(b, t1), t1) AS b FROM h, feed),
    k AS (SELECT market, funding_rate, a, b, unnest(generate_series(time_bucket(INTERVAL '6 hours', a), b - INTERVAL 1 MICROSECOND, INTERVAL 6 HOUR)) AS block_start FROM c WHERE a < b),
    s AS (SELECT market, funding_rate, block_start, greatest(a, block_start) AS interval_start, least(b, block_start + INTERVAL 6 HOUR) AS interval_end FROM k)
    SELECT market, block_start, interval_start, interval_end, funding_rate, funding_rate * 24 * 365 AS annualized_rate, {_BUCKET.format(r='funding_rate')} AS funding_bucket,
      (epoch_us(interval_end) - epoch_us(interval_start)) / 3.6e9::DOUBLE AS exposure_hours,
      (SELECT count(*) FROM shocks e WHERE e.market = s.market AND e.start_time >= s.interval_start AND e.start_time < s.interval_end) AS event_count,
      market || '|' || strftime(block_start, '%Y-%m-%dT%H:%M:%S') AS cluster_key FROM s""", "rates shocks feed")


def exposure_of(t: Tables):
    return cn.exposure_panel(rates_of(t), t.shocks.select("market", "start_time"), *t.span)


@query("T13_exposure_panel", "SELECT * REPLACE (round(funding_rate, 6) AS funding_rate, round(annualized_rate, 6) AS annualized_rate, round(exposure_hours, 6) AS exposure_hours) FROM exposure", "exposure")
def _(t: Tables):
    return exposure_of(t)


@query("A40_hazard_table", """WITH x AS (SELECT c.*, EXISTS (SELECT 1 FROM shocks s WHERE s.market = c.market AND s.start_time > c.conditioning_time AND s.start_time <= c.conditioning_time + INTERVAL 12 HOUR) AS hit FROM conditioned c)
    SELECT funding_bucket, count(*) AS conditioning_observations, count(*) FILTER (hit) AS event_within_horizon_count, round(avg(hit::INT::DOUBLE), 6) AS probability_event_within_horizon,
    12.0::DOUBLE AS hazard_horizon_hours, avg(hit::INT::DOUBLE) >= 0.9 AS coverage_saturated FROM x GROUP BY 1""", "conditioned shocks")
def _(t: Tables):
    return cn.hazard_table(conditioned(t), t.shocks.select("market", "start_time"), 12 * 3600)


add_view("bridge", f"""WITH e AS (SELECT s.market, s.start_time, s.direction, unnest(s.wallets) AS wallet, {_BUCKET.format(r='r.funding_rate')} AS funding_bucket
      FROM shocks s ASOF JOIN rates r ON s.market = r.market AND s.start_time >= r.time_exchange),
    c AS (SELECT 'high_apr_buy' AS cohort, * FROM e WHERE funding_bucket = 'ge_100pct' AND direction = 'BUY' UNION ALL SELECT 'low_apr_buy', * FROM e WHERE funding_bucket IN ('negative', '0_to_25pct') AND direction = 'BUY'
      UNION ALL SELECT 'high_apr_sell', * FROM e WHERE funding_bucket = 'ge_100pct' AND direction = 'SELL' UNION ALL SELECT 'proxy_population', * FROM e),
    f AS (SELECT cohort, wallet, min((start_time, market)) AS m FROM c GROUP BY 1, 2)
    SELECT cohort, wallet, m[2] AS cohort_market, m[1] AS cohort_time, m[1] > (SELECT t1 FROM feed) - INTERVAL 24 HOUR AS censored,
      (SELECT min((start_time, market)) FROM e WHERE e.wallet = f.wallet AND e.start_time > f.m[1]) AS l FROM f""", "shocks rates feed")


def bridge_of(t: Tables):
    ev = cn.causal_buckets(rates_of(t), t.shocks.select("market", "start_time", "direction", "wallets"), "start_time")
    return cn.wallet_bridge(ev, t.span[1])


@query("A41_wallet_bridge", """WITH p AS (SELECT cohort, count(*) FILTER (NOT censored) AS n, count(*) FILTER (NOT censored AND l IS NOT NULL) AS later, count(*) FILTER (censored) AS cens FROM bridge GROUP BY 1),
    q AS (SELECT *, CASE WHEN n > 0 THEN later / n END AS frac FROM p),
    w AS (SELECT max(n) FILTER (cohort = 'high_apr_buy') AS high_n, max(later) FILTER (cohort = 'high_apr_buy') AS high_later, max(cens) FILTER (cohort = 'high_apr_buy') AS high_censored, max(frac) FILTER (cohort = 'high_apr_buy') AS hf,
      max(n) FILTER (cohort = 'low_apr_buy') AS low_n, max(frac) FILTER (cohort = 'low_apr_buy') AS lf, max(n) FILTER (cohort = 'high_apr_sell') AS sell_n, max(frac) FILTER (cohort = 'high_apr_sell') AS sf,
      max(n) FILTER (cohort = 'proxy_population') AS population_n, max(frac) FILTER (cohort = 'proxy_population') AS pf FROM q)
    SELECT high_n, high_later, high_censored, round(hf, 6) AS high_fraction, low_n, round(lf, 6) AS low_fraction, sell_n, round(sf, 6) AS sell_fraction, population_n, round(pf, 6) AS population_fraction,
      round(hf - lf, 6) AS high_minus_low, NOT coalesce(CASE WHEN high_n > 0 AND low_n > 0 THEN abs(hf - lf) <= 1.96 * sqrt(hf * (1 - hf) / high_n + lf * (1 - lf) / low_n) ELSE false END, false) AS funding_specific_linkage FROM w""", "bridge")
def _(t: Tables):
    return cn.bridge_summary(bridge_of(t))


@query("A41_wallet_bridge_detail", "SELECT cohort, wallet, cohort_market, cohort_time, censored, l IS NOT NULL AS appeared_later, l[1] AS later_time, l[2] AS later_market FROM bridge", "bridge")
def _(t: Tables):
    return bridge_of(t)


_STATE = "CASE WHEN a IS NULL THEN 'unavailable' WHEN a < 0 THEN 'negative' WHEN a < 0.25 THEN '0%-25%' WHEN a < 1.0 THEN '25%-100%' ELSE '>=100%' END"
add_view("fund_cond", f"""WITH x AS (SELECT s.event_id, s.market, s.start_time, avg(f.funding_rate) * 24 * 365 AS a, count(f.funding_rate) AS n FROM shocks s LEFT JOIN funding f ON f.market = s.market AND f.time_exchange >= s.start_time - INTERVAL 24 HOUR
      AND f.time_exchange < s.start_time GROUP BY 1, 2, 3), y AS (SELECT *, ((start_time AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Seoul') AS kr FROM x)
    SELECT event_id, market, start_time, a AS trailing_mean_apr, {_STATE} AS funding_state, n AS funding_observations,
      CASE WHEN isodow(kr) < 6 AND strftime(kr, '%Y-%m-%d') <> '2024-01-01' AND strftime(kr, '%H:%M:%S') >= '09:00:00' AND strftime(kr, '%H:%M:%S') < '15:30:00' THEN 'live' ELSE 'frozen' END AS krx_state FROM y""", "shocks funding")
add_view("oracle_cond", """WITH x AS (SELECT s.event_id, count(*) FILTER (o.update_class = 'Deployer') AS d, count(*) FILTER (o.update_class = 'Fallback') AS f FROM shocks s LEFT JOIN oracle o ON o.market = s.market
      AND o.time_exchange BETWEEN s.start_time - INTERVAL 30 MINUTE AND s.end_time + INTERVAL 30 MINUTE GROUP BY 1)
    SELECT event_id, d AS oracle_deployer_updates, f AS oracle_fallback_updates, CASE WHEN d + f > 0 THEN f / (d + f) END AS oracle_fallback_frequency,
      CASE WHEN d + f = 0 THEN 'unavailable' WHEN f > 0 THEN 'fallback-present' ELSE 'deployer-only' END AS oracle_regime, d + f AS oracle_observations FROM x""", "shocks oracle")


def funding_conditioning(t: Tables):
    f = cn.trailing_funding(t.shocks.select("event_id", "market", "start_time"), t.funding)
    return label_sessions(f, "start_time", "XKRX", "k").select("*", F.when(F.col("k") == "RTH", "live").otherwise("frozen").alias("krx_state")).drop("k")


def oracle_conditioning(t: Tables):
    return cn.oracle_regime(t.shocks.select("event_id", "market", "start_time", "end_time"), t.oracle).drop("market", "start_time", "end_time")


@query("A61_funding_conditioning", "SELECT * REPLACE (round(trailing_mean_apr, 6) AS trailing_mean_apr) FROM fund_cond", "fund_cond")
def _(t: Tables):
    return funding_conditioning(t)


@query("A60_oracle_conditioning", "SELECT * REPLACE (round(oracle_fallback_frequency, 6) AS oracle_fallback_frequency) FROM oracle_cond", "oracle_cond")
def _(t: Tables):
    return oracle_conditioning(t)


@query("J21_conditioning_join", """SELECT f.event_id, market, funding_state, krx_state, oracle_regime, round(oracle_fallback_frequency, 6) AS oracle_fallback_frequency, coalesce(oracle_observations > 0, false) AS covered
    FROM fund_cond f LEFT JOIN oracle_cond o USING (event_id)""", "fund_cond oracle_cond")
def _(t: Tables):
    j = funding_conditioning(t).join(oracle_conditioning(t), "event_id", "left")
    return j.select("event_id", "market", "funding_state", "krx_state", "oracle_regime", "oracle_fallback_frequency", F.coalesce(F.col("oracle_observations") > 0, F.lit(False)).alias("covered"))


@query("A62_availability_census", "SELECT DISTINCT market, strftime(start_time, '%Y-%m-%d') AS date, NULL::DOUBLE AS open_interest, false AS available FROM shocks", "shocks")
def _(t: Tables):
    return t.shocks.select("market", F.to_date("start_time").alias("date")).distinct().select("*", F.lit(None).cast("double").alias("open_interest"), F.lit(False).alias("available"))


@query("A64_coverage_windows", "SELECT market, min(date_trunc('hour', time_exchange)) AS cover_start, max(date_trunc('hour', time_exchange)) + INTERVAL 1 HOUR AS cover_end FROM trades GROUP BY market", "trades")
def _(t: Tables):
    return ew.coverage_windows(t.trades)


add_view("merged", """WITH p AS (SELECT *, start_time - INTERVAL 30 MINUTE AS ws, end_time + INTERVAL 30 MINUTE AS we FROM shocks),
    r AS (SELECT *, max(we) OVER (PARTITION BY market ORDER BY start_time, end_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR ws > reach THEN 1 ELSE 0 END) OVER (PARTITION BY market ORDER BY start_time, end_time) AS k FROM r)
    SELECT market || '-W' || lpad(k::VARCHAR, 4, '0') AS pair_id, market, min(ws) AS start, max(we) AS "end", string_agg(event_id, ',' ORDER BY start_time, end_time) AS event_ids, max(rate_multiple * displacement_multiple) AS burst_strength
    FROM i GROUP BY market, k""", "shocks")


@query("A10_merge_event_windows", "SELECT * REPLACE (round(burst_strength, 6) AS burst_strength) FROM merged", "merged")
def _(t: Tables):
    return ew.merge_windows(t.shocks)


add_view("base_cand", """WITH c AS (SELECT market, min(date_trunc('hour', time_exchange)) AS a, max(date_trunc('hour', time_exchange)) + INTERVAL 1 HOUR AS z FROM trades GROUP BY market),
    d AS (SELECT m.*, u.shift, m.start + to_days(u.shift::INT) AS b_start, m."end" + to_days(u.shift::INT) AS b_end, c.a, c.z FROM merged m JOIN c USING (market), (SELECT unnest(generate_series(-32, 32)) AS shift) u
      WHERE u.shift <> 0 AND abs(u.shift) <= greatest(1, date_diff('day', c.a, c.z) + 1))
    SELECT pair_id, market, shift, b_start, b_end FROM d WHERE b_start >= a AND b_end <= z AND NOT EXISTS (SELECT 1 FROM merged x WHERE x.market = d.market AND x.start <= d.b_end AND d.b_start <= x."end")""", "merged trades")


@query("J19_baseline_candidates", "SELECT * FROM base_cand", "base_cand")
def _(t: Tables):
    return ew.baseline_candidates(ew.merge_windows(t.shocks), ew.coverage_windows(t.trades)).select("pair_id", "market", "shift", "b_start", "b_end")


def pairs_of(t: Tables):
    m = ew.merge_windows(t.shocks)
    return ew.match_baselines(m, ew.baseline_candidates(m, ew.coverage_windows(t.trades)))


@query("J19_matched_baselines")
def _(t: Tables):
    return pairs_of(t).select("pair_id", "market", "shift", "start", "end", "b_start", "b_end")


# legs with the nearest clean day, reuse allowed: the part SQL can check
add_view("leg_rows", """WITH n AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY abs(shift), shift) AS rn FROM base_cand), p AS (SELECT m.pair_id, m.market, m.start, m."end" AS e, n.b_start, n.b_end FROM merged m JOIN n ON m.pair_id = n.pair_id AND rn = 1)
    SELECT pair_id, market, 'forced-flow' AS window_type, start AS window_start, e AS window_end FROM p UNION ALL SELECT pair_id, market, 'baseline', b_start, b_end FROM p""", "base_cand")


def legs_of(t: Tables):
    m = ew.merge_windows(t.shocks)
    c = ew.baseline_candidates(m, ew.coverage_windows(t.trades))
    near = c.groupBy("pair_id", "market", "start", "end").agg(F.min_by(F.struct("b_start", "b_end"), F.struct("distance", "shift")).alias("n"))
    return ew.legs(near.select("pair_id", "market", "start", "end", "n.*"))


@query("A63_window_legs", "SELECT * FROM leg_rows", "leg_rows")
def _(t: Tables):
    return legs_of(t)


@query("A63_pairs_from_legs", """SELECT pair_id, market, max(window_start) FILTER (window_type = 'forced-flow') AS start, max(window_end) FILTER (window_type = 'forced-flow') AS "end",
    max(window_start) FILTER (window_type = 'baseline') AS b_start, max(window_end) FILTER (window_type = 'baseline') AS b_end FROM leg_rows GROUP BY 1, 2""", "leg_rows")
def _(t: Tables):
    return ew.pairs_from_legs(legs_of(t))


@query("A16_matched_pairs", """WITH f AS (SELECT l.pair_id, l.window_type, t.seq FROM leg_rows l JOIN trades t ON t.market = l.market AND t.time_exchange BETWEEN l.window_start AND l.window_end)
    SELECT pair_id, window_type, seq FROM f WHERE pair_id IN (SELECT pair_id FROM f GROUP BY 1 HAVING count(DISTINCT window_type) = 2)""", "leg_rows trades")
def _(t: Tables):
    f = rows_in_windows(legs_of(t), t.trades.select("market", "seq", "time_exchange"), ["market"], "window_start", "window_end", "time_exchange")
    return ew.matched_pairs(f.select("pair_id", "window_type", "seq"))


@query("A17_quote_coverage", """WITH x AS (SELECT l.pair_id, l.window_type, count(*) AS n, avg((q.best_bid_px > q.best_ask_px)::INT::DOUBLE) AS frac FROM leg_rows l JOIN quotes q ON q.market = l.market AND q.best_ask_px IS NOT NULL AND q.time_exchange BETWEEN l.window_start AND l.window_end GROUP BY 1, 2)
    SELECT window_type, count(*) AS window_count, count(*) FILTER (frac > 0.2) AS dropped, round(avg((frac > 0.2)::INT::DOUBLE), 6) AS dropped_fraction, round(avg(frac), 6) AS mean_fraction, round(quantile_cont(frac, 0.5), 6) AS median_fraction,
      round(avg(frac) - (SELECT avg(frac) FROM x), 6) AS minus_all_mean FROM x GROUP BY 1""", "leg_rows quotes")
def _(t: Tables):
    q = t.quotes.filter(F.col("best_ask_px").isNotNull()).select("market", "time_exchange", (F.col("best_bid_px") > F.col("best_ask_px")).cast("double").alias("crossed"))
    per = rows_in_windows(legs_of(t), q, ["market"], "window_start", "window_end", "time_exchange").groupBy("pair_id", "window_type").agg(F.avg("crossed").alias("frac"))
    gone = F.col("frac") > 0.2
    s = per.groupBy("window_type").agg(F.count(F.lit(1)).alias("window_count"), F.count_if(gone).alias("dropped"), F.avg(gone.cast("double")).alias("dropped_fraction"), F.avg("frac").alias("mean_fraction"), F.percentile("frac", 0.5).alias("median_fraction"))
    overall = per.agg(F.avg("frac").alias("_m"))  # one row
    return s.crossJoin(F.broadcast(overall)).select("window_type", "window_count", "dropped", "dropped_fraction", "mean_fraction", "median_fraction", (F.col("mean_fraction") - F.col("_m")).alias("minus_all_mean"))
