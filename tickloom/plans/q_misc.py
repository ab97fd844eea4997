"""Spreads, brackets, capacity, scalar functions and small reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickloom.functions.timecols import cluster_key, floor_to, horizon_seconds, micros
from tickloom.operators import bootstrap as bs, brackets as br, conditioning as cn, fills as fl, lookups as lk, ranking as rk, spreads as sp, stats as st
from tickloom.operators.conditioning import funding_bucket
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.q_fills import fills_of, l1_of
from tickloom.plans.q_joins import _BUCKET, _STATE, markets_dim
from tickloom.plans.q_stats import _STD, boot_sql, ci_names
from tickloom.plans.registry import query
from tickloom.session import materialize
from tickloom.sources.candles import CandleSources

# venues of the derived markets (fixed values)
DEX = {"click": "alpha", "view": "beta", "error": "alpha", "purchase": "beta", "signup": "gamma"}
_DEXSQL = "CASE market WHEN 'click' THEN 'alpha' WHEN 'view' THEN 'beta' WHEN 'error' THEN 'alpha' WHEN 'purchase' THEN 'beta' ELSE 'gamma' END"


def twins(t: Tables):
    m = t.trades.select("market").distinct()
    dex = F.create_map(*[F.lit(x) for kv in DEX.items() for x in kv])[F.col("market")]
    return lk.twin_pairs(m.select(F.lit("ALL").alias("underlier"), "market", dex.alias("dex"))).select("underlier", "market_a", "market_b")


add_view("twins", f"SELECT 'ALL' AS underlier, a.market AS market_a, b.market AS market_b FROM (SELECT DISTINCT market, {_DEXSQL} AS dex FROM trades) a JOIN (SELECT DISTINCT market, {_DEXSQL} AS dex FROM trades) b ON a.market < b.market AND a.dex <> b.dex", "trades")
_PC = "market_a || '~' || market_b || '|' || strftime(time_bucket(INTERVAL '6 hours', time), '%Y-%m-%dT%H:%M:%S')"
add_view("tdiff", f"SELECT *, {_PC} AS cluster_key FROM (SELECT p.*, a.time_exchange AS time, (a.funding_rate - b.funding_rate) * 8760 AS diff_apr, abs((a.funding_rate - b.funding_rate) * 8760) AS abs_diff_apr FROM twins p JOIN funding a ON a.market = market_a JOIN funding b ON b.market = market_b AND a.time_exchange = b.time_exchange)", "twins funding")
add_view("tbasis", f"SELECT *, abs(basis) AS abs_basis, {_PC} AS cluster_key FROM (SELECT *, l - quantile_cont(l, 0.5) OVER (PARTITION BY market_a, market_b) AS basis FROM (SELECT p.*, a.time_open AS time, ln(a.close / b.close) AS l FROM twins p JOIN candles_1h a ON a.market = market_a JOIN candles_1h b ON b.market = market_b AND a.time_open = b.time_open))", "twins candles_1h")


@query("J11_pair_differential", "SELECT underlier, market_a, market_b, time, round(diff_apr, 6) AS diff_apr, round(abs_diff_apr, 6) AS abs_diff_apr, cluster_key FROM tdiff", "tdiff")
def _(t: Tables):
    return sp.differential(twins(t), t.funding)


@query("F24_pair_basis", "SELECT market_a, market_b, time, round(l, 6) AS log_price_ratio, round(basis, 6) AS basis FROM tbasis", "tbasis")
def _(t: Tables):
    return sp.basis(twins(t), t.candles_1h).select("market_a", "market_b", "time", "log_price_ratio", "basis")


def fee_table(t: Tables):
    return t.raw("region").select(F.col("r_name").alias("dex"), (F.lit(1.5) + F.col("r_regionkey") / 2).alias("effective_maker_bps"), (F.lit(4.5) + F.col("r_regionkey")).alias("effective_taker_bps"))


def listed_half_spreads(t: Tables):
    s = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg((F.abs(F.avg("s_acctbal")) / 1000).alias("half_spread_bps"))
    m = markets_dim(t).withColumn("n_name", F.split("market", ":")[1])
    return m.join(s, "n_name").select("market", "half_spread_bps")


@query("F7_round_trip_cost", """WITH h AS (SELECT n_name, abs(avg(s_acctbal)) / 1000 AS hs FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1), m AS (SELECT m.*, 1.5 + r_regionkey / 2.0 AS mk, 4.5 + r_regionkey AS tk, hs FROM markets_dim m JOIN region ON r_name = dex JOIN h ON n_name = split_part(market, ':', 2))
    SELECT a.underlier, a.market AS market_a, b.market AS market_b, (2 * (a.mk + b.mk))::DOUBLE AS maker_bps, round((2 * (a.tk + b.tk + a.hs + b.hs))::DOUBLE, 6) AS taker_bps FROM m a JOIN m b ON a.underlier = b.underlier AND a.market < b.market AND a.dex <> b.dex""", "markets_dim")
def _(t: Tables):
    return sp.round_trip_costs(lk.twin_pairs(markets_dim(t)), fee_table(t), listed_half_spreads(t))


@query("F8_breakeven_apr", "SELECT s_suppkey, round(abs(s_acctbal) / 1000 / 10000 * 8760 / (1 + s_nationkey), 6) AS breakeven_apr FROM supplier")
def _(t: Tables):
    return t.raw("supplier").select("s_suppkey", sp.breakeven_apr(F.abs("s_acctbal") / 1000, F.lit(1) + F.col("s_nationkey")).alias("breakeven_apr"))


@query("A25_breakeven_episodes", """WITH x AS (SELECT *, abs_diff_apr > 0.3 AS a, lag(abs_diff_apr > 0.3) OVER w AS pa, time - lag(time) OVER w AS st FROM tdiff WINDOW w AS (PARTITION BY market_a, market_b ORDER BY time)), k AS (SELECT *, sum(CASE WHEN a AND NOT (coalesce(pa, false) AND coalesce(st = INTERVAL 1 HOUR, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY market_a, market_b ORDER BY time) AS run FROM x),
    r AS (SELECT market_a, market_b, run, count(*) AS h FROM k WHERE a GROUP BY 1, 2, 3) SELECT market_a, market_b, count(*) AS episodes, round(quantile_cont(h::DOUBLE, 0.5), 6) AS median_hours, max(h) AS longest FROM r GROUP BY 1, 2""", "tdiff")
def _(t: Tables):
    e = sp.episodes(sp.differential(twins(t), t.funding), F.lit(0.3), ["market_a", "market_b"])
    return e.groupBy("market_a", "market_b").agg(F.count(F.lit(1)).alias("episodes"), F.percentile("hours", 0.5).alias("median_hours"), F.max("hours").alias("longest"))


add_view("halves", "SELECT market, quantile_cont(m, 0.5) AS half_spread_bps, count(*) AS segments FROM (SELECT market, date_trunc('hour', time_exchange), quantile_cont((best_ask_px - best_bid_px) / ((best_bid_px + best_ask_px) / 2) * 10000 / 2, 0.5) AS m FROM quotes WHERE best_bid_px > 0 AND best_ask_px > 0 AND best_ask_px >= best_bid_px GROUP BY 1, 2) GROUP BY 1", "quotes")


@query("A46_half_spreads", "SELECT market, round(half_spread_bps, 6) AS half_spread_bps, segments FROM halves", "halves")
def _(t: Tables):
    return sp.half_spreads(t.quotes)


@query("A47_spread_table", "SELECT market, round(coalesce(h.half_spread_bps, 2 * (SELECT quantile_cont(half_spread_bps, 0.5) FROM halves WHERE market IN ('click', 'view'))), 6) AS half_spread_bps, CASE WHEN h.market IS NOT NULL THEN 'measured' ELSE 'assumed_2x_class_median' END AS spread_source FROM (SELECT DISTINCT market FROM trades) LEFT JOIN halves h USING (market)", "halves trades")
def _(t: Tables):
    m = sp.half_spreads(t.quotes).drop("segments")
    return sp.spread_table(t.trades, m, ["click", "view"])


HORIZON = 24.0
_MK, _TK = "(5.0 / 10000 * 8760 / 24)", "(25.0 / 10000 * 8760 / 24)"


def pair_metrics_of(t: Tables):
    costs = twins(t).select("*", F.lit(5.0).alias("maker_bps"), F.lit(25.0).alias("taker_bps"))
    return sp.pair_metrics(materialize(sp.differential(twins(t), t.funding), "diff"), materialize(sp.basis(twins(t), t.candles_1h), "basis"), costs, HORIZON)


_A58 = f"""WITH a AS ({boot_sql('(SELECT *, (abs_diff_apr > ' + _MK + ')::INT AS mk, (abs_diff_apr > ' + _TK + ')::INT AS tk FROM tdiff) z', ['market_a', 'market_b'], 'cluster_key', {'n': '1', 'x': 'abs_diff_apr', 'm': 'mk', 't': 'tk'}, {'mean_abs_diff_apr': '{s}x / {s}n', 'pct_gt_maker': '{s}m / {s}n', 'pct_gt_taker': '{s}t / {s}n'})}),
    v AS ({boot_sql('tbasis', ['market_a', 'market_b'], 'cluster_key', {'n': '1', 'x': 'basis', 'xx': 'basis * basis'}, {'basis_vol': _STD})}),
    q AS (SELECT market_a, market_b, quantile_cont(abs_diff_apr, 0.95) AS p FROM tdiff GROUP BY 1, 2), r AS (SELECT market_a, market_b, quantile_cont(abs_basis, 0.95) AS bp FROM tbasis GROUP BY 1, 2)
    SELECT a.* EXCLUDE (n, G, low_cluster), v.basis_vol, v.basis_vol_ci_low, v.basis_vol_ci_high, round(p, 6) AS p95_abs_diff_apr, round(bp, 6) AS basis_p95, round(bp / (p * 24 / 8760), 6) AS basis_to_return FROM a JOIN v USING (market_a, market_b) JOIN q USING (market_a, market_b) JOIN r USING (market_a, market_b)"""


@query("A58_pair_metrics", _A58, "tdiff tbasis")
def _(t: Tables):
    cols = [x + s for x in ("mean_abs_diff_apr", "pct_gt_maker", "pct_gt_taker", "basis_vol") for s in ("", "_ci_low", "_ci_high")]
    return pair_metrics_of(t).select("market_a", "market_b", *cols, "p95_abs_diff_apr", "basis_p95", "basis_to_return")


@query("A59_first_failed_gate", f"""WITH x AS (SELECT *, abs_diff_apr > {_MK} AS a, lag(abs_diff_apr > {_MK}) OVER w AS pa, time - lag(time) OVER w AS st FROM tdiff WINDOW w AS (PARTITION BY market_a, market_b ORDER BY time)), k AS (SELECT *, sum(CASE WHEN a AND NOT (coalesce(pa, false) AND coalesce(st = INTERVAL 1 HOUR, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY market_a, market_b ORDER BY time) AS run FROM x),
    e AS (SELECT market_a, market_b, count(*) AS n, quantile_cont(h::DOUBLE, 0.5) AS md FROM (SELECT market_a, market_b, run, count(*) AS h FROM k WHERE a GROUP BY 1, 2, 3) GROUP BY 1, 2), q AS (SELECT market_a, market_b, quantile_cont(abs_diff_apr, 0.95) AS p FROM tdiff GROUP BY 1, 2), r AS (SELECT market_a, market_b, quantile_cont(abs_basis, 0.95) AS bp FROM tbasis GROUP BY 1, 2)
    SELECT market_a, market_b, CASE WHEN coalesce(n, 0) = 0 THEN 'never-reaches-breakeven' WHEN md <= 3 THEN 'duration' WHEN bp / (p * 24 / 8760) > 1 THEN 'basis' ELSE 'survives' END AS gate FROM q JOIN r USING (market_a, market_b) LEFT JOIN e USING (market_a, market_b)""", "tdiff tbasis")
def _(t: Tables):
    m = pair_metrics_of(t)
    return m.select("market_a", "market_b", sp.first_failed_gate(F.col("maker_n_episodes"), F.col("maker_median_episode_hours"), 3.0, F.col("basis_to_return")).alias("gate"))


# --- brackets: hours stand for minutes ------------------------------------------
add_view("brk", """WITH f AS (SELECT market, time_exchange AS s, CASE WHEN funding_rate > 0 THEN 'positive' WHEN funding_rate < 0 THEN 'negative' ELSE 'zero' END AS sign, 'd' || lpad(least(10, greatest(1, (row_number() OVER (ORDER BY abs(funding_rate), market, time_exchange) - 1) * 10 // count(*) OVER () + 1))::VARCHAR, 2, '0') AS decile, CASE WHEN market IN ('click', 'view') THEN 'web' ELSE 'other' END AS grp FROM funding),
    w AS (SELECT f.*, b.k AS bracket, u.kind, CASE WHEN b.k < 0 THEN s + to_hours(u.sh) - to_hours(abs(b.k)) ELSE s + to_hours(u.sh) END AS a, CASE WHEN b.k < 0 THEN s + to_hours(u.sh) ELSE s + to_hours(u.sh) + to_hours(abs(b.k)) END AS z FROM f, (VALUES (-10), (-5), (-1), (1), (5), (10)) b(k), (VALUES ('event', 0), ('control', 30)) u(kind, sh)),
    r AS (SELECT market, s, sign, decile, grp, bracket, kind, ln(arg_max(close, time_close) / arg_min(open, time_close)) AS ret, count(*) AS n FROM w JOIN candles_1h c USING (market) WHERE c.time_close > a AND c.time_close < z GROUP BY ALL)
    SELECT e.market, e.s AS settlement_time, e.sign AS funding_sign, e.decile AS funding_size_decile, e.grp AS coverage_group, e.bracket::BIGINT AS bracket, e.ret AS event_return, c.ret AS baseline_return, e.n AS event_bars, c.n AS baseline_bars, e.market || '|' || strftime(time_bucket(INTERVAL '6 hours', e.s), '%Y-%m-%dT%H:%M:%S') AS cluster_key
    FROM r e JOIN r c ON e.market = c.market AND e.s = c.s AND e.bracket = c.bracket AND e.kind = 'event' AND c.kind = 'control'""", "funding candles_1h")


def windows_of(t: Tables):
    rate = F.col("funding_rate")
    sized = t.funding.withColumn("_abs", F.abs(rate))
    ranked = rk.global_prefix(sized, F.lit(1).cast("long"), "_abs", "market", micros("time_exchange"), out="_rank", width_s=86_400 * 30)
    decile = F.format_string("d%02d", rk.ordinal_decile(F.col("_rank"), F.col("_n")))
    s = ranked.crossJoin(F.broadcast(t.funding.agg(F.count(F.lit(1)).alias("_n")))).select(  # one row
        "market", F.col("time_exchange").alias("settlement_time"), F.when(rate > 0, "positive").when(rate < 0, "negative").otherwise("zero").alias("funding_sign"),
        decile.alias("funding_size_decile"), F.when(F.col("market").isin("click", "view"), "web").otherwise("other").alias("coverage_group"))
    return br.bracket_windows(s, "settlement_time", unit_s=3600, control_s=30 * 3600)


def brackets_of(t: Tables):
    return br.bracket_returns(windows_of(t), t.candles_1h, "settlement_time", bucket_s=86400)


@query("F12_bracket_windows", """SELECT market, time_exchange AS settlement_time, b.k::BIGINT AS bracket, u.kind, CASE WHEN b.k < 0 THEN time_exchange + to_hours(u.sh) - to_hours(abs(b.k)) ELSE time_exchange + to_hours(u.sh) END AS a, CASE WHEN b.k < 0 THEN time_exchange + to_hours(u.sh) ELSE time_exchange + to_hours(u.sh) + to_hours(abs(b.k)) END AS z
    FROM funding, (VALUES (-10), (-5), (-1), (1), (5), (10)) b(k), (VALUES ('event', 0), ('control', 30)) u(kind, sh)""", "funding")
def _(t: Tables):
    return windows_of(t).drop("funding_sign", "funding_size_decile", "coverage_group")


@query("F13_bracket_returns", "SELECT market, settlement_time, bracket, round(event_return, 6) AS event_return, round(baseline_return, 6) AS baseline_return, event_bars, baseline_bars FROM brk", "brk")
def _(t: Tables):
    return brackets_of(t).drop("funding_sign", "funding_size_decile", "coverage_group", "cluster_key")


_SPLITS = " UNION ALL ".join(f"SELECT coverage_group, bracket, {c} AS split, cluster_key, event_return, baseline_return FROM brk" for c in ("'all'", "funding_sign", "funding_size_decile"))


@query("A57_bracket_summary", boot_sql(f"({_SPLITS}) z", ["coverage_group", "bracket", "split"], "cluster_key", {"n": "1", "e": "event_return", "b": "baseline_return"}, {"event_mean": "{s}e / {s}n", "baseline_mean": "{s}b / {s}n"}), "brk")
def _(t: Tables):
    splits = F.explode(F.array(F.lit("all"), F.col("funding_sign"), F.col("funding_size_decile")))
    x = brackets_of(t).select("coverage_group", "bracket", "cluster_key", "event_return", "baseline_return", splits.alias("split"))
    return bs.bootstrap_many(x, ["coverage_group", "bracket", "split"], "cluster_key", {"n": F.lit(1), "e": F.col("event_return"), "b": F.col("baseline_return")}, {"event_mean": lambda s: s["e"] / s["n"], "baseline_mean": lambda s: s["b"] / s["n"]})


@query("A65_bracket_coverage", "SELECT market, coverage_group, bracket, count(DISTINCT settlement_time) AS settlements, min(settlement_time) AS first_settlement, max(settlement_time) AS last_settlement FROM brk GROUP BY 1, 2, 3", "brk")
def _(t: Tables):
    return brackets_of(t).groupBy("market", "coverage_group", "bracket").agg(F.countDistinct("settlement_time").alias("settlements"), F.min("settlement_time").alias("first_settlement"), F.max("settlement_time").alias("last_settlement"))


@query("X2_named_statistics", ci_names(boot_sql("brk", ["market"], "cluster_key", {"num": "event_bars", "den": "baseline_bars"}, {"point": "{s}num / nullif({s}den, 0)"})), "brk")
def _(t: Tables):
    return bs.bootstrap_ci(brackets_of(t), ["market"], "cluster_key", {"num": F.col("event_bars"), "den": F.col("baseline_bars")}, "ratio")


@query("X3_source_registry", "SELECT 'bars' AS source, market, '1h' AS interval, count(*) AS bars FROM candles_1h GROUP BY 2 UNION ALL SELECT 'bars', market, '1d', count(*) FROM candles_1d GROUP BY 2 UNION ALL SELECT 'prints', market, '1h', count(DISTINCT date_trunc('hour', time_exchange)) FROM trades GROUP BY 2", "candles_1h candles_1d trades")
def _(t: Tables):
    known = CandleSources()
    known.add("bars", lambda interval: {"1h": t.candles_1h, "1d": t.candles_1d}[interval].select("market", "time_open"), "1h", "1d")
    known.add("prints", lambda _: t.trades.groupBy("market", F.date_trunc("hour", "time_exchange").alias("time_open")).agg(F.avg("price").alias("close")).select("market", "time_open"), "1h")
    every = reduce(DataFrame.unionByName, [known.candles(s, i) for s, intervals in known.offers().items() for i in intervals])
    return every.groupBy("source", "market", "interval").agg(F.count(F.lit(1)).alias("bars"))


# --- census products --------------------------------------------------------------
def snapshots(t: Tables):
    return t.trades.groupBy("market").agg(F.sum("base_amount").alias("open_interest_base"), F.max_by("price", F.struct("time_exchange", "seq")).alias("oracle_price_usd"), F.sum(F.col("price") * F.col("base_amount")).alias("day_ntl_vlm_usd"))


add_view("cap", "SELECT f.market, f.a AS mean_apr, s.oi * s.px AS oi_usd, s.v AS vlm, f.a * s.oi * s.px AS x_oi, f.a * s.v AS x_vlm FROM (SELECT market, avg(funding_rate) * 8760 AS a FROM funding GROUP BY 1) f LEFT JOIN (SELECT market, sum(base_amount) AS oi, arg_max(price, (time_exchange, seq)) AS px, sum(price * base_amount) AS v FROM trades GROUP BY 1) s USING (market)", "funding trades")


@query("A43_capacity_map", "SELECT market, round(mean_apr, 6) AS mean_apr, round(oi_usd, 4) AS oi_usd, round(x_oi, 4) AS apr_x_oi, round(x_vlm, 4) AS apr_x_volume, row_number() OVER (ORDER BY x_vlm DESC NULLS LAST) AS rank FROM cap", "cap")
def _(t: Tables):
    from pyspark.sql import Window

    c = st.market_stats(t.funding).select("market", "mean_apr").join(snapshots(t), "market", "left")
    oi, v = F.col("open_interest_base") * F.col("oracle_price_usd"), F.col("day_ntl_vlm_usd")
    r = F.row_number().over(Window.orderBy((F.col("mean_apr") * v).desc_nulls_last()))  # one row per market
    return c.select("market", "mean_apr", F.round(oi, 4).alias("oi_usd"), F.round(F.col("mean_apr") * oi, 4).alias("apr_x_oi"), F.round(F.col("mean_apr") * v, 4).alias("apr_x_volume"), r.alias("rank"))


@query("A44_frozen_universe", "SELECT 'xyz:' || market AS market, coalesce(vlm > 800000, false) AS passes_liquidity_floor, round(mean_apr, 6) AS mean_apr FROM cap WHERE market <> 'error'", "cap")
def _(t: Tables):
    name = F.when(F.col("market") == "error", F.col("market")).otherwise(F.concat(F.lit("xyz:"), F.col("market")))
    c = st.market_stats(t.funding).select("market", "mean_apr").join(snapshots(t), "market", "left").withColumn("market", name)
    return c.filter(F.col("market").contains(":")).select("market", F.coalesce(F.col("day_ntl_vlm_usd") > 800000, F.lit(False)).alias("passes_liquidity_floor"), "mean_apr")


# --- scalars ----------------------------------------------------------------------
@query("F3_markout_arithmetic", """SELECT market, fill_time, side, round(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (filling_print_price - fill_price) / fill_price * 10000, 6) AS gross_bps, round(CASE WHEN side = 'buy' THEN 1 ELSE -1 END * 0.0036::DOUBLE * (600 / 3600.0::DOUBLE) * 10000, 6) AS funding_bps FROM fills""", "fills")
def _(t: Tables):
    s = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return fills_of(t).select("market", "fill_time", "side", fl.gross_bps(s, F.col("filling_print_price"), F.col("fill_price")).alias("gross_bps"), fl.funding_bps(s, F.lit(0.0036), 600).alias("funding_bps"))


@query("F6_apr_buckets", f"SELECT market, {_BUCKET.format(r='funding_rate')} AS bucket, count(*) AS n FROM funding GROUP BY 1, 2", "funding")
def _(t: Tables):
    return t.funding.groupBy("market", funding_bucket("funding_rate").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("F6_apr_states", f"SELECT {_STATE} AS state, count(*) AS n FROM (SELECT funding_rate * 8760 AS a FROM funding UNION ALL SELECT NULL FROM funding) GROUP BY 1", "funding")
def _(t: Tables):
    a = t.funding.select(cn.apr("funding_rate").alias("a"))
    return a.unionByName(t.funding.select(F.lit(None).cast("double").alias("a"))).groupBy(cn.funding_state(F.col("a")).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query("F10_log_returns", "SELECT market, time_open, round(ln(close / open), 6) AS log_return FROM candles_1d", "candles_1d")
def _(t: Tables):
    return t.candles_1d.select("market", "time_open", F.ln(F.col("close") / F.col("open")).alias("log_return"))


@query("F14_time_floors", "SELECT event_id, date_trunc('minute', ts) AS m, date_trunc('hour', ts) AS h, time_bucket(INTERVAL '6 hours', ts) AS b, date_trunc('hour', ts) + INTERVAL 1 HOUR AS settlement FROM events")
def _(t: Tables):
    return t.events.select("event_id", floor_to("ts", 60).alias("m"), floor_to("ts", 3600).alias("h"), floor_to("ts", 21600).alias("b"), (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).alias("settlement"))


@query("F15_cluster_key", "SELECT event_id, event_type || '|' || strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%dT%H:%M:%S') AS cluster_key FROM events")
def _(t: Tables):
    return t.events.select("event_id", cluster_key("event_type", "ts").alias("cluster_key"))


@query("F16_date_parts", "SELECT event_id, hour(ts)::BIGINT AS hour, minute(ts)::BIGINT AS minute, isodow(ts)::BIGINT AS weekday, strftime(ts, '%Y-%m') AS month, date_diff('day', TIMESTAMP '2023-12-25', ts) AS days FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.hour("ts").alias("hour"), F.minute("ts").alias("minute"), (F.weekday("ts") + 1).alias("weekday"), F.date_format("ts", "yyyy-MM").alias("month"), F.datediff("ts", F.lit("2023-12-25").cast("date")).alias("days"))


@query("F17_epochs", "SELECT event_id, epoch_us(ts) // 1000 AS ms, epoch_us(ts) // 1000000 AS s, make_timestamp(epoch_us(ts) // 1000 * 1000) AS back FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.unix_millis("ts").alias("ms"), F.unix_seconds("ts").alias("s"), F.timestamp_millis(F.unix_millis("ts")).alias("back"))


@query("F18_string_functions", """SELECT o_orderkey, strptime(substr(strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), 1, 16), '%Y-%m-%dT%H:%M') AS minute, split_part(o_orderpriority, '-', 2) AS tail, o_orderpriority LIKE '%URG%' AS has_urg, regexp_extract(o_orderpriority, '^(\\d+)', 1) AS digit, starts_with(o_orderpriority, '1') AS first, upper(o_orderstatus) AS up FROM orders""")
def _(t: Tables):
    p = F.col("o_orderpriority")
    return t.raw("orders").select("o_orderkey", F.to_timestamp(F.substring(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), 1, 16), "yyyy-MM-dd'T'HH:mm").alias("minute"), F.split(p, "-", 2)[1].alias("tail"),
                                  p.contains("URG").alias("has_urg"), F.regexp_extract(p, r"^(\d+)", 1).alias("digit"), p.startswith("1").alias("first"), F.upper("o_orderstatus").alias("up"))


@query("F19_strict_recode", "SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'partial' END AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    m = F.create_map(*[F.lit(x) for kv in {"F": "filled", "O": "open", "P": "partial"}.items() for x in kv])
    s = F.coalesce(m[F.col("o_orderstatus")], F.raise_error(F.concat(F.lit("unmapped value "), F.col("o_orderstatus"))))
    return t.raw("orders").groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("F20_list_functions", "SELECT event_id, array_to_string(list_sort(list_distinct(wallets || ['0', '7'])), ',') AS united, wallets[-1] AS last, len(wallets) AS n, array_to_string(coalesce(CASE WHEN direction = 'BUY' THEN wallets END, []), ',') AS filled FROM shocks", "shocks")
def _(t: Tables):
    w = F.col("wallets")
    return t.shocks.select("event_id", F.array_sort(F.array_union(w, F.array(F.lit("0"), F.lit("7")))).alias("united"), F.element_at(w, -1).alias("last"), F.size(w).alias("n"),
                           F.coalesce(F.when(F.col("direction") == "BUY", w), F.array().cast("array<string>")).alias("filled"))


@query("F21_horizontal_extremes", "SELECT market, time_open, round(least(open, close, low), 6) AS lo, round(greatest(open, close, high), 6) AS hi FROM candles_1h", "candles_1h")
def _(t: Tables):
    return t.candles_1h.select("market", "time_open", F.least("open", "close", "low").alias("lo"), F.greatest("open", "close", "high").alias("hi"))


@query("F22_between_and_fill", "SELECT l_returnflag, count(*) FILTER (l_discount BETWEEN 0.03 AND 0.06) AS mid, round(sum(coalesce(CASE WHEN l_tax > 0 THEN l_tax END, 0.01)), 6) AS tax FROM lineitem GROUP BY 1")
def _(t: Tables):
    return t.raw("lineitem").groupBy("l_returnflag").agg(F.count_if(F.col("l_discount").between(0.03, 0.06)).alias("mid"), F.sum(F.coalesce(F.when(F.col("l_tax") > 0, F.col("l_tax")), F.lit(0.01))).alias("tax"))


@query("F23_horizon_labels", "SELECT l, regexp_extract(l, '^(\\d+)', 1)::BIGINT * CASE right(l, 1) WHEN 's' THEN 1 WHEN 'm' THEN 60 ELSE 3600 END AS seconds, count(*) AS n FROM (SELECT (event_id % 90 + 1) || CASE event_id % 3 WHEN 0 THEN 's' WHEN 1 THEN 'm' ELSE 'h' END AS l FROM events) GROUP BY 1, 2")
def _(t: Tables):
    i = F.col("event_id")
    l = F.concat((i % 90 + 1).cast("string"), F.when(i % 3 == 0, "s").when(i % 3 == 1, "m").otherwise("h"))
    return t.events.select(l.alias("l")).groupBy("l", horizon_seconds("l").alias("seconds")).agg(F.count(F.lit(1)).alias("n"))


@query("F26_naive_utc", "SELECT event_id, ((ts AT TIME ZONE 'Asia/Seoul') AT TIME ZONE 'UTC') AS utc FROM events")
def _(t: Tables):
    return t.events.select("event_id", F.to_utc_timestamp("ts", "Asia/Seoul").alias("utc"))


@query("K3_worst_row", "SELECT l_suppkey, min((l_extendedprice, l_orderkey, l_linenumber))[2] AS l_orderkey, round(min(l_extendedprice), 6) AS price FROM lineitem GROUP BY 1")
def _(t: Tables):
    k = F.struct("l_extendedprice", "l_orderkey", "l_linenumber")
    return t.raw("lineitem").groupBy("l_suppkey").agg(F.min(k).alias("m")).select("l_suppkey", F.col("m.l_orderkey").alias("l_orderkey"), F.col("m.l_extendedprice").alias("price"))


@query("K5_top_by_volume", "SELECT l_partkey, round(v, 4) AS volume FROM (SELECT l_partkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ORDER BY v DESC, l_partkey LIMIT 25")
def _(t: Tables):
    g = t.raw("lineitem").groupBy("l_partkey").agg(F.sum("l_extendedprice").alias("v"))
    return g.orderBy(F.desc("v"), "l_partkey").limit(25).select("l_partkey", F.round("v", 4).alias("volume"))


# --- live-book payloads and ledger report ---------------------------------------
PAYLOAD = "time bigint, levels array<array<struct<px:string, sz:string>>>"


@query("T29_book_summary", """SELECT seq, best_bid_px AS bid_px, best_bid_sx AS bid_sz, best_ask_px AS ask_px, best_ask_sx AS ask_sz, CASE WHEN best_ask_px IS NULL THEN 1::BIGINT ELSE 2::BIGINT END AS sides, round((best_bid_px + best_ask_px) / 2, 6) AS mid_px, round((best_ask_px - best_bid_px) / ((best_bid_px + best_ask_px) / 2) * 10000, 6) AS spread_bp FROM quotes""", "quotes")
def _(t: Tables):
    s = lambda c: F.col(c).cast("string")
    level = lambda p, q: F.struct(s(p).alias("px"), s(q).alias("sz"))
    none = F.array().cast("array<struct<px:string,sz:string>>")
    lv = F.array(F.array(level("best_bid_px", "best_bid_sx")), F.when(F.col("best_ask_px").isNotNull(), F.array(level("best_ask_px", "best_ask_sx"))).otherwise(none))
    raw = t.quotes.select("seq", F.to_json(F.struct(F.unix_millis("time_exchange").alias("time"), lv.alias("levels"))).alias("payload"))
    return book_summary(raw).select("seq", "bid_px", "bid_sz", "ask_px", "ask_sz", ((F.size("bid_levels") > 0).cast("long") + (F.size("ask_levels") > 0).cast("long")).alias("sides"), "mid_px", "spread_bp")


def book_summary(raw, depth: int = 5):
    """Top, mid, spread and the first levels of a nested book payload."""
    p = raw.select("*", F.from_json("payload", PAYLOAD).alias("p"))
    side = lambda i: F.transform(F.slice(F.get(F.col("p.levels"), i), 1, depth), lambda l: F.struct(l["px"].cast("double").alias("px"), l["sz"].cast("double").alias("sz")))
    x = p.select(*[c for c in raw.columns if c != "payload"], F.col("p.time").alias("book_time_ms"), side(0).alias("bid_levels"), side(1).alias("ask_levels"))
    top = lambda c, f: F.get(F.col(c), 0)[f]
    x = x.select("*", top("bid_levels", "px").alias("bid_px"), top("bid_levels", "sz").alias("bid_sz"), top("ask_levels", "px").alias("ask_px"), top("ask_levels", "sz").alias("ask_sz"))
    mid = (F.col("bid_px") + F.col("ask_px")) / 2
    return x.select("*", mid.alias("mid_px"), ((F.col("ask_px") - F.col("bid_px")) / mid * 1e4).alias("spread_bp"))


@query("T30_ledger_report", """WITH s AS (SELECT s.*, q.best_bid_px AS b, q.best_bid_sx AS bs, q.best_ask_px AS a FROM shocks s ASOF LEFT JOIN l1 q ON s.market = q.market AND s.start_time >= q.time_exchange), m AS (SELECT s.event_id, h.v AS hh, f.time_exchange, f.funding_rate, abs(epoch_us(f.time_exchange) - epoch_us(s.start_time + to_hours(h.v))) / 3.6e9 AS gap,
      row_number() OVER (PARTITION BY s.event_id, h.v ORDER BY abs(epoch_us(f.time_exchange) - epoch_us(s.start_time + to_hours(h.v))), f.time_exchange) AS rn FROM shocks s, (VALUES (1), (6), (24)) h(v), funding f WHERE f.market = s.market)
    SELECT s.market, direction, count(*) AS signals, round(quantile_cont((a - b) / ((a + b) / 2) * 10000, 0.5), 6) AS med_spread_bp, round(quantile_cont(bs * b, 0.5), 6) AS med_bid_depth_usd, (SELECT count(*) FROM m JOIN shocks z USING (event_id) WHERE z.market = s.market AND z.direction = s.direction AND rn = 1 AND gap <= 0.75) AS marks FROM s GROUP BY 1, 2""", "shocks l1 funding")
def _(t: Tables):
    from tickloom.operators.asof import asof_join

    cols = ["best_bid_px", "best_bid_sx", "best_ask_px"]
    s = asof_join(t.shocks.select("event_id", "market", "start_time", "direction"), l1_of(t), ["market"], "start_time", "time_exchange", cols)
    b_, a_ = F.col("best_bid_px"), F.col("best_ask_px")
    r = s.groupBy("market", "direction").agg(F.count(F.lit(1)).alias("signals"), F.percentile((a_ - b_) / ((a_ + b_) / 2) * 1e4, 0.5).alias("med_spread_bp"), F.percentile(F.col("best_bid_sx") * b_, 0.5).alias("med_bid_depth_usd"))
    from tickloom.functions.timecols import plus_seconds

    probes = t.shocks.select("event_id", "market", "direction", "start_time", F.explode(F.array(F.lit(1), F.lit(6), F.lit(24))).alias("h")).select("*", plus_seconds("start_time", F.col("h") * 3600).alias("at"))
    m = lk.nearest_join(probes, t.funding, ["market"], "at", "time_exchange", ["funding_rate"], 0.75 * 3600).groupBy("market", "direction").agg(F.count("obs_time").alias("marks"))
    return r.join(m, ["market", "direction"])
