"""Panel statistics, bootstrap intervals, reconciliation and ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timecols import cluster_key, micros
from tickloom.operators import bars as b, bootstrap as bs, conditioning as cn, ranking as rk, stats as st
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.q_bars import wallet_trades
from tickloom.plans.q_fills import STUDY_HORIZONS, markouts_of
from tickloom.plans.q_joins import exposure_of
from tickloom.plans.registry import query

_CKT = "market || '|' || strftime(time_bucket(INTERVAL '6 hours', time_exchange), '%Y-%m-%dT%H:%M:%S')"
APR = "funding_rate * 24 * 365"


# --- SQL template for the bootstrap ----------------------------------------------
def boot_sql(src: str, group: list[str], cluster: str, sums: dict[str, str], stats: dict[str, str], seed: str = "0", n: str = "count(*)") -> str:
    """``stats`` are SQL templates over {s}NAME; rows come from the view ``src``."""
    g = ", ".join(group) or "1 AS one"
    gk = group or ["one"]
    gc = ", ".join(gk)
    fill = lambda t, pre: t.replace("{s}", pre)
    agg = ", ".join(f"sum({e})::DOUBLE AS s_{k}" for k, e in sums.items())
    tot = ", ".join(f"sum(s_{k}) AS s_{k}" for k in sums)
    cols = ", ".join(
        f"round(t.{m}, 6) AS {m}, round(q.{m}_l, 6) AS {m}_ci_low, round(q.{m}_h, 6) AS {m}_ci_high" for m in stats
    )
    tg = "".join(f"t.{c}, " for c in group)
    on = " AND ".join(f"t.{c} IS NOT DISTINCT FROM q.{c}" for c in gk)
    return f"""WITH c0 AS (SELECT {g}, {cluster} AS ck, {agg}, ({n})::BIGINT AS n FROM {src} WHERE {cluster} IS NOT NULL GROUP BY ALL),
    ci AS (SELECT *, row_number() OVER (PARTITION BY {gc} ORDER BY ck) - 1 AS idx FROM c0),
    tt AS (SELECT {gc}, {tot}, sum(n)::BIGINT AS n, count(*) AS G FROM c0 GROUP BY {gc}),
    t AS (SELECT {gc}, n, G, {', '.join(f'{fill(e, "s_")} AS {m}' for m, e in stats.items())} FROM tt),
    d AS (SELECT {gc}, G, d.draw, s.slot FROM t, range(2000) d(draw), range(100000) s(slot) WHERE G >= 5 AND s.slot < G),
    p AS (SELECT {gc}, draw, ('0x' || substr(md5(concat_ws('|', {seed}, draw, slot)), 1, 8))::BIGINT % G AS idx FROM d),
    w AS (SELECT {gc}, draw, {tot} FROM p JOIN ci USING ({gc}, idx) GROUP BY {gc}, draw),
    v AS (SELECT {gc}, {', '.join(f'{fill(e, "s_")} AS {m}' for m, e in stats.items())} FROM w),
    q AS (SELECT {gc}, {', '.join(f'quantile_cont({m}, 0.025) AS {m}_l, quantile_cont({m}, 0.975) AS {m}_h' for m in stats)} FROM v GROUP BY {gc})
    SELECT {tg}{cols}, t.n, t.G, t.G < 5 AS low_cluster FROM t LEFT JOIN q ON {on}"""


def ci_names(sql: str) -> str:
    return sql.replace("AS point_ci_low", "AS ci_low").replace("AS point_ci_high", "AS ci_high")


_MEAN = {"point": "{s}x / {s}n"}
_NET = "net_markout_30m_bps"
add_view("net30", f"SELECT market, segment, side, hour_of_day, size_bucket, cluster_key, {_NET} AS v, stale_30m FROM markouts", "markouts")


@query("B1_cluster_bootstrap_ci", ci_names(boot_sql("(SELECT * FROM net30 WHERE v IS NOT NULL) x", ["market"], "cluster_key", {"x": "v", "n": "1"}, _MEAN)), "net30")
def _(t: Tables):
    return bs.mean_ci(markouts_of(t), ["market"], "cluster_key", _NET)


_SLOPE = "({s}n * {s}xy - {s}x * {s}y) / nullif({s}n * {s}xx - {s}x * {s}x, 0)"
_STD = "CASE WHEN {s}n > 1 THEN sqrt(greatest(0, ({s}xx - {s}x * {s}x / {s}n) / ({s}n - 1))) END"
add_view("fclust", f"SELECT *, {_CKT} AS cluster_key, {APR} AS apr, extract(epoch FROM time_exchange)::DOUBLE / 86400 - 19723 AS day FROM funding", "funding")


def fclust(t: Tables):
    return t.funding.select("*", cluster_key("market", "time_exchange").alias("cluster_key"), cn.apr("funding_rate").alias("apr"),
                            (micros("time_exchange") / F.lit(86_400_000_000.0) - 19723).alias("day"))


@query("B2_cluster_bootstrap_statistic", boot_sql("fclust", ["market"], "cluster_key",
       {"n": "1", "x": "day", "y": "apr", "xx": "day * day", "xy": "day * apr"}, {"slope": _SLOPE, "spread": _STD}), "fclust")
def _(t: Tables):
    d, a = F.col("day"), F.col("apr")
    return bs.bootstrap_many(fclust(t), ["market"], "cluster_key", {"n": F.lit(1), "x": d, "y": a, "xx": d * d, "xy": d * a}, {"slope": bs.slope_stat, "spread": bs.std_stat})


@query("B2_quantile_bootstrap", """WITH k AS (SELECT DISTINCT market, cluster_key FROM fclust), i AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY cluster_key) - 1 AS idx, count(*) OVER (PARTITION BY market) AS G FROM k),
    g AS (SELECT DISTINCT market, G FROM i), p AS (SELECT market, draw, ('0x' || substr(md5(concat_ws('|', 0, draw, slot)), 1, 8))::BIGINT % G AS idx FROM g, range(2000) d(draw), range(1000) s(slot) WHERE slot < G),
    v AS (SELECT p.market, draw, quantile_cont(f.apr, 0.95) AS v FROM p JOIN i ON p.market = i.market AND p.idx = i.idx JOIN fclust f ON f.market = i.market AND f.cluster_key = i.cluster_key GROUP BY 1, 2),
    q AS (SELECT market, quantile_cont(v, 0.025) AS l, quantile_cont(v, 0.975) AS h FROM v GROUP BY 1)
    SELECT f.market, round(quantile_cont(apr, 0.95), 6) AS point, round(any_value(l), 6) AS ci_low, round(any_value(h), 6) AS ci_high, count(*) AS n, any_value(g.G) AS G, false AS low_cluster
    FROM fclust f JOIN q USING (market) JOIN g USING (market) GROUP BY 1""", "fclust")
def _(t: Tables):
    return bs.quantile_ci(fclust(t), ["market"], "cluster_key", "apr", 0.95)


add_view("panel", "SELECT market AS strategy, strftime(time_open, '%Y') AS stratum, date_trunc('month', time_open) AS slot, date_trunc('month', time_open) AS period, sum(close - open) AS net FROM candles_1d GROUP BY ALL", "candles_1d")


@query("B3_panel_bootstrap", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY strategy, stratum ORDER BY slot) - 1 AS i, count(*) OVER (PARTITION BY strategy, stratum) AS m, count(*) OVER (PARTITION BY strategy) AS G FROM panel),
    p AS (SELECT strategy, stratum, period, draw, ('0x' || substr(md5(concat_ws('|', 0, draw, strftime(slot, '%Y-%m-%d %H:%M:%S'))), 1, 8))::BIGINT % m AS i FROM r, range(2000) d(draw)),
    v AS (SELECT p.strategy, draw, avg(r.net) AS v FROM p JOIN r ON r.strategy = p.strategy AND r.stratum = p.stratum AND r.i = p.i GROUP BY 1, 2)
    SELECT a.strategy, round(a.point, 6) AS point, round(q.l, 6) AS ci_low, round(q.h, 6) AS ci_high, a.G, a.G < 5 AS low_cluster FROM (SELECT strategy, avg(net) AS point, count(*) AS G FROM panel GROUP BY 1) a
    JOIN (SELECT strategy, quantile_cont(v, 0.025) AS l, quantile_cont(v, 0.975) AS h FROM v GROUP BY 1) q USING (strategy)""", "panel")
def _(t: Tables):
    month = F.date_trunc("month", "time_open")
    p = t.candles_1d.groupBy(F.col("market").alias("strategy"), F.date_format("time_open", "yyyy").alias("stratum"), month.alias("slot")).agg(
        F.sum(F.col("close") - F.col("open")).alias("net")).withColumn("period", F.col("slot"))
    return bs.panel_ci(p, ["strategy"], ["stratum"], "slot", "net", "period", F.avg)


add_view("wallet_events2", "SELECT market, market || '|' || strftime(time_bucket(INTERVAL '6 hours', settlement_time), '%Y-%m-%dT%H:%M:%S') AS cluster_key, trade_count_pre AS pre, trade_count_post AS post FROM wallet_windows", "wallet_windows")


@query("B4_ratio_ci", ci_names(boot_sql("wallet_events2", ["market"], "cluster_key", {"num": "post", "den": "pre"}, {"point": "{s}num / nullif({s}den, 0)"}, n="sum(pre)")), "wallet_events2")
def _(t: Tables):
    w = b.wallet_windows(wallet_trades(t)).select("market", cluster_key("market", "settlement_time").alias("cluster_key"), "trade_count_pre", "trade_count_post")
    return bs.bootstrap_ci(w, ["market"], "cluster_key", {"num": F.col("trade_count_post"), "den": F.col("trade_count_pre")}, bs.ratio_stat, n=F.col("trade_count_pre"))


@query("B5_linear_percentile", "SELECT market, round(quantile_cont(price, 0.025), 6) AS p025, round(quantile_cont(price, 0.5), 6) AS p500, round(quantile_cont(price, 0.975), 6) AS p975 FROM trades GROUP BY market", "trades")
def _(t: Tables):
    return st_quantiles(t)


def st_quantiles(t: Tables):
    from tickloom.functions.quantiles import exact_quantiles

    return exact_quantiles(t.trades, ["market"], "price", {"p025": 0.025, "p500": 0.5, "p975": 0.975})


@query("B6_mean_apr_ci", ci_names(boot_sql("fclust", ["market"], "cluster_key", {"x": "apr", "n": "1"}, _MEAN)), "fclust")
def _(t: Tables):
    return bs.mean_ci(fclust(t), ["market"], "cluster_key", "apr")


add_view("lagp", "SELECT * FROM (SELECT *, lag(time_exchange) OVER w AS lt, lag(abs(apr)) OVER w AS x, abs(apr) AS y FROM fclust WINDOW w AS (PARTITION BY market ORDER BY time_exchange)) WHERE time_exchange - lt = INTERVAL 1 HOUR", "fclust")


@query("B7_lag_pair_bootstrap", boot_sql("lagp", ["market"], "cluster_key", {"n": "1", "x": "x", "y": "y", "xx": "x * x", "xy": "x * y"}, {"phi": _SLOPE}), "lagp")
def _(t: Tables):
    p = st.lag_pairs(fclust(t).withColumn("v", F.abs("apr")), "v", 1, max_step_s=3600)
    x, y = F.col("lag_value"), F.col("v")
    return bs.bootstrap_many(p, ["market"], "cluster_key", {"n": F.lit(1), "x": x, "y": y, "xx": x * x, "xy": x * y}, {"phi": bs.slope_stat})


@query("W15_adjacent_lag_pairs", "SELECT market, time_exchange, round(x, 6) AS lag_value, round(y, 6) AS value FROM lagp", "lagp")
def _(t: Tables):
    p = st.lag_pairs(fclust(t).withColumn("value", F.abs("apr")), "value", 1, max_step_s=3600)
    return p.select("market", "time_exchange", "lag_value", "value")


# --- markout summaries ---------------------------------------------------------
def _melt(horizons: dict[str, int]) -> str:
    return " UNION ALL ".join(f"SELECT market, segment, '{h}' AS horizon, net_markout_{h}_bps AS v, stale_{h} AS stale FROM markouts" for h in horizons)


@query("A18_markout_by_segment", f"""SELECT market, segment, horizon, round(avg(v) FILTER (NOT stale), 6) AS mean_bps, count(v) FILTER (NOT stale) AS n FROM ({_melt(STUDY_HORIZONS)}) GROUP BY 1, 2, 3""", "markouts")
def _(t: Tables):
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.when(~F.col(f"stale_{h}"), F.col(f"net_markout_{h}_bps")).alias("v")) for h in STUDY_HORIZONS])
    m = markouts_of(t).select("market", "segment", F.explode(cells).alias("c"))
    return m.groupBy("market", "segment", "c.horizon").agg(F.avg("c.v").alias("mean_bps"), F.count("c.v").alias("n"))


A19_SETS = [["market", "segment"], ["side"], ["size_bucket"], ["hour_of_day"]]


@query("A19_markout_summaries", ci_names(boot_sql("""(SELECT u.scope, CASE u.scope WHEN 'market,segment' THEN market || '/' || segment WHEN 'side' THEN side WHEN 'size_bucket' THEN size_bucket ELSE hour_of_day::VARCHAR END AS cell, cluster_key, v
     FROM net30, (VALUES ('market,segment'), ('side'), ('size_bucket'), ('hour_of_day')) u(scope) WHERE v IS NOT NULL) z""", ["scope", "cell"], "cluster_key", {"x": "v", "n": "1"}, _MEAN)), "net30")
def _(t: Tables):
    cell = lambda s, c: F.struct(F.lit(s).alias("scope"), c.cast("string").alias("cell"))
    m = markouts_of(t).filter(F.col(_NET).isNotNull()).select("cluster_key", _NET, F.explode(F.array(
        cell("market,segment", F.concat_ws("/", "market", "segment")), cell("side", F.col("side")), cell("size_bucket", F.col("size_bucket")), cell("hour_of_day", F.col("hour_of_day")))).alias("s"))
    return bs.mean_ci(m.select("cluster_key", _NET, "s.*"), ["scope", "cell"], "cluster_key", _NET)


@query("A19_staleness_rates", """SELECT market, segment, side, count(*) AS n, round(avg(stale_30m::INT::DOUBLE), 6) AS staleness_rate FROM net30 GROUP BY GROUPING SETS ((market, segment), (side), ())""", "net30")
def _(t: Tables):
    m = markouts_of(t).select("market", "segment", "side", F.col("stale_30m").cast("double").alias("s"))
    c = [F.col(x) for x in ("market", "segment", "side")]
    return m.groupingSets([[c[0], c[1]], [c[2]], []], *c).agg(F.count(F.lit(1)).alias("n"), F.avg("s").alias("staleness_rate"))


# --- exposure rates ------------------------------------------------------------
_RATIO = "({s}he / nullif({s}hh, 0)) / nullif({s}le / nullif({s}lh, 0), 0)"
_RS = {"he": "CASE WHEN funding_bucket = 'ge_100pct' THEN event_count ELSE 0 END", "hh": "CASE WHEN funding_bucket = 'ge_100pct' THEN exposure_hours ELSE 0 END",
       "le": "CASE WHEN funding_bucket = 'negative' THEN event_count ELSE 0 END", "lh": "CASE WHEN funding_bucket = 'negative' THEN exposure_hours ELSE 0 END"}


def rate_ratio(s):
    high = F.when(s["hh"] > 0, s["he"] / s["hh"])
    low = F.when(s["lh"] > 0, s["le"] / s["lh"])
    return F.when(low != 0, high / low)


def _rate_sums():
    at = lambda k, c: F.when(F.col("funding_bucket") == k, F.col(c)).otherwise(0)
    return {"he": at(cn.HIGH_BUCKET, "event_count"), "hh": at(cn.HIGH_BUCKET, "exposure_hours"), "le": at(cn.LOW_BUCKET, "event_count"), "lh": at(cn.LOW_BUCKET, "exposure_hours")}


@query("A38_bucket_event_rates", boot_sql("exposure", ["funding_bucket"], "cluster_key", {"e": "event_count", "h": "exposure_hours"}, {"rate": "{s}e / nullif({s}h, 0)"}), "exposure")
def _(t: Tables):
    return bs.bootstrap_many(exposure_of(t), ["funding_bucket"], "cluster_key", {"e": F.col("event_count"), "h": F.col("exposure_hours")}, {"rate": lambda s: F.when(s["h"] > 0, s["e"] / s["h"])})


@query("A38_rate_ratio_by_scope", boot_sql("(SELECT 'ALL' AS scope, * FROM exposure UNION ALL SELECT market, * FROM exposure) z", ["scope"], "cluster_key", _RS, {"rate_ratio": _RATIO}), "exposure")
def _(t: Tables):
    e = exposure_of(t)
    e = e.select("*", F.explode(F.array(F.lit("ALL"), F.col("market"))).alias("scope"))
    return bs.bootstrap_many(e, ["scope"], "cluster_key", _rate_sums(), {"rate_ratio": rate_ratio})


@query("A39_market_clustered_ratio", boot_sql("exposure", [], "market", _RS, {"rate_ratio": _RATIO}), "exposure")
def _(t: Tables):
    return bs.bootstrap_many(exposure_of(t), [], "market", _rate_sums(), {"rate_ratio": rate_ratio})


@query("A56_ci_separation", f"""WITH r AS ({boot_sql('fclust', ['market'], 'cluster_key', {'x': 'apr', 'n': '1'}, _MEAN)})
    SELECT a.market AS left_market, b.market AS right_market, CASE WHEN a.point_ci_low IS NULL OR b.point_ci_low IS NULL THEN 'INSUFFICIENT CLUSTERS' WHEN a.point_ci_high < b.point_ci_low OR b.point_ci_high < a.point_ci_low THEN 'SEPARATES' ELSE 'DOES NOT SEPARATE' END AS status
    FROM r a JOIN r b ON a.market < b.market""", "fclust")
def _(t: Tables):
    r = bs.mean_ci(fclust(t), ["market"], "cluster_key", "apr")
    a = r.select(F.col("market").alias("left_market"), F.col("ci_low").alias("al"), F.col("ci_high").alias("ah"))
    c = r.select(F.col("market").alias("right_market"), F.col("ci_low").alias("bl"), F.col("ci_high").alias("bh"))
    j = a.join(c, F.col("left_market") < F.col("right_market"))  # one interval per market
    return j.select("left_market", "right_market", bs.separation(F.col("al"), F.col("ah"), F.col("bl"), F.col("bh")).alias("status"))


# --- funding panel -------------------------------------------------------------
@query("A20_market_funding_stats", f"""SELECT market, count(*) AS n_funding_hours, min(time_exchange) AS first_funding_time, max(time_exchange) AS last_funding_time, round(avg({APR}), 6) AS mean_apr,
    round(quantile_cont({APR}, 0.5), 6) AS median_apr, round(avg((funding_rate > 0)::INT::DOUBLE), 6) AS pct_positive_hours FROM funding GROUP BY 1""", "funding")
def _(t: Tables):
    return st.market_stats(t.funding)


add_view("seg", "SELECT *, sum(brk) OVER (PARTITION BY market ORDER BY time_exchange) AS s FROM (SELECT *, CASE WHEN epoch(time_exchange) - epoch(lag(time_exchange) OVER (PARTITION BY market ORDER BY time_exchange)) <= 5400 THEN 0 ELSE 1 END AS brk FROM funding)", "funding")


def _lag_sql(k: int) -> str:
    return f"SELECT * FROM (SELECT market, funding_rate AS y, lag(funding_rate, {k}) OVER w AS x, s, lag(s, {k}) OVER w AS ps FROM seg WINDOW w AS (PARTITION BY market ORDER BY time_exchange)) WHERE s = ps"


@query("A21_autocorrelation", f"""WITH p1 AS ({_lag_sql(1)}), p3 AS ({_lag_sql(3)}), a AS (SELECT market, corr(x, y) AS ac1, count(*) AS n1, regr_slope(y, x) AS phi FROM p1 GROUP BY 1), c AS (SELECT market, corr(x, y) AS ac3, count(*) AS n3 FROM p3 GROUP BY 1)
    SELECT market, round(ac1, 6) AS ac1, n1 AS ac1_pair_count, round(ac3, 6) AS ac3, n3 AS ac3_pair_count, round(phi, 6) AS ar1_phi, round(CASE WHEN phi > 0 AND phi < 1 THEN ln(0.5) / ln(phi) END, 6) AS shock_half_life_hours FROM a JOIN c USING (market)""", "seg")
def _(t: Tables):
    f = t.funding
    return st.autocorrelation(f, "funding_rate", 1, "ac1").join(st.autocorrelation(f, "funding_rate", 3, "ac3"), "market").join(
        st.ar1(f, "funding_rate").drop("ar1_pair_count"), "market")


@query("A22_spearman", """WITH j AS (SELECT a.market, a.funding_rate AS x, c.close AS y FROM funding a JOIN candles_1h c ON a.market = c.market AND a.time_exchange = c.time_open),
    r AS (SELECT market, rank() OVER (PARTITION BY market ORDER BY x) + (count(*) OVER (PARTITION BY market, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY market ORDER BY y) + (count(*) OVER (PARTITION BY market, y) - 1) / 2.0::DOUBLE AS ry FROM j)
    SELECT market, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r GROUP BY 1""", "funding candles_1h")
def _(t: Tables):
    j = t.funding.join(t.candles_1h.select("market", F.col("time_open").alias("time_exchange"), "close"), ["market", "time_exchange"])
    return st.spearman(j, ["market"], "funding_rate", "close")


_AR = "rank() OVER (PARTITION BY {p} ORDER BY {v}) + (count(*) OVER (PARTITION BY {p}, {v}) - 1) / 2.0::DOUBLE"
add_view("weekly", f"SELECT week, market, m, {_AR.format(p='week', v='m')} AS rk FROM (SELECT date_trunc('week', time_exchange) AS week, market, avg(funding_rate) AS m FROM funding GROUP BY 1, 2)", "funding")


@query("A23_weekly_rank_persistence", f"""WITH l AS (SELECT market, rk, lag(rk) OVER (PARTITION BY market ORDER BY week) AS pv FROM weekly), x AS (SELECT market, {_AR.format(p='market', v='rk')} AS ra, {_AR.format(p='market', v='pv')} AS rb FROM l WHERE pv IS NOT NULL),
    c AS (SELECT market, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM x GROUP BY 1), n AS (SELECT market, count(*) AS k FROM weekly GROUP BY 1)
    SELECT market, k AS weekly_rank_observations, round(CASE WHEN k >= 4 THEN rho END, 6) AS week_over_week_rank_corr FROM n LEFT JOIN c USING (market)""", "weekly")
def _(t: Tables):
    return st.rank_persistence(st.weekly_ranks(t.funding))


@query("A23_adjacent_week_correlation", f"""WITH w AS (SELECT week, lead(week) OVER (ORDER BY week) AS nx FROM (SELECT DISTINCT week FROM weekly)), j AS (SELECT c.week, p.rk AS a, c.rk AS b FROM weekly p JOIN w USING (week) JOIN weekly c ON c.week = w.nx AND c.market = p.market),
    r AS (SELECT week, {_AR.format(p='week', v='a')} AS ra, {_AR.format(p='week', v='b')} AS rb FROM j), c AS (SELECT week, corr(ra, rb) AS rho FROM r GROUP BY 1)
    SELECT round(avg(rho), 6) AS mean_rho, round(quantile_cont(rho, 0.5), 6) AS median_rho, count(rho) AS week_pairs FROM c""", "weekly")
def _(t: Tables):
    return st.adjacent_week_correlation(st.weekly_ranks(t.funding))


@query("A24_regime_runs", f"""WITH x AS (SELECT market, time_exchange, regime, {APR} > thr AS a, lag({APR} > thr) OVER w AS pa, epoch(time_exchange) - epoch(lag(time_exchange) OVER w) AS st FROM funding, (VALUES ('25', 0.25), ('100', 1.0), ('300', 3.0)) r(regime, thr) WINDOW w AS (PARTITION BY market, regime ORDER BY time_exchange)),
    k AS (SELECT *, sum(CASE WHEN a AND NOT (coalesce(pa, false) AND coalesce(st <= 5400, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY market, regime ORDER BY time_exchange) AS run FROM x), l AS (SELECT market, regime, run, count(*) AS h FROM k WHERE a GROUP BY 1, 2, 3)
    SELECT market, regime, count(*) AS runs, round(avg(h), 6) AS mean_hours, round(quantile_cont(h::DOUBLE, 0.5), 6) AS median_hours FROM l GROUP BY 1, 2""", "funding")
def _(t: Tables):
    return st.regime_runs(t.funding, cn.apr("funding_rate"))


@query("A26_coverage_audit", """WITH i AS (SELECT DISTINCT market, time_exchange AS s FROM funding, feed WHERE time_exchange > t0 AND time_exchange <= t1),
    g AS (SELECT market, epoch(lead(s) OVER (PARTITION BY market ORDER BY s)) / 3600 - epoch(s) / 3600 - 1 AS m FROM i), h AS (SELECT market, count(*) AS gaps, max(m)::BIGINT AS largest FROM g WHERE m > 0 GROUP BY 1),
    a AS (SELECT market, count(*) AS k, min(s) AS a, max(s) AS b FROM i GROUP BY 1)
    SELECT market, k AS actual_rows, (epoch(b) - epoch(a))::BIGINT // 3600 + 1 AS expected_rows, (SELECT (epoch(t1) - epoch(t0))::BIGINT // 3600 FROM feed) AS window_rows, (epoch(b) - epoch(a))::BIGINT // 3600 + 1 - k AS missing_rows, coalesce(gaps, 0) AS gaps, coalesce(largest, 0) AS largest_gap, a AS first_time, b AS last_time,
      CASE WHEN epoch(a) - (SELECT epoch(t0) + 3600 FROM feed) >= 3600 THEN 'funding_truncated' ELSE 'complete' END AS status FROM a LEFT JOIN h USING (market)""", "funding feed")
def _(t: Tables):
    hour = F.expr("interval 1 hour")
    return st.coverage_audit(t.funding, t.trades, t.span[0] + hour, t.span[1] + hour)


add_view("patchy", "SELECT * FROM candles_1h WHERE NOT (market = 'error' AND extract(day FROM time_open) > 25) AND NOT (market = 'click' AND extract(hour FROM time_open) = 5) AND market <> 'view'", "candles_1h")


@query("A26_coverage_status", """WITH f AS (SELECT market, time_exchange AS s FROM funding WHERE market <> 'signup'), c AS (SELECT market, time_open AS s FROM patchy),
    fa AS (SELECT market, count(*) AS n, max(s) AS last, count(*) FILTER (m > 0) AS gaps FROM (SELECT *, (epoch(s) - epoch(lag(s) OVER (PARTITION BY market ORDER BY s))) / 3600 - 1 AS m FROM f) GROUP BY 1),
    ca AS (SELECT market, count(*) AS n, max(s) AS last, count(*) FILTER (m > 0) AS gaps FROM (SELECT *, (epoch(s) - epoch(lag(s) OVER (PARTITION BY market ORDER BY s))) / 3600 - 1 AS m FROM c) GROUP BY 1),
    j AS (SELECT u.market, coalesce(fa.n, 0) AS funding_rows, coalesce(ca.n, 0) AS candle_rows, coalesce(fa.gaps, 0) AS funding_gaps, coalesce(ca.gaps, 0) AS candle_gaps, fa.last AS fl, CASE WHEN fa.last IS NOT NULL THEN least(fa.last, t1) END AS target, ca.last AS cl, t1 FROM (SELECT DISTINCT market FROM trades) u LEFT JOIN fa USING (market) LEFT JOIN ca USING (market), feed)
    SELECT market, CASE WHEN funding_rows = 0 AND candle_rows = 0 THEN 'no_data' WHEN fl IS NULL OR epoch(t1) - epoch(fl) > 7200 OR funding_gaps > 0 THEN 'funding_truncated' WHEN target IS NOT NULL AND (cl IS NULL OR epoch(target) - epoch(cl) > 7200) OR candle_gaps > 0 THEN 'candle_truncated' ELSE 'complete' END AS status,
      funding_rows, candle_rows, funding_gaps, candle_gaps, CASE WHEN target IS NOT NULL AND cl IS NOT NULL THEN greatest(0, epoch(target) - epoch(cl)) / 3600.0::DOUBLE END AS candle_shortfall_hours FROM j""", "funding patchy trades feed")
def _(t: Tables):
    return coverage_status_of(t)


def coverage_status_of(t: Tables):
    day, hour = F.dayofmonth("time_open"), F.hour("time_open")
    patchy = t.candles_1h.filter(~((F.col("market") == "error") & (day > 25)) & ~((F.col("market") == "click") & (hour == 5)) & (F.col("market") != "view"))
    return st.coverage_status(t.funding.filter("market <> 'signup'"), patchy, t.trades, t.span[1])


@query("A26_status_counts", """WITH f AS (SELECT market, max(time_exchange) AS fl FROM funding WHERE market <> 'signup' GROUP BY 1), g AS (SELECT market, count(*) AS gaps FROM (SELECT market, (epoch(time_exchange) - epoch(lag(time_exchange) OVER (PARTITION BY market ORDER BY time_exchange))) / 3600 - 1 AS m FROM funding WHERE market <> 'signup') WHERE m > 0 GROUP BY 1),
    c AS (SELECT market, max(time_open) AS cl, count(*) FILTER (m > 0) AS cg FROM (SELECT *, (epoch(time_open) - epoch(lag(time_open) OVER (PARTITION BY market ORDER BY time_open))) / 3600 - 1 AS m FROM patchy) GROUP BY 1),
    j AS (SELECT market, CASE WHEN fl IS NULL AND cl IS NULL THEN 'no_data' WHEN fl IS NULL OR epoch(t1) - epoch(fl) > 7200 OR coalesce(gaps, 0) > 0 THEN 'funding_truncated' WHEN cl IS NULL OR epoch(least(fl, t1)) - epoch(cl) > 7200 OR cg > 0 THEN 'candle_truncated' ELSE 'complete' END AS status,
      cl IS NULL AS none, epoch(least(fl, t1)) - epoch(cl) > 86400 AS far FROM (SELECT DISTINCT market FROM trades) u LEFT JOIN f USING (market) LEFT JOIN g USING (market) LEFT JOIN c USING (market), feed)
    SELECT status, count(*) AS markets, count(*) FILTER (coalesce(far, false)) AS over_24h, count(*) FILTER (none) AS without_candles FROM j GROUP BY 1""", "funding patchy trades feed")
def _(t: Tables):
    far = F.coalesce(F.col("candle_shortfall_hours") > 24, F.lit(False))
    return coverage_status_of(t).groupBy("status").agg(F.count(F.lit(1)).alias("markets"), F.count_if(far).alias("over_24h"), F.count_if(F.col("candle_rows") == 0).alias("without_candles"))


@query("A26_gap_rows", """SELECT * FROM (SELECT market, time_exchange AS before, lead(time_exchange) OVER (PARTITION BY market ORDER BY time_exchange) AS after,
    (epoch(lead(time_exchange) OVER (PARTITION BY market ORDER BY time_exchange)) - epoch(time_exchange))::BIGINT // 3600 - 1 AS n_missing FROM funding) WHERE n_missing > 0""", "funding")
def _(t: Tables):
    return st.gap_rows(t.funding)


@query("A45_carry_evidence", f"""WITH p1 AS ({_lag_sql(1)}), a AS (SELECT market, regr_slope(y, x) AS phi FROM p1 GROUP BY 1), h AS (SELECT market, CASE WHEN phi > 0 AND phi < 1 THEN ln(0.5) / ln(phi) END AS hl FROM a),
    l AS (SELECT market, rk, lag(rk) OVER (PARTITION BY market ORDER BY week) AS pv FROM weekly), x AS (SELECT market, {_AR.format(p='market', v='rk')} AS ra, {_AR.format(p='market', v='pv')} AS rb FROM l WHERE pv IS NOT NULL),
    c AS (SELECT market, CASE WHEN var_pop(ra) > 0 AND var_pop(rb) > 0 THEN corr(ra, rb) END AS rho FROM x GROUP BY 1), n AS (SELECT market, count(*) AS k FROM weekly GROUP BY 1), r AS (SELECT market, CASE WHEN k >= 4 THEN rho END AS rho FROM n LEFT JOIN c USING (market))
    SELECT market, round(rho, 6) AS rho, round(hl, 6) AS half_life, CASE WHEN hl IS NULL OR rho IS NULL THEN 'insufficient' WHEN rho >= 0.5 AND hl >= 24 THEN 'carry' ELSE 'measured_fail' END AS carry_evidence FROM h LEFT JOIN r USING (market)""", "seg weekly")
def _(t: Tables):
    rho = st.rank_persistence(st.weekly_ranks(t.funding)).select("market", F.col("week_over_week_rank_corr").alias("rho"))
    a = st.ar1(t.funding, "funding_rate").join(rho, "market", "left")
    return a.select("market", "rho", F.col("shock_half_life_hours").alias("half_life"), st.carry_evidence(F.col("rho"), F.col("shock_half_life_hours")).alias("carry_evidence"))


# --- reconciliation --------------------------------------------------------------
INTEREST = 0.0001
_PRED = "least(greatest(least(greatest(" + str(INTEREST) + "::DOUBLE, {p} - 0.0005::DOUBLE), {p} + 0.0005::DOUBLE) / 8.0::DOUBLE, -0.04), 0.04)"
add_view("prem", "SELECT market, seq, time_exchange, update_class, (mark_px - oracle_px) / oracle_px AS p, date_trunc('hour', time_exchange) + INTERVAL 1 HOUR AS settlement_time, minute(time_exchange) AS minute FROM oracle", "oracle")
add_view("hours", f"""SELECT h.*, f.funding_rate AS realized_funding, {_PRED.format(p='average_premium')} AS predicted_funding FROM (SELECT market, settlement_time, avg(p) AS average_premium, count(*) AS sample_count,
    CASE WHEN bool_or(update_class = 'Fallback') THEN 'Fallback' ELSE 'Deployer' END AS update_class FROM prem GROUP BY 1, 2) h JOIN funding f ON f.market = h.market AND date_trunc('hour', f.time_exchange) = h.settlement_time""", "prem funding")


def samples_of(t: Tables):
    return st.premium_samples(t.oracle)


def hours_of(t: Tables):
    return st.reconcile(samples_of(t), t.funding, interest=INTEREST)


@query("A27_reconciled_hours", """SELECT market, settlement_time, round(average_premium, 6) AS average_premium, sample_count, update_class, round(realized_funding, 6) AS realized_funding, round(predicted_funding, 6) AS predicted_funding,
    round((realized_funding - predicted_funding) * 10000, 6) AS residual_bps, abs(predicted_funding) = 0.04 AS cap_hit, abs(average_premium - 0.0001) > 0.0005 AS clamp_active FROM hours""", "hours")
def _(t: Tables):
    return hours_of(t).drop("residual")


# the sample feed is thin: days stand for hours and hours for minutes
@query("A27_complete_hours", """WITH m AS (SELECT DISTINCT market, date_trunc('day', time_exchange) AS settlement_time, hour(time_exchange) AS minute FROM prem), g AS (SELECT *, minute - lag(minute) OVER (PARTITION BY market, settlement_time ORDER BY minute) - 1 AS g FROM m)
    SELECT market, settlement_time FROM g GROUP BY 1, 2 HAVING min(minute) = 0 AND max(minute) = 23 AND max(g) <= 5""", "prem")
def _(t: Tables):
    s = samples_of(t).select("market", F.date_trunc("day", "time_exchange").alias("settlement_time"), F.hour("time_exchange").alias("minute"))
    return st.complete_hours(s, last_minute=23)


add_view("cum", "SELECT a.market, a.settlement_time, g.m AS minute, sum(b.p) AS cs, count(*) AS ck FROM (SELECT DISTINCT market, settlement_time FROM prem) a CROSS JOIN (SELECT unnest(generate_series(0, 59)) AS m) g JOIN prem b ON b.market = a.market AND b.settlement_time = a.settlement_time AND b.minute <= g.m GROUP BY 1, 2, 3", "prem")


def _r2_sql(y: str, x: str) -> str:
    """R2 with intercept: undefined for constant y, zero for constant x (SQL leaves that null)."""
    return f"CASE WHEN count(*) < 2 OR min({y}) = max({y}) THEN NULL WHEN min({x}) = max({x}) THEN 0 ELSE regr_r2({y}, {x}) END"


@query("A28_minute_r2_curve", f"""SELECT minute, round({_r2_sql('realized_funding', 'pred')}, 6) AS r2, count(*) AS hour_count, sum(ck)::BIGINT AS sample_count
    FROM (SELECT c.minute, ck, realized_funding, {_PRED.format(p='(cs / ck)')} AS pred FROM cum c JOIN hours h USING (market, settlement_time)) GROUP BY 1""", "cum hours")
def _(t: Tables):
    return st.minute_curve(st.cumulative_minutes(st.minute_partials(samples_of(t))), hours_of(t), interest=INTEREST)


def _line_sql(fn: str) -> str:
    """A line's slope or intercept: undefined (null, never NaN) where all predictions are equal."""
    return f"CASE WHEN min(predicted_funding) < max(predicted_funding) THEN {fn}(realized_funding, predicted_funding) END"


@query("A29_regression_stats", f"""SELECT count(*) AS n, round({_line_sql('regr_intercept')}, 6) AS intercept, round({_line_sql('regr_slope')}, 6) AS slope, round({_r2_sql('realized_funding', 'predicted_funding')}, 6) AS r_squared,
    round({_r2_sql('realized_funding', 'average_premium')}, 6) AS raw_premium_r_squared, round(avg(realized_funding - predicted_funding) * 10000, 6) AS mean_residual_bps, round({_line_sql('regr_slope')}, 6) AS empirically_implied_multiplier FROM hours""", "hours")
def _(t: Tables):
    return st.regression_stats(hours_of(t))


@query("A30_clamp_split", """SELECT CASE WHEN abs(average_premium - 0.0001) > 0.0005 THEN 'active' ELSE 'inactive' END AS regime, count(*) AS n, round(CASE WHEN var_pop(predicted_funding) = 0 THEN 0 ELSE regr_r2(realized_funding, predicted_funding) END, 6) AS r_squared FROM hours GROUP BY 1""", "hours")
def _(t: Tables):
    return st.clamp_split(hours_of(t))


@query("A31_residual_summary", f"""SELECT update_class, count(*) AS n, round(avg(r), 6) AS mean, round(sqrt(avg(r * r)), 6) AS rmse, {', '.join(f"round(quantile_cont(r, {p}), 6) AS p{int(p * 100):02d}" for p in (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0))}
    FROM (SELECT *, (realized_funding - predicted_funding) * 10000 AS r FROM hours) GROUP BY 1""", "hours")
def _(t: Tables):
    return st.residual_summary(hours_of(t))


_GRID = "(-0.001::DOUBLE + i * (0.002::DOUBLE / 4000))"


@query("A32_interest_grid", f"""SELECT i, round(sum((y - pr) * (y - pr)) * 1e6, 6) AS sse_e6 FROM (SELECT i, realized_funding AS y, least(greatest((average_premium + least(greatest({_GRID} - average_premium, -0.0005), 0.0005)) / 8.0::DOUBLE, -0.04), 0.04) AS pr FROM hours, range(4001) g(i)) GROUP BY i""", "hours")
def _(t: Tables):
    return st.interest_grid(hours_of(t)).select("i", (F.col("sse") * 1e6).alias("sse_e6"))


@query("A32_best_interest", f"""WITH g AS (SELECT i, sum((y - pr) * (y - pr)) AS sse FROM (SELECT i, realized_funding AS y, least(greatest((average_premium + least(greatest({_GRID} - average_premium, -0.0005), 0.0005)) / 8.0::DOUBLE, -0.04), 0.04) AS pr FROM hours, range(4001) g(i)) GROUP BY i)
    SELECT round(arg_min({_GRID}, (sse, i)), 6) AS interest, round(sqrt(min(sse) / (SELECT count(*) FROM hours)), 6) AS rmse FROM g""", "hours")
def _(t: Tables):
    return st.best_interest(hours_of(t))


@query("A33_shuffle_floor", f"""WITH s AS (SELECT p.* FROM prem p SEMI JOIN hours h ON p.market = h.market AND p.settlement_time = h.settlement_time), pos AS (SELECT market, settlement_time, minute, row_number() OVER (PARTITION BY market, settlement_time ORDER BY time_exchange, seq) AS i FROM s),
    mix AS (SELECT market, settlement_time, k, p, row_number() OVER (PARTITION BY market, settlement_time, k ORDER BY md5(concat_ws('|', 0, k, seq)), seq) AS i FROM s, range(100) z(k)),
    j AS (SELECT m.market, m.settlement_time, k, minute, sum(p) AS s, count(*) AS n FROM mix m JOIN pos USING (market, settlement_time, i) GROUP BY ALL),
    c AS (SELECT market, settlement_time, k, g.m AS minute, sum(s) AS cs, sum(n) AS ck FROM j JOIN (SELECT unnest(generate_series(0, 59)) AS m) g ON j.minute <= g.m GROUP BY ALL),
    r AS (SELECT k, minute, regr_r2(realized_funding, {_PRED.format(p='(cs / ck)')}) AS r2 FROM c JOIN hours USING (market, settlement_time) GROUP BY 1, 2)
    SELECT minute, round(avg(r2), 6) AS shuffle_r2, count(r2) AS shuffles FROM r GROUP BY 1""", "prem hours")
def _(t: Tables):
    return st.shuffle_floor(samples_of(t), hours_of(t), interest=INTEREST)


@query("F4_funding_from_premium", f"SELECT market, settlement_time, round({_PRED.format(p='average_premium')} * 1e4, 6) AS predicted_bps FROM hours", "hours")
def _(t: Tables):
    return hours_of(t).select("market", "settlement_time", (F.col("predicted_funding") * 1e4).alias("predicted_bps"))


@query("F5_cap_and_clamp", "SELECT market, count(*) FILTER (abs(predicted_funding) = 0.04) AS caps, count(*) FILTER (abs(average_premium - 0.0001) > 0.0005) AS clamped FROM hours GROUP BY 1", "hours")
def _(t: Tables):
    return hours_of(t).groupBy("market").agg(F.count_if("cap_hit").alias("caps"), F.count_if("clamp_active").alias("clamped"))


# --- ranks ---------------------------------------------------------------------
@query("W10_ordinal_decile", "SELECT market, time_exchange, rn AS ordinal, least(10, greatest(1, (rn - 1) * 10 // n + 1)) AS decile FROM (SELECT *, row_number() OVER (ORDER BY abs(funding_rate), market, time_exchange) AS rn, count(*) OVER () AS n FROM funding)", "funding")
def _(t: Tables):
    f = t.funding.select("market", "time_exchange", F.abs("funding_rate").alias("a"))
    r = rk.global_prefix(f, F.lit(1).cast("long"), "a", "market", micros("time_exchange"), out="ordinal", width_s=86_400 * 30)
    n = t.funding.agg(F.count(F.lit(1)).alias("n"))
    return r.crossJoin(F.broadcast(n)).select("market", "time_exchange", "ordinal", rk.ordinal_decile(F.col("ordinal"), F.col("n")).alias("decile"))  # one row


@query("W11_weighted_deciles", """WITH c AS (SELECT *, sum(exposure_hours) OVER (ORDER BY abs(annualized_rate), market, interval_start ROWS UNBOUNDED PRECEDING) AS cw, sum(exposure_hours) OVER () AS tot FROM exposure)
    SELECT market, interval_start, CASE WHEN annualized_rate < 0 THEN 'negative' ELSE 'nonnegative' END || '_D' || lpad(least(10, floor((cw - exposure_hours / 2) / tot * 10)::BIGINT + 1)::VARCHAR, 2, '0') AS sign_size_decile FROM c""", "exposure")
def _(t: Tables):
    e = exposure_of(t).select("market", "interval_start", "annualized_rate", "exposure_hours", F.abs("annualized_rate").alias("a"))
    r = rk.global_prefix(e, F.col("exposure_hours"), "a", "market", micros("interval_start"), out="cum", width_s=86_400 * 30)
    tot = e.agg(F.sum("exposure_hours").alias("tot"))  # one row
    d = F.least(F.lit(10), F.floor((F.col("cum") - F.col("exposure_hours") / 2) / F.col("tot") * 10) + 1)
    return r.crossJoin(F.broadcast(tot)).select("market", "interval_start", F.format_string("%s_D%02d", F.when(F.col("annualized_rate") < 0, "negative").otherwise("nonnegative"), d.cast("int")).alias("sign_size_decile"))


@query("W12_tail_deciles", """WITH r AS (SELECT time_exchange, market, funding_rate, row_number() OVER (PARTITION BY time_exchange ORDER BY funding_rate, market) AS lo, row_number() OVER (PARTITION BY time_exchange ORDER BY funding_rate DESC, market DESC) AS hi, ceil(count(*) OVER (PARTITION BY time_exchange) * 0.1) AS k FROM funding)
    SELECT time_exchange, market, 'low' AS tail FROM r WHERE lo <= k UNION ALL SELECT time_exchange, market, 'high' FROM r WHERE hi <= k""", "funding")
def _(t: Tables):
    return rk.tails(t.funding, ["time_exchange"], "funding_rate", "market").select("time_exchange", "market", "tail")


@query("W13_row_index", "SELECT market, time_exchange, row_number() OVER (PARTITION BY market ORDER BY funding_rate DESC, time_exchange) AS rank FROM funding", "funding")
def _(t: Tables):
    from pyspark.sql import Window

    w = Window.partitionBy("market").orderBy(F.col("funding_rate").desc(), "time_exchange")
    return t.funding.select("market", "time_exchange", F.row_number().over(w).alias("rank"))


@query("W13b_stable_event_ids", "SELECT market || '-' || lpad((row_number() OVER (ORDER BY market, start_time, end_time))::VARCHAR, 6, '0') AS id, event_id FROM shocks", "shocks")
def _(t: Tables):
    e = t.shocks.select("event_id", "market", "start_time", "end_time", F.lit(0.0).alias("z"))
    r = rk.global_prefix(e, F.lit(1).cast("long"), "z", "market", micros("start_time"), out="n", tie=(micros("end_time"),), width_s=86_400 * 30)
    return r.select(F.format_string("%s-%06d", F.col("market"), F.col("n")).alias("id"), "event_id")
