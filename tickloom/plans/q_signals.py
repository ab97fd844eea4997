"""Indicators, lifecycle signals, harvesting, basis events and exits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.functions.timecols import plus_seconds
from tickloom.operators import bars as b, harvest as hv, indicators as ind, lifecycle as lc, portfolio as pf, stats as st
from tickloom.operators.asof import asof_join
from tickloom.operators.ranges import range_totals
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.q_portfolio import slots_of
from tickloom.plans.registry import query
from tickloom.session import materialize

_P = "OVER (PARTITION BY market ORDER BY time_open)"


@query("W5_sma_bollinger", """SELECT market, time_open, round(CASE WHEN rn >= 20 THEN m END, 6) AS bb_mid_20, round(CASE WHEN rn >= 20 THEN m + 2 * s END, 6) AS bb_upper_20, round(CASE WHEN rn >= 20 THEN m - 2 * s END, 6) AS bb_lower_20, round(CASE WHEN rn >= 10 THEN m10 END, 6) AS sma_10
    FROM (SELECT market, time_open, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, avg(close) OVER v AS m10, row_number() OVER (PARTITION BY market ORDER BY time_open) AS rn FROM candles_1d WINDOW w AS (PARTITION BY market ORDER BY time_open ROWS 19 PRECEDING), v AS (PARTITION BY market ORDER BY time_open ROWS 9 PRECEDING))""", "candles_1d")
def _(t: Tables):
    return ind.compute(["bbands", "sma:period=10"], t.candles_1d)


@query("W6_vwap", f"SELECT market, time_open, round(sum((high + low + close) / 3 * volume) {_P} / sum(volume) {_P}, 6) AS vwap FROM candles_1d", "candles_1d")
def _(t: Tables):
    return ind.compute("vwap", t.candles_1d)


def _ema(x: str, a: float) -> str:
    k = 1 - a
    return f"(pow({k!r}, i) * sum(CASE WHEN i = 0 THEN {x} ELSE {a!r} * {x} * pow({k!r}, -i) END) {_P})"


add_view("c1", f"SELECT *, row_number() {_P} - 1 AS i, coalesce(close - lag(close) {_P}, 0) AS d, greatest(high - low, abs(high - lag(close) {_P}), abs(low - lag(close) {_P})) AS tr FROM candles_1d", "candles_1d")


@query("W8_recursive_filters", f"""WITH e AS (SELECT market, time_open, i, {_ema('close', 2 / 21)} AS ema, {_ema('close', 2 / 13)} - {_ema('close', 2 / 27)} AS macd, {_ema('greatest(d, 0)', 1 / 14)} AS g, {_ema('greatest(-d, 0)', 1 / 14)} AS l, {_ema('tr', 1 / 14)} AS atr FROM c1)
    SELECT market, time_open, round(ema, 6) AS ema_20, round(100 * g / nullif(g + l, 0), 6) AS rsi_14, round(macd, 6) AS macd, round({_ema('macd', 2 / 10)}, 6) AS macd_signal, round(macd - {_ema('macd', 2 / 10)}, 6) AS macd_hist, round(atr, 6) AS atr_14 FROM e""", "c1")
def _(t: Tables):
    return ind.compute(["ema:20", "rsi", "macd", "atr:14"], materialize(t.candles_1d, "candles"))


@query("X1_indicator_registry", f"SELECT market, time_open, round(CASE WHEN row_number() {_P} >= 3 THEN avg(close) OVER (PARTITION BY market ORDER BY time_open ROWS 2 PRECEDING) END, 6) AS sma_3 FROM candles_1h", "candles_1h")
def _(t: Tables):
    return ind.compute("sma:3", t.candles_1h)


# --- lifecycle -----------------------------------------------------------------
KW = dict(age_min=7, age_max=5000, floor_usd=1000.0)
add_view("feat", """SELECT market, time_open AS date, close, volume * close AS ntl, min(time_open) OVER (PARTITION BY market) AS first_date, max(time_open) OVER (PARTITION BY market) AS last_date, close / lag(close, 3) OVER w - 1 AS ret3,
    CASE WHEN count(*) OVER v = 7 THEN quantile_cont(volume * close, 0.5) OVER v END AS liq7_usd, date_diff('day', min(time_open) OVER (PARTITION BY market), time_open) AS age_days
    FROM candles_1d WINDOW w AS (PARTITION BY market ORDER BY time_open), v AS (PARTITION BY market ORDER BY time_open ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)""", "candles_1d")
add_view("raw_sig", "SELECT *, side = 1 AND row_number() OVER (PARTITION BY date, side = 1 ORDER BY ret3, market) = 1 AS selected FROM (SELECT *, CASE WHEN ret3 <= -0.08 THEN 1 ELSE -1 END::BIGINT AS side FROM feat WHERE age_days >= 7 AND age_days < 5000 AND liq7_usd >= 1000 AND abs(ret3) >= 0.08)", "feat")
add_view("ev", """WITH a AS (SELECT s.*, c.time_open AS et, c.open AS ep FROM raw_sig s ASOF LEFT JOIN candles_1d c ON s.market = c.market AND s.date + INTERVAL 1 DAY <= c.time_open), e AS (SELECT * REPLACE (CASE WHEN et <= date + INTERVAL 3 DAY THEN et END AS et, CASE WHEN et <= date + INTERVAL 3 DAY THEN ep END AS ep) FROM a),
    x AS (SELECT e.*, c.time_open AS xt, c.open AS xp FROM e ASOF LEFT JOIN candles_1d c ON e.market = c.market AND e.et + INTERVAL 1 DAY <= c.time_open)
    SELECT * REPLACE (CASE WHEN xt <= et + INTERVAL 3 DAY THEN xt END AS xt, CASE WHEN xt <= et + INTERVAL 3 DAY THEN xp END AS xp), CASE WHEN xt <= et + INTERVAL 3 DAY THEN side * (xp / ep - 1) * 10000 - 20 END AS net_bp FROM x""", "raw_sig candles_1d")


def feat_of(t: Tables):
    return lc.features(t.candles_1d)


def events_of(t: Tables):
    return lc.event_backtest(lc.raw_signals(feat_of(t), **KW), t.candles_1d, tolerance_s=2 * 86400)


@query("W3_lagged_features", "SELECT market, date, age_days, round(ret3, 6) AS ret3, round(liq7_usd, 6) AS liq7_usd, first_date FROM feat", "feat")
def _(t: Tables):
    return feat_of(t).select("market", "date", "age_days", "ret3", "liq7_usd", "first_date")


@query("W4_cross_section_residual", "SELECT market, date, round(ret3 - quantile_cont(ret3, 0.5) OVER (PARTITION BY date), 6) AS residual FROM feat", "feat")
def _(t: Tables):
    return lc.with_median_residual(feat_of(t)).select("market", "date", "residual")


@query("T21_raw_signals", "SELECT market, date, side, round(ret3, 6) AS ret3, selected FROM raw_sig", "raw_sig")
def _(t: Tables):
    return lc.raw_signals(feat_of(t), **KW).select("market", "date", "side", "ret3", "selected")


@query("T21_residual_signals", "SELECT market, date, round(r, 6) AS signal_value, row_number() OVER (PARTITION BY date ORDER BY r, market) = 1 AS selected FROM (SELECT *, ret3 - quantile_cont(ret3, 0.5) OVER (PARTITION BY date) AS r FROM feat) WHERE age_days >= 7 AND age_days < 5000 AND liq7_usd >= 1000 AND r <= -0.08", "feat")
def _(t: Tables):
    return lc.residual_signals(feat_of(t), **KW).select("market", "date", "signal_value", "selected")


@query("K4_largest_decline", "SELECT market, date, round(ret3, 6) AS ret3 FROM raw_sig WHERE selected", "raw_sig")
def _(t: Tables):
    return lc.raw_signals(feat_of(t), **KW).filter("selected").select("market", "date", "ret3")


@query("T22_event_backtest", "SELECT market, date, side, et AS entry_ts, round(ep, 6) AS entry_px, xt AS exit_ts, round(xp, 6) AS exit_px, round(net_bp, 6) AS net_bp FROM ev", "ev")
def _(t: Tables):
    return events_of(t).select("market", "date", "side", "entry_ts", "entry_px", "exit_ts", "exit_px", "net_bp")


@query("A50_day_clustered_t", "SELECT side, round(avg(m), 6) AS mean, round(avg(m) / stddev_samp(m) * sqrt(count(*)), 6) AS t, count(*) AS days FROM (SELECT side, date, avg(net_bp) AS m FROM ev WHERE net_bp IS NOT NULL GROUP BY 1, 2) GROUP BY 1", "ev")
def _(t: Tables):
    return pf.day_clustered_t(events_of(t), ["side"], F.col("date"), "net_bp")


@query("A55_top_one_per_day", "SELECT market, date, round(ret3, 6) AS ret3 FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(ret3) DESC, market) AS rn FROM ev WHERE net_bp IS NOT NULL) WHERE rn = 1", "ev")
def _(t: Tables):
    return lc.top_one_per_day(events_of(t).filter("net_bp is not null"), F.abs("ret3")).select("market", "date", "ret3")


@query("A68_event_breakdown", "SELECT market, strftime(date, '%Y-%m') AS month, count(*) AS n, round(avg(net_bp), 6) AS mean_bp FROM ev WHERE side = 1 AND net_bp IS NOT NULL GROUP BY 1, 2", "ev")
def _(t: Tables):
    return events_of(t).filter("side = 1 and net_bp is not null").groupBy("market", F.date_format("date", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.avg("net_bp").alias("mean_bp"))


add_view("span", "SELECT market, min(time_open) AS first, max(time_open) AS last, count(*) AS rows, max(gap) AS max_gap, quantile_cont(volume * close, 0.5) AS median_ntl FROM (SELECT *, date_diff('day', lag(time_open) OVER (PARTITION BY market ORDER BY time_open), time_open) AS gap FROM candles_1d) GROUP BY 1", "candles_1d")


@query("A53_spans", "SELECT market, strftime(first, '%Y-%m') AS born, strftime(last, '%Y-%m') AS died, rows, max_gap, round(median_ntl, 6) AS median_ntl FROM span", "span")
def _(t: Tables):
    return lc.spans(t.candles_1d).select("market", F.date_format("first", "yyyy-MM").alias("born"), F.date_format("last", "yyyy-MM").alias("died"), "rows", "max_gap", "median_ntl")


@query("A53_days_to_death", """SELECT CASE WHEN d <= 7 THEN '<=7d' WHEN d <= 21 THEN '8-21d' WHEN last < TIMESTAMP '2001-11-01' THEN '>21d, died' ELSE 'survived' END AS bucket, count(*) AS n, round(avg(net_bp), 6) AS mean_bp, count(*) FILTER (ep IS NULL) AS no_entry, count(*) FILTER (ep IS NOT NULL AND xp IS NULL) AS no_exit
    FROM (SELECT e.*, s.last, date_diff('day', e.date, s.last) AS d FROM ev e JOIN span s USING (market)) GROUP BY 1""", "ev span")
def _(t: Tables):
    j = events_of(t).join(lc.spans(t.candles_1d).select("market", "last"), "market")
    bucket = lc.death_bucket(F.datediff("last", "date"), F.col("last") < F.lit("2001-11-01").cast("timestamp"))
    return j.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg("net_bp").alias("mean_bp"), F.count_if(F.col("entry_px").isNull()).alias("no_entry"), F.count_if(F.col("entry_px").isNotNull() & F.col("exit_px").isNull()).alias("no_exit"))


add_view("osplit", """WITH a AS (SELECT s.event_id, s.start_time, c1.close AS p1, c0.close AS p0, c2.close AS p2, o1.oracle_px AS o1, o0.oracle_px AS o0 FROM shocks s ASOF JOIN candles_1h c1 ON s.market = c1.market AND s.start_time >= c1.time_close ASOF JOIN candles_1h c0 ON s.market = c0.market AND s.start_time - INTERVAL 24 HOUR >= c0.time_close
      ASOF JOIN candles_1h c2 ON s.market = c2.market AND s.start_time + INTERVAL 6 HOUR >= c2.time_close ASOF JOIN oracle o1 ON s.market = o1.market AND s.start_time >= o1.time_exchange ASOF JOIN oracle o0 ON s.market = o0.market AND s.start_time - INTERVAL 24 HOUR >= o0.time_exchange)
    SELECT *, p1 / p0 - 1 AS ret, o1 / o0 - 1 AS oret, (p2 / p1 - 1) * 10000 AS net, (p1 / o1 - 1) * 10000 AS basis FROM a""", "shocks candles_1h oracle")


@query("A54_oracle_split", """SELECT CASE WHEN ret < 0 AND oret <= 0.5 * ret THEN 'confirmed' ELSE 'overshoot' END AS kind, count(*) AS n, round(avg(net), 6) AS mean_net, round(corr(basis, net), 6) AS r_basis, round(corr(ret - oret, net), 6) AS r_residual,
    count(*) FILTER (basis < (SELECT quantile_cont(basis, 0.5) FROM osplit)) AS below_median FROM osplit GROUP BY 1""", "osplit")
def _(t: Tables):
    c = t.candles_1h.select("market", "time_close", "close")
    s = t.shocks.select("event_id", "market", "start_time", plus_seconds("start_time", -86400).alias("t0"), plus_seconds("start_time", 6 * 3600).alias("t2"))
    for tm, p in (("start_time", "p1_"), ("t0", "p0_"), ("t2", "p2_")):
        s = asof_join(s, c, ["market"], tm, "time_close", ["close"], prefix=p).drop(f"{p}obs_time")
    for tm, p in (("start_time", "o1_"), ("t0", "o0_")):
        s = asof_join(s, t.oracle, ["market"], tm, "time_exchange", ["oracle_px"], prefix=p).drop(f"{p}obs_time")
    x = s.na.drop(subset=["p1_close", "p0_close", "p2_close", "o1_oracle_px", "o0_oracle_px"]).select(
        (F.col("p1_close") / F.col("p0_close") - 1).alias("ret"), (F.col("o1_oracle_px") / F.col("o0_oracle_px") - 1).alias("oret"),
        ((F.col("p2_close") / F.col("p1_close") - 1) * 1e4).alias("net"), ((F.col("p1_close") / F.col("o1_oracle_px") - 1) * 1e4).alias("basis"))
    x = materialize(x, "split")
    med = x.agg(F.percentile("basis", 0.5).alias("_m"))  # one row
    kind = F.when((F.col("ret") < 0) & (F.col("oret") <= 0.5 * F.col("ret")), "confirmed").otherwise("overshoot")
    return x.crossJoin(F.broadcast(med)).withColumn("resid", F.col("ret") - F.col("oret")).groupBy(kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("net").alias("mean_net"), F.corr("basis", "net").alias("r_basis"), F.corr("resid", "net").alias("r_residual"), F.count_if(F.col("basis") < F.col("_m")).alias("below_median"))


add_view("impulse", """WITH x AS (SELECT s.market, s.rebalance_time, (SELECT avg(funding_rate) FROM funding f WHERE f.market = s.market AND f.time_exchange > s.rebalance_time - INTERVAL 24 HOUR AND f.time_exchange <= s.rebalance_time) AS r,
      (SELECT {'n': count(*), 'm': avg(funding_rate), 'sd': stddev_samp(funding_rate)} FROM funding f WHERE f.market = s.market AND f.time_exchange > s.rebalance_time - INTERVAL 7 DAY AND f.time_exchange <= s.rebalance_time - INTERVAL 24 HOUR) AS b,
      coalesce((SELECT sum(funding_rate) FROM funding f WHERE f.market = s.market AND f.time_exchange > s.rebalance_time AND f.time_exchange <= s.end_time), 0) AS paid, (SELECT CASE WHEN count(*) >= 2 THEN arg_max(close, time_close) / arg_min(close, time_close) - 1 END FROM elig e WHERE e.market = s.market AND e.rebalance_time = s.rebalance_time) AS fwd FROM slots s)
    SELECT market, rebalance_time, (r - b.m) / b.sd AS z, r - b.m AS imp, b.m AS level, fwd, fwd - paid AS net FROM x WHERE fwd IS NOT NULL AND b.sd > 0 AND b.n >= 90""", "slots funding elig")


def impulse_of(t: Tables):
    s = slots_of(t)
    tm = F.col("rebalance_time")
    r = range_totals(s, t.funding, ["market"], "time_exchange", {
        "r": (plus_seconds(tm, -86400), tm, False, True), "b": (plus_seconds(tm, -7 * 86400), plus_seconds(tm, -86400), False, True), "p": (tm, F.col("end_time"), False, True)},
        {"n": F.lit(1), "x": F.col("funding_rate"), "xx": F.col("funding_rate") * F.col("funding_rate")}, width_s=30 * 86400)
    mb, mr = F.col("b_x") / F.col("b_n"), F.col("r_x") / F.col("r_n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("b_xx") - F.col("b_x") * F.col("b_x") / F.col("b_n")) / (F.col("b_n") - 1)))
    x = r.filter("b_n >= 90 and r_n > 0").select("market", "rebalance_time", "end_time", ((mr - mb) / sd).alias("z"), (mr - mb).alias("imp"), mb.alias("level"), "p_x")
    f = pf.strictly_after_return(s, t.candles_1h)
    return x.join(f, ["market", "rebalance_time", "end_time"]).select("market", "rebalance_time", "z", "imp", "level", F.col("period_return").alias("fwd"), (F.col("period_return") - F.col("p_x")).alias("net"))


_BAND = "CASE WHEN z < -0.5 THEN 'low' WHEN z < 0.5 THEN 'mid' ELSE 'high' END"


@query("A52_impulse_bands", f"SELECT band, round(avg(p), 6) AS mean, round(avg(p) / stddev_samp(p) * sqrt(count(*)), 6) AS t, count(*) AS days FROM (SELECT {_BAND} AS band, rebalance_time, avg(net) AS p FROM impulse GROUP BY 1, 2) GROUP BY 1", "impulse")
def _(t: Tables):
    z = F.col("z")
    x = impulse_of(t).withColumn("band", F.when(z < -0.5, "low").when(z < 0.5, "mid").otherwise("high"))
    return pf.day_clustered_t(x, ["band"], F.col("rebalance_time"), "net")


_R = "rank() OVER (PARTITION BY rebalance_time ORDER BY {v}) + (count(*) OVER (PARTITION BY rebalance_time, {v}) - 1) / 2.0::DOUBLE"


@query("A52_daily_rank_ic", f"SELECT rebalance_time, round(corr(a, f), 6) AS impulse_ic, round(corr(l, f), 6) AS level_ic, count(*) AS n FROM (SELECT rebalance_time, {_R.format(v='imp')} AS a, {_R.format(v='level')} AS l, {_R.format(v='fwd')} AS f FROM impulse) GROUP BY 1 HAVING count(*) >= 3", "impulse")
def _(t: Tables):
    x = materialize(impulse_of(t), "impulse")
    a = st.spearman(x, ["rebalance_time"], "imp", "fwd").withColumnRenamed("rho", "impulse_ic")
    l = st.spearman(x, ["rebalance_time"], "level", "fwd").select("rebalance_time", F.col("rho").alias("level_ic"))
    return a.join(l, "rebalance_time").filter("n >= 3").select("rebalance_time", "impulse_ic", "level_ic", "n")


# --- harvesting ------------------------------------------------------------------
HZ = {"h2": 7200, "h6": 21600, "d1": 86400}
DELTAS = (100.0, 300.0)
add_view("hbars", "SELECT market, date_trunc('hour', time_exchange) AS bar, min(price) AS lo, max(price) AS hi, quantile_cont(price, 0.5) AS med, count(*) AS n FROM trades GROUP BY 1, 2", "trades")
add_view("obars", "SELECT market, date_trunc('hour', time_exchange) AS bar, arg_max(oracle_px, (time_exchange, seq)) AS oracle_px FROM oracle GROUP BY 1, 2", "oracle")
add_view("refs", "SELECT *, CASE WHEN count(*) OVER v = 5 AND bar - lag(bar) OVER w <= INTERVAL 2 HOUR THEN quantile_cont(med, 0.5) OVER v END AS ref FROM hbars WINDOW w AS (PARTITION BY market ORDER BY bar), v AS (PARTITION BY market ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)", "hbars")
add_view("hcand", """SELECT * FROM (SELECT market, s.side, d.delta AS delta_bps, bar AS t, ref, lo, hi, CASE WHEN s.side = 'bid' THEN ref * (1 - d.delta / 10000) ELSE ref * (1 + d.delta / 10000) END AS px FROM refs, (VALUES ('bid'), ('ask')) s(side), (VALUES (100.0::DOUBLE), (300.0::DOUBLE)) d(delta) WHERE ref IS NOT NULL)
    WHERE (side = 'bid' AND lo < px) OR (side = 'ask' AND hi > px)""", "refs")


def _greedy(src: str, keys: str, t: str, hours: int) -> str:
    """Greedy thinning as a recursion: from each kept row jump to the next allowed one."""
    on = lambda a, c: " AND ".join(f"{a}.{k} = {c}.{k}" for k in keys.split(", "))
    ks = ", ".join(f"k.{k}" for k in keys.split(", "))
    return f"""kept AS (WITH RECURSIVE nx AS (SELECT {', '.join('a.' + k for k in keys.split(', '))}, a.{t} AS t, min(b.{t}) AS n FROM {src} a LEFT JOIN {src} b ON {on('a', 'b')} AND b.{t} >= a.{t} + INTERVAL {hours} HOUR GROUP BY ALL),
      k AS (SELECT {keys}, min({t}) AS t FROM {src} GROUP BY {keys} UNION ALL SELECT {ks}, nx.n FROM k JOIN nx ON {on('k', 'nx')} AND k.t = nx.t WHERE nx.n IS NOT NULL) SELECT * FROM k)"""


_FWD = "(SELECT med FROM hbars h WHERE h.market = k.market AND h.bar >= k.t + INTERVAL {s} SECOND AND h.bar <= k.t + INTERVAL {s} SECOND + INTERVAL 1 HOUR ORDER BY h.bar LIMIT 1)"
add_view("hfills", f"""WITH {_greedy('hcand', 'market, side, delta_bps', 't', 6)}, f AS (SELECT c.market, c.side, c.delta_bps, c.t, c.px, c.ref FROM hcand c JOIN kept USING (market, side, delta_bps, t))
    SELECT market, side, delta_bps, t AS fill_time, px AS fill_px, ref, {', '.join(f"CASE WHEN side = 'bid' THEN ({_FWD.format(s=s)} - px) / px ELSE (px - {_FWD.format(s=s)}) / px END * 10000 AS markout_{h}_bps" for h, s in HZ.items())} FROM f k""", "hcand hbars")


def hbars_of(t: Tables):
    return b.median_bars(t.trades, 3600)


def hfills_of(t: Tables):
    return hv.harvest_fills(materialize(hbars_of(t), "hbars"), DELTAS, cooldown_s=6 * 3600, horizons=HZ, tolerance_s=3600, recency_s=7200)


@query("W18_trailing_reference", "SELECT market, bar, round(ref, 6) AS ref FROM refs", "refs")
def _(t: Tables):
    return hv.trailing_reference(hbars_of(t), recency_s=7200).select("market", "bar", "ref")


@query("T23_harvest_fills", f"SELECT * REPLACE (round(fill_px, 6) AS fill_px, round(ref, 6) AS ref, {', '.join(f'round(markout_{h}_bps, 6) AS markout_{h}_bps' for h in HZ)}) FROM hfills", "hfills")
def _(t: Tables):
    return hfills_of(t)


@query("W17_cooldown", f"WITH {_greedy('(SELECT market, start_time AS t FROM shocks)', 'market', 't', 4)} SELECT market, t FROM kept", "shocks")
def _(t: Tables):
    return hv.cooldown(t.shocks.select("market", F.col("start_time").alias("t")), ["market"], "t", 4 * 3600)


add_view("exits", """WITH q AS (SELECT f.*, q.time_exchange AS qt, best_bid_px AS b, best_bid_sx AS bs, best_ask_px AS a, best_ask_sx AS s FROM hfills f ASOF LEFT JOIN quotes q ON f.market = q.market AND f.fill_time + INTERVAL 30 MINUTE >= q.time_exchange),
    o AS (SELECT *, coalesce(qt >= fill_time + INTERVAL 30 MINUTE - INTERVAL 1 HOUR AND b > 0 AND a > b, false) AS ok FROM q)
    SELECT market, side, delta_bps, fill_time, CASE WHEN ok THEN CASE WHEN side = 'bid' THEN b - fill_px ELSE fill_px - a END / fill_px * 10000 END AS exec_markout_bps, CASE WHEN ok THEN CASE WHEN side = 'bid' THEN b * coalesce(bs, 0) ELSE a * coalesce(s, 0) END END AS exit_touch_depth_usd, CASE WHEN ok THEN (a - b) / ((a + b) / 2) * 10000 END AS exit_spread_bps FROM o""", "hfills quotes")


@query("T24_executable_exit", "SELECT * REPLACE (round(exec_markout_bps, 6) AS exec_markout_bps, round(exit_touch_depth_usd, 6) AS exit_touch_depth_usd, round(exit_spread_bps, 6) AS exit_spread_bps) FROM exits", "exits")
def _(t: Tables):
    f = materialize(hfills_of(t), "hfills")
    return hv.executable_exit(f, t.quotes, max_age_s=3600).select("market", "side", "delta_bps", "fill_time", "exec_markout_bps", "exit_touch_depth_usd", "exit_spread_bps")


@query("T25_passive_exit", """WITH f AS (SELECT h.*, p.policy, CASE p.policy WHEN 'full' THEN ref ELSE ref * (1 - delta_bps / 20000) END AS tg FROM hfills h, (VALUES ('full'), ('half')) p(policy)), x AS (SELECT f.*, (SELECT min(bar) FROM hbars b WHERE b.market = f.market AND b.bar > f.fill_time AND b.bar <= f.fill_time + INTERVAL 4 HOUR AND b.hi > f.tg) AS fa FROM f),
    q AS (SELECT x.*, q.time_exchange AS qt, best_bid_px AS b, best_ask_px AS a FROM x ASOF LEFT JOIN quotes q ON x.market = q.market AND x.fill_time + INTERVAL 4 HOUR >= q.time_exchange), o AS (SELECT *, coalesce(qt >= fill_time + INTERVAL 4 HOUR - INTERVAL 1 HOUR AND b > 0 AND a > b AND (a - b) / ((a + b) / 2) * 10000 <= 200, false) AS ok FROM q)
    SELECT market, side, delta_bps, fill_time, policy, CASE WHEN fa IS NOT NULL THEN 'passive' WHEN ok THEN 'crossed' ELSE 'na' END AS mode, round(CASE WHEN fa IS NOT NULL THEN (tg - fill_px) / fill_px * 10000 - 3 WHEN ok THEN (b - fill_px) / fill_px * 10000 - 6 END, 6) AS net_bps FROM o""", "hfills hbars quotes")
def _(t: Tables):
    bars, f = materialize(hbars_of(t), "hbars"), materialize(hfills_of(t), "hfills")
    return hv.passive_exit(f, bars, t.quotes, window_s=4 * 3600, max_age_s=3600)


add_view("basis", """SELECT h.market, h.bar, h.med, CASE WHEN o.bar >= h.bar - INTERVAL 2 HOUR AND abs(h.med / o.oracle_px - 1) <= 0.30 THEN ln(h.med / o.oracle_px) * 10000 END AS basis_bps FROM hbars h ASOF LEFT JOIN obars o ON h.market = o.market AND h.bar >= o.bar""", "hbars obars")
add_view("crosses", "SELECT * FROM (SELECT market, th.v AS threshold, CASE WHEN basis_bps > 0 THEN 1 ELSE -1 END::BIGINT AS gap_sign, bar AS t, med, basis_bps, lag(basis_bps) OVER (PARTITION BY market, th.v ORDER BY bar) AS p FROM basis, (VALUES (50.0::DOUBLE), (150.0::DOUBLE)) th(v)) WHERE abs(basis_bps) >= threshold AND abs(p) < threshold", "basis")


def basis_of(t: Tables):
    return hv.basis_series(hbars_of(t), b.last_oracle_bars(t.oracle, 3600), max_age_s=7200)


@query("F24_basis", "SELECT market, bar, round(basis_bps, 6) AS basis_bps FROM basis", "basis")
def _(t: Tables):
    return basis_of(t).select("market", "bar", "basis_bps")


@query("W16_fresh_crosses", "SELECT market, threshold, gap_sign, t AS bar, round(basis_bps, 6) AS basis_bps FROM crosses", "crosses")
def _(t: Tables):
    return hv.fresh_crosses(basis_of(t), "basis_bps", (50.0, 150.0)).select("market", "threshold", "gap_sign", "bar", "basis_bps")


_OA = "(SELECT CASE WHEN max(o.bar) >= {t} - INTERVAL 2 HOUR THEN arg_max(o.oracle_px, o.bar) END FROM obars o WHERE o.market = k.market AND o.bar <= {t})"


@query("T26_basis_events", f"""WITH {_greedy('crosses', 'market, threshold, gap_sign', 't', 6)}, e AS (SELECT k.*, c.med AS m0, c.basis_bps, {_OA.format(t='k.t')} AS o1, {_OA.format(t='(k.t - INTERVAL 2 HOUR)')} AS o0 FROM kept k JOIN crosses c USING (market, threshold, gap_sign, t)),
    c AS (SELECT *, (o1 - o0) / o0 * 10000 * gap_sign AS tw FROM e WHERE o1 IS NOT NULL AND o0 IS NOT NULL)
    SELECT market, threshold, gap_sign, t AS bar, round(basis_bps, 6) AS basis_bps, CASE WHEN tw >= 0.25 * abs(basis_bps) THEN 'confirmed' WHEN tw <= -0.25 * abs(basis_bps) THEN 'opposed' ELSE 'flat' END AS cls, {', '.join(f"round(-gap_sign * ln({_FWD.format(s=s)} / m0) * 10000, 6) AS pnl_{h}" for h, s in HZ.items())} FROM c k""", "crosses obars hbars")
def _(t: Tables):
    bars, ob = materialize(hbars_of(t), "hbars"), materialize(b.last_oracle_bars(t.oracle, 3600), "obars")
    return hv.basis_events(bars, ob, (50.0, 150.0), HZ, cooldown_s=6 * 3600, pre_s=7200, tolerance_s=3600, max_age_s=7200)


@query("T27_oracle_conditioned_fills", f"""WITH e AS (SELECT k.*, {_OA.format(t='k.fill_time')} AS o1, {_OA.format(t='(k.fill_time - INTERVAL 2 HOUR)')} AS o0 FROM hfills k), m AS (SELECT *, (o1 - o0) / o0 * 10000 AS mv FROM e WHERE o1 IS NOT NULL AND o0 IS NOT NULL AND abs(fill_px / o1 - 1) <= 0.30), w AS (SELECT *, CASE WHEN side = 'bid' THEN -mv ELSE mv END AS tw FROM m)
    SELECT market, side, delta_bps, fill_time, round(mv, 6) AS oracle_move_bps, round(tw, 6) AS toward_bps, CASE WHEN tw >= 0.25 * delta_bps THEN 'confirmed' WHEN tw <= -0.25 * delta_bps THEN 'opposed' ELSE 'perp_only' END AS cls FROM w""", "hfills obars")
def _(t: Tables):
    ob = materialize(b.last_oracle_bars(t.oracle, 3600), "obars")
    return hv.oracle_conditioned_fills(hfills_of(t), ob, pre_s=7200, max_age_s=7200).select("market", "side", "delta_bps", "fill_time", "oracle_move_bps", "toward_bps", "cls")


@query("F25_move_class", """SELECT cls, count(*) AS n FROM (SELECT CASE WHEN g >= 0.25 * 100 THEN 'confirmed' WHEN g <= -0.25 * 100 THEN 'opposed' ELSE 'flat' END AS cls FROM (SELECT (close / open - 1) * 10000 AS g FROM candles_1h)) GROUP BY 1""", "candles_1h")
def _(t: Tables):
    g = (F.col("close") / F.col("open") - 1) * 1e4
    return t.candles_1h.groupBy(hv.move_class(g, F.lit(100.0)).alias("cls")).agg(F.count(F.lit(1)).alias("n"))
