"""Order-book reconstruction and everything fed by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import book as bk, conditioning as cn, eventwindows as ew
from tickloom.operators.quotes import microprices
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.q_fills import l1_of
from tickloom.plans.registry import query
from tickloom.session import materialize


def states_of(t: Tables):
    return bk.level_states(t.book, strict=False)  # the derived feed has orphan and oversize subs


add_view("epochs", """SELECT *, last_value(CASE WHEN update_type = 'SNAPSHOT' AND NOT coalesce(pt = 'SNAPSHOT', false) THEN seq END IGNORE NULLS) OVER (PARTITION BY market ORDER BY time_exchange, seq) AS epoch
    FROM (SELECT *, lag(update_type) OVER (PARTITION BY market ORDER BY time_exchange, seq) AS pt FROM book)""", "book")
add_view("states", """WITH a AS (SELECT *, CASE WHEN is_buy THEN 'bid' ELSE 'ask' END AS side, entry_px AS price, CASE WHEN update_type IN ('SNAPSHOT', 'SET') THEN entry_sx WHEN update_type = 'DELETE' THEN 0 END AS st,
      CASE update_type WHEN 'ADD' THEN entry_sx WHEN 'SUB' THEN -entry_sx ELSE 0 END AS d FROM epochs WHERE epoch IS NOT NULL),
    b AS (SELECT *, count(st) OVER (PARTITION BY market, epoch, side, price ORDER BY time_exchange, seq) AS sg FROM a),
    x AS (SELECT *, sum(coalesce(st, 0) + d) OVER (PARTITION BY market, epoch, side, price, sg ORDER BY time_exchange, seq) AS x FROM b),
    y AS (SELECT *, x - least(0, min(x) OVER (PARTITION BY market, epoch, side, price, sg ORDER BY time_exchange, seq)) AS size FROM x)
    SELECT market, epoch, side, price, time_exchange, seq, update_type, entry_sx, size, coalesce(lag(size) OVER (PARTITION BY market, epoch, side, price ORDER BY time_exchange, seq), 0) AS prior FROM y""", "epochs")
add_view("intervals", """WITH e AS (SELECT market, epoch, lead(s) OVER (PARTITION BY market ORDER BY epoch) AS en FROM (SELECT market, epoch, min(time_exchange) AS s FROM states GROUP BY 1, 2)),
    i AS (SELECT market, epoch, side, price, time_exchange AS from_time, size, lead(time_exchange) OVER (PARTITION BY market, epoch, side, price ORDER BY time_exchange, seq) AS nx FROM states)
    SELECT market, epoch, side, price, from_time, coalesce(nx, en) AS to_time, size FROM i JOIN e USING (market, epoch)""", "states")
add_view("live_levels", "SELECT b.market, b.time_exchange, i.side, i.price, i.size FROM (SELECT DISTINCT market, time_exchange FROM states) b JOIN intervals i ON i.market = b.market AND i.size > 0 AND i.from_time <= b.time_exchange AND (i.to_time IS NULL OR b.time_exchange < i.to_time)", "states intervals")


@query("T1_level_states", "SELECT market, epoch, side, price, time_exchange, seq, size, prior FROM states", "states")
def _(t: Tables):
    return states_of(t).select("market", "epoch", "side", "price", "time_exchange", "seq", "size", "prior")


@query("T1_strict_book", "SELECT market, epoch, side, price, time_exchange, seq, size FROM states WHERE NOT (update_type = 'SUB' AND prior <= 0)", "states")
def _(t: Tables):
    fixed = bk.sanitize(states_of(t)).filter("fix <> 'orphan_dropped'")
    clean = fixed.select("market", "seq", "time_exchange", "update_type", (F.col("side") == "bid").alias("is_buy"), F.col("price").alias("entry_px"), F.col("clean_sx").alias("entry_sx"))
    return bk.level_states(clean).select("market", "epoch", "side", "price", "time_exchange", "seq", "size")


@query("T1_level_intervals", "SELECT * FROM intervals", "intervals")
def _(t: Tables):
    return bk.level_intervals(states_of(t))


@query("T3_batches", "SELECT market, time_exchange, count(*) AS updates, max(seq) AS last_seq FROM epochs WHERE epoch IS NOT NULL GROUP BY 1, 2", "epochs")
def _(t: Tables):
    return bk.with_epochs(t.book).filter("epoch is not null").groupBy("market", "time_exchange").agg(F.count(F.lit(1)).alias("updates"), F.max("seq").alias("last_seq"))


@query("T3_monotonic_violations", "SELECT market, seq FROM (SELECT market, seq, ts, lag(ts) OVER (PARTITION BY market ORDER BY seq) AS p FROM (SELECT market, seq, time_exchange - to_minutes((seq % 11 * 12)::INT) AS ts FROM book)) WHERE p > ts", "book")
def _(t: Tables):
    jumbled = t.book.withColumn("time_exchange", F.timestamp_micros(F.unix_micros("time_exchange") - (F.col("seq") % 11) * 720_000_000))
    return bk.monotonic_violations(jumbled, ("market",), "seq").select("market", "seq")


@query("T4_l1_after_batches", """SELECT b.market, b.time_exchange, max(price) FILTER (side = 'bid') AS best_bid_px, arg_max(size, price) FILTER (side = 'bid') AS best_bid_sx, min(price) FILTER (side = 'ask') AS best_ask_px, arg_min(size, price) FILTER (side = 'ask') AS best_ask_sx
    FROM (SELECT DISTINCT market, time_exchange FROM states) b LEFT JOIN live_levels l USING (market, time_exchange) GROUP BY 1, 2""", "live_levels")
def _(t: Tables):
    return bk.l1_after_batches(states_of(t))


_LV = "row_number() OVER (PARTITION BY market, time_exchange, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END)"


@query("T5_depth_after_batches", f"SELECT * FROM (SELECT market, time_exchange, side, {_LV} AS level, price, size FROM live_levels) WHERE level <= 3", "live_levels")
def _(t: Tables):
    return bk.depth_after_batches(states_of(t), 3)


@query("T6_sampled_depth", f"""WITH s AS (SELECT DISTINCT market, start_time AS ts FROM shocks), h AS (SELECT s.market, s.ts AS time_exchange, i.side, i.price, i.size, (SELECT max(time_exchange) FROM states x WHERE x.market = s.market AND x.time_exchange <= s.ts) AS depth_source_time
      FROM s JOIN intervals i ON i.market = s.market AND i.size > 0 AND i.from_time <= s.ts AND (i.to_time IS NULL OR s.ts < i.to_time))
    SELECT * FROM (SELECT market, time_exchange, depth_source_time, side, {_LV} AS level, price, size FROM h) WHERE level <= 4""", "intervals shocks")
def _(t: Tables):
    return depth_samples(t)


def depth_samples(t: Tables):
    return bk.sample_depth(states_of(t), t.shocks.select("market", F.col("start_time").alias("sample_time")), 4)


@query("K1_top_levels", f"SELECT * FROM (SELECT market, time_exchange, side, {_LV} AS level, price, size FROM live_levels) WHERE level <= 1", "live_levels")
def _(t: Tables):
    return bk.top_levels(bk.depth_after_batches(states_of(t), 2).drop("level"), 1)


@query("T7_sanitize", """SELECT market, CASE WHEN update_type = 'SUB' AND prior <= 0 THEN 'orphan_dropped' WHEN update_type = 'SUB' AND entry_sx > prior THEN 'oversize_clamped' ELSE 'kept' END AS fix, count(*) AS n, sum(CASE WHEN update_type = 'SUB' AND entry_sx > prior THEN prior ELSE entry_sx END) AS clean_total FROM states GROUP BY 1, 2""", "states")
def _(t: Tables):
    return bk.sanitize(states_of(t)).groupBy("market", "fix").agg(F.count(F.lit(1)).alias("n"), F.sum("clean_sx").alias("clean_total"))


@query("P9_pre_snapshot_trim", "SELECT market, count(*) AS n, min(time_exchange) AS first_time FROM (SELECT *, min(CASE WHEN update_type = 'SNAPSHOT' THEN time_exchange END) OVER (PARTITION BY market) AS f FROM book) WHERE time_exchange >= f GROUP BY 1", "book")
def _(t: Tables):
    return bk.trim_before_snapshot(t.book).groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.min("time_exchange").alias("first_time"))


@query("P9_rotated_snapshot", """WITH d AS (SELECT *, date_trunc('day', time_exchange) AS day, (seq + 5000) % 10000 AS pos FROM book), h AS (SELECT market, day, arg_min(time_exchange, pos) AS ft, arg_min(update_type, pos) AS ut, min(time_exchange) AS mn FROM d GROUP BY 1, 2)
    SELECT d.market, d.day, count(*) AS n FROM d JOIN h ON d.market = h.market AND d.day = h.day WHERE NOT (ut = 'SNAPSHOT' AND ft > mn AND d.time_exchange = ft) GROUP BY 1, 2""", "book")
def _(t: Tables):
    d = t.book.select("*", F.date_trunc("day", "time_exchange").alias("day"), ((F.col("seq") + 5000) % 10000).alias("pos"))
    return bk.drop_rotated_snapshot(d, ("market", "day"), "pos").groupBy("market", "day").agg(F.count(F.lit(1)).alias("n"))


def book4(t: Tables):
    """Order-level feed: one standing order per user."""
    i, v, u = F.col("event_id"), F.floor(F.col("value")), F.col("user_id")
    kind = F.when(F.floor(i / 50) % 8 == 0, "SNAPSHOT").when(i % 10 < 4, "SET").when(i % 10 < 6, "ADD").when(i % 10 == 6, "SUB").when(i % 10 == 7, "DELETE").when(i % 10 == 8, "PENDING").otherwise("SET")
    return t.events.select(
        i.alias("seq"), F.col("event_type").alias("market"), F.col("ts").alias("time_exchange"), kind.alias("update_type"), F.concat(F.lit("o"), (u % 60).cast("string")).alias("order_id"),
        (u % 2).cast("string").alias("is_buy"), (F.lit(100) + F.when(u % 2 == 1, -1 - v % 6).otherwise(1 + v % 6)).cast("double").alias("entry_px"), (F.lit(1) + i % 5).cast("double").alias("entry_sx"),
        F.when(i % 17 == 0, "1").otherwise("0").alias("is_trigger"), F.when(i % 19 == 0, "Stop").otherwise("Limit").alias("order_type"), F.when(i % 23 == 0, "CLOSED").when(i % 3 == 0, "OPEN").alias("hl4_status"),
    )


add_view("book4", """SELECT event_id AS seq, event_type AS market, ts AS time_exchange, CASE WHEN (event_id // 50) % 8 = 0 THEN 'SNAPSHOT' WHEN event_id % 10 < 4 THEN 'SET' WHEN event_id % 10 < 6 THEN 'ADD' WHEN event_id % 10 = 6 THEN 'SUB' WHEN event_id % 10 = 7 THEN 'DELETE' WHEN event_id % 10 = 8 THEN 'PENDING' ELSE 'SET' END AS update_type,
    'o' || (user_id % 60) AS order_id, user_id % 2 = 1 AS buy, (100 + CASE WHEN user_id % 2 = 1 THEN -1 - floor(value)::BIGINT % 6 ELSE 1 + floor(value)::BIGINT % 6 END)::DOUBLE AS px, (1 + event_id % 5)::DOUBLE AS sx,
    NOT (event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0) AS live FROM events""")
add_view("states4", """WITH p AS (SELECT *, lag(update_type) OVER (PARTITION BY market ORDER BY time_exchange, seq) AS pt FROM book4),
    e AS (SELECT *, last_value(CASE WHEN update_type = 'SNAPSHOT' AND NOT coalesce(pt = 'SNAPSHOT', false) THEN seq END IGNORE NULLS) OVER (PARTITION BY market ORDER BY time_exchange, seq) AS epoch FROM p),
    a AS (SELECT *, CASE WHEN update_type IN ('SNAPSHOT', 'SET') THEN CASE WHEN live THEN sx ELSE 0 END WHEN update_type = 'DELETE' OR (update_type = 'ADD' AND NOT live) THEN 0 END AS st, CASE WHEN update_type = 'ADD' AND live THEN sx WHEN update_type = 'SUB' THEN -sx ELSE 0 END AS d
      FROM e WHERE epoch IS NOT NULL AND update_type <> 'PENDING' AND NOT (update_type = 'SNAPSHOT' AND NOT live)),
    b AS (SELECT *, count(st) OVER (PARTITION BY market, epoch, order_id ORDER BY time_exchange, seq) AS sg FROM a), x AS (SELECT *, sum(coalesce(st, 0) + d) OVER (PARTITION BY market, epoch, order_id, sg ORDER BY time_exchange, seq) AS x FROM b),
    y AS (SELECT *, x - least(0, min(x) OVER (PARTITION BY market, epoch, order_id, sg ORDER BY time_exchange, seq)) AS size FROM x), z AS (SELECT *, coalesce(lag(size) OVER w, 0) AS prior FROM y WINDOW w AS (PARTITION BY market, epoch, order_id ORDER BY time_exchange, seq)),
    q AS (SELECT *, last_value(CASE WHEN update_type IN ('SNAPSHOT', 'SET') OR (update_type = 'ADD' AND prior <= 0) THEN {'b': buy, 'p': px} END IGNORE NULLS) OVER (PARTITION BY market, epoch, order_id ORDER BY time_exchange, seq) AS att FROM z),
    r AS (SELECT *, lag(att) OVER (PARTITION BY market, epoch, order_id ORDER BY time_exchange, seq) AS was FROM q),
    m AS (SELECT market, epoch, time_exchange, seq, was.b AS b, was.p AS price, -prior AS d FROM r UNION ALL SELECT market, epoch, time_exchange, seq, att.b, att.p, size FROM r),
    l AS (SELECT market, epoch, time_exchange, seq, CASE WHEN b THEN 'bid' ELSE 'ask' END AS side, price, sum(d) AS d FROM m WHERE price IS NOT NULL GROUP BY ALL)
    SELECT market, epoch, time_exchange, seq, side, price, greatest(0, sum(d) OVER (PARTITION BY market, epoch, side, price ORDER BY time_exchange, seq)) AS size FROM l""", "book4")


@query("T2_order_level_states", "SELECT * FROM states4", "states4")
def _(t: Tables):
    return bk.order_level_states(book4(t), strict=False)


@query("T4_order_level_l1", """WITH e AS (SELECT market, epoch, lead(s) OVER (PARTITION BY market ORDER BY epoch) AS en FROM (SELECT market, epoch, min(time_exchange) AS s FROM states4 GROUP BY 1, 2)),
    i AS (SELECT market, epoch, side, price, time_exchange AS a, size, lead(time_exchange) OVER (PARTITION BY market, epoch, side, price ORDER BY time_exchange, seq) AS nx FROM states4), v AS (SELECT i.*, coalesce(nx, en) AS z FROM i JOIN e USING (market, epoch)), b AS (SELECT DISTINCT market, time_exchange FROM states4)
    SELECT b.market, b.time_exchange, max(price) FILTER (side = 'bid') AS best_bid_px, arg_max(size, price) FILTER (side = 'bid') AS best_bid_sx, min(price) FILTER (side = 'ask') AS best_ask_px, arg_min(size, price) FILTER (side = 'ask') AS best_ask_sx
    FROM b LEFT JOIN v ON v.market = b.market AND v.size > 0 AND v.a <= b.time_exchange AND (v.z IS NULL OR b.time_exchange < v.z) GROUP BY 1, 2""", "states4")
def _(t: Tables):
    return bk.l1_after_batches(bk.order_level_states(book4(t), strict=False))


add_view("intervals4", """WITH e AS (SELECT market, epoch, lead(s) OVER (PARTITION BY market ORDER BY epoch) AS en FROM (SELECT market, epoch, min(time_exchange) AS s FROM states4 GROUP BY 1, 2)),
    i AS (SELECT market, epoch, side, price, time_exchange AS from_time, size, lead(time_exchange) OVER (PARTITION BY market, epoch, side, price ORDER BY time_exchange, seq) AS nx FROM states4)
    SELECT market, epoch, side, price, from_time, coalesce(nx, en) AS to_time, size FROM i JOIN e USING (market, epoch)""", "states4")


@query("T5_order_level_depth", f"SELECT * FROM (SELECT b.market, b.time_exchange, side, {_LV.replace('market', 'b.market').replace('time_exchange', 'b.time_exchange')} AS level, price, size FROM (SELECT DISTINCT market, time_exchange FROM states4) b JOIN intervals4 i ON i.market = b.market AND i.size > 0 AND i.from_time <= b.time_exchange AND (i.to_time IS NULL OR b.time_exchange < i.to_time)) WHERE level <= 3", "intervals4")
def _(t: Tables):
    return bk.depth_after_batches(bk.order_level_states(book4(t), strict=False), 3)


@query("T6_order_level_sampled", f"""WITH s AS (SELECT DISTINCT market, start_time AS ts FROM shocks), h AS (SELECT s.market, s.ts AS time_exchange, i.side, i.price, i.size, (SELECT max(time_exchange) FROM states4 x WHERE x.market = s.market AND x.time_exchange <= s.ts) AS depth_source_time
      FROM s JOIN intervals4 i ON i.market = s.market AND i.size > 0 AND i.from_time <= s.ts AND (i.to_time IS NULL OR s.ts < i.to_time))
    SELECT * FROM (SELECT market, time_exchange, depth_source_time, side, {_LV} AS level, price, size FROM h) WHERE level <= 4""", "intervals4 shocks")
def _(t: Tables):
    return bk.sample_depth(bk.order_level_states(book4(t), strict=False), t.shocks.select("market", F.col("start_time").alias("sample_time")), 4)


_PRE = 3 * 3600
add_view("anatomy", """WITH n AS (SELECT s.event_id, avg(m.microprice) FILTER (m.time_exchange < s.start_time) AS pm, count(m.microprice) FILTER (m.time_exchange < s.start_time) AS pc,
      arg_min({'t': m.time_exchange, 'p': m.microprice}, (CASE WHEN s.direction = 'SELL' THEN m.microprice ELSE -m.microprice END, m.time_exchange)) FILTER (m.time_exchange >= s.start_time) AS x
      FROM shocks s JOIN micro m ON m.market = s.market AND m.time_exchange BETWEEN s.start_time - INTERVAL 3 HOUR AND s.end_time GROUP BY 1),
    o AS (SELECT s.*, n.pm, coalesce(n.pc, 0) AS pc, n.x.t AS ot, greatest(0, CASE WHEN direction = 'SELL' THEN pm - n.x.p ELSE n.x.p - pm END) AS op, n.x.p AS xp FROM shocks s LEFT JOIN n USING (event_id)),
    p AS (SELECT *, CASE WHEN pm IS NULL OR xp IS NULL THEN NULL ELSE op END AS over FROM o),
    b AS (SELECT p.event_id, min(m.time_exchange) AS back FROM p JOIN micro m ON m.market = p.market AND m.time_exchange BETWEEN p.ot AND p.end_time + INTERVAL 3 HOUR WHERE over > 0 AND CASE WHEN direction = 'SELL' THEN m.microprice >= pm - over / 2 ELSE m.microprice <= pm + over / 2 END GROUP BY 1)
    SELECT event_id, market, direction, pm AS pre_event_microprice_mean, pc AS pre_event_observation_count, over AS overshoot_price, over / pm * 10000 AS overshoot_bps, CASE WHEN over IS NOT NULL THEN ot END AS overshoot_time,
      (epoch_us(back) - epoch_us(ot)) / 1e6::DOUBLE AS reversion_half_life_seconds, coalesce(over > 0, false) AND back IS NULL AS reversion_censored, coalesce(over <= 0, false) AS zero_overshoot, (epoch_us(end_time) - epoch_us(start_time)) / 1e6::DOUBLE AS duration_seconds FROM p LEFT JOIN b USING (event_id)""", "shocks micro")
add_view("walk", f"""WITH s AS (SELECT DISTINCT market, start_time AS ts FROM shocks), h AS (SELECT s.market, s.ts, i.side, i.price, i.size FROM s JOIN intervals i ON i.market = s.market AND i.size > 0 AND i.from_time <= s.ts AND (i.to_time IS NULL OR s.ts < i.to_time)),
    d AS (SELECT *, row_number() OVER (PARTITION BY market, ts, side ORDER BY CASE WHEN side = 'bid' THEN -price ELSE price END) AS level FROM h), k AS (SELECT * FROM d WHERE level <= 4),
    e AS (SELECT event_id, market, start_time, CASE WHEN direction = 'SELL' THEN 'bid' ELSE 'ask' END AS side, aggressor_size, (SELECT max(ts) FROM k WHERE k.market = x.market AND k.ts <= x.start_time) AS dt FROM shocks x),
    w AS (SELECT e.*, k.size, greatest(0, least(k.size, aggressor_size - coalesce(sum(k.size) OVER (PARTITION BY event_id ORDER BY level ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM e LEFT JOIN k ON k.market = e.market AND k.ts = e.dt AND k.side = e.side WHERE dt IS NOT NULL)
    SELECT event_id, max(dt) AS depth_snapshot_time, count(*) FILTER (take > 0) AS depth_levels_consumed, coalesce(sum(take), 0) AS depth_size_consumed, coalesce(sum(size), 0) AS depth_size_available, greatest(0, max(aggressor_size) - coalesce(sum(take), 0)) AS depth_size_shortfall FROM w GROUP BY 1""", "intervals shocks")
_AN = ", ".join(f"round({c}, 6) AS {c}" for c in ("pre_event_microprice_mean", "overshoot_price", "overshoot_bps", "reversion_half_life_seconds", "duration_seconds"))


def anatomy_of(t: Tables):
    depth = materialize(depth_samples(t), "depth")
    ev = t.shocks.select("event_id", "market", "start_time", "end_time", "direction", "aggressor_size")
    return ew.cascade_anatomy(ev, microprices(l1_of(t)), depth, pre_s=_PRE, reversion_s=_PRE)


@query("T12_cascade_anatomy", f"SELECT a.* REPLACE ({_AN}), depth_snapshot_time, depth_levels_consumed, depth_size_consumed, depth_size_available, depth_size_shortfall FROM anatomy a LEFT JOIN walk USING (event_id)", "anatomy walk")
def _(t: Tables):
    return anatomy_of(t).drop("start_time", "end_time", "aggressor_size")


@query("A42_conditioning_summary", """SELECT a.market, funding_state, count(*) AS event_n, round(avg(overshoot_bps), 6) AS mean_overshoot_bps, round(avg(reversion_half_life_seconds), 6) AS mean_half_life, count(*) FILTER (reversion_censored) AS censored_count, count(*) FILTER (zero_overshoot) AS zero_overshoot_count
    FROM anatomy a JOIN fund_cond f USING (event_id) GROUP BY 1, 2""", "anatomy fund_cond")
def _(t: Tables):
    f = cn.trailing_funding(t.shocks.select("event_id", "market", "start_time"), t.funding).select("event_id", "funding_state")
    return anatomy_of(t).join(f, "event_id").groupBy("market", "funding_state").agg(
        F.count(F.lit(1)).alias("event_n"), F.avg("overshoot_bps").alias("mean_overshoot_bps"), F.avg("reversion_half_life_seconds").alias("mean_half_life"),
        F.count_if("reversion_censored").alias("censored_count"), F.count_if("zero_overshoot").alias("zero_overshoot_count"))


@query("A42_oracle_summary", """SELECT a.market, krx_state, oracle_regime, count(*) AS event_n, round(avg(oracle_fallback_frequency), 6) AS mean_fallback_frequency, round(avg(overshoot_bps), 6) AS mean_overshoot_bps, round(avg(reversion_half_life_seconds), 6) AS mean_half_life,
    count(*) FILTER (reversion_censored) AS censored_count, count(*) FILTER (zero_overshoot) AS zero_overshoot_count FROM anatomy a JOIN fund_cond f USING (event_id) JOIN oracle_cond o USING (event_id) GROUP BY 1, 2, 3""", "anatomy fund_cond oracle_cond")
def _(t: Tables):
    from tickloom.plans.q_joins import funding_conditioning, oracle_conditioning

    f, o = funding_conditioning(t).select("event_id", "krx_state"), oracle_conditioning(t)
    return anatomy_of(t).join(f, "event_id").join(o, "event_id").groupBy("market", "krx_state", "oracle_regime").agg(
        F.count(F.lit(1)).alias("event_n"), F.avg("oracle_fallback_frequency").alias("mean_fallback_frequency"), F.avg("overshoot_bps").alias("mean_overshoot_bps"),
        F.avg("reversion_half_life_seconds").alias("mean_half_life"), F.count_if("reversion_censored").alias("censored_count"), F.count_if("zero_overshoot").alias("zero_overshoot_count"))


@query("A67_overshoot_tails", """SELECT market, count(overshoot_bps) AS n, round(list_sort(list(overshoot_bps))[round(0.95 * (count(overshoot_bps) - 1))::BIGINT + 1], 6) AS p95, round(max(overshoot_bps), 6) AS max FROM anatomy WHERE direction = 'BUY' AND overshoot_bps IS NOT NULL GROUP BY 1""", "anatomy")
def _(t: Tables):
    from tickloom.functions.quantiles import nearest_rank

    a = anatomy_of(t).filter("direction = 'BUY' and overshoot_bps is not null")
    return a.groupBy("market").agg(F.count("overshoot_bps").alias("n"), F.max("overshoot_bps").alias("max")).join(nearest_rank(a, ["market"], "overshoot_bps", 0.95, "p95"), "market")
