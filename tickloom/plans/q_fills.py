"""Quotes, passive fills and markouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators import fills as fl
from tickloom.operators.quotes import drop_crossed, half_spread_bps, microprices, mid, spread_bps, two_sided
from tickloom.operators.sessions import label_sessions
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.registry import query
from tickloom.session import materialize

STUDY_HORIZONS = {"10m": 600, "30m": 1800, "2h": 7200, "6h": 21600, "1d": 86400}
MAX_AGE = 6 * 3600

add_view(
    "l1",
    """SELECT seq, market, time_exchange,
    CASE WHEN best_bid_px > best_ask_px THEN NULL ELSE best_bid_px END AS best_bid_px,
    CASE WHEN best_bid_px > best_ask_px THEN NULL ELSE best_bid_sx END AS best_bid_sx,
    CASE WHEN best_bid_px > best_ask_px THEN NULL ELSE best_ask_px END AS best_ask_px,
    CASE WHEN best_bid_px > best_ask_px THEN NULL ELSE best_ask_sx END AS best_ask_sx FROM quotes""",
    "quotes",
)
add_view(
    "micro",
    """SELECT market, time_exchange, (best_bid_px * best_ask_sx + best_ask_px * best_bid_sx) / (best_ask_sx + best_bid_sx) AS microprice
    FROM l1 WHERE best_bid_px > 0 AND best_bid_sx > 0 AND best_ask_px > 0 AND best_ask_sx > 0 AND best_bid_px <= best_ask_px""",
    "l1",
)
# row-by-row state machine said with windows over (quote, trade) rows
add_view(
    "fills",
    """WITH q AS (SELECT *, coalesce(best_bid_px > 0 AND best_bid_sx > 0 AND best_ask_px > 0 AND best_ask_sx > 0, false) AS ok FROM l1),
    s AS (SELECT market, time_exchange, ok, u.side, CASE WHEN u.side = 'buy' THEN best_bid_px ELSE best_ask_px END AS px,
            CASE WHEN u.side = 'buy' THEN best_bid_sx ELSE best_ask_sx END AS sx
          FROM q, (VALUES ('buy'), ('sell')) AS u(side)),
    c AS (SELECT *, ok AND (lag(ok) OVER w IS NULL OR NOT lag(ok) OVER w OR lag(px) OVER w <> px OR lag(sx) OVER w <> sx) AS opens
          FROM s WINDOW w AS (PARTITION BY market, side ORDER BY time_exchange)),
    e AS (SELECT *, max(CASE WHEN opens THEN time_exchange END) OVER (PARTITION BY market, side ORDER BY time_exchange) AS join_time FROM c),
    t AS (SELECT k.market, k.time_exchange, k.seq, k.price, k.base_amount, e.side, e.px, e.sx, e.join_time
          FROM (SELECT k.*, u.side FROM ticks k, (VALUES ('buy'), ('sell')) AS u(side)) k
          ASOF JOIN e ON k.market = e.market AND k.side = e.side AND k.time_exchange >= e.time_exchange
          WHERE e.ok AND e.time_exchange < k.time_exchange),
    v AS (SELECT *, sum(CASE WHEN price = px THEN base_amount ELSE 0 END) OVER (PARTITION BY market, side, join_time ORDER BY time_exchange, seq) AS at_price FROM t),
    h AS (SELECT *, row_number() OVER (PARTITION BY market, side, join_time ORDER BY time_exchange, seq) AS rn FROM v
          WHERE (side = 'buy' AND price < px) OR (side = 'sell' AND price > px) OR (price = px AND at_price > sx))
    SELECT market, time_exchange AS fill_time, join_time, side, px AS fill_price, price AS filling_print_price,
      base_amount AS filling_print_size, sx AS queue_ahead, at_price AS at_price_cumulative,
      CASE WHEN base_amount > sx THEN 'sweep' ELSE 'trickle' END AS size_bucket FROM h WHERE rn = 1""",
    "l1 ticks",
)
add_view(
    "rates",
    """SELECT market, time_exchange, funding_rate FROM funding UNION ALL
    SELECT market, t0, 0.0::DOUBLE FROM funding, feed GROUP BY market, t0 HAVING min(time_exchange) > t0""",
    "funding feed",
)
_SEG = """CASE WHEN isodow(loc) >= 6 THEN 'weekend'
    WHEN strftime(loc, '%Y-%m-%d') IN ('2024-01-01', '2024-01-15') THEN '{hol}'
    WHEN strftime(loc, '%H:%M:%S') >= '09:30:00' AND strftime(loc, '%H:%M:%S') < '16:00:00' THEN 'RTH' ELSE 'off-hours-weekday' END"""
_LOC = "(({t} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"
_CLUSTER = "market || '|' || strftime(time_bucket(INTERVAL '6 hours', fill_time), '%Y-%m-%dT%H:%M:%S')"


def _markout_sql() -> str:
    joins, cols = [], []
    for i, (k, s) in enumerate(STUDY_HORIZONS.items()):
        joins.append(
            f"ASOF LEFT JOIN micro AS m{i} ON f.market = m{i}.market AND f.fill_time + INTERVAL {s} SECOND >= m{i}.time_exchange"
        )
        stale = (
            f"(en.time_exchange IS NULL OR en.time_exchange < f.fill_time - INTERVAL {MAX_AGE} SECOND OR m{i}.time_exchange IS NULL"
            f" OR m{i}.time_exchange < f.fill_time + INTERVAL {s} SECOND - INTERVAL {MAX_AGE} SECOND)"
        )
        sg = "(CASE WHEN f.side = 'buy' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END)"
        gross = f"{sg} * (m{i}.microprice - fill_price) / fill_price * 10000"
        drift = f"{sg} * r.funding_rate * ({s} / 3600.0::DOUBLE) * 10000"
        cols.append(
            f"""CASE WHEN NOT {stale} THEN m{i}.microprice END AS microprice_{k}, CASE WHEN NOT {stale} THEN {gross} END AS gross_markout_{k}_bps,
            {drift} AS funding_drift_{k}_bps, CASE WHEN NOT {stale} THEN {gross} - 1.5::DOUBLE - {drift} END AS net_markout_{k}_bps, {stale} AS stale_{k}"""
        )
    seg = _SEG.format(hol="off-hours-weekday")
    return f"""SELECT f.market, f.fill_time, f.join_time, f.side, f.fill_price, f.filling_print_price, f.filling_print_size, f.queue_ahead,
      f.at_price_cumulative, f.size_bucket, {seg} AS segment, hour(f.fill_time)::BIGINT AS hour_of_day,
      f.{_CLUSTER.replace('fill_time', 'f.fill_time')} AS cluster_key, 1.5::DOUBLE AS maker_fee_bps, r.funding_rate AS funding_hourly_rate, {', '.join(cols)}
      FROM (SELECT *, {_LOC.format(t='fill_time')} AS loc FROM fills) f
      ASOF JOIN rates r ON f.market = r.market AND f.fill_time >= r.time_exchange
      ASOF LEFT JOIN micro en ON f.market = en.market AND f.fill_time >= en.time_exchange {' '.join(joins)}"""


add_view("markouts", _markout_sql(), "fills micro rates")
_ROUND = ", ".join(
    f"round({c}_{k}{sfx}, 6) AS {c}_{k}{sfx}" for k in STUDY_HORIZONS
    for c, sfx in (("microprice", ""), ("gross_markout", "_bps"), ("funding_drift", "_bps"), ("net_markout", "_bps"))
)


def l1_of(t: Tables):
    return drop_crossed(t.quotes)


def fills_of(t: Tables):
    return fl.touch_fills(l1_of(t), t.ticks)


def markouts_of(t: Tables):
    rates = fl.with_default_rate(t.funding, t.quotes, t.span[0])
    fills = materialize(fills_of(t), "fills")  # far fewer rows than ticks; cuts the plan in two
    return fl.fill_markouts(fills, l1_of(t), rates, horizons=STUDY_HORIZONS, max_quote_age_s=MAX_AGE)


@query("F1_microprice", "SELECT market, time_exchange, round(microprice, 6) AS microprice FROM micro", "micro")
def _(t: Tables):
    return microprices(l1_of(t)).select("market", "time_exchange", "microprice")


@query(
    "F2_spreads",
    """SELECT market, time_exchange, round((best_bid_px + best_ask_px) / 2, 6) AS mid,
    round((best_ask_px - best_bid_px) / ((best_bid_px + best_ask_px) / 2) * 10000, 6) AS spread_bps,
    round((best_ask_px - best_bid_px) / ((best_bid_px + best_ask_px) / 2) * 10000 / 2, 6) AS half_spread_bps
    FROM l1 WHERE best_bid_px <= best_ask_px""", "l1")
def _(t: Tables):
    return l1_of(t).filter(two_sided()).select(
        "market", "time_exchange", mid().alias("mid"), spread_bps().alias("spread_bps"), half_spread_bps().alias("half_spread_bps"))


@query(
    "P7_valid_two_sided",
    """SELECT market, count(*) AS n, count(*) FILTER (best_bid_px > 0 AND best_bid_sx > 0 AND best_ask_px > 0 AND best_ask_sx > 0 AND best_bid_px <= best_ask_px) AS valid,
    count(*) FILTER (best_ask_px IS NULL) AS one_sided FROM quotes GROUP BY market""", "quotes")
def _(t: Tables):
    return t.quotes.groupBy("market").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(two_sided()).alias("valid"), F.count_if(F.col("best_ask_px").isNull()).alias("one_sided"))


@query("P8_crossed_to_null", "SELECT * FROM l1", "l1")
def _(t: Tables):
    return l1_of(t)


@query("T8_touch_fills", "SELECT * FROM fills", "fills")
def _(t: Tables):
    return fills_of(t)


@query("T9_fill_markouts", f"SELECT * REPLACE (round(funding_hourly_rate, 6) AS funding_hourly_rate, {_ROUND}) FROM markouts", "markouts")
def _(t: Tables):
    return markouts_of(t)


@query(
    "T10_session_label",
    f"""SELECT event_id, market, time_exchange, {_SEG.format(hol='holiday')} AS xnys,
    CASE WHEN isodow(kr) >= 6 THEN 'weekend' WHEN strftime(kr, '%Y-%m-%d') = '2024-01-01' THEN 'holiday'
      WHEN strftime(kr, '%H:%M:%S') >= '09:00:00' AND strftime(kr, '%H:%M:%S') < '15:30:00' THEN 'RTH' ELSE 'off-hours-weekday' END AS xkrx
    FROM (SELECT *, {_LOC.format(t='time_exchange')} AS loc, ((time_exchange AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Seoul') AS kr FROM trades)""", "trades")
def _(t: Tables):
    a = label_sessions(t.trades.select("event_id", "market", "time_exchange"), "time_exchange", "XNYS", "xnys")
    return label_sessions(a, "time_exchange", "XKRX", "xkrx")


@query(
    "U5_default_prefix_row",
    """SELECT market, time_exchange, round(funding_rate, 6) AS funding_rate FROM rates""", "rates")
def _(t: Tables):
    return fl.with_default_rate(t.funding, t.quotes, t.span[0])
