"""Streaming queries, run over the event table as a stream."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import functions as F

from tickloom.plans.bindings import Tables
from tickloom.plans.q_bars import _HIST, BURST, H6
from tickloom.plans.registry import query
from tickloom.session import shared_dir
from tickloom.streaming import jobs


def stream_tables(t: Tables) -> SimpleNamespace:
    """The same views, over the event table read as a stream."""
    s = Tables(t.spark, t.dir)
    raw = t.spark.readStream.schema(t.raw("events").schema).parquet(f"{t.dir}/events*.parquet")
    s.__dict__["events"] = raw.withColumn("ts", F.col("ts").cast("timestamp"))
    return s


@query("R1_streaming_ohlcv", """SELECT market, time_bucket(INTERVAL '6 hours', time_exchange) AS bar, round(arg_min(price, (time_exchange, seq)), 6) AS open, round(max(price), 6) AS high, round(min(price), 6) AS low, round(arg_max(price, (time_exchange, seq)), 6) AS close, sum(base_amount) AS volume
    FROM trades GROUP BY 1, 2 HAVING time_bucket(INTERVAL '6 hours', any_value(time_exchange)) + INTERVAL 6 HOUR <= (SELECT max(time_exchange) - INTERVAL 1 HOUR FROM trades)""", "trades")
def _(t: Tables):
    return jobs.run_to_table(t.spark, jobs.ohlcv(stream_tables(t).trades, "6 hours", "1 hour"), "ohlcv")


@query("R2_streaming_book_l1", """SELECT b.market, b.time_exchange, max(price) FILTER (side = 'bid') AS best_bid_px, arg_max(size, price) FILTER (side = 'bid') AS best_bid_sx, min(price) FILTER (side = 'ask') AS best_ask_px, arg_min(size, price) FILTER (side = 'ask') AS best_ask_sx, 0::BIGINT AS late
    FROM (SELECT DISTINCT market, time_exchange FROM states) b LEFT JOIN live_levels l USING (market, time_exchange) GROUP BY 1, 2""", "live_levels")
def _(t: Tables):
    beat = jobs.Heartbeat(t.spark)
    return jobs.run_to_table(t.spark, jobs.book_l1(stream_tables(t).book, beat), "book", lambda: beat.end(t.span[1] + F.expr("interval 1 hour")))


@query("R3_streaming_bursts", f"""SELECT market, bucket, direction, trade_count, trailing_median_trade_rate AS median_rate, round(price_displacement, 6) AS displacement, round(trailing_return_sigma, 6) AS sigma, 0::BIGINT AS late FROM candidates
    WHERE trailing_median_trade_rate > 0 AND trailing_return_sigma > 0 AND trade_count >= 1.1 * trailing_median_trade_rate AND price_displacement >= 0.4 * trailing_return_sigma""", "candidates")
def _(t: Tables):
    beat = jobs.Heartbeat(t.spark)
    s = jobs.burst_candidates(stream_tables(t).trades, beat, bucket_s=H6, history=_HIST, rate_multiple=BURST["rate_multiple"], sigma_multiple=BURST["sigma_multiple"])
    return jobs.run_to_table(t.spark, s, "bursts", lambda: beat.end(t.span[1] + F.expr("interval 1 day")))


@query("R4_streaming_dedup", "SELECT market, count(*) AS n, round(sum(price), 6) AS total FROM trades GROUP BY 1", "trades")
def _(t: Tables):
    doubled = stream_tables(t).trades.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy")).drop("copy")
    rows = jobs.run_to_table(t.spark, jobs.drop_duplicate_prints(doubled, ["market", "seq"], "1 day"), "dedup")
    return rows.groupBy("market").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


@query("R5_idempotent_append", "SELECT 'daily' AS strategy, strftime(ts, '%Y-%m-%d') AS date, event_type AS market, max(value) AS peak FROM events GROUP BY ALL")
def _(t: Tables):
    base = f"{shared_dir(t.spark)}/signals-{uuid.uuid4().hex}"
    shape = lambda b: b.groupBy(F.lit("daily").alias("strategy"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("market")).agg(F.max("value").alias("peak"))
    for attempt in ("first", "again"):  # the second run must add nothing
        jobs.append_signals(stream_tables(t).events, f"{base}/data", f"{base}/{attempt}", ["strategy", "date", "market"], shape)
    return t.spark.read.schema("strategy string, date string, market string, peak double").parquet(f"{base}/data")
