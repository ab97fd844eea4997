"""Market-event tables derived from the driver tables, in Spark and in SQL.

The two definitions of each view are written independently; the SQL text feeds the
checking queries only.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tickloom.functions.rounding import whole
from tickloom.functions.timecols import micros


class Tables:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def span(self) -> tuple[Column, Column]:
        """Start of the first and end of the last hour of the feed, as literals (null for an empty one)."""
        first, last = self.events.agg(F.min("ts"), F.max("ts")).first()
        hour = lambda c: F.date_trunc("hour", F.lit(c).cast("timestamp"))
        return hour(first), hour(last) + F.expr("interval 1 hour")

    @cached_property
    def trades(self) -> DataFrame:
        e = self.events
        return e.select(
            "event_id",
            F.col("event_type").alias("market"),
            F.col("ts").alias("time_exchange"),
            F.timestamp_micros(micros("ts") + (F.col("event_id") % 40 - 3) * 50_000).alias("time_received"),
            (F.lit(100.0) + F.col("value") / F.lit(10.0)).alias("price"),
            (F.lit(1) + F.col("event_id") % 7).cast("double").alias("base_amount"),
            F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("taker_side"),
            F.col("user_id").cast("string").alias("user_taker"),
            F.col("event_id").alias("seq"),
        )

    @cached_property
    def quotes(self) -> DataFrame:
        """One quote per event, mostly some time before it; some one-sided, some crossed."""
        i = F.col("event_id")
        mid = whole(F.lit(100.0) + F.col("value") / F.lit(10.0))
        return self.events.select(
            i.alias("seq"),
            F.col("event_type").alias("market"),
            F.timestamp_micros(micros("ts") - (i % 7) * 90_000_000).alias("time_exchange"),
            F.when(i % 51 == 0, mid + 1).otherwise(mid - 1).alias("best_bid_px"),
            (F.lit(1) + i % 5).cast("double").alias("best_bid_sx"),
            F.when(i % 33 != 0, F.when(i % 51 == 0, mid - 1).otherwise(mid + 1)).alias("best_ask_px"),
            F.when(i % 33 != 0, (F.lit(1) + i % 11).cast("double")).alias("best_ask_sx"),
        )

    @cached_property
    def ticks(self) -> DataFrame:
        """Trades on a whole-number price grid (so that touch prices do trade)."""
        return self.trades.withColumn("price", whole(F.col("price")))

    @cached_property
    def book(self) -> DataFrame:
        """Signed level updates; sizes are whole numbers."""
        i = F.col("event_id")
        kind = (
            F.when(F.floor(i / 50) % 8 == 0, "SNAPSHOT")
            .when(i % 10 < 4, "SET").when(i % 10 < 7, "ADD").when(i % 10 == 7, "SUB").otherwise("DELETE")
        )
        return self.events.select(
            i.alias("seq"),
            F.col("event_type").alias("market"),
            F.col("ts").alias("time_exchange"),
            kind.alias("update_type"),
            (i % 2 == 0).alias("is_buy"),
            (F.lit(100) + F.when(i % 2 == 0, -1 - F.floor(F.col("value")) % 12).otherwise(1 + F.floor(F.col("value")) % 12)).cast("double").alias("entry_px"),
            F.when(i % 10 == 7, F.lit(1.0)).otherwise((F.lit(2) + i % 6).cast("double")).alias("entry_sx"),
        )

    @cached_property
    def funding(self) -> DataFrame:
        """Hourly settlement rates; hours without events leave gaps."""
        return (
            self.events.groupBy(F.col("event_type").alias("market"), F.date_trunc("hour", "ts").alias("hour"))
            .agg(((F.avg("value") - 50) / 97_931).alias("funding_rate"))
            .select("market", (F.col("hour") + F.expr("interval 1 hour")).alias("time_exchange"), "funding_rate")
        )

    @cached_property
    def oracle(self) -> DataFrame:
        i = F.col("event_id")
        price = F.lit(100.0) + F.col("value") / F.lit(10.0)
        return self.events.select(
            i.alias("seq"),
            F.col("event_type").alias("market"),
            F.timestamp_micros(micros("ts") + (i % 4) * 20_000_000).alias("time_exchange"),
            F.when(i % 8 == 1, "Deployer").otherwise("Fallback").alias("update_class"),
            price.alias("oracle_px"),
            (price * (F.lit(1.0) + ((i % 9) - 4) / F.lit(1000.0))).alias("mark_px"),
            (price * (F.lit(1.0) + ((i % 7) - 3) / F.lit(1000.0))).alias("external_perp_px"),
        )

    @cached_property
    def shocks(self) -> DataFrame:
        """Tagged events: the large values, each lasting up to two hours."""
        i, v = F.col("event_id"), F.col("value")
        wallet = lambda k: ((F.col("user_id") + k) % 20).cast("string")
        return self.events.filter(v > 120).select(
            F.concat_ws("-", "event_type", i.cast("string")).alias("event_id"),
            F.col("event_type").alias("market"),
            F.col("ts").alias("start_time"),
            F.timestamp_micros(micros("ts") + (i % 13) * 600_000_000).alias("end_time"),
            F.when(i % 2 == 0, "BUY").otherwise("SELL").alias("direction"),
            (F.lit(1) + i % 9).cast("double").alias("aggressor_size"),
            F.array_sort(F.array_distinct(F.array(wallet(0), wallet(7)))).alias("wallets"),
            (F.lit(3.0) + (i % 5) / F.lit(2.0)).alias("rate_multiple"),
            (F.lit(3.0) + (i % 4) / F.lit(4.0)).alias("displacement_multiple"),
            F.lit("proxy-tagged").alias("tag_label"),
        )

    @cached_property
    def candles_1d(self) -> DataFrame:
        """Daily panel: one market per supplier group and line status."""
        order = F.struct("l_orderkey", "l_linenumber")
        return (
            self.raw("lineitem")
            .withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
            .groupBy(
                F.concat_ws("-", "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 2).cast("string")).alias("market"),
                F.col("l_shipdate").cast("timestamp").alias("time_open"),
            )
            .agg(
                F.min_by("price", order).alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", order).alias("close"),
                F.sum("l_quantity").alias("volume"),
                F.count(F.lit(1)).alias("n"),
            )
        )

    @cached_property
    def candles_1h(self) -> DataFrame:
        order = F.struct("time_exchange", "seq")
        return (
            self.trades.groupBy("market", F.date_trunc("hour", "time_exchange").alias("time_open"))
            .agg(
                F.min_by("price", order).alias("open"),
                F.max("price").alias("high"),
                F.min("price").alias("low"),
                F.max_by("price", order).alias("close"),
                F.sum("base_amount").alias("volume"),
            )
            .withColumn("time_close", F.col("time_open") + F.expr("interval 59 minutes 59 seconds 999 milliseconds"))
        )


# --- the same views for the checking SQL ---------------------------------------
VIEW_SQL: dict[str, str] = {
    "feed": "SELECT date_trunc('hour', min(ts)) AS t0, date_trunc('hour', max(ts)) + INTERVAL 1 HOUR AS t1 FROM events",
    "trades": """SELECT event_id, event_type AS market, ts AS time_exchange,
        make_timestamp(epoch_us(ts) + (event_id % 40 - 3) * 50000) AS time_received,
        100.0::DOUBLE + value / 10.0::DOUBLE AS price, (1 + event_id % 7)::DOUBLE AS base_amount,
        CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS taker_side,
        user_id::VARCHAR AS user_taker, event_id AS seq FROM events""",
    "ticks": "SELECT * REPLACE (round(price) AS price) FROM trades",
    "quotes": """SELECT event_id AS seq, event_type AS market, ts - to_microseconds((event_id % 7) * 90000000) AS time_exchange,
        CASE WHEN event_id % 51 = 0 THEN m + 1 ELSE m - 1 END AS best_bid_px,
        (1 + event_id % 5)::DOUBLE AS best_bid_sx,
        CASE WHEN event_id % 33 = 0 THEN NULL WHEN event_id % 51 = 0 THEN m - 1 ELSE m + 1 END AS best_ask_px,
        CASE WHEN event_id % 33 = 0 THEN NULL ELSE (1 + event_id % 11)::DOUBLE END AS best_ask_sx
        FROM (SELECT *, round(100.0::DOUBLE + value / 10.0::DOUBLE) AS m FROM events)""",
    "book": """SELECT event_id AS seq, event_type AS market, ts AS time_exchange,
        CASE WHEN (event_id // 50) % 8 = 0 THEN 'SNAPSHOT' WHEN event_id % 10 < 4 THEN 'SET'
             WHEN event_id % 10 < 7 THEN 'ADD' WHEN event_id % 10 = 7 THEN 'SUB' ELSE 'DELETE' END AS update_type,
        event_id % 2 = 0 AS is_buy,
        (100 + CASE WHEN event_id % 2 = 0 THEN -1 - floor(value)::BIGINT % 12 ELSE 1 + floor(value)::BIGINT % 12 END)::DOUBLE AS entry_px,
        CASE WHEN event_id % 10 = 7 THEN 1.0 ELSE 2 + event_id % 6 END::DOUBLE AS entry_sx FROM events""",
    "funding": """SELECT event_type AS market, date_trunc('hour', ts) + INTERVAL 1 HOUR AS time_exchange,
        (avg(value) - 50) / 97931 AS funding_rate FROM events GROUP BY 1, 2""",
    "oracle": """SELECT event_id AS seq, event_type AS market, ts + to_microseconds((event_id % 4) * 20000000) AS time_exchange,
        CASE WHEN event_id % 8 = 1 THEN 'Deployer' ELSE 'Fallback' END AS update_class,
        p AS oracle_px, p * (1.0::DOUBLE + (event_id % 9 - 4)::DOUBLE / 1000.0::DOUBLE) AS mark_px,
        p * (1.0::DOUBLE + (event_id % 7 - 3)::DOUBLE / 1000.0::DOUBLE) AS external_perp_px
        FROM (SELECT *, 100.0::DOUBLE + value / 10.0::DOUBLE AS p FROM events)""",
    "shocks": """SELECT event_type || '-' || event_id AS event_id, event_type AS market, ts AS start_time, ts + to_microseconds((event_id % 13) * 600000000) AS end_time,
        CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS direction, (1 + event_id % 9)::DOUBLE AS aggressor_size,
        list_sort(list_distinct([(user_id % 20)::VARCHAR, ((user_id + 7) % 20)::VARCHAR])) AS wallets,
        3.0::DOUBLE + (event_id % 5)::DOUBLE / 2 AS rate_multiple, 3.0::DOUBLE + (event_id % 4)::DOUBLE / 4 AS displacement_multiple,
        'proxy-tagged' AS tag_label FROM events WHERE value > 120""",
    "candles_1d": """SELECT concat_ws('-', l_returnflag, l_linestatus, (l_suppkey % 2)::VARCHAR) AS market,
        l_shipdate::TIMESTAMP AS time_open,
        arg_min(p, (l_orderkey, l_linenumber)) AS open, max(p) AS high, min(p) AS low,
        arg_max(p, (l_orderkey, l_linenumber)) AS close, sum(l_quantity) AS volume, count(*) AS n
        FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2""",
    "candles_1h": """SELECT market, date_trunc('hour', time_exchange) AS time_open,
        arg_min(price, (time_exchange, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (time_exchange, seq)) AS close, sum(base_amount) AS volume,
        date_trunc('hour', time_exchange) + INTERVAL '59 minutes 59 seconds 999 milliseconds' AS time_close
        FROM trades GROUP BY market, date_trunc('hour', time_exchange)""",
}
_NEEDS = {"ticks": ["trades"], "candles_1h": ["trades"]}


def add_view(name: str, sql: str, needs: str = "") -> None:
    """Let a query module name a longer SQL view once."""
    VIEW_SQL[name] = sql
    _NEEDS[name] = needs.split()


def with_views(names: list[str], sql: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        for d in _NEEDS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    body = sql.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in order)
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
