"""Archive scans, inventories, sinks and table browsing over data Spark derives."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tickloom.operators import bars as b
from tickloom.plans.bindings import Tables, add_view
from tickloom.plans.registry import query
from tickloom.session import shared_dir
from tickloom.sources import archive as ar, tables as tb

_ROOTS: dict[tuple[str, str], tuple[str, set[str]]] = {}
L4 = ("click", "view")


def _iso(c):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("0"))


def _s(c):
    return F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit(""))


FEEDS = ("TRADES", "QUOTES", "LIMITBOOK_FULL", "HLORACLEPRICES")


def archive_root(t: Tables, *feeds: str) -> str:
    """Write the derived feeds a query reads (all if none are named), each once per session and data folder, as a gz archive."""
    root, written = _ROOTS.setdefault((t.spark.sparkContext.applicationId, t.dir), (f"{shared_dir(t.spark)}/archive-{uuid.uuid4().hex}", set()))
    wanted = [f for f in feeds or FEEDS if f not in written]
    if not wanted:
        return root
    l4 = F.col("market").isin(*L4)
    day = F.date_format("time_exchange", "yyyyMMdd")

    def rel(feed, only_l4=False):
        ex = F.lit("HYPERLIQUIDL4") if only_l4 else F.when(l4, "HYPERLIQUIDL4").otherwise("HYPERLIQUID")
        part = F.concat(day, F.lit("00")) if only_l4 else F.when(l4, F.concat(day, F.lit("00"))).otherwise(day)
        return F.concat(F.lit(f"T-{feed}/D-"), part, F.lit("/E-"), ex, F.lit("/IDDI-1+SC-"), ex, F.lit("_PERP+S-XYZ__003A"), F.col("market"), F.lit(".csv.gz"))

    def lines(df, feed, cols, l2_header, l4_header=None, only_l4=False, extra=()):
        base = F.concat_ws(";", *cols)
        line = F.when(l4, F.concat_ws(";", base, *extra)).otherwise(base) if extra else base
        head = F.when(l4, ";".join(l4_header)).otherwise(";".join(l2_header)) if l4_header else F.lit(";".join(l2_header))
        return df.select(rel(feed, only_l4).alias("rel"), head.alias("header"), line.alias("line"), F.col("seq").alias("pos"), (day == "20240115").alias("cut"))

    tr = lines(t.trades, "TRADES", [_iso("time_exchange"), _iso("time_received"), F.concat(F.lit("g"), _s("seq")), _s("price"), _s("base_amount"), F.col("taker_side"), F.lit(""), F.lit("1"), F.lit(""), F.lit("")],
               ar.FEEDS["TRADES", "l2"], ar.FEEDS["TRADES", "l4"], extra=(F.col("user_taker"), F.lit("m")))
    qu = lines(t.quotes, "QUOTES", [_iso("time_exchange"), _iso("time_exchange"), _s("best_ask_px"), _s("best_ask_sx"), _s("best_bid_px"), _s("best_bid_sx")], ar.FEEDS["QUOTES", "l2"])
    clock = F.concat(F.date_format("time_exchange", "HH:mm:ss.SSSSSS"), F.lit("0"))
    bo = lines(t.book, "LIMITBOOK_FULL", [clock, clock, F.when(F.col("is_buy"), "1").otherwise("0"), F.col("update_type"), _s("entry_px"), _s("entry_sx")],
               ar.FEEDS["LIMITBOOK_FULL", "l2"], ar.FEEDS["LIMITBOOK_FULL", "l4"], extra=(F.concat(F.lit("o"), _s("seq")), F.lit("0"), F.lit("Limit"), F.lit("OPEN")))
    orc = lines(t.oracle, "HLORACLEPRICES", [_iso("time_exchange"), _iso("time_exchange"), F.col("market"), F.col("update_class"), _s("mark_px"), _s("oracle_px"), _s("external_perp_px")], ar.FEEDS["HLORACLEPRICES", "l4"], only_l4=True)
    # only one trade day is left broken, and only in the daily era
    tr = tr.withColumn("cut", F.col("cut") & F.col("rel").contains("E-HYPERLIQUID/"))
    no = lambda d: d.withColumn("cut", F.lit(False))
    lines_of = dict(zip(FEEDS, (tr, no(qu), no(bo), no(orc)), strict=True))
    ar.write_archive(reduce(DataFrame.unionByName, [lines_of[f] for f in wanted]), root).write.parquet(f"{root}-manifest-{uuid.uuid4().hex}")
    written.update(wanted)
    return root


add_view("good_trades", "SELECT * FROM trades WHERE market IN ('click', 'view') OR strftime(time_exchange, '%Y%m%d') <> '20240115'", "trades")


@query("S1_scan_trades", "SELECT 'xyz:' || market AS market, time_exchange, time_received AS time_coinapi, round(price, 6) AS price, base_amount, taker_side, CASE WHEN market IN ('click', 'view') THEN user_taker END AS user_taker FROM good_trades", "good_trades")
def _(t: Tables):
    cols = ["time_exchange", "time_coinapi", "price", "base_amount", "taker_side", "user_taker"]
    return ar.scan_both_eras(t.spark, archive_root(t, "TRADES"), "TRADES", cols, salvage=True).select("market", *cols)


@query("S2_scan_quotes", "SELECT 'xyz:' || market AS market, time_exchange, best_ask_px AS ask_px, best_ask_sx AS ask_sx, best_bid_px AS bid_px, best_bid_sx AS bid_sx FROM quotes", "quotes")
def _(t: Tables):
    cols = ["time_exchange", "ask_px", "ask_sx", "bid_px", "bid_sx"]
    return ar.scan_both_eras(t.spark, archive_root(t, "QUOTES"), "QUOTES", cols).select("market", *cols)


@query("S3_scan_book_events", "SELECT 'xyz:' || market AS market, time_exchange, is_buy, update_type, entry_px, entry_sx FROM book", "book")
def _(t: Tables):
    cols = ["time_exchange", "is_buy", "update_type", "entry_px", "entry_sx"]
    return ar.scan_both_eras(t.spark, archive_root(t, "LIMITBOOK_FULL"), "LIMITBOOK_FULL", cols).select("market", *cols)


@query("S4_scan_oracle_prices", "SELECT 'xyz:' || market AS market, time_exchange, update_class, round(mark_px, 6) AS mark_px, round(oracle_px, 6) AS oracle_px FROM oracle", "oracle")
def _(t: Tables):
    return ar.scan_oracle_prices(t.spark, archive_root(t, "HLORACLEPRICES"), ["time_exchange", "update_class", "mark_px", "oracle_px"]).drop("partition", "day", "file")


@query("S5_scan_flat_file", "SELECT time_exchange, round(price, 6) AS price, user_taker FROM trades WHERE market = 'click' AND strftime(time_exchange, '%Y%m%d') = '20240103'", "trades")
def _(t: Tables):
    f = f"{archive_root(t, "TRADES")}/T-TRADES/D-2024010300/E-HYPERLIQUIDL4/IDDI-1+SC-HYPERLIQUIDL4_PERP+S-XYZ__003Aclick.csv.gz"
    return ar.scan_flat_file(t.spark, f).select("time_exchange", "price", "user_taker")


add_view("files", """SELECT DISTINCT f.feed, CASE WHEN f.feed = 'HLORACLEPRICES' OR m IN ('click', 'view') THEN d || '00' ELSE d END AS partition, CASE WHEN f.feed = 'HLORACLEPRICES' OR m IN ('click', 'view') THEN 'l4' ELSE 'l2' END AS era, 'xyz:' || m AS market, d
    FROM (SELECT 'TRADES' AS feed, market AS m, strftime(time_exchange, '%Y%m%d') AS d FROM trades UNION SELECT 'QUOTES', market, strftime(time_exchange, '%Y%m%d') FROM quotes UNION SELECT 'LIMITBOOK_FULL', market, strftime(time_exchange, '%Y%m%d') FROM book UNION SELECT 'HLORACLEPRICES', market, strftime(time_exchange, '%Y%m%d') FROM oracle) f""", "trades quotes book oracle")


@query("S6_parse_keys", "SELECT feed, partition, CASE era WHEN 'l4' THEN 'HYPERLIQUIDL4' ELSE 'HYPERLIQUID' END AS exchange, era, CASE era WHEN 'l4' THEN 'HYPERLIQUIDL4_PERP' ELSE 'HYPERLIQUID_PERP' END AS symbol, upper(left(market, 3)) || substr(market, 4) AS coin, market FROM files", "files")
def _(t: Tables):
    f = ar.file_table(t.spark, archive_root(t)).select("file")
    return ar.with_key(f, "file", ("feed", "partition", "exchange", "era", "symbol", "coin", "market")).drop("file")


@query("S10_feed_inventory", """SELECT feed, count(*) AS files, strftime(min(strptime(d, '%Y%m%d')), '%Y-%m-%d') AS first_day, strftime(max(strptime(d, '%Y%m%d')), '%Y-%m-%d') AS last_day, string_agg(DISTINCT era, ',' ORDER BY era) AS eras, count(DISTINCT market) AS markets, count(DISTINCT partition) AS partitions, true AS has_bytes FROM files GROUP BY 1""", "files")
def _(t: Tables):
    return ar.feed_inventory(ar.file_table(t.spark, archive_root(t))).withColumn("has_bytes", F.col("size_bytes") > 0).drop("size_bytes")


@query("S11_corrupt_salvage", """SELECT market, count(*) AS rows, CASE WHEN market IN ('xyz:click', 'xyz:view') THEN 0::BIGINT ELSE 1::BIGINT END AS broken_files FROM (SELECT 'xyz:' || market AS market FROM good_trades) GROUP BY 1""", "good_trades")
def _(t: Tables):
    root = archive_root(t, "TRADES")
    rows = ar.scan_both_eras(t.spark, root, "TRADES", ["time_exchange", "price"], salvage=True).groupBy("market").agg(F.count(F.lit(1)).alias("rows"))
    bad = ar.with_key(ar.file_validity(t.spark, f"{root}/T-TRADES/D-*/E-*/*.csv.gz"), "file", ("market",)).groupBy("market").agg(F.count_if(~F.col("ok")).alias("broken_files"))
    return rows.join(bad, "market", "left")


@query("S13_first_partition_wins", "SELECT market, day, any_value(era) FILTER (era = mn) AS era FROM (SELECT market, d AS day, era, min(era) OVER (PARTITION BY market, d) AS mn FROM files WHERE feed IN ('TRADES', 'HLORACLEPRICES')) GROUP BY 1, 2", "files")
def _(t: Tables):
    f = ar.file_table(t.spark, archive_root(t)).filter(F.col("feed").isin("TRADES", "HLORACLEPRICES"))
    x = f.select("market", F.substring("partition", 1, 8).alias("partition"), F.concat_ws("/", "era", "feed").alias("path"), "era")
    return b.first_partition_wins(x).select("market", F.col("partition").alias("day"), "era")


@query("S14_wallet_era_gate", "SELECT 'xyz:' || market AS market, count(*) AS rows, count(*) FILTER (market IN ('click', 'view')) AS with_wallet FROM good_trades GROUP BY 1", "good_trades")
def _(t: Tables):
    r = ar.scan_both_eras(t.spark, archive_root(t, "TRADES"), "TRADES", ["price", "user_taker"], salvage=True)
    return r.groupBy("market").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.col("user_taker"), F.lit("")) != "").alias("with_wallet"))


@query("S19_partition_gaps", "SELECT market, count(*) AS files, min(partition) AS first_partition, max(partition) AS last_partition, count(*) FILTER (date_diff('day', p, strptime(d, '%Y%m%d')) <> 1) AS partition_gaps FROM (SELECT *, lag(strptime(d, '%Y%m%d')) OVER (PARTITION BY market ORDER BY d) AS p FROM files WHERE feed = 'QUOTES') GROUP BY 1", "files")
def _(t: Tables):
    return ar.partition_gaps(ar.file_table(t.spark, archive_root(t, "QUOTES"), "QUOTES"))


@query("S7_projected_parquet", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(t: Tables):
    return tb.scan_parquet(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_orderstatus"])


@query("S8_in_list_pushdown", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def _(t: Tables):
    return tb.scan_members(t.spark, f"{t.dir}/orders.parquet", ["o_orderkey", "o_orderpriority"], "o_orderpriority", ["1-URGENT", "5-LOW"])


@query("S9_dataset_by_name", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(t: Tables):
    return tb.scan_dataset(t.spark, t.dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("S9_dataset_listing", "SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations']) AS name, 'table' AS kind, 1::BIGINT AS files, true AS has_bytes")
def _(t: Tables):
    return tb.list_datasets(t.spark, t.dir).select("name", "kind", "files", (F.col("size_bytes") > 0).alias("has_bytes"))


@query("S15_partitioned_sink", "SELECT event_type AS market, strftime(ts, '%Y-%m-%d') AS date, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    p = f"{shared_dir(t.spark)}/sink-{uuid.uuid4().hex}"
    tb.write_parts(t.events.select(F.col("event_type").alias("market"), F.date_format("ts", "yyyy-MM-dd").alias("date"), "value"), p, ["market", "date"])
    back = t.spark.read.schema("value double, market string, date string").parquet(p)
    return back.groupBy("market", "date").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("S16_resumable_parts", "SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables):
    p = f"{shared_dir(t.spark)}/resume-{uuid.uuid4().hex}"
    rows = t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("date"))
    schema = "event_id long, date string"
    tb.write_parts(rows.filter("date < '2024-01-15'"), p, ["date"])  # a run that stopped half-way
    tb.write_parts(tb.missing_parts(rows, t.spark.read.schema(schema).parquet(p), ["date"]), p, ["date"], mode="append")
    return t.spark.read.schema(schema).parquet(p).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


@query("S17_ledger_default", "SELECT CASE WHEN event_id % 3 = 0 THEN 'raw_lifecycle' ELSE 'residual' END AS strategy, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def _(t: Tables):
    p = f"{shared_dir(t.spark)}/ledger-{uuid.uuid4().hex}"
    t.events.select("event_id", "value", F.when(F.col("event_id") % 3 != 0, "residual").alias("strategy")).write.json(p)
    return tb.read_ledger(t.spark, p, "event_id long, value double, strategy string").groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("S18_rest_panel_normalize", """SELECT event_type AS market, epoch_ms(date_trunc('hour', ts)) AS time_ms, date_trunc('hour', ts) AS time_exchange, round(arg_max(value, event_id) / 1000, 6) AS funding_rate, NULL::DOUBLE AS premium FROM events
    CROSS JOIN feed WHERE date_trunc('hour', ts) >= t0 AND date_trunc('hour', ts) < t1 GROUP BY 1, 2, 3""", "feed")
def _(t: Tables):
    p = f"{shared_dir(t.spark)}/rest-{uuid.uuid4().hex}"
    ms = F.unix_millis(F.date_trunc("hour", "ts"))
    t.events.select(F.col("event_type").alias("coin"), ms.alias("time"), (F.col("value") / 1000).cast("string").alias("fundingRate"), F.col("event_id").alias("fetch_seq")).write.json(p)
    raw = t.spark.read.schema("coin string, time long, fundingRate string, premium string, fetch_seq long").json(p)
    return tb.normalize_funding(raw, *(F.unix_millis(x) for x in t.span))


@query("S18_candle_normalize", """SELECT market, k AS interval, epoch_ms(h) AS open_time_ms, epoch_ms(h) + i % 1000 + 3599000 AS close_time_ms, h AS time_open, round(v, 6) AS open, round(v + 2, 6) AS high, round(v - 2, 6) AS low, round(v + 1, 6) AS close, (i % 7)::DOUBLE AS volume, i % 11 AS trade_count
    FROM (SELECT event_type AS market, CASE WHEN event_id % 2 = 0 THEN '1h' ELSE '2h' END AS k, date_trunc('hour', ts) AS h, arg_max(value, event_id) AS v, max(event_id) AS i FROM events GROUP BY 1, 2, 3)""")
def _(t: Tables):
    p = f"{shared_dir(t.spark)}/candles-{uuid.uuid4().hex}"
    i, v, s = F.col("event_id"), F.col("value"), lambda c: c.cast("string")
    ms = F.unix_millis(F.date_trunc("hour", "ts"))
    own = {"t": ms, "T": ms + i % 1000 + 3_599_000, "s": F.when(i % 3 > 0, F.col("event_type")), "i": F.when(i % 4 > 1, F.when(i % 2 == 0, "1h").otherwise("2h")),
           "o": s(v), "h": s(v + 2), "l": s(v - 2), "c": s(v + 1), "v": s(i % 7), "n": i % 11, "coin": F.col("event_type"), "asked": F.when(i % 2 == 0, "1h").otherwise("2h"), "fetch_seq": i}
    t.events.select(F.to_json(F.struct(*[c.alias(n) for n, c in own.items()])).alias("value")).write.text(p)
    return tb.normalize_candles(tb.read_candle_pages(t.spark, p))


@query("S20_chart_candles", "SELECT epoch(time_open)::BIGINT AS time_s, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, volume FROM candles_1h WHERE market = 'click'", "candles_1h")
def _(t: Tables):
    c = t.candles_1h.select("market", F.unix_millis("time_open").alias("open_time_ms"), "open", "high", "low", "close", F.col("volume").alias("v"))
    return tb.chart_frame(c, "click")


@query("S21_snapshot_rows", "SELECT day, market, round(f / 1000, 6) AS funding, round(oi, 6) AS openInterest, round(px, 6) AS oraclePx, round(oi * px, 6) AS dayNtlVlm FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS market, max(value) AS f, count(*)::DOUBLE AS oi, round(min(value), 2) + 100 AS px FROM events GROUP BY 1, 2)")
def _(t: Tables):
    g = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("name")).agg(F.max("value").alias("f"), F.count(F.lit(1)).cast("double").alias("oi"), (F.round(F.min("value"), 2) + 100).alias("px"))
    s = lambda c: c.cast("string")
    rows = F.collect_list(F.struct("name", s(F.col("f") / 1000).alias("funding"), s(F.col("oi")).alias("openInterest"), s(F.col("px")).alias("oraclePx"), s(F.col("oi") * F.col("px")).alias("dayNtlVlm")))
    day = g.groupBy("day").agg(rows.alias("r"))  # one row per market and day
    payload = F.to_json(F.struct(F.transform("r", lambda x: F.struct(x["name"].alias("name"))).alias("universe"), F.transform("r", lambda x: F.struct(x["funding"].alias("funding"), x["openInterest"].alias("openInterest"), x["oraclePx"].alias("oraclePx"), x["dayNtlVlm"].alias("dayNtlVlm"))).alias("contexts")))
    return tb.snapshot_rows(day.select("day", payload.alias("payload")))


# --- browsing -------------------------------------------------------------------
@query("P1_typed_filters", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice FROM orders WHERE o_totalprice > 200000 AND o_orderpriority LIKE '%URGENT%' AND o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'")
def _(t: Tables):
    o = t.raw("orders")
    for f in ("o_totalprice:gt:200000", "o_orderpriority:contains:URGENT", "o_orderstatus:ne:F", "o_orderdate:ge:1997-01-01"):
        o = tb.selected(o, [f])
    return o.select("o_orderkey", "o_totalprice")


@query("P2_sorted_page", "SELECT o_orderkey, round(o_totalprice, 6) AS o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 50 OFFSET 100)")
def _(t: Tables):
    rows, total = tb.page(t.raw("orders"), number=3, size=50, sort="o_totalprice", order="desc", filters=["o_orderstatus:eq:O"], tie=["o_orderkey"])
    return rows.select("o_orderkey", "o_totalprice").crossJoin(F.broadcast(total))  # one row


@query("P4_file_preview", "SELECT time_exchange, round(price, 6) AS price, (SELECT count(*) FROM trades WHERE market = 'view' AND strftime(time_exchange, '%Y%m%d') = '20240105') AS total FROM (SELECT * FROM trades WHERE market = 'view' AND strftime(time_exchange, '%Y%m%d') = '20240105' ORDER BY time_exchange LIMIT 20)", "trades")
def _(t: Tables):
    f = ar.scan_trades(t.spark, archive_root(t, "TRADES"), "l4", ["time_exchange", "price"]).filter("market = 'xyz:view' and partition = '2024010500'")
    rows, total = tb.page(f, size=20, sort="time_exchange")
    return rows.select("time_exchange", "price").crossJoin(F.broadcast(total))  # one row


@query("P5_finite_or_null", "SELECT event_id, round(CASE WHEN event_id % 4 < 2 THEN value END, 6) AS v FROM events")
def _(t: Tables):
    odd = F.when(F.col("event_id") % 4 == 2, F.lit(float("nan"))).when(F.col("event_id") % 4 == 3, F.lit(float("-inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", tb.finite_or_null(odd).alias("v"))


@query("P10_market_names", "SELECT DISTINCT lower(r_name) || ':' || n_name AS market, n_name AS coin, lower(r_name) AS dex FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t: Tables):
    j = t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(ar.market_name(F.concat_ws(":", "r_name", "n_name")).alias("market")).distinct()
    return j.select("market", ar.bare_coin(F.col("market")).alias("coin"), F.split("market", ":")[0].alias("dex"))


@query("K2_nulls_last_sort", "SELECT event_id, rn FROM (SELECT event_id, row_number() OVER (ORDER BY v DESC NULLS LAST, event_id) AS rn FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS v FROM events)) WHERE rn <= 400")
def _(t: Tables):
    from pyspark.sql import Window

    e = t.events.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("v"))
    rows, _n = tb.page(e, size=400, sort="v", order="desc", tie=["event_id"])
    return rows.select("event_id", F.row_number().over(Window.orderBy(F.col("v").desc_nulls_last(), "event_id")).cast("long").alias("rn"))  # one page


@query("U2_last_per_key", "SELECT market, date_trunc('hour', time_exchange) AS hour, max(time_exchange) AS time_exchange, round(arg_max(best_bid_px, (time_exchange, seq)), 6) AS best_bid_px FROM quotes GROUP BY 1, 2", "quotes")
def _(t: Tables):
    q = t.quotes.select("market", F.date_trunc("hour", "time_exchange").alias("hour"), "time_exchange", "best_bid_px", "seq")
    return tb.last_per_key(q, ["market", "hour"], ["time_exchange", "seq"]).drop("seq")


@query("U1_relaxed_union", "SELECT event_id::DOUBLE AS id, event_type AS kind, NULL AS status FROM events UNION ALL SELECT o_orderkey::DOUBLE, NULL, o_orderstatus FROM orders")
def _(t: Tables):
    a = t.events.select(F.col("event_id").cast("double").alias("id"), F.col("event_type").alias("kind"))
    c = t.raw("orders").select(F.col("o_orderkey").cast("double").alias("id"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(c, allowMissingColumns=True)


@query("U4_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_shipdate FROM lineitem")
def _(t: Tables):
    return t.raw("lineitem").select("l_returnflag", "l_linestatus", "l_shipdate").distinct()
