"""Partitioned gz-CSV archive: keys, scans by feed and era, inventory, salvage, sink."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

# Archive layout, era names and column lists of the feeds.
KEY = r"T-([^/]+)/D-(\d{8}(?:\d{2})?)/E-([^/]+)/IDDI-([^+/]+)(?:\+SC-([^+/]+))?\+S-(.+?)\.csv\.gz$"
WHOLE = r"T-([^/]+)/D-(\d{8}(?:\d{2})?)/E-([^/]+)\.csv\.gz$"
ERAS = {"l2": "HYPERLIQUID", "l4": "HYPERLIQUIDL4"}
TRADES_L2 = "time_exchange time_coinapi guid price base_amount taker_side id_exch_guid id_exch_int_inc order_id_maker order_id_taker".split()
FEEDS = {
    ("TRADES", "l2"): TRADES_L2,
    ("TRADES", "l4"): [*TRADES_L2, "user_taker", "user_maker"],
    ("QUOTES", "l2"): "time_exchange time_coinapi ask_px ask_sx bid_px bid_sx".split(),
    ("QUOTES", "l4"): "time_exchange time_coinapi ask_px ask_sx bid_px bid_sx".split(),
    ("LIMITBOOK_FULL", "l2"): "time_exchange time_coinapi is_buy update_type entry_px entry_sx".split(),
    ("LIMITBOOK_FULL", "l4"): "time_exchange time_coinapi is_buy update_type entry_px entry_sx order_id is_trigger order_type hl4_status".split(),
    ("HLORACLEPRICES", "l4"): "time_exchange time_coinapi coin_id update_class mark_px oracle_px external_perp_px".split(),
}
FLOATS = {"price", "base_amount", "ask_px", "ask_sx", "bid_px", "bid_sx", "entry_px", "entry_sx", "mark_px", "oracle_px", "external_perp_px"}
BOOLS = {"is_buy", "is_trigger"}
TIMES = ("time_exchange", "time_coinapi")


def market_name(coin: Column) -> Column:
    """``DEX:asset`` becomes ``dex:asset``; a bare coin stays as it is."""
    parts = F.split(coin, ":", 2)
    return F.when(F.size(parts) == 2, F.concat_ws(":", F.lower(parts[0]), F.element_at(parts, -1))).otherwise(coin)


def bare_coin(market: Column) -> Column:
    return F.element_at(F.split(market, ":"), -1)


def era_of(exchange: Column) -> Column:
    return F.when(exchange == "HYPERLIQUID", "l2").when(exchange == "HYPERLIQUIDL4", "l4").otherwise(F.lower(exchange))


def parse_key(path: Column | str) -> dict[str, Column]:
    """Partition columns from a file path; whole-exchange files get market ``all``."""
    p = F.col(path) if isinstance(path, str) else path
    hit = p.rlike(KEY)
    part = lambda i, j: F.when(hit, F.regexp_extract(p, KEY, i)).otherwise(F.regexp_extract(p, WHOLE, j)) if j else F.when(hit, F.regexp_extract(p, KEY, i))
    exchange = part(3, 3)
    coin = F.regexp_replace(F.when(hit, F.regexp_extract(p, KEY, 6)), "__003A", ":")
    # a name bound by ``transform`` is matched once a row, however often the rule of the market uses it
    market = F.get(F.transform(F.array(coin), lambda c: F.when(c.isNull(), "all").otherwise(market_name(c))), 0)
    return {
        "feed": part(1, 1), "partition": part(2, 2), "exchange": exchange, "era": era_of(exchange), "iddi": part(4, 0),
        "symbol": F.nullif(part(5, 0), F.lit("")), "coin": coin, "market": market,
        "day": F.to_date(F.substring(part(2, 2), 1, 8), "yyyyMMdd"),
    }


def with_key(df: DataFrame, path: Column | str, names: Sequence[str]) -> DataFrame:
    cols = parse_key(path)
    return df.select("*", *[cols[n].alias(n) for n in names])


def scan(spark: SparkSession, root: str, feed: str, era: str, columns: Sequence[str] | None = None, *, salvage: bool = False) -> DataFrame:
    """One feed and era as a typed table with ``market``, ``partition`` and ``file``.

    Unknown columns are an error.  Limit-book rows of the daily era carry times of
    day, which get the date of their partition.  With ``salvage`` only files that
    decompress to the end are kept: a broken file is left out whole.
    """
    if (feed, era) not in FEEDS:
        raise ValueError(f"no layout for feed {feed!r} in era {era!r}")
    layout = FEEDS[feed, era]
    wanted = list(columns) if columns is not None else layout
    absent = [c for c in wanted if c not in layout]
    if absent:
        raise ValueError(f"columns absent from {feed} header: {absent}")
    schema = ", ".join(f"`{c}` {'double' if c in FLOATS else 'string'}" for c in layout)
    path = f"{root}/T-{feed}/D-*/E-{ERAS[era]}/*.csv.gz"
    reader = spark.read.schema(schema).option("sep", ";").option("header", True).option("mode", "PERMISSIVE")
    if salvage:
        reader = reader.option("ignoreCorruptFiles", True)
    raw = reader.csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    keyed = with_key(raw, "file", ("market", "partition", "day"))
    cols = []
    for c in wanted:
        if c in TIMES:
            v = F.col(c)
            if feed == "LIMITBOOK_FULL":
                v = F.when(F.instr(v, "-") > 0, v).otherwise(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit("T"), v))
            cols.append(v.cast("timestamp").alias(c))
        elif c in BOOLS:
            cols.append(F.col(c).cast("int").cast("boolean").alias(c))
        else:
            cols.append(F.col(c))
    out = keyed.select("market", "partition", "day", *cols, "file")
    if salvage:
        good = file_validity(spark, path).filter("ok").select("file")
        out = out.join(good, "file", "left_semi")
    return out


def scan_trades(spark: SparkSession, root: str, era: str, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return scan(spark, root, "TRADES", era, columns, **kw)


def scan_quotes(spark: SparkSession, root: str, era: str, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return scan(spark, root, "QUOTES", era, columns, **kw)


def scan_book_events(spark: SparkSession, root: str, era: str, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return scan(spark, root, "LIMITBOOK_FULL", era, columns, **kw)


def scan_oracle_prices(spark: SparkSession, root: str, columns: Sequence[str] | None = None, **kw) -> DataFrame:
    return scan(spark, root, "HLORACLEPRICES", "l4", columns, **kw)


def scan_both_eras(spark: SparkSession, root: str, feed: str, columns: Sequence[str], **kw) -> DataFrame:
    """Union of the eras; columns an era lacks are null."""
    parts = []
    for era in ("l2", "l4"):
        layout = FEEDS.get((feed, era), [])
        parts.append(scan(spark, root, feed, era, [c for c in columns if c in layout], **kw).withColumn("era", F.lit(era)))
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


def scan_flat_file(spark: SparkSession, path: str) -> DataFrame:
    """Any single file: feed and era from its path, plain CSV for other layouts."""
    import re

    m = re.search(KEY, path)
    era = next((e for e, x in ERAS.items() if m and x == m.group(3)), None)
    if m and (m.group(1), era) in FEEDS:
        root = path[: path.index(f"/T-{m.group(1)}/")]
        name = os.path.basename(path)
        return scan(spark, root, m.group(1), era).filter(F.col("file").endswith(f"/D-{m.group(2)}/E-{m.group(3)}/{name}"))
    df = spark.read.option("sep", ";").option("header", True).csv(path)
    return df.select(*[F.col(c).cast("timestamp").alias(c) if c in TIMES else F.col(c) for c in df.columns])


def file_table(spark: SparkSession, root: str, feed: str = "*") -> DataFrame:
    """Path, size and parsed key of every archive file; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv.gz").load(f"{root}/T-{feed}")
    return with_key(files.select(F.col("path").alias("file"), F.col("length").alias("size_bytes")), "file", ("feed", "partition", "era", "market", "day"))


def feed_inventory(files: DataFrame, by: Sequence[str] = ("feed",)) -> DataFrame:
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"), F.min("day").alias("first_day"), F.max("day").alias("last_day"),
        F.sort_array(F.collect_set("era")).alias("eras"), F.countDistinct("market").alias("markets"), F.countDistinct("partition").alias("partitions"),
    )


def partition_gaps(files: DataFrame, step_hours: int = 24) -> DataFrame:
    """Files, first and last partition and irregular steps per market (one row per file)."""
    at = F.to_timestamp(F.rpad("partition", 10, "0"), "yyyyMMddHH")
    f = files.select("market", "partition", at.alias("at"))
    w = Window.partitionBy("market").orderBy("at")
    gap = F.unix_timestamp("at") - F.lag(F.unix_timestamp("at"), 1).over(w) != step_hours * 3600
    return f.withColumn("_g", gap).groupBy("market").agg(
        F.count(F.lit(1)).alias("files"), F.min("partition").alias("first_partition"), F.max("partition").alias("last_partition"), F.count_if("_g").alias("partition_gaps")
    )


def _gunzip_ok(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ok = []
        for content in pdf["content"]:
            data, good = memoryview(content), len(content) > 0
            try:
                d = zlib.decompressobj(wbits=31)
                while len(data):
                    d.decompress(data)
                    if not d.eof:
                        good = False
                        break
                    data = memoryview(d.unused_data)
                    d = zlib.decompressobj(wbits=31)
            except zlib.error:
                good = False
            ok.append(good)
        yield pd.DataFrame({"file": pdf["path"], "ok": ok})


def file_validity(spark: SparkSession, path: str) -> DataFrame:
    """Whether each gz file decompresses to its end, one file per row."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(_gunzip_ok, "file string, ok boolean")


# --- sink ------------------------------------------------------------------------
LINES_PER_TASK = 250_000  # lines that one task sorts, unless one file holds more


def write_archive(rows: DataFrame, root: str) -> DataFrame:
    """Write (rel, header, line, pos) rows to gz files, one task per file.

    A file appears under its name only when complete, so a retried task replaces
    nothing but its own work.  ``cut`` marks files to leave truncated (fixtures).
    """

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import gzip
        import uuid

        current, handle, tmp, cut = None, None, None, False
        done = []

        def close():
            handle.close()
            if cut:
                with open(tmp, "r+b") as f:
                    f.truncate(max(20, os.path.getsize(tmp) // 2))
            os.replace(tmp, os.path.join(root, current))
            done.append(current)

        for pdf in batches:
            for rel, header, line, c in zip(pdf["rel"], pdf["header"], pdf["line"], pdf["cut"]):
                if rel != current:
                    if handle:
                        close()
                    current, cut = rel, bool(c)
                    target = os.path.join(root, rel)
                    os.makedirs(os.path.dirname(target), exist_ok=True)
                    tmp = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}.tmp")
                    handle = gzip.open(tmp, "wt")
                    handle.write(header + "\n")
                handle.write(line + "\n")
        if handle:
            close()
        if done:  # a task may get no file
            yield pd.DataFrame({"rel": done})

    tasks = max(1, -(-rows.count() // LINES_PER_TASK))  # a given number, or small partitions would be merged again
    ordered = rows.select("rel", "header", "line", "pos", "cut").repartition(tasks, "rel").sortWithinPartitions("rel", "pos")
    return ordered.mapInPandas(write, "rel string")
