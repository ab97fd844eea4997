"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

import math
import statistics
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickloom.session import materialize, shared_dir


def run_to_table(spark: SparkSession, stream: DataFrame, name: str, ending: Callable[[], None] | None = None) -> DataFrame:
    """Process what is available now into a parquet table and read it back.

    ``ending`` is called once the input is used up, to add what closes it (``Heartbeat.end``); the stream then goes on from its
    checkpoint.
    """
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for step in (None, ending, ending) if ending else (None,):  # a batch sees the watermark of the one before it
        if step:
            step()
        q = (
            stream.writeStream.format("parquet").option("path", f"{base}/data").option("checkpointLocation", f"{base}/log")
            .outputMode("append").trigger(availableNow=True).start()
        )
        q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


class Heartbeat:
    """A stream of times without rows, which moves the clock on when a feed has ended or gone quiet.

    Timers close what is open once the watermark passes it; a watermark moves only with input.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/beats-{uuid.uuid4().hex}"
        spark.createDataFrame([], "time_exchange timestamp").write.parquet(self.path)

    def beside(self, rows: DataFrame, lateness: str) -> DataFrame:
        """The rows and the beats (rows of nulls but for the time), under one watermark."""
        beats = self.spark.readStream.schema("time_exchange timestamp").parquet(self.path)
        return rows.unionByName(beats, allowMissingColumns=True).withWatermark("time_exchange", lateness)

    @staticmethod
    def rows(both: DataFrame) -> DataFrame:
        """Without the beats. The condition names the event time, or it would be moved below the watermark and no beat counted."""
        return both.filter(F.unix_micros("time_exchange") * 0 + F.col("market").isNotNull().cast("int") == 1)

    def end(self, at: Column) -> None:
        self.spark.range(1).select(at.cast("timestamp").alias("time_exchange")).write.mode("append").parquet(self.path)


def stateful(spark: SparkSession) -> None:
    """Map states and timers need the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def ohlcv(trades: DataFrame, every: str, lateness: str) -> DataFrame:
    """Tumbling bars, emitted once the watermark has passed their end."""
    order = F.struct("time_exchange", "seq")
    return (
        trades.withWatermark("time_exchange", lateness).groupBy("market", F.window("time_exchange", every))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("base_amount").alias("volume"))
        .select("market", F.col("window.start").alias("bar"), "open", "high", "low", "close", "volume")
    )


def drop_duplicate_prints(trades: DataFrame, keys: Sequence[str], lateness: str) -> DataFrame:
    return trades.withWatermark("time_exchange", lateness).dropDuplicatesWithinWatermark(list(keys))


BOOK_OUT = "market string, time_exchange timestamp, best_bid_px double, best_bid_sx double, best_ask_px double, best_ask_sx double, late long"


class BookKeeper(StatefulProcessor):
    """A market's book as one state entry for each level; of a batch only the touched levels are written back.

    An instant is reported when a later one comes or the watermark has passed it, so two batches that share an instant report it
    once. Rows before the last instant, or of a reported one, are counted as late and never applied.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.levels = handle.getMapState("levels", "buy boolean, price double", "size double")
        self.clock = handle.getValueState("clock", "last long, snapshot boolean, started boolean, open boolean")

    def report(self, market: str, us: int, book: dict) -> tuple:
        bids, asks = book[True], book[False]
        b, a = max(bids, default=None), min(asks, default=None)
        return market, pd.Timestamp(us, unit="us"), b, bids.get(b), a, asks.get(a), 0

    def saved(self) -> dict:
        book: dict = {True: {}, False: {}}
        for (buy, price), (size,) in self.levels.iterator():
            book[buy][price] = size
        return book

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, snapshot, started, open_ = self.clock.get() if self.clock.exists() else (None, False, False, False)
        before = last
        book, touched, cleared, out, late = self.saved(), set(), False, [], {}
        for us, kind, buy, px, sx in in_order(rows):
            if len(out) >= PIECE:
                yield pd.DataFrame(out, columns=L1)
                out = []
            if last is not None and (us < last or (us == last and not open_)):
                late[us] = late.get(us, 0) + 1
                continue
            if us != last:
                if open_ and started:
                    out.append(self.report(key[0], last, book))
                last, open_ = us, True
            if kind == "SNAPSHOT" and not snapshot:
                book, touched, cleared, started = {True: {}, False: {}}, set(), True, True
            snapshot = kind == "SNAPSHOT"
            side = book[buy]
            size = sx if kind in SETS else side.get(px, 0.0) + sx if kind == "ADD" else max(0.0, side.get(px, 0.0) - sx) if kind == "SUB" else 0.0
            if size > 0:
                side[px] = size
            else:
                side.pop(px, None)
            touched.add((buy, px))
        if cleared:
            self.levels.clear()
        for buy, px in touched:
            if px in book[buy]:
                self.levels.updateValue((buy, px), (book[buy][px],))
            elif not cleared:
                self.levels.removeKey((buy, px))
        if last is not None:
            self.clock.update((last, snapshot, started, open_))
            if last != before:
                if before is not None:
                    self.handle.deleteTimer(before // 1000 + 1)
                self.handle.registerTimer(last // 1000 + 1)
        out += [(key[0], pd.Timestamp(us, unit="us"), None, None, None, None, n) for us, n in late.items()]
        yield pd.DataFrame(out, columns=L1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, snapshot, started, open_ = self.clock.get()
        self.clock.update((last, snapshot, started, False))
        yield pd.DataFrame([self.report(key[0], last, self.saved())] if open_ and started else [], columns=L1)

    def close(self) -> None:
        pass


SETS = ("SNAPSHOT", "SET", "CHANGE", "UPDATE")
KINDS = (*SETS, "ADD", "SUB", "DELETE")  # anything else deletes, too
PIECE = 50_000  # rows that are Python objects at a time


def in_order(rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """A batch's level updates by time and ``seq``: held as plain numbers, some forty bytes a row, and handed out piece by piece."""
    columns: dict[str, list[np.ndarray]] = {c: [] for c in ("us", "seq", "kind", "is_buy", "entry_px", "entry_sx")}
    number = {k: i for i, k in enumerate(KINDS)}
    for part in rows:
        if part["is_buy"].isna().any():
            raise ValueError("a level update without a side")
        part = part.assign(kind=part["update_type"].map(number).fillna(number["DELETE"]).astype("int8"), is_buy=part["is_buy"].astype(bool))
        for c, kept in columns.items():
            kept.append(part[c].to_numpy(copy=True))
    whole = {}
    for c in list(columns):
        whole[c] = np.concatenate(columns.pop(c))  # one column is held twice at a time
    order = np.lexsort((whole["seq"], whole["us"]))
    for i in range(0, len(order), PIECE):
        at = order[i : i + PIECE]
        us, kind, buy, px, sx = (whole[c][at].tolist() for c in ("us", "kind", "is_buy", "entry_px", "entry_sx"))
        yield from zip(us, map(KINDS.__getitem__, kind), buy, px, sx, strict=True)


L1 = ["market", "time_exchange", "best_bid_px", "best_bid_sx", "best_ask_px", "best_ask_sx", "late"]


def book_l1(events: DataFrame, beat: Heartbeat, lateness: str = "0 seconds") -> DataFrame:
    """Top of book after each instant; late rows come out counted instead of failing."""
    stateful(beat.spark)
    e = beat.beside(events.select("market", "time_exchange", "seq", "update_type", "is_buy", "entry_px", "entry_sx"), lateness)
    # The copy of the time is no event time: late rows are to be seen, not filtered.
    rows = beat.rows(e).select("market", F.unix_micros("time_exchange").alias("us"), "seq", F.upper("update_type").alias("update_type"), "is_buy", "entry_px", "entry_sx")
    return rows.groupBy("market").transformWithStateInPandas(BookKeeper(), BOOK_OUT, "append", "EventTime")


BURST_OUT = "market string, bucket timestamp, direction string, trade_count long, median_rate double, displacement double, sigma double, late long"
PART = "market string, bucket long, side string, wallet string, n long, lo double, hi double, at long, seq long, close double"


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A partition's trades as one row for each (market, bucket, side, wallet): what a shuffle carries."""
    for rows in batches:
        rows = rows.sort_values(["at", "seq"], kind="stable")
        by = rows.groupby(["market", "bucket", "side", "wallet"], sort=False, dropna=False)
        out = by.agg(n=("price", "size"), lo=("price", "min"), hi=("price", "max"), at=("at", "last"), seq=("seq", "last"), close=("price", "last")).reset_index()
        yield out[["market", "bucket", "side", "wallet", "n", "lo", "hi", "at", "seq", "close"]]


ENDS = {"lo": "double", "hi": "double", "at": "long", "seq": "long", "close": "double"}


class Counts:
    """Trades by (bucket, side, wallet), as plain numbers: names are kept once, equal keys are summed whenever the rows have doubled."""

    def __init__(self, least: int = 500_000):
        self.names: dict[str, int] = {}
        self.parts: list[pd.DataFrame] = []
        self.rows, self.limit, self.least = 0, least, least

    def add(self, part: pd.DataFrame) -> None:
        number = lambda c: np.fromiter((self.names.setdefault(x, len(self.names)) for x in part[c]), "int32", len(part))
        self.parts.append(pd.DataFrame({"bucket": part["bucket"].to_numpy("int64"), "side": number("side"), "wallet": number("wallet"), "n": part["n"].to_numpy("int64")}))
        self.rows += len(part)
        if self.rows > self.limit:
            self.rows = len(self.summed())
            self.limit = max(self.least, 2 * self.rows)

    def summed(self) -> pd.DataFrame:
        self.parts = [pd.concat(self.parts).groupby(["bucket", "side", "wallet"], as_index=False)["n"].sum()]
        return self.parts[0]

    def buckets(self) -> Iterator[tuple[int, dict]]:
        """One bucket's counts at a time as a dictionary."""
        if not self.parts:
            return
        name = list(self.names)
        for bucket, own in self.summed().groupby("bucket"):
            yield int(bucket), {(name[s], name[w]): n for s, w, n in zip(own["side"], own["wallet"], own["n"].tolist(), strict=True)}


class BurstKeeper(StatefulProcessor):
    """Buckets of a market as they close: by the watermark, whether or not the market trades again.

    State: the trailing history (bounded) and, for each open bucket, its trades by side and wallet and its prices by side. Trades of a closed bucket
    come out as rows that count them.
    """

    def __init__(self, bucket_s: int, history: int, rate_multiple: float, sigma_multiple: float):
        self.bucket_s, self.history, self.rate, self.sigma = bucket_s, history, rate_multiple, sigma_multiple

    def init(self, handle) -> None:
        self.handle = handle
        self.past = handle.getValueState("past", "next long, close double, ret array<double>, buy array<long>, sell array<long>")
        self.open = handle.getMapState("open", "bucket long", "side array<string>, wallet array<string>, n array<long>, sides array<string>, " + ", ".join(f"{c} array<{t}>" for c, t in ENDS.items()))

    def ends(self, bucket: int) -> int:
        return (bucket + 1) * self.bucket_s * 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        next_ = self.past.get()[0] if self.past.exists() else None
        late: dict[int, int] = {}
        ends: dict[tuple[int, str], tuple] = {}
        counts = Counts()
        for part in rows:
            if next_ is not None:
                old = part["bucket"] < next_
                for bucket, n in part[old].groupby("bucket")["n"].sum().items():
                    late[bucket] = late.get(bucket, 0) + int(n)
                part = part[~old]
            part = part.assign(side=part["side"].fillna(""), wallet=part["wallet"].fillna("")).sort_values(["at", "seq", "close"], kind="stable")
            by = part.groupby(["bucket", "side"], sort=False).agg(lo=("lo", "min"), hi=("hi", "max"), at=("at", "last"), seq=("seq", "last"), close=("close", "last"))
            for at, *sums in by.itertuples(name=None):
                ends[at] = self.joined(ends.get(at), sums)
            counts.add(part)
        for bucket, own in counts.buckets():
            mine = {side: ends.pop((bucket, side)) for side in {side for side, _ in own}}
            if self.open.containsKey((bucket,)):
                wallets, sides = self.saved(self.open.getValue((bucket,)))
                for k, n in wallets.items():
                    own[k] = own.get(k, 0) + n
                for side, sums in sides.items():
                    mine[side] = self.joined(mine.get(side), sums)
            keys = list(zip(*own, strict=True))
            self.open.updateValue((bucket,), (*map(list, keys), list(own.values()), list(mine), *map(list, zip(*mine.values(), strict=True))))
            self.handle.registerTimer(self.ends(bucket))
        yield pd.DataFrame([(key[0], self.time(b), None, None, None, None, None, n) for b, n in late.items()], columns=BURST)

    @staticmethod
    def joined(one: Sequence | None, two: Sequence) -> tuple:
        """Prices of two parts of a side's trades: the later part has the close."""
        lo, hi, at, seq, close = two
        last = (int(at), int(seq), float(close))
        if one is None:
            return float(lo), float(hi), *last
        return min(float(lo), one[0]), max(float(hi), one[1]), *max(last, tuple(one[2:]))

    @staticmethod
    def saved(row: tuple) -> tuple[dict, dict]:
        """Trades by (side, wallet) and prices by side of an open bucket."""
        side, wallet, n, sides, *sums = row
        return dict(zip(zip(side, wallet, strict=True), n, strict=True)), dict(zip(sides, zip(*sums, strict=True), strict=True))

    def time(self, bucket: int) -> pd.Timestamp:
        return pd.Timestamp(bucket * self.bucket_s, unit="s")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs() // (self.bucket_s * 1000) - 1
        closed = self.past.get()[0] if self.past.exists() else None
        # Most often one bucket closes; after a long pause it is cheaper to ask for all that are open.
        few = closed is not None and upto - closed < self.history
        due = [b for b in range(closed, upto + 1) if self.open.containsKey((b,))] if few else [b for (b,) in list(self.open.keys()) if b <= upto]
        mine: dict[int, dict] = {}
        for bucket in due:
            wallets, sides = self.saved(self.open.getValue((bucket,)))
            mine[bucket] = {side: (sum(each := [n for (s, _), n in wallets.items() if s == side]), max(each), *sums) for side, sums in sides.items()}
            self.open.removeKey((bucket,))
        next_, close, ret, buy, sell = self.past.get() if self.past.exists() else (min(mine, default=upto), None, [], [], [])
        counts = {"BUY": list(buy), "SELL": list(sell)}
        ret, out = list(ret), []
        # A gap longer than the history leaves nothing but empty buckets behind: its first part need not be walked.
        first = min(mine, default=upto)
        if first - next_ > self.history:
            ret, counts = [0.0] * self.history, {s: [0] * self.history for s in counts}
            next_ = first
        for bucket in range(next_, upto + 1):
            own = mine.get(bucket, {})
            for side in ("BUY", "SELL"):
                out += self.judged(key[0], bucket, side, own.get(side), close, ret, counts[side])
            ends = [x[4:] for x in own.values()]
            now = max(ends)[2] if ends else close
            ret = (ret + [math.log(now / close) if close is not None else 0.0])[-self.history :]
            counts = {s: (c + [own[s][0] if s in own else 0])[-self.history :] for s, c in counts.items()}
            close = now
        self.past.update((upto + 1, close, ret, counts["BUY"], counts["SELL"]))
        yield pd.DataFrame(out, columns=BURST)

    def judged(self, market: str, bucket: int, side: str, sums: tuple | None, close: float | None, ret: list, counts: list) -> list[tuple]:
        if sums is None or close is None or len(ret) < self.history:
            return []
        n, most, lo, hi = sums[:4]
        if most < 2:
            return []
        med, sig = float(statistics.median(counts)), statistics.pstdev(ret)
        move = math.log(close / lo) if side == "SELL" else math.log(hi / close)
        good = med > 0 and sig > 0 and n >= self.rate * med and move >= self.sigma * sig
        return [(market, self.time(bucket), side, n, med, move, sig, 0)] if good else []

    def close(self) -> None:
        pass


BURST = ["market", "bucket", "direction", "trade_count", "median_rate", "displacement", "sigma", "late"]


def burst_candidates(trades: DataFrame, beat: Heartbeat, *, bucket_s: int = 60, history: int = 60, rate_multiple: float = 3.0, sigma_multiple: float = 3.0, lateness: str = "0 seconds") -> DataFrame:
    """Bursts as each bucket closes, and the numbers of trades that came too late for theirs."""
    stateful(beat.spark)
    t = beat.rows(beat.beside(trades.select("market", "time_exchange", "seq", "taker_side", "price", "user_taker"), lateness))
    us = F.unix_micros("time_exchange")
    rows = t.select("market", F.floor(us / (bucket_s * 1_000_000)).cast("long").alias("bucket"), F.col("taker_side").alias("side"), F.col("user_taker").alias("wallet"), us.alias("at"), "seq", "price")
    parts = rows.mapInPandas(summed, PART)
    return parts.groupBy("market").transformWithStateInPandas(BurstKeeper(bucket_s, history, rate_multiple, sigma_multiple), BURST_OUT, "append", "EventTime")


def append_signals(stream: DataFrame, target: str, checkpoint: str, keys: Sequence[str], shape: Callable[[DataFrame], DataFrame], part: str = "date") -> None:
    """Append each batch's new keys only, so that repeats and restarts add nothing.

    The table is partitioned by ``part``, one of the keys; a batch reads the partitions that it adds to and no others.
    """

    def write(batch: DataFrame, _batch_id: int) -> None:
        spark = batch.sparkSession
        rows = materialize(shape(batch).dropDuplicates(list(keys)), "signals")
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        fresh = rows
        if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
            mine = [r[0] for r in rows.select(part).distinct().collect()]  # the days of one batch
            have = spark.read.schema(rows.schema).parquet(target).filter(F.col(part).isin(mine)).select(*keys)
            fresh = rows.join(have, list(keys), "left_anti")
        fresh.write.mode("append").partitionBy(part).parquet(target)

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
