"""Order-book state as window expressions over level updates.

A snapshot run clears the book, so every run starts an epoch; inside an epoch each
price level evolves on its own.  A level's size is its last set value plus later
adds minus subs, reflected at zero: subtracting from an absent level does nothing
and subtracting too much empties it.  The reflected walk is
``X - min(0, running minimum of X)``, so no row-at-a-time fold is needed, and the
work spreads over (market, epoch, side, price).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.timecols import MICROS, micros
from tickloom.operators.asof import asof_join
from tickloom.operators.fantree import before, ranked, skyline
from tickloom.operators.slicing import DAY, SLICE, Running, fine_slices, lagged, openings, running
from tickloom.session import materialize

SETS = ("SNAPSHOT", "SET", "CHANGE", "UPDATE")
DELETES = ("DELETE", "REMOVE", "DELETE_IF_EXISTS")
IGNORED = ("PENDING", "REJECTED")
TINY = 1e-12
LEVEL = ["market", "epoch", "side", "price"]


def truthy(c: Column) -> Column:
    """Sides and flags arrive as booleans, 0/1 or words."""
    return F.lower(F.trim(c.cast("string"))).isin("1", "true", "t", "yes")


def sliced(events: DataFrame, width_s: int = DAY, rows_per_slice: int = 1_000_000) -> DataFrame:
    """The events in the slices of their market's order; counted on the feed itself, before anything is done to it."""
    return fine_slices(events, ["market"], "time_exchange", "seq", width_s, rows_per_slice)


def with_epochs(events: DataFrame, width_s: int = DAY, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Adds ``epoch``: the sequence number that opened the current snapshot run.

    A snapshot puts many rows into one instant; beyond ``rows_per_slice`` it is cut by
    ``seq``. The slices stay in the result, for the walks that follow.
    """
    e = (events if SLICE in events.columns else sliced(events, width_s, rows_per_slice)).withColumn("update_type", F.upper("update_type"))
    fresh = (F.col("update_type") == "SNAPSHOT") & ~F.coalesce(F.col("_was"), F.lit(False))
    return openings(
        e, ["market"], "time_exchange", {"epoch": fresh}, {"_was": F.col("update_type") == "SNAPSHOT"},
        mark="seq", tie=[F.col("seq")], width_s=width_s,
    )


def trim_before_snapshot(events: DataFrame, keys: tuple[str, ...] = ("market",)) -> DataFrame:
    """Drop rows before a key's first snapshot; keys without one keep nothing."""
    first = events.filter(F.upper("update_type") == "SNAPSHOT").groupBy(*keys).agg(F.min("time_exchange").alias("_first"))
    return events.join(first, list(keys)).filter(F.col("time_exchange") >= F.col("_first")).drop("_first")


def drop_rotated_snapshot(events: DataFrame, keys: tuple[str, ...], position: str) -> DataFrame:
    """Where a file opens with a snapshot later than its earliest row, drop that instant.

    ``position`` is the physical row order inside the file.
    """
    head = events.groupBy(*keys).agg(
        F.min_by(F.struct("time_exchange", F.upper("update_type").alias("t")), position).alias("_h"), F.min("time_exchange").alias("_min")
    ).select(*keys, F.when((F.col("_h.t") == "SNAPSHOT") & (F.col("_h.time_exchange") > F.col("_min")), F.col("_h.time_exchange")).alias("_drop"))
    return events.join(head, list(keys)).filter(F.coalesce(F.col("time_exchange") != F.col("_drop"), F.lit(True))).drop("_drop")


def monotonic_violations(events: DataFrame, keys: tuple[str, ...], position: str, rows_per_slice: int = 1_000_000) -> DataFrame:
    """Rows whose time precedes that of the physically previous row.

    Sliced by position, so that a feed held by one market still spreads out.
    """
    prev = lagged(events, list(keys), F.col(position).cast("long"), {"_p": F.col("time_exchange")}, width_s=max(1, rows_per_slice // MICROS))
    return prev.filter(F.col("_p") > F.col("time_exchange")).drop("_p")


def _reflected(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``prior`` and ``size``: the key's size before and after each row.

    Needs ``set_to`` (null unless the row sets), ``delta`` and the slices of the rows.
    A slice acts on the size it starts with as ``s -> max(s + total, floor)``, or, if
    it holds a set, as a constant; both are known from its last row. Chained over the
    few slices of a key these give every slice its opening size. The walk inside the
    slices is written once, for its ends and for the rows.
    """
    by = [*keys, SLICE]
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    base = rows.filter(known).repartition(*[F.col(k) for k in by])
    w = Window.partitionBy(*by).orderBy("time_exchange", "seq")
    upto = (Window.unboundedPreceding, 0)
    walk = base.withColumn("_seg", F.count("set_to").over(w.rowsBetween(*upto)))
    ws = Window.partitionBy(*by, "_seg").orderBy("time_exchange", "seq").rowsBetween(*upto)
    walk = walk.withColumn("_x", F.sum(F.coalesce("set_to", F.lit(0.0)) + F.col("delta")).over(ws)).withColumn("_m", F.min("_x").over(ws))
    state = F.struct("_seg", "_x", "_m")
    walk = materialize(walk.withColumns({"_p": F.lag(state, 1).over(w), "_next": F.lead(F.lit(True), 1).over(w)}), "walk")
    ends = walk.filter("_next is null").select(*by, state.alias("e"))  # a slice's last row
    fixed = F.col("e._seg") > 0
    chain = ends.select(*by, fixed.alias("_fixed"), F.when(fixed, 0.0).otherwise(F.col("e._x")).alias("_total"), (F.col("e._x") - F.least(F.lit(0.0), F.col("e._m"))).alias("_floor"))
    of_key = Window.partitionBy(*keys).orderBy(SLICE)  # one row for each slice that touches the key
    chain = chain.withColumn("_run", F.count_if("_fixed").over(of_key.rowsBetween(*upto)))
    of_run = Window.partitionBy(*keys, "_run").orderBy(SLICE).rowsBetween(*upto)
    chain = chain.withColumn("_c", F.sum("_total").over(of_run))
    peak = F.max(F.col("_floor") - F.col("_c")).over(of_run)
    chain = chain.withColumn("_end", F.col("_c") + F.when(F.col("_run") == 0, F.greatest(peak, F.lit(0.0))).otherwise(peak))
    opening = chain.select(*by, F.lag("_end", 1).over(of_key).alias("_open")).filter(F.col("_open") > 0)
    open_ = F.coalesce("_open", F.lit(0.0))

    def size(of: str) -> Column:
        seg, x, m = (F.col(f"{of}{c}") for c in ("_seg", "_x", "_m"))
        raw = F.when(seg == 0, open_ + x - F.least(F.lit(0.0), open_ + m)).otherwise(x - F.least(F.lit(0.0), m))
        return F.when(raw <= TINY, F.lit(0.0)).otherwise(raw)

    return walk.join(opening, by, "left").select(*rows.columns, size("").alias("size"), F.coalesce(size("_p."), open_).alias("prior"))


def in_order(events: DataFrame, width_s: int = DAY) -> DataFrame:
    """The events; running it fails where ``seq`` runs against the clock of a market."""
    seen = lagged(events, ["market"], micros("time_exchange"), {"_seq": F.col("seq")}, tie=[F.col("seq")], width_s=width_s)
    back = F.concat(F.lit("book time runs backwards at seq "), F.col("_seq").cast("string"))
    return seen.withColumn("seq", F.when(_must(~(F.col("_seq") > F.col("seq")), back), F.col("seq"))).drop("_seq")


def _must(rule: Column, message: Column | str) -> Column:
    """True where the rule holds or cannot be judged, an error elsewhere."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(rule, F.lit(True)), F.lit(True)).otherwise(F.raise_error(text).cast("boolean"))


def _sound(states: DataFrame, what: str) -> DataFrame:
    """The states; running it fails on sizes that no book can have."""
    sub, at = F.col("update_type") == "SUB", F.concat(F.lit(" at seq "), F.col("seq").cast("string"))
    rules = {
        f"negative size of {what}": F.col("entry_sx") >= 0,
        f"SUB of absent {what}": ~(sub & (F.col("prior") <= 0)),
        f"SUB of more than the {what} holds": ~(sub & (F.col("entry_sx") > F.col("prior") * (1 + TINY) + TINY)),
    }
    for message, rule in rules.items():
        states = states.filter(_must(rule, F.concat(F.lit(message), at)))
    return states


def level_states(events: DataFrame, width_s: int = DAY, rows_per_slice: int = 1_000_000, *, strict: bool = True) -> DataFrame:
    """Each update with its level's size before (``prior``) and after (``size``).

    ``strict`` fails on what a sound feed cannot hold: a negative size, a SUB of an
    absent level or of more than it holds, and time that runs against ``seq``.
    Otherwise the walk forgives them, as ``sanitize`` needs.
    """
    events = sliced(events, width_s, rows_per_slice)
    if strict:
        events = in_order(events, width_s)
    e = with_epochs(events, width_s, rows_per_slice).filter(F.col("epoch").isNotNull())
    u, sx = F.col("update_type"), F.col("entry_sx")
    known = u.isin(*SETS, *DELETES, "ADD", "SUB")
    ok = F.when(known, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unsupported book update_type "), u)).cast("boolean"))
    r = e.filter(ok).select(
        "market", "epoch", F.when(truthy(F.col("is_buy")), "bid").otherwise("ask").alias("side"), F.col("entry_px").alias("price"),
        "time_exchange", "seq", "update_type", "entry_sx", SLICE,
        F.when(u.isin(*SETS), F.greatest(sx, F.lit(0.0))).when(u.isin(*DELETES), F.lit(0.0)).alias("set_to"),
        F.when(u == "ADD", sx).when(u == "SUB", -sx).otherwise(F.lit(0.0)).alias("delta"),
    )
    states = _reflected(r, LEVEL).drop(SLICE)
    return _sound(states, "level") if strict else states


def sanitize(states: DataFrame) -> DataFrame:
    """Drop subs of absent levels and clamp oversize ones; ``fix`` says which."""
    sub = F.col("update_type") == "SUB"
    over = F.col("entry_sx") > F.col("prior") * (1 + TINY) + TINY
    fix = F.when(sub & (F.col("prior") <= 0), "orphan_dropped").when(sub & over, "oversize_clamped").otherwise("kept")
    return states.select("*", fix.alias("fix"), F.when(sub & over, F.col("prior")).otherwise(F.col("entry_sx")).alias("clean_sx"))


def batches(states: DataFrame) -> DataFrame:
    """A level's size after each instant that updates it, as a table: the walk behind ``states`` runs once."""
    return materialize(states.groupBy(*LEVEL, "time_exchange").agg(F.max_by("size", "seq").alias("size")), "batches")


def _lifetimes(batch: DataFrame, mark: Column, width_s: int) -> DataFrame:
    """Each batch of a level with ``_from``, its own mark, and ``_to``, that of the level's next batch or of the next epoch."""
    rows = batch.select(*LEVEL, "time_exchange", "size", mark.alias("_from"))
    starts = rows.groupBy("market", "epoch").agg(F.min("_from").alias("_s"))  # one row per snapshot run
    ends = starts.select("market", "epoch", F.lead("_s", 1).over(Window.partitionBy("market").orderBy("epoch")).alias("_end"))
    j = lagged(rows, LEVEL, -micros("time_exchange"), {"_n": F.col("_from")}, width_s=width_s).join(ends, ["market", "epoch"])
    return j.select(*LEVEL, "size", "_from", F.coalesce("_n", "_end").alias("_to"))


def level_intervals(states: DataFrame, width_s: int = DAY) -> DataFrame:
    """Size of each level over ``[from_time, to_time)``; open ends are null.

    Updates sharing an instant are one batch; an epoch ends where the next begins.
    The next instant of a level is found from behind, in slices of time.
    """
    out = _lifetimes(batches(states), F.col("time_exchange"), width_s)
    return out.select(*LEVEL, F.col("_from").alias("from_time"), F.col("_to").alias("to_time"), "size").filter("to_time is null or from_time < to_time")


def _live(batch: DataFrame, points: DataFrame, width_s: int) -> DataFrame:
    """Levels with the ranks ``[a, b)`` of the points over which they hold a size."""
    placed = before(batch, points, ["market"], micros("time_exchange"), "r", width_s=width_s)
    life = _lifetimes(placed, F.struct("time_exchange", "r"), width_s).filter("size > 0")
    total = points.groupBy("market").agg(F.count(F.lit(1)).alias("_all"))
    return life.join(total, "market").select("market", "side", "price", "size", F.col("_from.r").alias("a"), F.coalesce("_to.r", "_all").alias("b")).filter("a < b")


def _points(batch: DataFrame, width_s: int) -> DataFrame:
    """The instants at which a market's book was touched, ranked."""
    return ranked(batch.select("market", F.col("time_exchange").alias("time")).distinct(), ["market"], "time", width_s=width_s)


def _order(side: str) -> Column:
    return F.when(F.col(side) == "bid", -F.col("price")).otherwise(F.col("price"))


def _best(live: DataFrame, points: DataFrame, n: int) -> DataFrame:
    """``points`` with the best ``n`` bids and asks of each, as arrays of (order, price, size)."""
    items = live.withColumnRenamed("side", "kind")
    return skyline(points, items, ["market"], ("bid", "ask"), F.struct(_order("kind").alias("order"), "price", "size"), n)


def _depth(live: DataFrame, points: DataFrame, levels: int | None) -> DataFrame:
    if levels is None:  # the result is the books themselves, so each level is laid out over its points
        laid = live.select("market", "side", "price", "size", F.explode(F.sequence(F.col("a"), F.col("b") - 1)).alias("r")).join(points, ["market", "r"])
        level = F.row_number().over(Window.partitionBy("market", "r", "side").orderBy(_order("side"))).cast("long")  # levels of one book
        return laid.select("market", F.col("time").alias("time_exchange"), "side", level.alias("level"), "price", "size")
    rows = lambda s: F.transform(s, lambda x, i: F.struct(F.lit(s).alias("side"), (i + 1).cast("long").alias("level"), x["price"].alias("price"), x["size"].alias("size")))
    both = _best(live, points, levels).select("market", F.col("time").alias("time_exchange"), F.explode(F.concat(rows("bid"), rows("ask"))).alias("_x"))
    return both.select("market", "time_exchange", "_x.side", "_x.level", "_x.price", "_x.size")


def l1_after_batches(states: DataFrame, width_s: int = DAY) -> DataFrame:
    """Best bid and ask after every instant; an absent side is null, never zero."""
    batch = batches(states)
    points = _points(batch, width_s)
    top = _best(_live(batch, points, width_s), points, 1)
    of = lambda s, c: F.get(s, 0)[c].alias(f"best_{s}_{'px' if c == 'price' else 'sx'}")
    return top.select("market", F.col("time").alias("time_exchange"), of("bid", "price"), of("bid", "size"), of("ask", "price"), of("ask", "size"))


def depth_after_batches(states: DataFrame, levels: int | None = None, width_s: int = DAY) -> DataFrame:
    """The best levels of both sides after every instant; all of them if ``levels`` is None."""
    if levels is not None and levels < 1:
        raise ValueError("levels must be positive or None")
    batch = batches(states)
    points = _points(batch, width_s)
    return _depth(_live(batch, points, width_s), points, levels)


def sample_depth(states: DataFrame, samples: DataFrame, levels: int | None = None, bucket_s: int = DAY) -> DataFrame:
    """Depth as of requested (market, sample_time), with the batch it comes from.

    Levels meet samples as ranges of sample ranks, so a level that lasts over many samples costs a few rows.
    """
    if levels is not None and levels < 1:
        raise ValueError("levels must be positive or None")
    points = ranked(samples.select("market", F.col("sample_time").alias("time")).distinct(), ["market"], "time", width_s=bucket_s)
    batch = batches(states)
    top = _depth(_live(batch, points, bucket_s), points, levels)
    source = batch.select("market", F.col("time_exchange").alias("depth_source_time")).distinct()
    src = asof_join(points.select("market", F.col("time").alias("time_exchange")), source, ["market"], "time_exchange", "depth_source_time", ["depth_source_time"], prefix="s_", width_s=bucket_s)
    return top.join(src.select("market", "time_exchange", F.col("s_depth_source_time").alias("depth_source_time")), ["market", "time_exchange"]).select(
        "market", "time_exchange", "depth_source_time", "side", "level", "price", "size"
    )


def order_level_states(events: DataFrame, width_s: int = DAY, rows_per_slice: int = 1_000_000, *, strict: bool = True) -> DataFrame:
    """Order-keyed feed folded to price levels, in the shape of ``level_states``.

    Triggers, non-limit and non-open orders never rest; pending and rejected rows
    change nothing.  Every order update moves size between at most two levels.
    ``strict`` also fails on a missing order id and on an ADD that moves an order;
    otherwise rows without an id belong to one order.
    """
    events = sliced(events, width_s, rows_per_slice)
    if strict:
        events = in_order(events, width_s)
    u, sx = F.upper("update_type"), F.col("entry_sx")
    status = F.upper(F.trim(F.coalesce(F.col("hl4_status"), F.lit(""))))
    live = ~F.coalesce(truthy(F.col("is_trigger")), F.lit(False)) & F.coalesce(F.lower(F.trim("order_type")) == "limit", F.lit(True)) & status.isin("", "OPEN")
    keep = ~((u == "SNAPSHOT") & ~live) & ~u.isin(*IGNORED)
    narrow = events.select(  # what a row does, before the feed is written with its epochs
        "market", "time_exchange", "seq", SLICE, "update_type", F.coalesce("order_id", F.lit("\0")).alias("_order"), truthy(F.col("is_buy")).alias("_buy"), F.col("entry_px").alias("_px"), keep.alias("_keep"),
        F.when(u.isin(*SETS), F.when(live, F.greatest(sx, F.lit(0.0))).otherwise(F.lit(0.0))).when(u.isin(*DELETES) | ((u == "ADD") & ~live), F.lit(0.0)).alias("set_to"),
        F.when((u == "ADD") & live, sx).when(u == "SUB", -sx).otherwise(F.lit(0.0)).alias("delta"), *(["order_id", "entry_sx"] if strict else []),
    )
    r = with_epochs(narrow, width_s, rows_per_slice).filter(F.col("epoch").isNotNull() & F.col("_keep")).drop("_keep")
    order, seq = ["market", "epoch", "_order"], [F.col("seq")]
    s = _reflected(r, order)
    places = F.col("update_type").isin(*SETS) | ((F.col("update_type") == "ADD") & (F.col("prior") <= 0))
    placed = F.when(places, F.struct("_buy", "_px"))
    s = s.withColumn("_placed", placed)
    if not strict:  # columns that nobody reads later would run the walk twice
        s = s.select("market", "epoch", "_order", "time_exchange", "seq", SLICE, "prior", "size", "_placed")
    s = running(s, order, micros("time_exchange"), {"_at": Running("last", F.col("_placed")), "_was": Running("last", F.col("_placed"), exclusive=True)}, tie=seq, consume=["_placed"] if not strict else [])
    if strict:
        moves = (F.col("update_type") == "ADD") & (F.col("prior") > 0) & (F.struct("_buy", "_px") != F.struct("_was._buy", "_was._px"))
        s = _sound(s, "order").filter(_must(F.col("order_id").isNotNull(), "book row without an order id")).filter(_must(~moves, F.concat(F.lit("ADD moves order "), "order_id")))
    move = lambda at_, d: F.struct(F.col(f"{at_}._buy").alias("buy"), F.col(f"{at_}._px").alias("price"), d.alias("d"))
    moved = s.select("market", "epoch", "time_exchange", "seq", SLICE, F.explode(F.array(move("_was", -F.col("prior")), move("_at", F.col("size")))).alias("m"))
    lv = moved.filter("m.price is not null").groupBy("market", "epoch", "time_exchange", "seq", SLICE, F.when(F.col("m.buy"), "bid").otherwise("ask").alias("side"), F.col("m.price").alias("price")).agg(F.sum("m.d").alias("d"))
    out = running(lv, LEVEL, micros("time_exchange"), {"size": Running("sum", F.col("d"))}, tie=seq, consume=["d"])
    return out.withColumn("size", F.when(F.col("size") <= TINY, F.lit(0.0)).otherwise(F.col("size"))).drop(SLICE)


def top_levels(depth: DataFrame, n: int) -> DataFrame:
    """Best ``n`` levels per side and instant."""
    order = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    lv = F.row_number().over(Window.partitionBy("market", "time_exchange", "side").orderBy(order))
    return depth.withColumn("level", lv.cast("long")).filter(F.col("level") <= n)
