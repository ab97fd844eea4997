"""Running windows that never put one key's whole history into one task.

A market may hold a third of all rows, so ``Window.partitionBy(market)`` over
ticks is off the table.  Every running quantity used here (sum, max, min, last
known value) is decomposable: fold each (key, time slice) to one summary row,
run the window over those few summaries, and hand every slice the state it
starts with.  The row-level window then partitions by (key, slice), so a hot key
spreads over as many tasks as it has slices while results stay exact.

Slice width is a parameter: pick it so that the busiest (key, slice) fits a task.
Where many rows share one instant, no width helps; ``fine_slices`` then cuts the
instant itself by the order of its rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import materialize

SLICE = "_slice"
DAY = 86_400


@dataclass(frozen=True)
class Running:
    """One running quantity: ``kind`` in sum, count, max, min, last."""

    kind: str
    value: Column
    exclusive: bool = False  # leave the current row out


def slice_of(us: Column, width_s: int) -> Column:
    return F.floor(us / F.lit(width_s * 1_000_000)).cast("long")


def _fold(kind: str, c: Column) -> Column:
    if kind in ("sum", "count"):
        return F.sum(c)
    if kind == "max":
        return F.max(c)
    if kind == "min":
        return F.min(c)
    if kind == "last":
        return F.last(c, ignorenulls=True)
    raise ValueError(f"unknown running kind {kind!r}")


def _combine(kind: str, carry: Column, local: Column) -> Column:
    if kind == "sum":
        return F.when(carry.isNull(), local).when(local.isNull(), carry).otherwise(carry + local)
    if kind == "count":
        return F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
    if kind == "max":
        return F.greatest(carry, local)
    if kind == "min":
        return F.least(carry, local)
    return F.coalesce(local, carry)


def _sliced(df, keys, time_us, tie, width_s, extra, consume=()):
    """Project, slice and shuffle once; returns the base, its columns and order."""
    ties = [f"_tie{i}" for i in range(len(tie))]
    base = df.select(*[c for c in df.columns if c not in consume], time_us.alias("_us"), *[c.alias(n) for c, n in zip(tie, ties)], *extra)
    by = [*keys, SLICE]
    # the join below implies non-null keys; saying so here keeps the planner from
    # adding that filter to one branch only, which would cost the shared exchange
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    if SLICE not in df.columns:  # else the caller has cut the rows (fine_slices)
        base = base.withColumn(SLICE, slice_of(F.col("_us"), width_s))
    base = base.filter(known).repartition(*[F.col(k) for k in by])
    return base, by, ties


def _whole(base: DataFrame) -> Column:
    """Touch every column, so that the summary branch reads the very same exchange.

    The row branch and the summary branch then differ in nothing below the
    shuffle and the planner reuses it instead of running the input twice.
    """
    return F.max(F.xxhash64(*base.columns)).alias("_all")


def running(
    df: DataFrame,
    keys: Sequence[str],
    time_us: Column,
    specs: Mapping[str, Running],
    *,
    tie: Sequence[Column] = (),
    width_s: int = DAY,
    consume: Sequence[str] = (),
) -> DataFrame:
    """Add running columns ordered by ``time_us`` then ``tie`` within ``keys``.

    ``consume`` names input columns that only feed the expressions; they are not
    carried along (a column nobody reads later would cost the shared exchange).
    """
    base, by, ties = _sliced(df, keys, time_us, tie, width_s, [s.value.alias(f"_v_{n}") for n, s in specs.items()], consume)
    order = F.struct("_us", *ties)

    def summary(n: str, kind: str) -> Column:
        v = F.col(f"_v_{n}")
        if kind == "last":
            return F.max_by(v, F.when(v.isNotNull(), order))
        return F.count(v) if kind == "count" else _fold(kind, v)

    slices = base.groupBy(*by).agg(
        *[summary(n, s.kind).alias(f"_s_{n}") for n, s in specs.items()], _whole(base)
    ).filter(F.col("_all").isNotNull())
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = slices.select(*by, *[_fold(s.kind, F.col(f"_s_{n}")).over(before).alias(f"_c_{n}") for n, s in specs.items()])

    within = Window.partitionBy(*by).orderBy("_us", *ties)
    cols = []
    for n, s in specs.items():
        frame = within.rowsBetween(Window.unboundedPreceding, -1 if s.exclusive else 0)
        v = F.col(f"_v_{n}")
        local = (F.count(v) if s.kind == "count" else _fold(s.kind, v)).over(frame)
        cols.append(_combine(s.kind, F.col(f"_c_{n}"), local).alias(n))
    return base.join(carry, by, "inner").select(*[c for c in df.columns if c not in specs and c not in consume], *cols)


def lagged(
    df: DataFrame,
    keys: Sequence[str],
    time_us: Column,
    values: Mapping[str, Column],
    *,
    tie: Sequence[Column] = (),
    width_s: int = DAY,
) -> DataFrame:
    """``lag(value, 1)`` across slices; nulls of the previous row are kept."""
    # a struct is never null, so "last" returns exactly the previous row's values
    packed = F.struct(*[c.alias(n) for n, c in values.items()])
    out = running(df, keys, time_us, {"_prev": Running("last", packed, exclusive=True)}, tie=tie, width_s=width_s)
    return out.select(
        *[c for c in df.columns if c not in values], *[F.col(f"_prev.{n}").alias(n) for n in values]
    )


def openings(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    opens: Mapping[str, Column],
    carry: Mapping[str, Column],
    *,
    mark: str | None = None,
    tie: Sequence[Column] = (),
    width_s: int = DAY,
) -> DataFrame:
    """Time of the latest row at which a condition on (previous row, row) held.

    ``mark`` names another column to report instead of the time.

    ``carry`` names columns holding the previous row's values (null on the first
    row of a key); each ``opens`` condition may use them and the row's own columns.
    Adds one timestamp column per condition, in a single shuffle and a single pass:
    what a slice knows of itself is written, and the rows that start a slice are
    decided from the last row of the slice before.
    """
    own = [c for c in df.columns]
    mark = mark or time
    base, by, ties = _sliced(df, keys, F.unix_micros(F.col(time)), tie, width_s, [c.alias(f"_v_{n}") for n, c in carry.items()])
    within = Window.partitionBy(*by).orderBy("_us", *ties)
    begun, ended = F.lag(F.lit(True), 1).over(within), F.lead(F.lit(True), 1).over(within)  # null on a slice's first and last row
    local = base.select(*base.columns, *[F.lag(f"_v_{n}", 1).over(within).alias(n) for n in carry], begun.alias("_begun"), ended.alias("_ended"))
    marked = local.select(
        *base.columns, "_begun", "_ended",
        *[F.when(F.col("_begun") & F.coalesce(c, F.lit(False)), F.col(mark)).alias(f"_o_{n}") for n, c in opens.items()],
    )
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = marked.select(*dict.fromkeys([*own, *by]), *[f"_v_{n}" for n in carry], "_begun", "_ended", *[F.last(f"_o_{n}", ignorenulls=True).over(upto).alias(f"_m_{n}") for n in opens])
    rows = materialize(rows, "marked")
    first, last = F.col("_begun").isNull(), F.col("_ended").isNull()
    slices = rows.filter(first | last).groupBy(*by).agg(
        F.first(F.when(first, F.struct(*own)), ignorenulls=True).alias("_first"),
        F.first(F.when(last, F.struct(*[F.col(f"_v_{n}").alias(n) for n in carry])), ignorenulls=True).alias("_last"),
        *[F.first(F.when(last, F.col(f"_m_{n}")), ignorenulls=True).alias(f"_m_{n}") for n in opens],
    )
    seq = Window.partitionBy(*keys).orderBy(SLICE)
    head = slices.select(*by, *[f"_m_{n}" for n in opens], "_first", F.lag("_last", 1).over(seq).alias("_p"))
    head = head.select(*by, *[f"_m_{n}" for n in opens], *[F.col(f"_first.{c}").alias(c) for c in own if c not in by], *[F.col(f"_p.{n}").alias(n) for n in carry])
    head = head.select(*by, *[f"_m_{n}" for n in opens], *[F.when(F.coalesce(c, F.lit(False)), F.col(mark)).alias(f"_f_{n}") for n, c in opens.items()])
    before = seq.rowsBetween(Window.unboundedPreceding, -1)
    start = head.select(
        *by, *[F.col(f"_f_{n}") for n in opens],
        *[F.last(F.coalesce(F.col(f"_m_{n}"), F.col(f"_f_{n}")), ignorenulls=True).over(before).alias(f"_c_{n}") for n in opens],
    )
    return rows.join(start, by, "inner").select(*own, *[F.coalesce(f"_m_{n}", f"_f_{n}", f"_c_{n}").alias(n) for n in opens])


def fine_slices(df: DataFrame, keys: Sequence[str], time: str, order: str, width_s: int = DAY, most: int = 1_000_000) -> DataFrame:
    """Adds slices of ``width_s`` seconds in which an instant of more than ``most`` rows is cut by ``order``, a whole number.

    ``running``, ``lagged`` and ``openings`` then use them, and keep the column. Crowded instants are few (rows / ``most``);
    they are counted with partial aggregation and met by an ordinary join.
    """
    us = F.unix_micros(F.col(time))
    cut = slice_of(us, width_s)
    if df.count() <= most:  # no instant can be crowded
        return df.select(*df.columns, cut.alias(SLICE))
    crowded = df.groupBy(*keys, us.alias("_us")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most)
    by_slice = materialize(crowded.groupBy(*keys, slice_of(F.col("_us"), width_s).alias("_cut")).agg(F.array_sort(F.collect_list("_us")).alias("_at")), "crowded")
    if by_slice.isEmpty():
        return df.select(*df.columns, cut.alias(SLICE))
    out = df.withColumn("_cut", cut).join(by_slice, [*keys, "_cut"], "left")
    inside = F.coalesce(F.array_contains("_at", us), F.lit(False))
    part = F.coalesce(2 * F.size(F.filter("_at", lambda t: t < us)), F.lit(0)) + inside.cast("int")
    block = F.when(inside, F.floor(F.col(order) / most)).otherwise(0).cast("long")
    return out.select(*df.columns, F.struct(cut.alias("cut"), part.alias("part"), block.alias("block")).alias(SLICE))


def busiest_slice(df: DataFrame, keys: Sequence[str], time_us: Column, width_s: int) -> int:
    """Rows of the fullest (key, slice); a counting pass over the time column."""
    n = df.groupBy(*keys, slice_of(time_us, width_s).alias(SLICE)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return int(n or 0)


def fitting_width(
    df: DataFrame, keys: Sequence[str], time_us: Column, max_rows: int = 5_000_000,
    widths: Sequence[int] = (DAY, 21_600, 3_600, 600, 60, 10, 1),
) -> int:
    """Widest slice whose busiest (key, slice) stays within ``max_rows``.

    For feeds where one market's single hour may hold a large share of all rows:
    measure once, then pass the result as ``width_s``.
    """
    for w in widths:
        if busiest_slice(df, keys, time_us, w) <= max_rows:
            return w
    return widths[-1]
