"""Interval operators: counts in ranges, ticks inside windows, partition lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.functions.timecols import micros
from tickloom.operators.slicing import DAY, Running, running


TASKS = 20_000  # most tasks that a join dealt by its pairs has


def range_totals(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    right_time: str,
    bounds: Mapping[str, tuple[Column, Column, bool, bool]],
    values: Mapping[str, Column],
    *,
    width_s: int = DAY,
) -> DataFrame:
    """Counts and sums of right rows in per-left-row time ranges.

    ``bounds`` maps a label to ``(low, high, include_low, include_high)`` and
    ``values`` a name to the summed expression of the right side (``lit(1)``
    counts).  Adds ``{label}_{name}`` columns.  A range total is the difference
    of two running totals, so no (left, right) pair is ever produced and dense
    ranges cost the same as empty ones.

    Only what lies inside a range enters its total.  Integers and the whole parts
    of doubles below 1e30 are summed exactly, so a large history costs a small
    range no digits; NaN and infinities are counted apart and come back only in
    ranges that hold them.  Repeated left rows are kept, each with its totals.
    """
    lcols = left.columns
    tagged = left.groupBy(*lcols).agg(F.count(F.lit(1)).alias("_copies")).withColumn("_lid", F.struct(*lcols, "_copies"))
    probes = []
    for label, (low, high, inc_low, inc_high) in bounds.items():
        # prio 0: before the rows of that instant; 2: after them
        probes.append(F.struct(F.lit(label).alias("label"), micros(low).alias("t"), F.lit(0 if inc_low else 2).alias("prio"), F.lit(-1).alias("sign")))
        probes.append(F.struct(F.lit(label).alias("label"), micros(high).alias("t"), F.lit(2 if inc_high else 0).alias("prio"), F.lit(1).alias("sign")))
    parts = {n: _parts(c, right.select(c.alias("v")).schema["v"].dataType) for n, c in values.items()}
    pieces = {f"{n}_{k}": v for n, own in parts.items() for k, v in own.items()}
    kinds = {k: right.select(v.alias("v")).schema["v"].dataType for k, v in pieces.items()}
    ltag = tagged.select(*keys, "_lid", F.explode(F.array(*probes)).alias("p")).select(
        *keys, "_lid", "p.label", F.col("p.t").alias("_t"), F.col("p.prio").alias("_prio"), F.col("p.sign").alias("_sign"),
        *[F.lit(None).cast(kinds[n]).alias(f"_in_{n}") for n in pieces],
    )
    rtag = right.filter(F.col(right_time).isNotNull()).select(
        *keys, F.lit(None).cast(ltag.schema["_lid"].dataType).alias("_lid"), F.lit(None).cast("string").alias("label"),
        micros(right_time).alias("_t"), F.lit(1).alias("_prio"), F.lit(0).alias("_sign"),
        *[v.alias(f"_in_{n}") for n, v in pieces.items()],
    )
    cum = running(
        ltag.unionByName(rtag), keys, F.col("_t"),
        {f"_cum_{n}": Running("sum", F.col(f"_in_{n}")) for n in pieces},
        tie=[F.col("_prio")], width_s=width_s, consume=["_t", "_prio", *[f"_in_{n}" for n in pieces]],
    ).filter(F.col("_lid").isNotNull())
    sums = [
        F.sum(F.when(F.col("label") == label, F.col("_sign") * F.coalesce(F.col(f"_cum_{n}"), F.lit(0)))).alias(f"_{label}_{n}")
        for label in bounds for n in pieces
    ]
    totals = cum.groupBy("_lid").agg(*sums)
    out = [_total(f"_{label}_{n}", own).alias(f"{label}_{n}") for label in bounds for n, own in parts.items()]
    each = totals.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_lid._copies"))).alias("_copy"))
    return each.select(*[F.col("_lid")[c].alias(c) for c in lcols], *out)


def _parts(value: Column, kind: T.DataType) -> dict[str, Column]:
    """What is summed for one value: exact whole parts, fractions, and marks of what is not finite."""
    if isinstance(kind, T.IntegralType):
        return {"whole": value.cast("long")}
    x = value.cast("double")
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    whole = finite & (F.abs(x) < 1e30)
    return {
        "whole": F.when(whole, F.rint(x)).cast("decimal(38,0)"),
        "rest": F.when(whole, x - F.rint(x)).when(finite, x),
        "up": F.when(F.isnan(x) | (x == float("inf")), 1).cast("long"),
        "down": F.when(F.isnan(x) | (x == float("-inf")), 1).cast("long"),
    }


def _total(stem: str, own: Mapping[str, Column]) -> Column:
    whole = F.col(f"{stem}_whole").cast("double")
    if "rest" not in own:
        return whole
    up, down = F.col(f"{stem}_up") > 0, F.col(f"{stem}_down") > 0
    infinite = F.when(up & down, float("nan")).when(up, float("inf")).when(down, float("-inf"))
    return F.coalesce(infinite, F.coalesce(whole, F.lit(0.0)) + F.col(f"{stem}_rest"))


def rows_in_windows(
    windows: DataFrame,
    ticks: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    time: str,
    *,
    bucket_s: int = 3600,
    include_start: bool = True,
    include_end: bool = True,
    pairs_per_task: int | None = None,
) -> DataFrame:
    """Ticks inside each window, as an equi-join on (key, time bucket).

    Windows are few and short next to ticks: each is repeated once per bucket it
    touches, which turns the range condition into a hash or merge join AQE can
    broadcast or split, plus an exact residual filter.

    Where windows overlap densely, rows returned outgrow rows read. With
    ``pairs_per_task``, the (window, tick) pairs of all buckets are counted first
    and buckets dealt to so many tasks that each makes about that many, and a
    tick's windows come one after the other: a file then holds long runs of one
    tick and few different windows, which its dictionaries can hold.
    """
    width = bucket_s * 1_000_000
    w = windows.withColumn(
        "_bucket",
        F.explode(F.sequence(F.floor(micros(start) / width).cast("long"), F.floor(micros(end) / width).cast("long"))),
    )
    t = ticks.withColumn("_bucket", F.floor(micros(time) / width).cast("long"))
    lo = F.col(time) >= F.col(start) if include_start else F.col(time) > F.col(start)
    hi = F.col(time) <= F.col(end) if include_end else F.col(time) < F.col(end)
    by = [*keys, "_bucket"]
    if pairs_per_task is None:
        return w.join(t, by, "inner").filter(lo & hi).drop("_bucket")
    count = lambda df, n: df.groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias(n))
    pairs = count(w, "_w").join(count(t, "_t"), by).agg(F.sum(F.col("_w") * F.col("_t"))).first()[0] or 0
    tasks = min(TASKS, int(pairs // pairs_per_task) + 1)
    out = t.repartition(tasks, *by).hint("merge").join(w.repartition(tasks, *by), by).filter(lo & hi)
    return out.select(*keys, *[c for c in windows.columns if c not in keys], *[c for c in ticks.columns if c not in keys])


def hours_touched(windows: DataFrame, start: str, end: str, out: str = "hour") -> DataFrame:
    """One row per hourly partition a closed window intersects."""
    return windows.withColumn(
        out,
        F.explode(F.sequence(F.date_trunc("hour", F.col(start)), F.date_trunc("hour", F.col(end)), F.expr("interval 1 hour"))),
    )


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed windows intersect."""
    return (a_start <= b_end) & (b_start <= a_end)
