"""Global ranks and prefix sums without a single-partition sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.operators.slicing import DAY, Running, running

SLICES = 256


def global_prefix(df: DataFrame, weight: Column, value: str, group: str, time_us: Column, *, out: str, tie: tuple[Column, ...] = (), width_s: int = DAY) -> DataFrame:
    """Inclusive running total of ``weight`` over the order (value, group, time).

    Built from three totals that each split well: over distinct values (cut at
    sampled quantiles; a value held by a third of the rows is one row here), over
    the groups within one value, and over time within one (value, group).
    """
    rows = df.withColumn("_w", weight)
    by_value = rows.groupBy(value).agg(F.sum("_w").alias("_vw"))
    cuts = by_value.agg(F.percentile_approx(value, [i / SLICES for i in range(1, SLICES)], 10_000).alias("_cuts"))
    cut = by_value.crossJoin(F.broadcast(cuts)).select(
        value, "_vw", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_s")
    )  # the cut list has a fixed length
    slices = cut.groupBy("_s").agg(F.sum("_vw").alias("_sw"))
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)  # at most SLICES rows
    carry = slices.select("_s", F.coalesce(F.sum("_sw").over(before), F.lit(0)).alias("_sc"))
    inside = Window.partitionBy("_s").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut.join(carry, "_s").select(value, (F.col("_sc") + F.coalesce(F.sum("_vw").over(inside), F.lit(0))).alias("_ov"))
    by_group = rows.groupBy(value, group).agg(F.sum("_w").alias("_gw"))
    wg = Window.partitionBy(value).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    groups = by_group.select(value, group, F.coalesce(F.sum("_gw").over(wg), F.lit(0)).alias("_og"))
    own = running(rows, [value, group], time_us, {"_own": Running("sum", F.col("_w"))}, tie=tie, width_s=width_s)
    return own.join(groups, [value, group]).join(offsets, value).select(
        *df.columns, (F.col("_ov") + F.col("_og") + F.col("_own")).alias(out)
    )


def ordinal_decile(rank: Column, n: Column) -> Column:
    """``floor((rank-1)*10/n)+1`` within 1..10 (not the same cut as ntile)."""
    return F.least(F.lit(10), F.greatest(F.lit(1), F.floor((rank - 1) * 10 / n) + 1)).cast("long")


def average_rank(partition: list[str], value: str) -> Column:
    """Rank with ties sharing their mean rank."""
    order = Window.partitionBy(*partition).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(Window.partitionBy(*partition, value)) - 1) / 2


def tails(df: DataFrame, partition: list[str], value: str, tie: str, share: float = 0.1) -> DataFrame:
    """Lowest and highest ``ceil(n*share)`` rows; the tails may overlap for tiny n."""
    w = Window.partitionBy(*partition)
    size = F.ceil(F.count(F.lit(1)).over(w) * F.lit(share))
    lo = F.row_number().over(w.orderBy(F.col(value).asc(), F.col(tie).asc()))
    hi = F.row_number().over(w.orderBy(F.col(value).desc(), F.col(tie).desc()))
    both = df.select("*", size.alias("_k"), lo.alias("_lo"), hi.alias("_hi"))
    low = both.filter(F.col("_lo") <= F.col("_k")).withColumn("tail", F.lit("low"))
    high = both.filter(F.col("_hi") <= F.col("_k")).withColumn("tail", F.lit("high"))
    return low.unionByName(high).drop("_k", "_lo", "_hi")
