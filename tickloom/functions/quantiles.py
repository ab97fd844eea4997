"""Exact quantiles of groups too large for one task's value map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

CUTS = 200


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Mapping[str, float], *, upper: bool = False) -> DataFrame:
    """Linear-interpolated quantiles per group, exact at any group size; with ``upper``, the element at the next position.

    A sketch cuts each group into value bins; counting the bins tells which hold
    the wanted positions, and only those bins' distinct values are ranked.  No
    group's values ever meet in one task.
    """
    clean = df.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    cuts = clean.groupBy(*keys).agg(F.percentile_approx(value, [i / CUTS for i in range(1, CUTS)], 2_000).alias("_cuts"))
    binned = clean.join(cuts, list(keys)).select(*keys, value, "_k", F.size(F.filter("_cuts", lambda c: c < F.col(value))).alias("_b"))
    per_bin = binned.groupBy(*keys, "_b").agg(F.sum("_k").alias("_n"))  # at most CUTS rows per group
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    placed = per_bin.select(
        *keys, "_b", "_n", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_total")
    )
    want = placed.select("*", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in probs.items()])).alias("_q"))
    pos = F.col("_q.p") * (F.col("_total") - 1)
    hit = want.select(
        *keys, "_b", "_before", F.col("_q.name").alias("_name"), F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi"), (pos - F.floor(pos)).alias("_w"), "_n"
    ).filter((F.col("_before") <= F.col("_hi")) & (F.col("_lo") < F.col("_before") + F.col("_n")))
    ranked_bins = binned.join(hit.select(*keys, "_b").distinct(), [*keys, "_b"], "left_semi")
    wv = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked_bins.select(*keys, "_b", value, "_k", F.coalesce(F.sum("_k").over(wv), F.lit(0)).alias("_r"))
    a = F.col("_before") + F.col("_r")
    b = a + F.col("_k") - 1
    at = lambda c: F.max(F.when((a <= F.col(c)) & (F.col(c) <= b), F.col(value)))
    picked = hit.join(ranked, [*keys, "_b"]).groupBy(*keys, "_name").agg(at("_lo").alias("_x"), at("_hi").alias("_y"), F.max("_w").alias("_w"))
    val = F.col("_y") if upper else F.col("_x") + (F.col("_y") - F.col("_x")) * F.col("_w")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, val)).alias(n) for n in probs])


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, prob: float, name: str) -> DataFrame:
    """The element at the position nearest to ``prob * (n - 1)`` (no interpolation).

    For per-event summaries; halves round up.
    """
    w = Window.partitionBy(*keys)
    r = df.filter(F.col(value).isNotNull()).select(
        *keys, value, F.row_number().over(w.orderBy(value)).alias("_r"), F.count(F.lit(1)).over(w).alias("_n")
    )
    return r.filter(F.col("_r") == F.round(F.lit(prob) * (F.col("_n") - 1)) + 1).select(*keys, F.col(value).alias(name))
