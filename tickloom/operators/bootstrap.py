"""Deterministic cluster-bootstrap intervals as joins and aggregates.

Clusters are first folded to sufficient sums; a draw picks clusters by a hash of
(seed, draw, slot), so results do not depend on partitioning, retries or the
engine.  Draws are spread over tasks; the cluster table is joined, and is
broadcast only when the planner measures it small.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.session import materialize

RESAMPLES = 2_000
MIN_CLUSTERS = 5
Stat = Callable[[Mapping[str, Column]], Column]


#: Clusters (rows of a few numbers) that may be sent to every task.
SMALL = 200_000


def hash_index(seed: int | Column, draw: Column, slot: Column, size: Column) -> Column:
    """A number in [0, size) from the first 32 bits of an md5."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    key = F.concat_ws("|", s.cast("string"), draw.cast("string"), slot.cast("string"))
    return F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long"), size)


def check_settings(n_resamples: int, min_clusters: int) -> None:
    if n_resamples < RESAMPLES:
        raise ValueError("n_resamples must be at least 2000")
    if min_clusters < 2:
        raise ValueError("min_clusters must be at least 2")


def mean_stat(s: Mapping[str, Column]) -> Column:
    return s["x"] / s["n"]


def ratio_stat(s: Mapping[str, Column]) -> Column:
    return F.when(s["den"] != 0, s["num"] / s["den"])


def slope_stat(s: Mapping[str, Column]) -> Column:
    den = s["n"] * s["xx"] - s["x"] * s["x"]
    return F.when(den != 0, (s["n"] * s["xy"] - s["x"] * s["y"]) / den)


def std_stat(s: Mapping[str, Column]) -> Column:
    return F.when(s["n"] > 1, F.sqrt(F.greatest(F.lit(0.0), (s["xx"] - s["x"] * s["x"] / s["n"]) / (s["n"] - 1))))


def half_life_stat(s: Mapping[str, Column]) -> Column:
    phi = slope_stat(s)
    return F.when((phi > 0) & (phi < 1), F.ln(F.lit(0.5)) / F.ln(phi))


#: Statistics by name, each with the sums that it needs; ``statistic`` also takes any function of the sums.
STATISTICS: dict[str, tuple[Stat, tuple[str, ...]]] = {
    "mean": (mean_stat, ("n", "x")),
    "ratio": (ratio_stat, ("num", "den")),
    "slope": (slope_stat, ("n", "x", "y", "xx", "xy")),
    "std": (std_stat, ("n", "x", "xx")),
    "half_life": (half_life_stat, ("n", "x", "y", "xx", "xy")),
}


def statistic(which: str | Stat, sums: Mapping[str, Column]) -> Stat:
    """A statistic by name, checked against the sums at hand, or one's own function."""
    if callable(which):
        return which
    if which not in STATISTICS:
        raise ValueError(f"no statistic {which!r}: choose from {', '.join(STATISTICS)} or pass a function of the sums")
    found, needs = STATISTICS[which]
    if absent := [k for k in needs if k not in sums]:
        raise ValueError(f"statistic {which!r} needs the sums {', '.join(absent)}")
    return found


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def draws_of(sizes: DataFrame, group: Sequence[str], n_resamples: int, seed: int | Column) -> DataFrame:
    """(group, draw, slot) -> cluster index; ``sizes`` has the group and ``G``."""
    draws = sizes.select(*group, "G", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("draw"))
    # an explicit count: these rows are tiny but each one grows into G slots, so
    # they must not be packed together by size
    parts = max(8, int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return draws.repartition(parts, *group, "draw").select(
        *group, "G", "draw", F.explode(F.sequence(F.lit(0).cast("long"), F.col("G") - 1)).alias("slot")
    ).select(*group, "draw", hash_index(seed, F.col("draw"), F.col("slot"), F.col("G")).alias("idx"))


def bootstrap_many(
    df: DataFrame,
    group: Sequence[str],
    cluster: str,
    sums: Mapping[str, Column],
    stats: Mapping[str, Stat],
    *,
    n: Column | None = None,
    n_resamples: int = RESAMPLES,
    seed: int | Column = 0,
    min_clusters: int = MIN_CLUSTERS,
) -> DataFrame:
    """Several statistics of the same draws: ``{name}``, ``{name}_ci_low``, ``{name}_ci_high``.

    ``sums`` are per-row expressions whose totals determine every statistic.  Below
    ``min_clusters`` the intervals are undefined (null), never of zero width.
    """
    check_settings(n_resamples, min_clusters)
    names = list(sums)
    g = list(group) or ["_every"]
    base = df if group else df.withColumn("_every", F.lit(1))
    rows = F.count(F.lit(1)) if n is None else F.sum(n)
    clusters = base.filter(F.col(cluster).isNotNull()).groupBy(*g, cluster).agg(
        *[F.sum(sums[k]).cast("double").alias(f"s_{k}") for k in names], rows.cast("long").alias("_n")
    )
    clusters = materialize(clusters, "clusters")  # one row per cluster, used three times
    # numbering the clusters of a group: one short row per time block
    numbered = clusters.withColumn("idx", F.row_number().over(Window.partitionBy(*g).orderBy(cluster)).cast("long") - 1)
    totals = clusters.groupBy(*g).agg(
        *[F.sum(f"s_{k}").alias(f"t_{k}") for k in names], F.sum("_n").alias("n"), F.count(F.lit(1)).alias("G")
    ).select(*g, *[s({k: F.col(f"t_{k}") for k in names}).alias(m) for m, s in stats.items()], "n", "G")
    picks = draws_of(totals.filter(F.col("G") >= min_clusters).select(*g, "G"), g, n_resamples, seed)
    # Draws are many more rows than their plan lets on: the planner must not build a table of them.
    sums_of = numbered.drop(cluster, "_n")
    sums_of = F.broadcast(sums_of) if clusters.count() <= SMALL else sums_of.hint("shuffle_hash")
    per_draw = picks.join(sums_of, [*g, "idx"]).groupBy(*g, "draw").agg(*[F.sum(f"s_{k}").alias(f"s_{k}") for k in names])
    values = per_draw.select(*g, *[_finite(s({k: F.col(f"s_{k}") for k in names})).alias(f"_v_{m}") for m, s in stats.items()])
    ends = F.array(F.lit(0.025), F.lit(0.975))
    ci = values.groupBy(*g).agg(*[F.percentile(f"_v_{m}", ends).alias(f"_q_{m}") for m in stats])
    cols = []
    for m in stats:
        cols += [F.col(m), F.col(f"_q_{m}")[0].alias(f"{m}_ci_low"), F.col(f"_q_{m}")[1].alias(f"{m}_ci_high")]
    return totals.join(ci, g, "left").select(*group, *cols, "n", "G", (F.col("G") < min_clusters).alias("low_cluster"))


def bootstrap_ci(df: DataFrame, group: Sequence[str], cluster: str, sums: Mapping[str, Column], stat: str | Stat, **kw) -> DataFrame:
    """Point, percentile interval, n, G and low_cluster per group; ``stat`` is a name or a function of the sums."""
    out = bootstrap_many(df, group, cluster, sums, {"point": statistic(stat, sums)}, **kw)
    return out.withColumnsRenamed({"point_ci_low": "ci_low", "point_ci_high": "ci_high"})


def mean_ci(df: DataFrame, group: Sequence[str], cluster: str, value: str, **kw) -> DataFrame:
    """Pooled-mean interval over the finite, non-null values."""
    v = _finite(F.col(value))
    return bootstrap_ci(df.filter(v.isNotNull()), group, cluster, {"x": F.col(value), "n": F.lit(1)}, mean_stat, **kw)


def quantile_ci(
    df: DataFrame, group: Sequence[str], cluster: str, value: str, prob: float, *,
    n_resamples: int = RESAMPLES, seed: int = 0, min_clusters: int = MIN_CLUSTERS,
) -> DataFrame:
    """Interval of a quantile: rows weighted by their cluster's multiplicity.

    Values are pre-counted per cluster, and each draw only carries weights, so no
    row is ever copied once per resampled occurrence.
    """
    check_settings(n_resamples, min_clusters)
    clean = df.filter(F.col(value).isNotNull() & F.col(cluster).isNotNull())
    counted = materialize(clean.groupBy(*group, cluster, value).agg(F.count(F.lit(1)).alias("_k")), "counted")
    ids = counted.select(*group, cluster).distinct().withColumn(
        "idx", F.row_number().over(Window.partitionBy(*group).orderBy(cluster)).cast("long") - 1
    )
    totals = counted.groupBy(*group).agg(F.percentile(value, prob, F.col("_k")).alias("point"), F.sum("_k").alias("n")).join(
        ids.groupBy(*group).agg(F.count(F.lit(1)).alias("G")), list(group)
    )
    weights = draws_of(totals.filter(F.col("G") >= min_clusters).select(*group, "G"), group, n_resamples, seed).groupBy(
        *group, "draw", "idx"
    ).agg(F.count(F.lit(1)).alias("_w"))
    per = weights.join(ids, [*group, "idx"]).join(counted, [*group, cluster]).groupBy(*group, "draw").agg(
        F.percentile(value, prob, F.col("_k") * F.col("_w")).alias("_v")
    )
    ci = per.groupBy(*group).agg(F.percentile("_v", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return totals.join(ci, list(group), "left").select(
        *group, "point", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "n", "G", (F.col("G") < min_clusters).alias("low_cluster")
    )


def panel_ci(
    panel: DataFrame, group: Sequence[str], strata: Sequence[str], slot: str, value: str, period: str, stat: Callable[[Column], Column], *,
    n_resamples: int = RESAMPLES, seed: int = 0, min_clusters: int = MIN_CLUSTERS,
) -> DataFrame:
    """Block bootstrap of a netted panel: blocks move between slots of their stratum.

    ``slot`` identifies a row (one netted block), ``period`` is the destination
    time kept in place; values resampled into a period are summed, and ``stat``
    aggregates the period totals of a draw.
    """
    check_settings(n_resamples, min_clusters)
    s = [*group, *strata]
    panel = materialize(panel, "panel")
    ranked = panel.withColumn("_i", F.row_number().over(Window.partitionBy(*s).orderBy(slot)).cast("long") - 1)
    sizes = panel.groupBy(*s).agg(F.count(F.lit(1)).alias("_m"))
    per_group = panel.groupBy(*group).agg(F.count(F.lit(1)).alias("G"))
    point = panel.groupBy(*group, period).agg(F.sum(value).alias("_p")).groupBy(*group).agg(stat(F.col("_p")).alias("point"))
    dest = ranked.select(*s, period, slot).join(sizes, s).join(per_group.filter(F.col("G") >= min_clusters).select(*group), list(group), "left_semi")
    picks = dest.select(*s, period, slot, "_m", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("draw")).select(
        *s, period, "draw", hash_index(seed, F.col("draw"), F.col(slot), F.col("_m")).alias("_i")
    )
    drawn = picks.join(ranked.select(*s, "_i", F.col(value).alias("_x")), [*s, "_i"]).groupBy(*group, "draw", period).agg(F.sum("_x").alias("_p"))
    values = drawn.groupBy(*group, "draw").agg(_finite(stat(F.col("_p"))).alias("_v"))
    ci = values.groupBy(*group).agg(F.percentile("_v", F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return point.join(per_group, list(group)).join(ci, list(group), "left").select(
        *group, "point", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "G", (F.col("G") < min_clusters).alias("low_cluster")
    )


def separation(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    """Whether two intervals are apart; an undefined one is insufficient, never apart."""
    undefined = a_low.isNull() | a_high.isNull() | b_low.isNull() | b_high.isNull()
    return F.when(undefined, "INSUFFICIENT CLUSTERS").when((a_high < b_low) | (b_high < a_low), "SEPARATES").otherwise("DOES NOT SEPARATE")
