"""Joins with checked cardinality, twin pairing and nearest matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tickloom.functions.timecols import micros
from tickloom.operators.asof import asof_many, Source


def one_row_per_key(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The dimension, or an error on the first duplicated key."""
    rest = [c for c in dim.columns if c not in keys]
    g = dim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    ok = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate key "), F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))).cast("boolean")).otherwise(F.lit(True))
    return g.filter(ok).select(*keys, "_r.*")


def join_one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join whose both sides must have unique keys."""
    return one_row_per_key(left, keys).join(one_row_per_key(right, keys), list(keys), "left")


def strict_lookup(df: DataFrame, dim: DataFrame, key: str, values: Sequence[str]) -> DataFrame:
    """Exactly one dimension row per key: duplicates and absences are errors."""
    d = one_row_per_key(dim.select(key, *values), [key])
    missing = F.raise_error(F.concat(F.lit(f"no {key} row for "), F.col(key).cast("string")))
    tagged = df.join(d.withColumn("_found", F.lit(True)), key, "left")
    return tagged.filter(F.coalesce(F.col("_found"), missing.cast("boolean"))).drop("_found")


def underlier(coin: Column, aliases: Mapping[str, str]) -> Column:
    """Exact-alias map; names without an alias stand for themselves."""
    if not aliases:
        return coin
    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(table[coin], coin)


def twin_pairs(markets: DataFrame) -> DataFrame:
    """Markets of one underlier on different venues, each pair once (a < b)."""
    a = markets.select("underlier", F.col("market").alias("market_a"), F.col("dex").alias("dex_a"))
    b = markets.select("underlier", F.col("market").alias("market_b"), F.col("dex").alias("dex_b"))
    return a.join(b, "underlier").filter((F.col("market_a") < F.col("market_b")) & (F.col("dex_a") != F.col("dex_b")))


def nearest_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, payload: Sequence[str], max_gap_s: float, *, width_s: int = 86_400) -> DataFrame:
    """Row with the smallest absolute time gap (the earlier one on ties), if close enough."""
    src = lambda: Source(right, right_time, payload)
    back = asof_many(left, {"b_": src()}, keys, left_time, width_s=width_s)
    both = asof_many(back, {"f_": src()}, keys, left_time, direction="forward", width_s=width_s)
    gb = micros(left_time) - micros("b_obs_time")
    gf = micros("f_obs_time") - micros(left_time)
    use_b = F.coalesce(gb <= gf, gb.isNotNull())
    gap = F.when(use_b, gb).otherwise(gf) / F.lit(1_000_000.0)
    near = gap <= max_gap_s
    pick = lambda c: F.when(near, F.when(use_b, F.col(f"b_{c}")).otherwise(F.col(f"f_{c}"))).alias(c)
    return both.select(*left.columns, pick("obs_time"), *[pick(c) for c in payload], F.when(near, gap).alias("gap_s"))
