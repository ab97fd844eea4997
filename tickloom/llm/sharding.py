"""Shards by a hierarchical weighted hash tree.

Shards are leaves of a tree region -> rack -> shard. Every leaf draws an exponential variate of rate ``weight`` from a hash of
(key, leaf name); a node's draw is the smallest in its subtree, which is again exponential, of rate the subtree's weight. The
row descends to the region, then the rack, then the shard of smallest draw: each level is a weighted hash draw, and since a
draw depends on nothing outside its subtree, a leaf that is added or grows takes rows only into itself, and all other
movement stays out of subtrees whose weights are unchanged.

Law ``key``: the key and the shard list decide alone. The tree is fixed and small, so a draw is a column expression and no
Python runs. Slots are gapless row numbers in each shard; they are counted in two levels (shard x hash bucket, then inside a
bucket), so no task sorts a whole shard.

Null texts have size 1 and CRC 0. A null key draws as the text "null". Repeated rows share a shard and get slots of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tickloom.llm.common import pick, table

#: (region, rack, shard, weight); names enter the hash, so they must not change when shards are added.
Leaf = tuple[str, str, int, float]
ROWS_PER_BUCKET = 50_000


def tree(shards: int, racks: int = 2, regions: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Shards 0..n-1 of weight 1, filled rack by rack; more shards than places go on around the racks."""
    places = [(f"region{g}", f"rack{g}.{k}") for g in range(regions) for k in range(racks) for _ in range(per_rack)]
    return [(*places[s % len(places)], s, 1.0) for s in range(shards)]


def draw(key: Column, shard: int, weight: float) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an MD5 over "key:shard"."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}")).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def least(columns: list[Column]) -> Column:
    return F.least(*columns) if len(columns) > 1 else columns[0]


def first_least(columns: list[Column], values: list[Column]) -> Column:
    """The value beside the smallest column, the first of equals."""
    low, out = least(columns), values[-1]
    for c, v in list(zip(columns, values, strict=True))[-2::-1]:
        out = F.when(c == low, v).otherwise(out)
    return out


def place(leaves: list[Leaf], draws: Column) -> Column:
    """Descend the tree; ``draws`` maps shard number to its draw."""
    regions: dict[str, dict[str, list[int]]] = {}
    for region, rack, shard, weight in leaves:
        if weight > 0:
            regions.setdefault(region, {}).setdefault(rack, []).append(shard)
    leaf = lambda s: F.element_at(draws, F.lit(s + 1))
    region_draws, region_picks = [], []
    for racks in regions.values():
        rack_draws = [least([leaf(s) for s in shards]) for shards in racks.values()]
        rack_picks = [first_least([leaf(s) for s in shards], [F.lit(s) for s in shards]) for shards in racks.values()]
        region_draws.append(least(rack_draws))
        region_picks.append(first_least(rack_draws, rack_picks))
    return first_least(region_draws, region_picks)


def assign(rows: DataFrame, key: str, shards: int, out: str = "shard", grown: str | None = "grown_shard") -> DataFrame:
    """Add the shard of each row among ``shards`` equal shards and, for comparison, among one more."""
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    n = shards + bool(grown)
    drawn = rows.withColumn("_draws", F.array(*[draw(name, s, 1.0) for s in range(n)]))
    drawn = drawn.withColumn(out, place(tree(shards), F.col("_draws")).cast("int"))
    if grown:
        drawn = drawn.withColumn(grown, place(tree(shards + 1), F.col("_draws")).cast("int"))
    return drawn.drop("_draws")


def slots(rows: DataFrame, shard: str, key: str, order: list[str], total: int) -> DataFrame:
    """Add ``slot``: gapless from 0 in each shard, by hash bucket of the key, then ``order``."""
    buckets = max(1, total // ROWS_PER_BUCKET)
    own = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.col(key), *order), F.lit(buckets)))
    counts = own.groupBy(F.col(shard).alias("_s"), F.col("_bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(shard, "_bucket").orderBy(key, *order)
    ranked = own.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(starts, (F.col(shard) == F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("slot", (F.col("_start") + F.col("_rank")).cast("long")).drop("_s", "_b", "_bucket", "_start", "_rank")


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: size, CRC, law, shard, slot and the shard under one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.lit("key").alias("law"))
    total = docs.count()
    placed = slots(assign(rows, "doc_id", shards), "shard", "doc_id", ["text_crc32", "size"], total)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
