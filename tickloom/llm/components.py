"""Connected components of a link table by alternating large and small stars.

Every round is a handful of joins and aggregations over the links; nothing is collected but two numbers that tell whether the
table still changes. A hub with many links is only ever aggregated (partial minima first) or joined, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tickloom.llm.common import written


def star(links: DataFrame, large: bool) -> DataFrame:
    """Hang neighbours on the smallest of each neighbourhood: larger ones (large star) or all smaller ones (small star)."""
    if large:
        seen = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        seen = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = seen.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def labels(links: DataFrame, name: str = "links") -> DataFrame:
    """``id``, ``root``: the smallest id reachable over links (a, b), for every id that has a link to another one."""
    links = written(links.filter("a <> b").select("a", "b").distinct(), name)
    state = None
    while True:
        links = written(star(star(links, True), False), name)
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("id"), F.col("b").alias("root")).union(roots)
