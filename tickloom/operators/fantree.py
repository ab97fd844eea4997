"""Answers about ranges of ranked points through a tree of fixed fan-out, with joins and aggregates only.

Points of a key have the ranks 0, 1, 2, ...; node ``i`` of level ``k`` stands for the ranks ``[i * FAN**k, (i + 1) * FAN**k)``.
A range of ranks is a few nodes of each level (``covered``), however long it is. Two questions are served:

* *skyline*: items live over ranges; which are the best n at each point? Items are kept at the nodes that make up their
  range, each node keeps its best n, and these are handed down level by level. The rows grow with the items times the
  logarithm of their length, never with (items x points).
* *extremes*: points carry values; which is the smallest of a range, and which point of a range is the first to reach a bound?
  Nodes hold the extremes of their points; a range reads its nodes, and the search for the first point goes down from the
  first node that holds one.

No node is a hot key: joins go from nodes to their at most ``FAN`` children, and aggregates combine before they shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickloom.functions.timecols import micros
from tickloom.operators.slicing import DAY, Running, running
from tickloom.session import materialize

FAN = 16


def ranked(points: DataFrame, keys: Sequence[str], time: str, tie: Sequence[Column] = (), width_s: int = DAY) -> DataFrame:
    """The points with ``r``, their rank within the key; a written table, as several steps read it."""
    out = running(points, keys, micros(time), {"r": Running("count", F.lit(1), exclusive=True)}, tie=tie, width_s=width_s)
    return materialize(out, "points")


def height(points: DataFrame) -> int:
    """Levels that hold the ranks of the longest key."""
    most = points.agg(F.max("r")).first()[0]
    levels = 1
    while FAN**levels <= (most or 0) + 1:
        levels += 1
    return levels


def before(rows: DataFrame, points: DataFrame, keys: Sequence[str], time: Column, name: str, *, through: bool = False, width_s: int = DAY) -> DataFrame:
    """Adds ``name``: how many points of the key come before a time (given in microseconds), or up to it if ``through``."""
    cols = [c for c in rows.columns if c not in keys]
    both = rows.select(*keys, time.alias("_t"), F.lit(2 if through else 0).alias("_prio"), F.struct(*cols).alias("_row"), F.lit(None).cast("int").alias("_one")).unionByName(
        points.select(*keys, micros("time").alias("_t"), F.lit(1).alias("_prio"), F.lit(1).alias("_one")), allowMissingColumns=True
    )
    seen = running(both, keys, F.col("_t"), {"_n": Running("count", F.col("_one"))}, tie=[F.col("_prio")], width_s=width_s, consume=["_t", "_prio", "_one"])
    return seen.filter("_row is not null").select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in cols if c != name], F.col("_n").alias(name))


def covered(a: Column, b: Column, levels: int) -> Column:
    """The nodes that make up the ranks ``[a, b)``: an array of (level, node)."""
    up = lambda k: F.ceil(a / F.lit(FAN**k)).cast("long")
    down = lambda k: F.floor(b / F.lit(FAN**k)).cast("long")
    none = F.array().cast("array<bigint>")
    run = lambda low, high: F.when(low < high, F.sequence(low, high - 1)).otherwise(none)
    parts = []
    for k in range(levels):
        lo, hi, lo2, hi2 = up(k), down(k), up(k + 1), down(k + 1)
        split = (lo2 < hi2) if k + 1 < levels else F.lit(False)
        nodes = F.when(split, F.concat(run(lo, lo2 * FAN), run(hi2 * FAN, hi))).otherwise(run(lo, hi))
        parts.append(F.transform(nodes, _at_level(k)))
    return F.concat(*parts)


def _at_level(k: int):
    return lambda node: F.struct(F.lit(k).alias("level"), node.alias("node"))


def skyline(points: DataFrame, items: DataFrame, keys: Sequence[str], groups: Sequence[str], best: Column, n: int) -> DataFrame:
    """``points`` with one array for each group: the up to ``n`` items of smallest ``best`` that are live at the point.

    ``items`` have ranks ``[a, b)``, a column ``kind`` naming the group, and ``best``, a struct column that orders and describes
    the item. Points are a table with ``r``.
    """
    levels = height(points)
    pieces = items.filter("a < b").select(*keys, "kind", best.alias("item"), F.explode(covered(F.col("a"), F.col("b"), levels)).alias("c")).select(*keys, "kind", "item", "c.level", "c.node")
    own = [F.when(F.col("kind") == g, F.col("item")) for g in groups]
    if n == 1:
        kept = pieces.groupBy(*keys, "level", "node").agg(*[F.array_compact(F.array(F.min(c))).alias(g) for c, g in zip(own, groups, strict=True)])
    else:
        place = F.row_number().over(Window.partitionBy(*keys, "level", "node", "kind").orderBy("item"))
        first = pieces.withColumn("_n", place).filter(F.col("_n") <= n)
        kept = first.groupBy(*keys, "level", "node").agg(*[F.array_sort(F.collect_list(c)).alias(g) for c, g in zip(own, groups, strict=True)])
    kept = materialize(kept, "nodes")
    shape = kept.schema[groups[0]].dataType
    state = None
    for k in reversed(range(levels)):
        # Ranks have no gaps, so a node's first rank stands for it.
        nodes = points.filter(F.col("r") % FAN**k == 0).withColumn("node", (F.col("r") / FAN**k).cast("long"))
        here = kept.filter(F.col("level") == k).select(*keys, "node", *[F.col(g).alias(f"_own_{g}") for g in groups])
        now = (nodes if k == 0 else nodes.select(*keys, "node")).join(here, [*keys, "node"], "left")
        lists = {g: [F.col(f"_own_{g}")] for g in groups}
        if state is not None:
            now = now.withColumn("_up", F.floor(F.col("node") / FAN).cast("long")).join(state, [*keys, "_up"], "left")
            lists = {g: [*own_, F.col(f"_up_{g}")] for g, own_ in lists.items()}
        merged = [F.slice(F.array_sort(F.concat(*[F.coalesce(x, F.array().cast(shape)) for x in lists[g]])), 1, n).alias(g) for g in groups]
        if k == 0:
            return now.select(*points.columns, *merged)
        state = now.select(*keys, F.col("node").alias("_up"), *[m.alias(f"_up_{g}") for g, m in zip(groups, merged, strict=True)])
    raise AssertionError


def node_extremes(points: DataFrame, keys: Sequence[str], low: Column, high: Column) -> tuple[DataFrame, int]:
    """(nodes with ``low`` and ``high``, the smallest and largest of two struct columns over their points; levels)."""
    levels = height(points)
    base = points.select(*keys, F.col("r").alias("node"), low.alias("low"), high.alias("high"))
    tables = [materialize(base.withColumn("level", F.lit(0)), "nodes")]
    for k in range(1, levels):
        up = tables[-1].groupBy(*keys, F.floor(F.col("node") / FAN).cast("long").alias("node")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
        tables.append(materialize(up.withColumn("level", F.lit(k)), "nodes"))
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out, levels


def range_extremes(ranges: DataFrame, nodes: DataFrame, levels: int, keys: Sequence[str], ident: str) -> DataFrame:
    """``ident, low, high`` over the ranks ``[a, b)`` of each range that holds a point."""
    pieces = ranges.filter("a < b").select(*keys, ident, F.explode(covered(F.col("a"), F.col("b"), levels)).alias("c")).select(*keys, ident, "c.level", "c.node")
    return pieces.join(nodes, [*keys, "level", "node"]).groupBy(ident).agg(F.min("low").alias("low"), F.max("high").alias("high"))


def first_reaching(ranges: DataFrame, nodes: DataFrame, levels: int, keys: Sequence[str], ident: str, reaches: Column) -> DataFrame:
    """``ident, r``: the first point of each range ``[a, b)`` at which ``reaches`` holds, where there is one.

    ``reaches`` may use a node's ``low`` and ``high`` and the ranges' own columns, and must hold for a node exactly if it holds
    for one of its points.
    """
    extra = [c for c in ranges.columns if c not in (*keys, ident, "a", "b")]
    pieces = ranges.filter("a < b").select(*keys, ident, *extra, F.explode(covered(F.col("a"), F.col("b"), levels)).alias("c"))
    found = pieces.select(*keys, ident, *extra, "c.level", "c.node")
    start = lambda level, node: node * F.pow(F.lit(float(FAN)), level).cast("long")
    done = None
    for k in reversed(range(levels)):
        hit = found.join(nodes, [*keys, "level", "node"]).filter(reaches)
        first = hit.groupBy(*keys, ident, *extra).agg(F.min_by(F.struct("level", "node"), start(F.col("level"), F.col("node"))).alias("c"))
        first = materialize(first.select(*keys, ident, *extra, "c.level", "c.node"), "search")
        ended = first.filter("level = 0").select(ident, F.col("node").alias("r"))
        done = ended if done is None else done.unionByName(ended)
        if k == 0:
            return done
        # The first node of a range holds its first point: only its children are looked at.
        found = first.filter("level > 0").select(*keys, ident, *extra, (F.col("level") - 1).alias("level"), F.explode(F.sequence(F.col("node") * FAN, F.col("node") * FAN + FAN - 1)).alias("node"))
    raise AssertionError
