"""Ranges of ranked points through the fan-out tree, and slices of crowded instants, against direct search."""

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import at
from tickloom.operators import book as bk, fantree as ft
from tickloom.operators.slicing import SLICE, Running, fine_slices, running


@pytest.mark.parametrize("fan", [2, 16])
def test_covered_nodes_make_up_the_range(spark, fan, monkeypatch):
    monkeypatch.setattr(ft, "FAN", fan)
    ranges = [(a, b) for a in (0, 1, 15, 16, 17, 250) for b in (0, 1, 16, 31, 33, 255, 256, 271) if a <= b]
    levels = {2: 9, 16: 3}[fan]
    for r in spark.createDataFrame(ranges, "a long, b long").select("a", "b", ft.covered(F.col("a"), F.col("b"), levels).alias("c")).collect():
        got = sorted(x for c in r["c"] for x in range(c["node"] * fan ** c["level"], (c["node"] + 1) * fan ** c["level"]))
        assert got == list(range(r["a"], r["b"])) and len(r["c"]) <= 2 * fan * levels


def test_skyline_and_searches_equal_direct_search(spark, monkeypatch):
    monkeypatch.setattr(ft, "FAN", 4)
    r = random.Random(5)
    points = [(m, at(10 * i), float(r.randrange(1000))) for m, n in (("x", 90), ("y", 7)) for i in range(n)]
    df = ft.ranked(spark.createDataFrame(points, "market string, time timestamp, px double"), ["market"], "time", width_s=100)
    of = {(m, i): p for m in "xy" for i, p in enumerate(x[2] for x in points if x[0] == m)}
    assert {(x["market"], x["r"]): x["px"] for x in df.collect()} == of
    items = [("x", r.choice(["bid", "ask"]), float(k), *sorted((r.randrange(91), r.randrange(91)))) for k in range(60)] + [("y", "bid", 1.0, 0, 7), ("z", "bid", 1.0, 0, 1)]
    it = spark.createDataFrame(items, "market string, kind string, price double, a long, b long")
    for n in (1, 3):
        for x in ft.skyline(df, it, ["market"], ("bid", "ask"), F.struct("price"), n).collect():
            for kind in ("bid", "ask"):
                want = sorted(p for m, k, p, a, b in items if m == x["market"] and k == kind and a <= x["r"] < b)[:n]
                assert [y["price"] for y in x[kind]] == want
    nodes, levels = ft.node_extremes(df, ["market"], F.struct("px", "r"), F.struct("px", (-F.col("r")).alias("r")))
    ranges = [(i, "x", *sorted((r.randrange(91), r.randrange(91))), float(r.randrange(1000))) for i in range(40)] + [(50, "y", 0, 7, 2000.0)]
    rg = spark.createDataFrame(ranges, "i long, market string, a long, b long, bound double")
    got = {x["i"]: (x["low"]["px"], x["high"]["px"]) for x in ft.range_extremes(rg.drop("bound"), nodes, levels, ["market"], "i").collect()}
    first = {x["i"]: x["r"] for x in ft.first_reaching(rg, nodes, levels, ["market"], "i", F.col("high.px") >= F.col("bound")).collect()}
    for i, m, a, b, bound in ranges:
        own = [of[m, k] for k in range(a, b)]
        assert got.get(i) == ((min(own), max(own)) if own else None)
        assert first.get(i) == next((k for k in range(a, b) if of[m, k] >= bound), None)


def test_a_crowded_instant_is_cut_by_order(spark):
    rows = [("m", at(0), 1), *(("m", at(5), k) for k in range(2, 400)), ("m", at(6), 400), ("n", at(5), 401)]
    df = fine_slices(spark.createDataFrame(rows, "market string, t timestamp, seq long"), ["market"], "t", "seq", most=50)
    assert df.groupBy("market", SLICE).count().agg(F.max("count")).first()[0] <= 50
    got = running(df, ["market"], F.unix_micros("t"), {"n": Running("count", F.lit(1))}, tie=[F.col("seq")]).collect()
    assert all(x["n"] == (x["seq"] if x["market"] == "m" else 1) for x in got)


def test_one_snapshot_and_one_level_may_hold_most_rows(spark):
    """A snapshot of 300 levels at one instant and 300 updates of one level: slices of at most 40 rows, sizes as before."""
    ev = [(at(0), "SNAPSHOT", i % 2 == 0, 100.0 + (-1 - i if i % 2 == 0 else 1 + i), 2.0) for i in range(300)]
    ev += [(at(1 + i // 100), r, True, 99.0, float(1 + i % 3)) for i, r in enumerate(random.Random(3).choices(["ADD", "SUB", "SET", "DELETE"], [5, 6, 1, 1], k=300))]
    schema = "market string, seq long, time_exchange timestamp, update_type string, is_buy boolean, entry_px double, entry_sx double"
    df = spark.createDataFrame([("m", i, *e) for i, e in enumerate(ev)], schema)
    size = {}
    got = {r["seq"]: (r["prior"], r["size"]) for r in bk.level_states(df, rows_per_slice=40, strict=False).collect()}
    for i, (_, kind, buy, px, sx) in enumerate(ev):
        prior = size.get((buy, px), 0.0)
        size[buy, px] = {"ADD": prior + sx, "SUB": max(0.0, prior - sx), "DELETE": 0.0}.get(kind, sx)
        assert got[i] == (prior, size[buy, px])


@pytest.mark.parametrize("seed", [1, 2])
def test_cooldown_keeps_what_the_greedy_pass_keeps(spark, seed):
    from tickloom.operators.harvest import cooldown

    r, rows = random.Random(seed), []
    for key, n, span in (("a", 400, 3000), ("b", 60, 100_000), ("c", 1, 10)):  # a dense run, a sparse one, a single one
        rows += [(key, at(t), i) for i, t in enumerate(sorted(r.randrange(span) for _ in range(n)))]
    df = spark.createDataFrame(rows, "market string, t timestamp, i long")
    want, last = [], {}
    for key, t, i in sorted(rows):
        if key not in last or (t - last[key]).total_seconds() >= 60:
            last[key] = t
            want.append((key, t, i))
    assert sorted(tuple(x) for x in cooldown(df, ["market"], "t", 60).collect()) == want
