"""Sliced windows, as-of joins, ranges, islands, ranks and quantiles against brute force."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.helpers import at
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.rounding import whole
from tickloom.functions.timecols import micros
from tickloom.operators.asof import asof_join
from tickloom.operators.harvest import cooldown
from tickloom.operators.indicators import Macd, compute, ewm, read_spec
from tickloom.operators.islands import interval_islands
from tickloom.operators.lookups import join_one_to_one, nearest_join, strict_lookup
from tickloom.operators.ranges import range_totals, rows_in_windows
from tickloom.operators.ranking import global_prefix
from tickloom.operators.slicing import Running, busiest_slice, fitting_width, openings, running


def ticks(n=300, seed=1, span=5000):
    r = random.Random(seed)
    # one market holds most rows; repeated instants are common
    return [("hot" if r.random() < 0.7 else "cold", at(r.randrange(span)), i, float(r.randrange(50))) for i in range(n)]


@pytest.mark.parametrize("width", [60, 100_000])
def test_running_matches_a_plain_fold(spark, width):
    rows = ticks()
    df = spark.createDataFrame(rows, "market string, t timestamp, seq int, v double")
    even = F.when(F.col("seq") % 2 == 0, F.col("v"))
    got = running(df, ["market"], micros("t"), {
        "s": Running("sum", F.col("v")), "m": Running("max", F.col("v"), exclusive=True), "l": Running("last", even), "c": Running("count", even)},
        tie=[F.col("seq")], width_s=width).toPandas().set_index("seq").sort_index()
    for market in ("hot", "cold"):
        s, m, last, c = 0.0, None, None, 0
        for mk, t, i, v in sorted((x for x in rows if x[0] == market), key=lambda x: (x[1], x[2])):
            g = got.loc[i]
            assert (None if pd.isna(g["m"]) else g["m"]) == m
            s, m = s + v, v if m is None else max(m, v)
            if i % 2 == 0:
                last, c = v, c + 1
            assert g["s"] == pytest.approx(s) and g["c"] == c
            assert (None if pd.isna(g["l"]) else g["l"]) == last


@pytest.mark.parametrize("width", [60, 100_000])
def test_openings_cross_slice_borders(spark, width):
    rows = [(m, t, i, float(int(v) % 3)) for m, t, i, v in ticks(seed=2)]
    df = spark.createDataFrame(rows, "market string, t timestamp, seq int, v double")
    changed = F.col("p").isNull() | (F.col("p") != F.col("v"))
    got = openings(df, ["market"], "t", {"o": changed}, {"p": F.col("v")}, mark="seq", tie=[F.col("seq")], width_s=width).toPandas().set_index("seq")["o"]
    for market in ("hot", "cold"):
        prev, opened = None, None
        for mk, t, i, v in sorted((x for x in rows if x[0] == market), key=lambda x: (x[1], x[2])):
            if v != prev:
                opened = i
            prev = v
            assert got.loc[i] == opened


@pytest.mark.parametrize("direction,strict", [("backward", False), ("backward", True), ("forward", False), ("forward", True)])
def test_asof_matches_merge_asof(spark, direction, strict):
    a = [(m, t, i) for m, t, i, _ in ticks(200, 3)]
    b = list({(m, t): (m, t, v) for m, t, _, v in ticks(200, 4)}.values())
    left = spark.createDataFrame(a, "market string, t timestamp, id int")
    right = spark.createDataFrame(b, "market string, rt timestamp, v double")
    got = asof_join(left, right, ["market"], "t", "rt", ["v"], direction=direction, strict=strict, width_s=300).toPandas().set_index("id")["v"]
    pa = pd.DataFrame(a, columns=["market", "t", "id"]).sort_values("t")
    pb = pd.DataFrame(b, columns=["market", "rt", "v"]).sort_values("rt")
    want = pd.merge_asof(pa, pb, left_on="t", right_on="rt", by="market", direction=direction, allow_exact_matches=not strict).set_index("id")["v"]
    pd.testing.assert_series_equal(got.sort_index(), want.sort_index(), check_dtype=False, check_index_type=False)


def test_staleness_nulls_and_flags(spark):
    left = spark.createDataFrame([("m", at(100)), ("m", at(1000)), ("x", at(5))], "market string, t timestamp")
    right = spark.createDataFrame([("m", at(90), 1.0)], "market string, rt timestamp, v double")
    got = {r["market"] + str(r["t"].minute): (r["v"], r["stale"]) for r in asof_join(left, right, ["market"], "t", "rt", ["v"], max_age_s=60).collect()}
    assert got == {"m1": (1.0, False), "m16": (None, True), "x0": (None, True)}


def test_range_totals_and_rows_agree_with_scans(spark):
    rows = ticks(250, 5)
    r = random.Random(6)
    wins = [(i, r.choice(["hot", "cold"]), at(s := r.randrange(4000)), at(s + r.randrange(900))) for i in range(40)]
    t = spark.createDataFrame(rows, "market string, t timestamp, seq int, v double")
    w = spark.createDataFrame(wins, "id int, market string, a timestamp, z timestamp")
    got = {x["id"]: (x["c_n"], x["o_n"], x["c_v"]) for x in range_totals(
        w, t, ["market"], "t", {"c": (F.col("a"), F.col("z"), True, True), "o": (F.col("a"), F.col("z"), False, False)}, {"n": F.lit(1), "v": F.col("v")}, width_s=500).collect()}
    pairs = rows_in_windows(w, t, ["market"], "a", "z", "t", bucket_s=200).groupBy("id").count().toPandas().set_index("id")["count"].to_dict()
    for i, m, a, z in wins:
        hit = [v for mk, tt, _, v in rows if mk == m and a <= tt <= z]
        assert got[i][0] == len(hit) == pairs.get(i, 0)
        assert got[i][1] == sum(1 for mk, tt, _, v in rows if mk == m and a < tt < z)
        assert got[i][2] == pytest.approx(sum(hit))


@pytest.mark.parametrize("end", [True, False])
def test_dense_windows_are_dealt_by_their_pairs(spark, end):
    """Same rows as without counting; tasks grow with the pairs, not with the rows read, and a tick's windows lie together."""
    rows = ticks(400)
    t = spark.createDataFrame(rows, "market string, t timestamp, seq int, v double")
    w = spark.createDataFrame([(f"w{i}", m, at(10 * i), at(10 * i + 900)) for i in range(200) for m in ("hot", "cold")], "id string, market string, a timestamp, z timestamp")
    few, many, none = (rows_in_windows(x, t, ["market"], "a", "z", "t", bucket_s=200, include_end=end, pairs_per_task=n) for x, n in ((w, None), (w, 500), (w.limit(0), 500)))
    assert few.columns == many.columns == none.columns and none.count() == 0
    got = many.withColumn("_p", F.spark_partition_id()).collect()
    assert sorted(tuple(r)[:-1] for r in got) == sorted(map(tuple, few.collect())) and len(got) > 5_000
    assert len({r["_p"] for r in got}) > 15 and many.rdd.getNumPartitions() > len(got) / 500
    runs = sum(x["seq"] != y["seq"] for x, y in zip(got, got[1:], strict=False)) + 1
    assert runs == len({r["seq"] for r in got})


def test_interval_islands_merge_touching_and_contained(spark):
    iv = [("m", at(0), at(100)), ("m", at(10), at(20)), ("m", at(100), at(110)), ("m", at(171), at(180)), ("m", at(240), at(241))]
    df = spark.createDataFrame(iv, "market string, s timestamp, e timestamp")
    got = {r["s"]: r["island_start"] for r in interval_islands(df, ["market"], "s", "e", max_gap_s=60, width_s=50).collect()}
    assert got == {at(0): at(0), at(10): at(0), at(100): at(0), at(171): at(171), at(240): at(171)}


def test_global_prefix_orders_heavy_ties(spark):
    r = random.Random(7)
    rows = [("a" if r.random() < 0.8 else "b", at(i), 0.0 if r.random() < 0.5 else r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "market string, t timestamp, v double")
    got = {x["t"]: x["n"] for x in global_prefix(df, F.lit(1).cast("long"), "v", "market", micros("t"), out="n", width_s=60).collect()}
    want = {t: i + 1 for i, (m, t, v) in enumerate(sorted(rows, key=lambda x: (x[2], x[0], x[1])))}
    assert got == want


def test_exact_quantiles_with_one_dominant_value(spark):
    r = random.Random(8)
    rows = [("m", 5.0 if r.random() < 0.4 else r.gauss(0, 10)) for _ in range(3001)] + [("k", 1.0)]
    got = {x["market"]: x for x in exact_quantiles(spark.createDataFrame(rows, "market string, v double"), ["market"], "v", {"a": 0.025, "b": 0.5, "c": 0.99}).collect()}
    v = np.array([x for m, x in rows if m == "m"])
    for n, p in (("a", 0.025), ("b", 0.5), ("c", 0.99)):
        assert got["m"][n] == pytest.approx(np.quantile(v, p))
        assert got["k"][n] == 1.0


def test_cooldown_equals_the_greedy_loop(spark):
    r = random.Random(9)
    ts = sorted({at(r.randrange(40_000)) for _ in range(250)})
    got = sorted(x["t"] for x in cooldown(spark.createDataFrame([("m", t) for t in ts], "market string, t timestamp"), ["market"], "t", 300).collect())
    want, last = [], None
    for t in ts:
        if last is None or t >= last + dt.timedelta(seconds=300):
            want.append(t)
            last = t
    assert got == want


def test_nearest_prefers_the_earlier_on_ties(spark):
    left = spark.createDataFrame([("m", at(100)), ("m", at(500))], "market string, t timestamp")
    right = spark.createDataFrame([("m", at(90), 1.0), ("m", at(110), 2.0), ("m", at(505), 3.0)], "market string, rt timestamp, v double")
    got = [r["v"] for r in nearest_join(left, right, ["market"], "t", "rt", ["v"], 60).orderBy("t").collect()]
    assert got == [1.0, 3.0]


def test_lookups_reject_duplicates_and_absences(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Exception, match="duplicate key a"):
        join_one_to_one(df, spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int"), ["k"]).collect()
    with pytest.raises(Exception, match="no k row for b"):
        strict_lookup(df, spark.createDataFrame([("a", 1)], "k string, v int"), "k", ["v"]).collect()


def test_recursive_filter_is_independent_of_chunks(spark):
    v = [float(x) for x in np.random.default_rng(0).normal(100, 5, 120)]
    df = spark.createDataFrame([("m", at(86_400 * i), x) for i, x in enumerate(v)], "market string, time_open timestamp, close double")
    want = pd.Series(v).ewm(alpha=2 / 11, adjust=False).mean()
    for chunk in (86_400 * 7, 86_400 * 1000):
        got = [r["e"] for r in ewm(df, {"e": ("close", 2 / 11)}, chunk_s=chunk).orderBy("time_open").collect()]
        assert got == pytest.approx(list(want))


def test_recursive_filter_over_many_chunks(spark):
    v = [float(x) for x in np.random.default_rng(1).normal(0, 5, 3000)]
    rows = [(m, at(3600 * i), x * s) for m, s in (("m", 1.0), ("n", -2.0)) for i, x in enumerate(v)] + [("bad", at(0), 1.0), ("bad", at(60), None), ("bad", at(120), 2.0)]
    df = spark.createDataFrame(rows, "market string, time_open timestamp, close double")
    alphas = {"a": 1.0, "b": 0.9, "c": 2 / 3, "d": 0.1, "e": 1e-4}
    got = ewm(df, {n: ("close", a) for n, a in alphas.items()}, chunk_s=86_400 * 30).orderBy("market", "time_open").toPandas()
    assert list(got.columns) == ["market", "time_open", "close", *alphas] and len(got) == len(rows)
    for market, scale in (("m", 1.0), ("n", -2.0)):
        own = got[got.market == market]
        for n, a in alphas.items():
            assert list(own[n]) == pytest.approx(list(pd.Series(v).mul(scale).ewm(alpha=a, adjust=False).mean()), rel=1e-9, abs=1e-9)
    assert got[got.market == "bad"]["d"].isna().tolist() == [False, True, True]


def test_indicator_specs(spark):
    assert read_spec("macd:5:10") == read_spec("macd:slow=10:fast=5") == Macd(5, 10, 9)
    for bad, text in (("nope", "known indicators"), ("sma:0", "cannot use"), ("sma:x", "takes int"), ("sma:1:2", "no free parameter"), ("sma:5:period=6", "no free parameter"), ("bbands:mult=nan", "cannot use")):
        with pytest.raises(ValueError, match=text):
            read_spec(bad)


def test_indicators_share_one_pass(spark):
    bars = spark.createDataFrame([("m", at(i), float(i % 7)) for i in range(40)], "market string, time_open timestamp, close double")
    both = compute(["sma:3", "bbands:period=5"], bars)
    assert both.columns == ["market", "time_open", "sma_3", "bb_mid_5", "bb_upper_5", "bb_lower_5"] and both.count() == 40


def test_slice_width_follows_the_busiest_hour(spark):
    rows = [("hot", at(i / 100), i, 1.0) for i in range(1000)] + [("cold", at(i * 3600), i, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "market string, t timestamp, seq int, v double")
    assert fitting_width(df, ["market"], micros("t"), 5000) == 86_400
    assert fitting_width(df, ["market"], micros("t"), 999) == 1
    assert busiest_slice(df, ["market"], micros("t"), 1) == 100


def test_statistics_by_name_or_by_function(spark):
    from tickloom.operators.bootstrap import bootstrap_ci, statistic

    df = spark.createDataFrame([("m", f"c{i % 8}", float(i)) for i in range(64)], "market string, c string, v double")
    sums = {"n": F.lit(1), "x": F.col("v")}
    named = bootstrap_ci(df, ["market"], "c", sums, "mean").first()
    own = bootstrap_ci(df, ["market"], "c", sums, lambda s: s["x"] / s["n"]).first()
    assert named == own and named["point"] == pytest.approx(31.5)
    for bad in ("median", "ratio"):
        with pytest.raises(ValueError, match="statistic"):
            statistic(bad, sums)


def test_candle_sources(spark):
    from tickloom.sources.candles import CandleSources

    known = CandleSources()
    known.add("own", lambda interval: spark.createDataFrame([("a", 1), ("b", 2)], "market string, n int"), "1h")
    assert [tuple(r) for r in known.candles("own", "1h", "b").collect()] == [("b", 2, "own", "1h")]
    for name, interval in (("own", "1d"), ("other", "1h")):
        with pytest.raises(ValueError, match="no source"):
            known.candles(name, interval)
    with pytest.raises(ValueError, match="known already"):
        known.add("own", lambda i: None)


def test_whole_rounds_as_round_does(spark):
    values = [0.5, -0.5, 1.5, 2.5, -2.5, 0.49999999999999994, -0.3, 4503599627370497.0, 1e12 + 0.5, 1e300, 104.49999999999999, 104.5, float("inf"), -float("inf"), float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.filter(~whole(F.col("v")).eqNullSafe(F.round("v"))).count() == 0


def test_derived_prices_take_decimal_rounding_only_beyond_the_plain_range(spark):
    """Filters and columns repeat a price's expression, so each repetition has to be arithmetic."""
    from tickloom.operators.quotes import microprices
    from tickloom.plans.bindings import Tables
    from tickloom.plans.q_fills import l1_of

    plan = microprices(l1_of(Tables(spark, "/root/testdata/sf0.001")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == plan.count("ELSE round(") > 0


def test_book_walks_run_once(spark):
    """Sizes and epochs are read from a written walk: what is left to run passes over slices, never over rows in order."""
    from tickloom.operators import book as bk
    from tickloom.plans.bindings import Tables

    states = bk.level_states(Tables(spark, "/root/testdata/sf0.001").book, strict=False)
    lines = states._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert any("Window" in x for x in lines) and not any("Window" in x and "seq#" in x for x in lines)
