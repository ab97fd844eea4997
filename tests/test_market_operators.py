"""Fills, books, windows, calendars and statistics on hand-checked or folded examples."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import BASE, at, book_fold, order_fold
from tickloom.operators import book as bk, bursts as bu, conditioning as cn, eventwindows as ew, fills as fl, spreads as sp, stats as st
from tickloom.operators.bars import wallet_window_events, wallet_windows
from tickloom.operators.sessions import label_sessions

L1 = "market string, time_exchange timestamp, best_bid_px double, best_bid_sx double, best_ask_px double, best_ask_sx double"
# Six quotes (seconds, bid, size, ask, size) whose microprices are 50.8, 50.5, 49.4, 50, 51 and 47.5.
TICKS = [(0, 50.0, 4.0, 52.0, 6.0), (2, 50.0, 5.0, 51.0, 5.0), (6, 49.0, 2.0, 51.0, 8.0), (45, 49.5, 1.0, 50.5, 1.0), (118, 48.0, 3.0, 52.0, 1.0), (590, 47.0, 1.0, 49.0, 3.0)]
# At 50 the queue of 4 is passed by the third print; at 52 one print takes the queue of 6.
PRINTS = [(0.5, 50.0, 3.0), (0.7, 50.0, 1.0), (0.9, 50.0, 0.5), (1.05, 52.0, 7.0)]
M = "aa:IDX"


def fill_inputs(spark, ticks=TICKS, prints=PRINTS):
    l1 = spark.createDataFrame([(M, at(t), *r) for t, *r in ticks], L1)
    tr = spark.createDataFrame([(M, at(t), i, p, q) for i, (t, p, q) in enumerate(prints)], "market string, time_exchange timestamp, seq long, price double, base_amount double")
    fund = spark.createDataFrame([(M, at(-3600), 0.0018)], "market string, time_exchange timestamp, funding_rate double")
    return l1, tr, fund


def test_fills_and_money_math(spark):
    l1, tr, fund = fill_inputs(spark)
    f = fl.fill_markouts(fl.touch_fills(l1, tr, width_s=1), l1, fund, width_s=60).orderBy("fill_time").collect()
    assert [(r["side"], r["fill_price"], r["fill_time"], r["size_bucket"]) for r in f] == [("buy", 50.0, at(0.9), "trickle"), ("sell", 52.0, at(1.05), "sweep")]
    seen = {"1s": (50.8, 1), "5s": (50.5, 5), "30s": (49.4, 30), "2m": (51.0, 120), "10m": (47.5, 600)}
    for h, (micro, s) in seen.items():
        gross, drift = (micro - 50.0) / 50.0 * 1e4, 0.005 * s
        assert f[0][f"microprice_{h}"] == pytest.approx(micro)
        assert f[0][f"gross_markout_{h}_bps"] == pytest.approx(gross)
        assert f[0][f"funding_drift_{h}_bps"] == pytest.approx(drift)
        assert f[0][f"net_markout_{h}_bps"] == pytest.approx(gross - 1.5 - drift)
    assert f[1]["net_markout_1s_bps"] == pytest.approx((52.0 - 50.5) / 52.0 * 1e4 - 1.5 + 0.005)
    assert {r["segment"] for r in f} == {"RTH"} and {r["cluster_key"] for r in f} == {"aa:IDX|2026-07-06T12:00:00"}


def test_repeated_fills_stay_apart(spark):
    l1, tr, fund = fill_inputs(spark)
    fills = fl.touch_fills(l1, tr)
    assert fl.fill_markouts(fills.union(fills), l1, fund).count() == 4


def test_future_rows_never_change_past_fills(spark):
    l1, tr, _ = fill_inputs(spark)
    base = {tuple(r) for r in fl.touch_fills(l1, tr).collect()}
    l2, tr2, _ = fill_inputs(spark, TICKS + [(800, 50.0, 1.0, 51.0, 1.0)], PRINTS + [(805, 10.0, 9.0)])
    later = {tuple(r) for r in fl.touch_fills(l2, tr2).collect()}
    assert base <= later


def test_unknown_funding_is_an_error(spark):
    l1, tr, fund = fill_inputs(spark)
    late = fund.withColumn("time_exchange", F.lit(at(10_000)))
    with pytest.raises(Exception, match="no funding rate known"):
        fl.fill_markouts(fl.touch_fills(l1, tr), l1, late).collect()


def tape(seed, n=220):
    r, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += r.choice([0, 0, 1, 2, 7])
        kind = "SNAPSHOT" if (i < 6 or 90 <= i < 97) else r.choice(["SET", "ADD", "ADD", "SUB", "DELETE"])
        buy = r.random() < 0.5
        out.append((at(t), kind, buy, float(100 + (-r.randrange(1, 5) if buy else r.randrange(1, 5))), float(r.randrange(0 if kind == "SET" else 1, 5))))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_book_windows_equal_a_fold(spark, seed):
    ev = tape(seed)
    df = spark.createDataFrame([("m", i, *e) for i, e in enumerate(ev)], "market string, seq long, time_exchange timestamp, update_type string, is_buy boolean, entry_px double, entry_sx double")
    st_ = bk.level_states(df, width_s=20, strict=False)
    want = book_fold(ev)
    l1 = {r["time_exchange"]: tuple(r)[2:] for r in bk.l1_after_batches(st_, width_s=30).collect()}
    for t, bids, asks in want:
        b, a = max(bids, default=None), min(asks, default=None)
        assert l1[t] == (b, bids.get(b), a, asks.get(a))
    depth = {}
    for r in bk.depth_after_batches(st_, 2, width_s=30).collect():
        depth.setdefault((r["time_exchange"], r["side"]), []).append((r["level"], r["price"], r["size"]))
    for t, bids, asks in want:
        assert [x[1:] for x in sorted(depth.get((t, "bid"), []))] == sorted(bids.items(), reverse=True)[:2]
        assert [x[1:] for x in sorted(depth.get((t, "ask"), []))] == sorted(asks.items())[:2]
    # sampled between instants: the latest earlier state, with its own time
    mid = want[len(want) // 2][0] + dt.timedelta(milliseconds=500)
    s = bk.sample_depth(st_, spark.createDataFrame([("m", mid)], "market string, sample_time timestamp"), bucket_s=30).collect()
    assert {(r["side"], r["price"], r["size"]) for r in s} == {("bid", p, q) for p, q in want[len(want) // 2][1].items()} | {("ask", p, q) for p, q in want[len(want) // 2][2].items()}
    assert all(r["depth_source_time"] == want[len(want) // 2][0] for r in s)


@pytest.mark.parametrize("seed", [4, 5])
def test_order_level_book_equals_a_fold(spark, seed):
    r, t, ev = random.Random(seed), 0, []
    for i in range(200):
        t += r.choice([0, 1, 3])
        kind = "SNAPSHOT" if (i < 8 or 80 <= i < 88) else r.choice(["SET", "ADD", "SUB", "DELETE", "PENDING"])
        buy = r.random() < 0.5
        ev.append((at(t), kind, f"o{r.randrange(8)}", buy, float(100 + (-1 if buy else 1) * r.randrange(1, 4)), float(r.randrange(1, 5)), r.random() < 0.85))
    rows = [("m", i, tt, k, o, b, p, q, "0" if live else "1", "Limit", "OPEN") for i, (tt, k, o, b, p, q, live) in enumerate(ev)]
    df = spark.createDataFrame(rows, "market string, seq long, time_exchange timestamp, update_type string, order_id string, is_buy boolean, entry_px double, entry_sx double, is_trigger string, order_type string, hl4_status string")
    l1 = {x["time_exchange"]: tuple(x)[2:] for x in bk.l1_after_batches(bk.order_level_states(df, strict=False), width_s=40).collect()}
    for tt, bids, asks in order_fold(ev):
        if tt in l1:
            b, a = max(bids, default=None), min(asks, default=None)
            assert l1[tt] == (b, bids.get(b), a, asks.get(a))


def test_sanitize_drops_orphans_and_clamps(spark):
    ev = [(at(0), "SNAPSHOT", True, 99.0, 5.0), (at(1), "SUB", True, 98.0, 1.0), (at(2), "SUB", True, 99.0, 8.0), (at(3), "ADD", True, 99.0, 2.0)]
    df = spark.createDataFrame([("m", i, *e) for i, e in enumerate(ev)], "market string, seq long, time_exchange timestamp, update_type string, is_buy boolean, entry_px double, entry_sx double")
    got = [(r["fix"], r["clean_sx"], r["size"]) for r in bk.sanitize(bk.level_states(df, strict=False)).orderBy("seq").collect()]
    assert [g[0] for g in got] == ["kept", "orphan_dropped", "oversize_clamped", "kept"]
    assert got[2][1] == 5.0 and got[3][2] == 2.0
    with pytest.raises(Exception, match="unsupported book update_type"):
        bk.level_states(df.withColumn("update_type", F.lit("NOPE"))).collect()


def test_baselines_match_the_greedy_search(spark):
    r = random.Random(3)
    day = 86_400
    ev = sorted((r.randrange(0, 12) * day + r.randrange(8, 12) * 3600, r.randrange(60, 5400)) for _ in range(14))
    rows = [("m", f"e{i}", at(s), at(s + d), 3.0, 3.0) for i, (s, d) in enumerate(ev)]
    sh = spark.createDataFrame(rows, "market string, event_id string, start_time timestamp, end_time timestamp, rate_multiple double, displacement_multiple double")
    w = ew.merge_windows(sh)
    cover = spark.createDataFrame([("m", at(-2 * day), at(16 * day))], "market string, cover_start timestamp, cover_end timestamp")
    got = {x["pair_id"]: x["b_start"] for x in ew.match_baselines(w, ew.baseline_candidates(w, cover)).collect()}
    wins = sorted((x["start"], x["end"], x["pair_id"]) for x in w.collect())
    used, want = [], {}
    for s, e, pid in wins:
        done = False
        for d in range(1, 30):
            for k in (-d, d):
                a, z = s + dt.timedelta(days=k), e + dt.timedelta(days=k)
                if a < at(-2 * day) or z > at(16 * day):
                    continue
                if any(a <= y and x <= z for x, y, *_ in [*wins, *used]):
                    continue
                used.append((a, z))
                want[pid] = a
                done = True
                break
            if done:
                break
    assert got == want


def test_session_labels(spark):
    u = lambda *a: dt.datetime(*a)
    ny = [(u(2026, 3, 8, 16), "weekend"), (u(2026, 3, 9, 13, 29, 59), "off-hours-weekday"), (u(2026, 3, 9, 13, 30), "RTH"), (u(2026, 3, 6, 14, 30), "RTH"),
          (u(2026, 7, 3, 16), "holiday"), (u(2026, 11, 27, 17, 59), "RTH"), (u(2026, 11, 27, 18), "off-hours-weekday")]
    kr = [(u(2026, 5, 5, 1), "holiday"), (u(2026, 5, 6, 0), "RTH"), (u(2026, 5, 6, 6, 30), "off-hours-weekday")]
    for rows, venue in ((ny, "XNYS"), (kr, "XKRX")):
        df = spark.createDataFrame(rows, "t timestamp, want string")
        assert label_sessions(df, "t", venue, "got").filter("got <> want").count() == 0
    with pytest.raises(ValueError):
        label_sessions(df, "t", "XXXX")


def hourly(spark, values, start=0, gap_after=None):
    rows, t = [], start
    for i, v in enumerate(values):
        rows.append(("m", at(t), float(v)))
        t += 7200 if gap_after == i else 3600
    return spark.createDataFrame(rows, "market string, time_exchange timestamp, funding_rate double")


def test_regime_runs_and_gap_excluded_lags(spark):
    f = hourly(spark, [x / 8760 for x in (-0.10, 0.30, 1.20, 3.50, 0.20, 1.10)])
    got = {r["regime"]: (r["runs"], r["mean_hours"]) for r in st.regime_runs(f, cn.apr("funding_rate")).collect()}
    assert got == {"25": (2, 2.0), "100": (2, 1.5), "300": (1, 1.0)}
    g = hourly(spark, range(50), gap_after=25)
    assert st.lag_pairs(g, "funding_rate", 1).count() == 48
    assert st.lag_pairs(g, "funding_rate", 24).count() == 2 + 0


def test_ar1_recovers_phi(spark):
    r, x, v = random.Random(0), 0.0, []
    for _ in range(4000):
        x = 0.8 * x + r.gauss(0, 1)
        v.append(x)
    row = st.ar1(hourly(spark, v), "funding_rate").collect()[0]
    assert row["ar1_phi"] == pytest.approx(0.8, abs=0.05)
    assert row["shock_half_life_hours"] == pytest.approx(math.log(0.5) / math.log(row["ar1_phi"]))


def test_round_trip_costs_and_breakeven(spark):
    pairs = spark.createDataFrame([("X", "a:X", "b:X")], "underlier string, market_a string, market_b string")
    fees = spark.createDataFrame([("a", 1.0, 2.0), ("b", 2.0, 3.0)], "dex string, effective_maker_bps double, effective_taker_bps double")
    hs = spark.createDataFrame([("a:X", 2.0), ("b:X", 4.0)], "market string, half_spread_bps double")
    r = sp.round_trip_costs(pairs, fees, hs).collect()[0]
    assert (r["maker_bps"], r["taker_bps"]) == (6.0, 22.0)
    with pytest.raises(Exception, match="duplicate key"):
        sp.round_trip_costs(pairs, fees.unionByName(fees), hs).collect()


def test_wallet_windows_pair_settlement_and_placebo(spark):
    h = dt.datetime(2026, 7, 6, 10)
    m = lambda k: h + dt.timedelta(minutes=k)
    rows = [("m", m(55), "a", -5.0), ("m", m(62), "a", 6.0), ("m", m(55), "b", 5.0), ("m", m(63), "b", 1.0), ("m", m(85), "c", -1.0), ("m", m(92), "c", 2.0), ("m", m(55), "solo", 1.0)]
    df = spark.createDataFrame(rows, "market string, time_exchange timestamp, user_taker string, signed_notional double")
    e = wallet_window_events(wallet_windows(df)).collect()[0]
    assert (e["short_open_close_share"], e["baseline_short_open_close_share"], e["short_open_close_share_difference"]) == (0.5, 1.0, -0.5)


def burst_tape(spark, extra=()):
    rows, i = [], 0
    for k in range(65):
        for j, side in enumerate(("BUY", "SELL")):
            rows.append(("m", at(k * 60 + 10 + j), i, 100.0 + (0.01 if k % 2 else -0.01), 1.0, side, "w" + str(k)))
            i += 1
    for j in range(7):
        rows.append(("m", at(65 * 60 + j), i, 99.0 - j * 0.1, 2.0, "SELL", "whale"))
        i += 1
    rows += [("m", at(s), i + 1 + n, p, q, sd, w) for n, (s, p, q, sd, w) in enumerate(extra)]
    return spark.createDataFrame(rows, "market string, time_exchange timestamp, seq long, price double, base_amount double, taker_side string, user_taker string")


def test_burst_detected_and_future_proof(spark):
    one = bu.burst_events(burst_tape(spark)).collect()
    assert len(one) == 1
    e = one[0]
    assert (e["direction"], e["trade_count"], e["wallets"], e["aggressor_size"], e["start_time"]) == ("SELL", 7, ["whale"], 14.0, at(65 * 60))
    assert e["rate_multiple"] == pytest.approx(7.0)
    later = bu.burst_events(burst_tape(spark, [(65 * 60 + 600, 150.0, 1.0, "BUY", "z")])).collect()
    assert later[0] == e


def test_zero_baseline_abstains(spark):
    flat = burst_tape(spark).filter("taker_side = 'BUY' or user_taker = 'whale'")
    c = bu.burst_candidates(flat)
    assert bu.burst_events(flat).count() == 0
    assert bu.abstentions(c).collect()[0]["zero_baseline_rate"] == 1


def test_range_totals_of_repeated_odd_and_large_values(spark):
    from tickloom.operators.ranges import range_totals

    left = spark.createDataFrame([("m", at(10), at(20))] * 2 + [("m", at(20), at(30)), ("m", at(100), at(200)), ("m", at(300), at(400))], "market string, a timestamp, b timestamp")
    ticks = [("m", at(0), 1e15), ("m", at(5), float("nan")), ("m", at(12), 0.25), ("m", at(15), 0.5), ("m", at(25), float("inf")), ("m", at(150), float("nan")), ("m", at(350), -0.125)]
    right = spark.createDataFrame(ticks, "market string, t timestamp, v double")
    got = range_totals(left, right, ["market"], "t", {"w": (F.col("a"), F.col("b"), False, True)}, {"n": F.lit(1), "v": F.col("v")}, width_s=7).orderBy("a").collect()
    assert [r["w_n"] for r in got] == [2, 2, 1, 1, 1]
    assert [r["w_v"] for r in got[:3]] == [0.75, 0.75, float("inf")] and math.isnan(got[3]["w_v"]) and got[4]["w_v"] == -0.125


@pytest.mark.parametrize(("exchange", "time", "label"), [
    ("XNYS", dt.datetime(2022, 6, 15, 15), "RTH"), ("XNYS", dt.datetime(2028, 6, 14, 15), "RTH"), ("XNYS", dt.datetime(2021, 6, 18, 15), "RTH"), ("XNYS", dt.datetime(2022, 6, 20, 15), "holiday"), ("XNYS", dt.datetime(2024, 11, 29, 18, 30), "off-hours-weekday"),
    ("XKRX", dt.datetime(2023, 1, 23, 2), "holiday"), ("XKRX", dt.datetime(2023, 5, 5, 2), "holiday"), ("XKRX", dt.datetime(2027, 2, 8, 2), "unknown"), ("XKRX", dt.datetime(2025, 6, 12, 2), "RTH"), ("XKRX", dt.datetime(2025, 6, 14, 2), "weekend"),
])
def test_session_labels_by_year(spark, exchange, time, label):
    assert label_sessions(spark.createDataFrame([(time,)], "t timestamp"), "t", exchange).first()["session"] == label


def test_a_calendar_of_ones_own(spark):
    cal = spark.createDataFrame([(dt.date(2027, 2, 8), None, None)], "local_date date, open_utc timestamp, close_utc timestamp")
    df = spark.createDataFrame([(dt.datetime(2027, 2, 8, 2),), (dt.datetime(2027, 2, 9, 2),)], "t timestamp")
    assert [r["session"] for r in label_sessions(df, "t", "XKRX", calendar=cal).orderBy("t").collect()] == ["holiday", "unknown"]


def test_pages_hold_what_is_asked_for(spark):
    from tickloom.sources.tables import page

    rows, total = page(spark.range(12_000).toDF("id"), number=2, size=5_000, sort="id")
    assert [r["id"] for r in rows.collect()] == list(range(5_000, 10_000)) and total.first()["total"] == 12_000


EVENT = "market string, seq long, time_exchange timestamp, update_type string, is_buy boolean, entry_px double, entry_sx double"


@pytest.mark.parametrize(("row", "message"), [
    ((at(2), "SUB", True, 98.0, 1.0), "SUB of absent level"), ((at(2), "SUB", True, 99.0, 8.0), "SUB of more than"), ((at(2), "SET", True, 99.0, -1.0), "negative size"), ((at(-5), "SET", True, 99.0, 1.0), "runs backwards"),
])
def test_a_strict_book_refuses_unsound_rows(spark, row, message):
    sound = [(at(0), "SNAPSHOT", True, 99.0, 5.0), (at(1), "ADD", True, 99.0, 2.0)]
    frame = lambda ev: spark.createDataFrame([("m", i, *e) for i, e in enumerate(ev)], EVENT)
    assert [r["size"] for r in bk.level_states(frame(sound)).orderBy("seq").collect()] == [5.0, 7.0]
    with pytest.raises(Exception, match=message):
        bk.level_states(frame([*sound, row])).collect()


@pytest.mark.parametrize(("row", "message"), [
    ((at(2), "SUB", "o9", True, 99.0, 1.0), "SUB of absent order"), ((at(2), "ADD", "o1", True, 98.0, 1.0), "ADD moves order o1"), ((at(2), "ADD", None, True, 98.0, 1.0), "without an order id"),
])
def test_a_strict_order_book_refuses_unsound_rows(spark, row, message):
    sound = [(at(0), "SNAPSHOT", "o1", True, 99.0, 5.0), (at(1), "SUB", "o1", True, 99.0, 2.0)]
    schema = "market string, seq long, time_exchange timestamp, update_type string, order_id string, is_buy boolean, entry_px double, entry_sx double, is_trigger string, order_type string, hl4_status string"
    frame = lambda ev: spark.createDataFrame([("m", i, *e, "0", "Limit", "OPEN") for i, e in enumerate(ev)], schema)
    assert [r["size"] for r in bk.order_level_states(frame(sound)).orderBy("seq").collect()] == [5.0, 3.0]
    with pytest.raises(Exception, match=message):
        bk.order_level_states(frame([*sound, row])).collect()
