"""Queries against their own SQL on feeds that the sample tables do not show."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry

from .helpers import canon_rows


def both(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet/*.parquet')")
    got = entry.queries()[name](spark, str(folder))
    cur = con.execute(entry.oracle_sql()[name])
    return canon_rows(got.columns, got.collect()), canon_rows([c[0] for c in cur.description], cur.fetchall())


@pytest.fixture
def calm(spark, tmp_path):
    """Premiums of zero throughout: every prediction is the bare interest term."""
    rows = [(9 * i + 4, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), i % 5, "click", 40.0 + i % 11, "{}") for i in range(200)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return tmp_path


def test_minute_curve_of_constant_predictions_is_zero_in_both(spark, calm):
    got, want = both(spark, calm, "A28_minute_r2_curve")
    assert got == want and len(got) == 60 and {r["r2"] for r in got} == {0.0}


def test_regression_on_constant_predictions_has_no_line_in_both(spark, calm):
    got, want = both(spark, calm, "A29_regression_stats")
    assert got == want and got[0]["r_squared"] == 0.0 and got[0]["slope"] is None


@pytest.fixture
def lively(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=47 * i), i % 5, "click view".split()[i % 3 == 0], 150.0 * (i * 37 % 101) / 101, "{}") for i in range(700)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return tmp_path


def test_shuffle_floor_sorts_in_pieces_of_bounded_size(spark, lively, monkeypatch):
    """Copies are spread by their number, whatever the session's partitions, and only sums are exchanged."""
    from tickloom.operators import stats as st

    monkeypatch.setattr(st, "SORTED_ROWS", 2_000)
    got, want = both(spark, lively, "A33_shuffle_floor")
    assert got == want and len(got) == 60
    plan = entry.queries()["A33_shuffle_floor"](spark, str(lively))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_shuffled_copies_are_never_broadcast(spark, lively):
    """Whatever the planner takes for the copies' size, running sums over them stay out of the driver."""
    got = entry.queries()["A33_shuffle_floor"](spark, str(lively))
    before = got._jdf.queryExecution().executedPlan().toString()
    assert len(got.collect()) == 60
    for plan in (before, got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]):
        depth = None  # of the broadcast whose inputs the lines tell
        for line in plan.splitlines():
            at = len(line) - len(line.lstrip(" :+-*"))
            depth = None if depth is not None and at <= depth else depth
            if depth is None and "BroadcastExchange" in line:
                depth = at
            assert depth is None or "Window" not in line, plan


def windows(spark, tmp_path, spans):
    """A feed whose shocks start at the given seconds; the id's remainder by 13 gives the length in ten minutes."""
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s), i % 5, "click", 200.0, "{}") for i, s in spans]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    return tmp_path


def plan_of(spark, folder, name):
    return entry.queries()[name](spark, str(folder))._jdf.queryExecution().optimizedPlan().toString()


def test_overlapping_windows_are_found_once_without_a_distinct(spark, tmp_path):
    """Equal starts, a window of no length, nested and touching ones."""
    folder = windows(spark, tmp_path, [(1, 0), (14, 0), (13, 0), (2, 600), (26, 1200), (3, 1200), (5, 9000), (12, 9000), (4, 12000)])
    got, want = both(spark, folder, "P11_window_overlap")
    assert got == want and len(got) > 8
    assert "Aggregate" not in plan_of(spark, folder, "P11_window_overlap")


def test_hours_are_folded_before_set_operations(spark, tmp_path):
    folder = windows(spark, tmp_path, [(i, 700 * i) for i in range(40)])
    got, want = both(spark, folder, "U3_set_ops")
    assert got == want and got
    below = plan_of(spark, folder, "U3_set_ops").split("Join")[1:]
    assert below and all("Aggregate" in part for part in below)
