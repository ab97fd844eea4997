"""Exchange-session calendar as a small dimension, and labels joined from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Local hours and time zones of the two venues.
VENUES = {
    "XNYS": {"tz": "America/New_York", "open": "09:30:00", "close": "16:00:00", "half_close": "13:00:00"},
    "XKRX": {"tz": "Asia/Seoul", "open": "09:00:00", "close": "15:30:00", "half_close": "15:30:00"},
}
# One-off NYSE closures and the KRX weekday closures (lunar and
# election dates follow no simple rule).
XNYS_EXTRA = (
    "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09",
)
XKRX_HOLIDAYS = (
    "2023-01-23", "2023-01-24", "2023-03-01", "2023-05-01", "2023-05-05", "2023-05-29", "2023-06-06", "2023-08-15",
    "2023-09-28", "2023-09-29", "2023-10-02", "2023-10-03", "2023-10-09", "2023-12-25", "2023-12-29",
    "2024-01-01", "2024-02-09", "2024-02-12", "2024-03-01", "2024-04-10", "2024-05-01", "2024-05-06", "2024-05-15",
    "2024-06-06", "2024-08-15", "2024-09-16", "2024-09-17", "2024-09-18", "2024-10-01", "2024-10-03", "2024-10-09",
    "2024-12-25", "2024-12-31",
    "2025-01-01", "2025-01-27", "2025-01-28", "2025-01-29", "2025-01-30", "2025-03-03", "2025-05-01", "2025-05-05",
    "2025-05-06", "2025-06-03", "2025-06-06", "2025-08-15", "2025-10-03", "2025-10-06", "2025-10-07", "2025-10-08",
    "2025-10-09", "2025-12-25", "2025-12-31",
    "2026-01-01", "2026-02-16", "2026-02-17", "2026-02-18", "2026-03-02", "2026-05-01", "2026-05-05", "2026-05-25",
    "2026-06-03", "2026-08-17", "2026-09-24", "2026-09-25", "2026-10-05", "2026-10-09", "2026-12-25", "2026-12-31",
)

#: Years for which each venue's closures are known: by rule, or by the list above.
KNOWN_YEARS = {"XNYS": (2002, 2099), "XKRX": (2023, 2026)}


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    d = dt.date(year, month, 1)
    d += dt.timedelta((weekday - d.weekday()) % 7)
    return d + dt.timedelta(7 * (n - 1))


def _last(year: int, month: int, weekday: int) -> dt.date:
    d = dt.date(year, month + 1, 1) - dt.timedelta(1)
    return d - dt.timedelta((d.weekday() - weekday) % 7)


def _easter(year: int) -> dt.date:
    """Gregorian computus (anonymous algorithm)."""
    a, b, c = year % 19, year // 100, year % 100
    d, e = b // 4, b % 4
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = c // 4, c % 4
    l = (32 + 2 * e + 2 * i - h - k) % 7
    m = (a + 11 * h + 19 * l) // 433
    month = (h + l - 7 * m + 90) // 25
    return dt.date(year, month, (h + l - 7 * m + 33 * month + 19) % 32)


def _observed(d: dt.date) -> dt.date:
    return d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(1) if d.weekday() == 6 else d


def nyse_holidays(year: int) -> list[dt.date]:
    new_year = dt.date(year, 1, 1)
    days = [
        _nth(year, 1, 0, 3), _nth(year, 2, 0, 3), _easter(year) - dt.timedelta(2), _last(year, 5, 0),
        _observed(dt.date(year, 7, 4)), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4),
        _observed(dt.date(year, 12, 25)),
    ]
    if year >= 2022:  # the exchange's first Juneteenth closure
        days.append(_observed(dt.date(year, 6, 19)))
    if new_year.weekday() != 5:  # a Saturday New Year is not observed on the Friday before
        days.append(_observed(new_year))
    return days + [dt.date.fromisoformat(d) for d in XNYS_EXTRA if d.startswith(str(year))]


def nyse_half_days(year: int) -> list[dt.date]:
    days = [_nth(year, 11, 3, 4) + dt.timedelta(1)]
    for d in (dt.date(year, 7, 3), dt.date(year, 12, 24)):
        if d.weekday() < 5 and d not in nyse_holidays(year):
            days.append(d)
    return days


def session_calendar(spark: SparkSession, exchange: str, first_year: int | None = None, last_year: int | None = None) -> DataFrame:
    """One row per weekday of the known years: the session's opening and closing instants in UTC, null on closures.

    At most 262 rows a year and 99 years, so it is safe to broadcast.
    """
    low, high = KNOWN_YEARS[exchange]
    first, last = max(low, first_year or low), min(high, last_year or high)
    v, years = VENUES[exchange], range(first, last + 1)
    closed = [str(d) for y in years for d in nyse_holidays(y)] if exchange == "XNYS" else list(XKRX_HOLIDAYS)
    half = [str(d) for y in years for d in nyse_half_days(y)] if exchange == "XNYS" else []
    marked = spark.createDataFrame([(d, v["half_close"]) for d in half] + [(d, None) for d in closed], "_day string, _close string")
    text = F.date_format("local_date", "yyyy-MM-dd")
    dates = spark.range(1).select(F.explode(F.sequence(F.lit(f"{first}-01-01").cast("date"), F.lit(f"{last}-12-31").cast("date"))).alias("local_date"))
    days = dates.filter(F.weekday("local_date") < 5).join(F.broadcast(marked), text == F.col("_day"), "left")
    at = lambda clock: F.to_utc_timestamp(F.to_timestamp(F.concat_ws(" ", text, clock)), v["tz"])
    open_day = F.col("_day").isNull() | F.col("_close").isNotNull()
    return days.select(
        F.lit(exchange).alias("exchange"), "local_date", F.when(open_day, at(F.lit(v["open"]))).alias("open_utc"),
        F.when(open_day, at(F.coalesce("_close", F.lit(v["close"])))).alias("close_utc"),
    )


def label_sessions(df: DataFrame, time: str, exchange: str, out: str = "session", calendar: DataFrame | None = None) -> DataFrame:
    """RTH / off-hours-weekday / weekend / holiday by the venue's local clock.

    A weekday that the calendar does not know is labelled ``unknown``, never
    guessed.  ``calendar`` (local_date, open_utc, close_utc; null instants on
    closures, one row a weekday) replaces the built-in one, for other years.
    """
    if exchange not in VENUES:
        raise ValueError(f"unsupported exchange {exchange!r}")
    own = session_calendar(df.sparkSession, exchange) if calendar is None else calendar
    cal = own.select(F.col("local_date").alias("_d"), F.col("open_utc").alias("_o"), F.col("close_utc").alias("_c"))
    local = F.to_date(F.from_utc_timestamp(F.col(time), VENUES[exchange]["tz"]))
    label = (
        F.when(F.weekday("_d0") >= 5, "weekend")
        .when(F.col("_d").isNull(), "unknown")
        .when(F.col("_o").isNull(), "holiday")
        .when((F.col(time) >= F.col("_o")) & (F.col(time) < F.col("_c")), "RTH")
        .otherwise("off-hours-weekday")
    )
    joined = df.withColumn("_d0", local).join(F.broadcast(cal) if calendar is None else cal, F.col("_d0") == F.col("_d"), "left")
    return joined.withColumn(out, label).drop("_d0", "_d", "_o", "_c")


def study_segment(session: Column) -> Column:
    """Holidays count as off-hours weekdays in the study segments."""
    return F.when(session == "holiday", "off-hours-weekday").otherwise(session)
