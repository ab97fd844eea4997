"""Column helpers for instants, floors and keys (all JVM-side expressions)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts) if isinstance(ts, str) else ts)


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)


def plus_seconds(ts: Column | str, seconds: Column | float) -> Column:
    """``ts + seconds``; exact to the microsecond."""
    step = seconds if isinstance(seconds, Column) else F.lit(int(round(seconds * MICROS)))
    if isinstance(seconds, Column):
        step = F.round(seconds.cast("double") * F.lit(float(MICROS))).cast("long")
    return F.timestamp_micros(micros(ts) + step)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (micros(later) - micros(earlier)) / F.lit(float(MICROS))


def floor_to(ts: Column | str, seconds: int) -> Column:
    """Start of the UTC-aligned bucket of the given width."""
    width = seconds * MICROS
    us = micros(ts)
    return F.timestamp_micros(us - F.pmod(us, F.lit(width)))


def cluster_key(market: Column | str, ts: Column | str, hours: int = 6) -> Column:
    """``market|ISO start of the UTC block`` used to cluster resampling."""
    m = F.col(market) if isinstance(market, str) else market
    return F.concat_ws("|", m, F.date_format(floor_to(ts, hours * 3600), "yyyy-MM-dd'T'HH:mm:ss"))


def horizon_seconds(label: Column | str) -> Column:
    """Seconds of a horizon label such as ``30s``, ``2m``, ``4h``."""
    c = F.col(label) if isinstance(label, str) else label
    number = F.regexp_extract(c, r"^(\d+)([smh])$", 1).cast("long")
    unit = F.regexp_extract(c, r"^(\d+)([smh])$", 2)
    return number * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600)
