"""As-of joins by union and sliced running windows (no nested-loop join).

Both inputs are tagged and unioned; the last payload seen at or before a probe is
its match.  One shuffle on (key, slice) serves any number of probes and sources.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tickloom.functions.timecols import MICROS, micros
from tickloom.operators.slicing import DAY, Running, running


@dataclass(frozen=True)
class Source:
    """A right side: its rows, time column and the columns to bring over."""

    rows: DataFrame
    time: str
    payload: Sequence[str]
    tie: Sequence[str] = ()


def _signed(rows: DataFrame, column: str, sign: int) -> Column:
    """A tie key that sorts along the direction; whole numbers keep all their digits."""
    whole = isinstance(rows.schema[column].dataType, T.IntegralType)
    return F.lit(sign) * F.col(column).cast("long" if whole else "double")


def asof_many(
    left: DataFrame,
    sources: Mapping[str, Source],
    keys: Sequence[str],
    left_time: str,
    *,
    direction: str = "backward",
    strict: bool = False,
    width_s: int = DAY,
) -> DataFrame:
    """Match every left row against several sources in one pass.

    Adds ``{name}obs_time`` and ``{name}{payload}`` per source.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    sign = 1 if direction == "backward" else -1
    lcols = [c for c in left.columns if c not in keys]
    nties = max(len(s.tie) for s in sources.values())
    # rows sharing an instant: matches first (they count) unless strict
    both = left.select(
        *keys, (F.lit(sign) * micros(left_time)).alias("_t"), F.lit(0 if strict else 1).alias("_prio"), F.struct(*lcols).alias("_left")
    )
    for name, s in sources.items():
        tagged = s.rows.filter(F.col(s.time).isNotNull()).select(
            *keys,
            (F.lit(sign) * micros(s.time)).alias("_t"),
            F.lit(1 if strict else 0).alias("_prio"),
            *[_signed(s.rows, c, sign).alias(f"_k{i}") for i, c in enumerate(s.tie)],
            F.struct(F.col(s.time).alias("obs_time"), *[F.col(c) for c in s.payload]).alias(f"_pack_{name}"),
        )
        both = both.unionByName(tagged, allowMissingColumns=True)
    seen = running(
        both, keys, F.col("_t"),
        {f"_hit_{n}": Running("last", F.col(f"_pack_{n}")) for n in sources},
        tie=[F.col("_prio"), *[F.col(f"_k{i}") for i in range(nties)]],
        width_s=width_s,
        consume=["_t", "_prio", *[f"_k{i}" for i in range(nties)], *[f"_pack_{n}" for n in sources]],
    ).filter(F.col("_left").isNotNull())
    return seen.select(
        *keys,
        *[F.col(f"_left.`{c}`").alias(c) for c in lcols],
        *[F.col(f"_hit_{n}.{c}").alias(f"{n}{c}") for n, s in sources.items() for c in ("obs_time", *s.payload)],
    )


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    *,
    direction: str = "backward",
    strict: bool = False,
    tie: Sequence[str] = (),
    prefix: str = "",
    max_age_s: float | None = None,
    width_s: int = DAY,
) -> DataFrame:
    """Attach to every left row the nearest right row of the same key.

    ``backward`` takes the latest right row at or before the left time (before,
    when ``strict``); ``forward`` the earliest at or after it.  ``tie`` orders
    right rows sharing a time (the last one wins backward, the first forward).
    Matches older than ``max_age_s`` keep their time but lose their payload and
    are flagged stale, as are rows with no match at all.
    """
    out = asof_many(
        left, {prefix: Source(right, right_time, payload, tie)}, keys, left_time, direction=direction, strict=strict, width_s=width_s
    )
    if max_age_s is None:
        return out
    return with_staleness(out, left_time, f"{prefix}obs_time", [prefix + c for c in payload], max_age_s, f"{prefix}stale")


def with_staleness(
    df: DataFrame, time_col: str, obs_col: str, values: Sequence[str], max_age_s: float, flag: str
) -> DataFrame:
    """Null the values observed more than ``max_age_s`` away and flag them."""
    age = F.abs(micros(time_col) - micros(obs_col))
    stale = F.coalesce(age > F.lit(int(max_age_s * MICROS)), F.lit(True))
    return df.select(
        *[F.when(~stale, F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns],
        stale.alias(flag),
    )


def require_match(value: Column, message: Column | str) -> Column:
    """The value, or an error where an as-of match is mandatory."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.coalesce(value, F.raise_error(text).cast("double"))
