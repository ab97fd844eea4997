"""Top-of-book expressions: validity, microprice, spreads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

L1 = ("best_bid_px", "best_bid_sx", "best_ask_px", "best_ask_sx")


def two_sided(bid_px="best_bid_px", bid_sx="best_bid_sx", ask_px="best_ask_px", ask_sx="best_ask_sx") -> Column:
    """Every field present and positive, and the book not crossed; never null."""
    cols = [F.col(c) for c in (bid_px, bid_sx, ask_px, ask_sx)]
    ok = cols[0] > 0
    for c in cols[1:]:
        ok = ok & (c > 0)
    finite = F.lit(True)
    for c in cols:
        finite = finite & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(ok & finite & (cols[0] <= cols[2]), F.lit(False))


def microprice() -> Column:
    """Size-weighted mid: each price is weighted by the opposite side's size."""
    b, bs, a, as_ = (F.col(c) for c in L1)
    return (b * as_ + a * bs) / (as_ + bs)


def mid() -> Column:
    return (F.col("best_bid_px") + F.col("best_ask_px")) / 2


def spread_bps() -> Column:
    return (F.col("best_ask_px") - F.col("best_bid_px")) / mid() * 10_000


def half_spread_bps() -> Column:
    return spread_bps() / 2


def drop_crossed(l1: DataFrame) -> DataFrame:
    """A crossed row says nothing about either side: null all four fields."""
    crossed = F.coalesce(F.col("best_bid_px") > F.col("best_ask_px"), F.lit(False))
    return l1.select(*[F.when(~crossed, F.col(c)).alias(c) if c in L1 else F.col(c) for c in l1.columns])


def microprices(l1: DataFrame) -> DataFrame:
    """Microprice series; one-sided rows are absent, never zero-filled."""
    return l1.filter(two_sided()).withColumn("microprice", microprice())
