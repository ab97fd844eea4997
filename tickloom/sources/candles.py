"""Candle sources by name: who offers which intervals, and the rows of one market."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

Load = Callable[[str], DataFrame]


class CandleSources:
    """Named loaders; a loader gives the candles of all markets at one of its intervals."""

    def __init__(self) -> None:
        self._known: dict[str, tuple[Load, tuple[str, ...]]] = {}

    def add(self, name: str, load: Load, *intervals: str) -> None:
        if name in self._known:
            raise ValueError(f"a source {name!r} is known already")
        self._known[name] = (load, intervals)

    def offers(self) -> dict[str, tuple[str, ...]]:
        return {name: intervals for name, (_, intervals) in self._known.items()}

    def candles(self, name: str, interval: str, market: str | None = None) -> DataFrame:
        """Candles with their ``source`` and ``interval``, of one market or of all."""
        if interval not in self.offers().get(name, ()):
            raise ValueError(f"no source offers {name!r} at {interval!r}: {self.offers()}")
        rows = self._known[name][0](interval).withColumns({"source": F.lit(name), "interval": F.lit(interval)})
        return rows if market is None else rows.filter(F.col("market") == market)
