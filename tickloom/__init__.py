"""PySpark-native analytics for tick-level and panel market-event data."""

__version__ = "0.1.0"
