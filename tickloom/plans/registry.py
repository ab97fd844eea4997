"""Query registry: a Spark builder and, where SQL can say it, the checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from tickloom.plans import bindings
from tickloom.session import ensure_conf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def round6(c: Column) -> Column:
    """Six decimals, halves away from zero on the scaled double; no negative zero."""
    a = F.abs(c) * F.lit(1e6)
    f = F.floor(a)
    near = F.signum(c) * (f + F.when(a - f >= 0.5, 1).otherwise(0)) / F.lit(1e6)
    return F.when(F.abs(c) < 1e12, near).otherwise(F.round(c, 6)) + F.lit(0.0)


def present(df: DataFrame) -> DataFrame:
    """Stable output types: naive timestamps, rounded doubles, joined arrays."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        elif isinstance(f.dataType, T.DoubleType):
            c = round6(c)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.ByteType):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``views`` names the shared views its SQL starts from."""

    def wrap(fn: Callable[[bindings.Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            return present(fn(bindings.Tables(spark, sf_dir)))

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = bindings.with_views(views.split(), sql)
        return fn

    return wrap
