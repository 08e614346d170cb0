"""Registry of runnable queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from intel_spark.catalog.adapters import adapter, with_adapters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Comparable values: times as text, doubles to five places, arrays as text."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.TimestampNTZType):
            c = F.date_format(c.cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            c = c.cast("string")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), 5) + F.lit(0.0)
        elif isinstance(field.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(field.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None, inputs: str = ""):
    """Register ``fn(*inputs)`` under ``name``; ``inputs`` lists adapters, and the result is made comparable."""
    def wrap(fn):
        names = inputs.split()

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            frames = [adapter(spark, sf_dir, n) for n in names]
            return plain(fn(*frames))

        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = with_adapters(oracle)
        return fn

    return wrap


def ts(col: str, alias: str | None = None) -> str:
    return f"strftime({col}, '%Y-%m-%d %H:%M:%S') AS {alias or col}"


def r4(expression: str, alias: str | None = None) -> str:
    return f"round(CAST({expression} AS DOUBLE), 5) + 0.0 AS {alias or expression}"


def half_up(expression: str, places: int) -> str:
    """Round the shortest decimal spelling of a double half up, as Spark does."""
    return f"CAST(round(CAST(CAST(CAST({expression} AS DOUBLE) AS VARCHAR) AS DECIMAL(24, 18)), {places}) AS DOUBLE)"
