"""Candle and liquidation loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.operators.sanctions import upsert

CANDLE_KEY = ["asset", "exchange", "timeframe", "ts"]
# Commodity tickers to asset codes.
TICKERS = {"GC=F": "GOLD", "CL=F": "OIL", "HG=F": "COPPER", "SI=F": "SILVER", "NG=F": "NATGAS", "BZ=F": "BRENT", "TTF=F": "TTF"}


def candle_rows(rows: DataFrame) -> DataFrame:
    """Rows (asset, exchange, timeframe, ts_ms, open, high, low, close, volume) with time and dollar volume."""
    return rows.select(
        "asset", "exchange", "timeframe", F.timestamp_millis(F.col("ts_ms").cast("long")).alias("ts"), "open", "high", "low", "close", "volume", (F.coalesce("volume", F.lit(0.0)) * F.col("close")).alias("volume_usd"), *[c for c in ("ingest",) if c in rows.columns]
    )


def load_candles(new: DataFrame, stored: DataFrame | None = None, ingest: str = "ingest") -> DataFrame:
    """Newest ingest wins per (asset, exchange, timeframe, ts)."""
    fresh = candle_rows(new)
    stored = fresh.limit(0) if stored is None else stored
    return upsert(fresh, stored, CANDLE_KEY, ingest)


def asset_code(ticker: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TICKERS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, ticker), F.upper(F.replace(ticker, F.lit("=F"), F.lit(""))))


def load_commodities(rows: DataFrame, stored: DataFrame | None = None, exchange: str = "futures") -> DataFrame:
    """Rows keyed by ticker, without a close dropped, then as L01."""
    named = rows.where(F.col("close").isNotNull()).withColumn("asset", asset_code(F.col("ticker"))).withColumn("exchange", F.lit(exchange)).withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return load_candles(named.drop("ticker"), stored)


def load_liquidations(messages: DataFrame, assets: list[str] | None = None, exchange: str = "binance") -> DataFrame:
    """Liquidation order messages (value: JSON text) of the tracked assets, batch or stream."""
    # field names differ only in case, so each is read by its exact path
    field = lambda name: F.get_json_object(F.col("value").cast("string"), f"$.o.{name}")
    number = lambda name: F.nullif(field(name).try_cast("double"), F.lit(0.0))
    price, quantity = F.coalesce(number("ap"), number("p")), F.coalesce(number("z"), number("q"))
    out = messages.select(
        F.regexp_replace(field("s"), "USDT$", "").alias("asset"), F.lit(exchange).alias("exchange"), F.lower(field("S")).alias("side"), price.alias("price"), quantity.alias("quantity"), (price * quantity).alias("usd"), F.timestamp_millis(field("T").try_cast("long")).alias("ts")
    ).where((F.col("price") > 0) & (F.col("quantity") > 0))
    return out if assets is None else out.where(F.col("asset").isin([a.upper() for a in assets]))
