"""Registered stream runs: the given tables as streams in order of time, run until nothing is left, checked against the SQL of
the batch queries they must equal."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.catalog import energy, maritime, market, news  # noqa: F401  (their SQL is used again)
from intel_spark.catalog.helpers import rings
from intel_spark.catalog.registry import ORACLES, query, r4, ts
from intel_spark.session import shared_folder
from intel_spark.streaming import jobs, vessels

PARTS = 2


def run(start, frame: DataFrame, order: str = "ts", last: DataFrame | None = None) -> DataFrame:
    """What a stream job writes for ``frame``, which arrives in ``PARTS`` deliveries in order of time; ``last`` comes behind them.

    ``start(stream, checkpoint, path)`` returns the running query.
    """
    spark = frame.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    files = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low, high = frame.agg(F.min(F.unix_micros(order)), F.max(F.unix_micros(order))).first()
    step = ((high or 0) - (low or 0)) // PARTS + 1
    delivery = F.floor((F.unix_micros(order) - (low or 0)) / step)
    for k in range(PARTS):
        frame.where(delivery == k).repartition(files).write.parquet(f"{folder}/in/d{k}")
    if last is not None:
        last.select(*frame.columns).write.parquet(f"{folder}/in/d{PARTS}")
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/d*")
    start(stream, f"{folder}/checkpoint", f"{folder}/out").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def much_later(frame: DataFrame, order: str = "ts") -> DataFrame:
    """The newest row once more, a month on: what came before it is complete then."""
    return frame.orderBy(F.col(order).desc()).limit(1).withColumn(order, F.col(order) + F.expr("INTERVAL 30 DAYS"))


@query("t01_vessel_events", inputs="positions zones", oracle=f"""
    SELECT mmsi, ts, 'ais_gap' AS event_type, severity FROM ({ORACLES['w08_ais_gaps']}) UNION ALL SELECT mmsi, ts, 'position_anomaly', severity FROM ({ORACLES['w09_position_anomalies']})
    UNION ALL SELECT mmsi, ts, event_type, CASE event_type WHEN 'flag_change' THEN 'high' ELSE 'medium' END FROM ({ORACLES['w10_identity_changes']}) UNION ALL SELECT mmsi, ts, kind, NULL FROM ({ORACLES['w11_imo_conflicts']})""")
def _(positions, zones):
    fixes = positions.select("mmsi", "ts", "lat", "lon", "speed", "name", "flag", "ship_type", "imo")
    out = run(lambda s, c, p: vessels.start_vessel_events(s, c, p, rings(zones), 12.0, available_now=True), fixes)
    # the severity of a claim looks at the flags known by then
    return out.select("mmsi", "ts", "event_type", F.when(~F.col("event_type").startswith("identity"), F.col("severity")).alias("severity"))


@query("t03_cascades", inputs="liquidations", oracle=ORACLES["w05_g05_cascades"])
def _(orders):
    out = run(lambda s, c, p: jobs.start_cascades(s, c, p, 90, 5, 100_000, available_now=True), orders, last=much_later(orders))
    return out.drop("last_price", "summary")


@query("t04_resample", inputs="candles", oracle=f"""
    SELECT asset, exchange, {ts("time_bucket(INTERVAL 240 MINUTE, ts, TIMESTAMP '1970-01-01')", "ts")}, {r4('min_by(open, ts)', 'open')}, {r4('max(high)', 'high')}, {r4('min(low)', 'low')}, {r4('max_by(close, ts)', 'close')}, {r4('round(sum(volume), 3)', 'volume')}
    FROM {{candles}} GROUP BY asset, exchange, time_bucket(INTERVAL 240 MINUTE, ts, TIMESTAMP '1970-01-01')""")
def _(candles):
    out = run(lambda s, c, p: jobs.start_resample(s, c, p, 240, available_now=True), candles.drop("volume_usd"), last=much_later(candles))
    return out.withColumn("volume", F.round("volume", 3))


@query("t07_token_flows", inputs="transfers wallet_labels", oracle=f"SELECT DISTINCT tx_hash, pattern, risk_score FROM ({ORACLES['x10_assess_transfers']}) WHERE pattern <> 'watched_wallet_activity'")
def _(transfers, labels):
    out = run(lambda s, c, p: jobs.start_token_flows(s, c, p, labels, 60_000, available_now=True), transfers)
    return out.select("tx_hash", "pattern", "risk_score")


@query("t12_sightings", inputs="sightings", oracle=ORACLES["w22_flights"])
def _(sightings):
    return run(lambda s, c, p: vessels.start_sightings(s, c, p, 21_600, available_now=True), sightings).select("id", "flight_key", "new_flight")
