import random

from conftest import NOW, minutes
from pyspark.sql import functions as F

from intel_spark.operators import market as m
from intel_spark.sources.market import load_candles

CANDLE = "asset string, exchange string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double, volume_usd double"


def series(spark, closes, volumes=None, exchange="binance", start=0):
    rows = [("BTC", exchange, "1m", minutes(start + i), c, c, c, c, (volumes or {}).get(i, 10.0), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, CANDLE)


def quiet(n, seed=1):
    rng = random.Random(seed)
    return [100 + rng.gauss(0, 0.2) for _ in range(n)]


def test_newest_candle_wins(spark):
    schema = "asset string, exchange string, timeframe string, ts_ms long, open double, high double, low double, close double, volume double, ingest int"
    rows = [("BTC", "x", "1m", 60_000, 1.0, 1.0, 1.0, 5.0, 2.0, 1), ("BTC", "x", "1m", 0, 1.0, 1.0, 1.0, 4.0, 2.0, 1), ("BTC", "x", "1m", 60_000, 1.0, 1.0, 1.0, 7.0, 2.0, 2)]
    out = load_candles(spark.createDataFrame(rows, schema)).orderBy("ts").collect()
    assert [r.close for r in out] == [4.0, 7.0] and out[1].volume_usd == 14.0


def test_price_spike_is_one_critical(spark):
    closes = quiet(600)
    assert m.price_anomalies(series(spark, closes), sigma=5).count() == 0
    closes[-1] *= 1.5
    hits = m.price_anomalies(series(spark, closes), sigma=5).collect()
    assert len(hits) == 1 and hits[0].severity == "critical" and hits[0].z_score > 7 and hits[0].change_pct > 40


def test_short_history_gives_nothing(spark):
    assert m.price_anomalies(series(spark, [100.0] * 29 + [300.0])).count() == 0


def test_volume_spike(spark):
    volumes = {i: 60.0 for i in range(1445, 1450)}
    hits = m.volume_spikes(series(spark, quiet(1450), volumes)).collect()
    assert len(hits) == 1 and hits[0].volume_multiplier > 4 and hits[0].severity in ("high", "critical")


def three_venues(spark, jump_on):
    base = quiet(90, 3)
    out = None
    for k, venue in enumerate(("binance", "coinbase", "kraken")):
        closes = [c * (1 + 0.00001 * k) for c in base]
        if venue in jump_on:
            closes = closes[:-2] + [c * 1.03 for c in closes[-2:]]
        frame = series(spark, closes, exchange=venue)
        out = frame if out is None else out.unionByName(frame)
    return out


def test_coordination_needs_several_venues(spark):
    found = m.coordination(three_venues(spark, ("binance", "coinbase", "kraken"))).collect()
    assert len(found) == 1 and len(found[0].exchanges) == 3 and found[0].delta_s == 0 and found[0].correlation >= 0.85
    assert m.coordination(three_venues(spark, ("binance",))).count() == 0


def orders(spark):
    from datetime import timedelta
    rows = [("BTC", "binance", "sell", 100.0 - i, 500_000.0, NOW + timedelta(seconds=20 * i)) for i in range(8)]
    rows += [("BTC", "binance", "sell", 90.0, 500_000.0, minutes(120)), ("ETH", "binance", "buy", 10.0, 900_000.0, NOW)]
    return spark.createDataFrame(rows, "asset string, exchange string, side string, price double, usd double, ts timestamp")


def test_cascade_and_external_event(spark):
    found = m.cascades(orders(spark))
    row = found.collect()
    assert len(row) == 1 and row[0]["count"] == 8 and row[0].total_usd == 4_000_000 and row[0].side == "sell" and row[0].price_impact < 0
    external = spark.createDataFrame([("BTC", minutes(5), "BTC price anomaly (high)"), ("ETH", minutes(1), "ETH")], "asset string, ts timestamp, description string")
    linked = m.nearest_external(found, external).collect()[0]
    assert linked.external_event.startswith("BTC") and 0 < linked.correlation_score < 1


def test_cooldown_lets_only_higher_severity_through(spark):
    rows = [(1, "BTC", "price_anomaly", ["x"], "low", minutes(0)), (2, "BTC", "price_anomaly", ["x"], "low", minutes(20)), (3, "BTC", "price_anomaly", ["x"], "high", minutes(25)), (4, "BTC", "price_anomaly", ["x"], "medium", minutes(50)), (5, "BTC", "price_anomaly", ["x"], "low", minutes(56))]
    alerts = spark.createDataFrame(rows, "alert_id long, asset string, alert_type string, exchanges array<string>, severity string, ts timestamp")
    assert sorted(r.alert_id for r in m.cooldown(alerts).collect()) == [1, 3, 5]


def test_resample_and_volatility(spark):
    candles = series(spark, quiet(1500))
    assert 24 <= m.resample(candles, "1h").count() <= 26
    stats = m.volatility(candles, 15).collect()[0]
    assert stats.daily_percent > 0 and stats.annual_percent > stats.daily_percent
    assert m.volatility_series(candles, 15).where(F.col("vol") <= 0).count() == 0
