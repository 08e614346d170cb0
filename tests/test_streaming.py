import pytest
from conftest import NOW, hours, minutes
from pyspark.sql import functions as F
from test_sanctions import listings
from test_vessels import ZONE, box, fix, fixes

from intel_spark.operators import fusion, maritime, market, monitors
from intel_spark.streaming import jobs
from intel_spark.streaming import vessels as ships


def as_stream(spark, frame, folder, parts=3, order="ts"):
    """The frame's rows as a stream of several files in time order."""
    rows = frame.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for k in range(parts):
        spark.createDataFrame(rows[k * size:(k + 1) * size], frame.schema).coalesce(1).write.mode("append").parquet(f"{folder}/p{k}")
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{folder}/p*")


COLUMNS = ["mmsi", "ts", "lat", "lon", "speed", "name", "flag", "ship_type", "imo"]


def events_of(spark, tmp_path, positions, zones, parts=3, **more):
    stream = as_stream(spark, positions, str(tmp_path / "in"), parts=parts)
    ships.start_vessel_events(stream, str(tmp_path / "cp"), str(tmp_path / "out"), zones, 6.0, available_now=True, **more).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out")).drop("batch")


def war_zone(spark):
    return spark.createDataFrame([("Z", "war_zone", "", False, box(9.0, 9.0, 11.0, 10.05))], ZONE)


def test_vessel_events_equal_batch(spark, tmp_path):
    flags = ["PA", "XX", "IR", None, "XX", "IR", "GA"]
    names = ["MMSI 1", "STAR NO. 2", "STAR NO2", "ALPHA", "BRAVO", "DELTA", "STAR NO 2"]
    rows = [fix(f"00{k}", hours(-40 + 9 * i + k), lat=10.0 + (i % 3) * 0.1, lon=10.0, speed=10.0 if i % 2 else 45.0, name="ALPHA" if i < 3 else "BETA", flag="PA" if i < 2 else "GA") for k in range(1, 4) for i in range(5)]
    rows += [fix("004", hours(-40 + i), speed=0.0, name=names[i], flag=flags[i]) for i in range(7)]
    # a live rival, then the holder falls silent for more than a day and the rival takes the number over, then the first returns
    rows += [fix("005", hours(h), imo="9074729", flag="PA") for h in (-90, -80, -70)] + [fix("006", hours(h), imo="9074729", flag="PA") for h in (-85, -78, -44, -30, -20)] + [fix("005", hours(h), imo="9074729", flag="PA") for h in (-28, -19)]
    positions = fixes(spark, rows).select(*COLUMNS)
    got = events_of(spark, tmp_path, positions, war_zone(spark), 2)
    gaps, jumps, identity = maritime.ais_gaps(positions, war_zone(spark)), maritime.position_anomalies(positions), maritime.identity_changes(positions)
    claims = maritime.imo_conflicts(positions)
    want = [(r.mmsi, r.ts, r.event_type, r.severity) for part in (gaps, jumps, identity, claims.withColumnRenamed("kind", "event_type")) for r in part.collect()]
    assert sorted((r.mmsi, r.ts, r.event_type, r.severity) for r in got.collect()) == sorted(want)
    assert {w[2] for w in want} == {"ais_gap", "position_anomaly", "name_change", "flag_change", "identity_conflict", "identity_transfer"}
    details = {(r.mmsi, r.ts, r.event_type): r.detail for r in got.collect()}
    assert all(details[r.mmsi, r.ts, r.event_type] == r.old_value for r in identity.collect())


def test_messages_carry_the_last_static_one(spark, tmp_path):
    def message(mmsi, at, static=None, name=None):
        where = None if static else (10.0, 10.0, 1.0)
        return (mmsi, at, static is not None, *(where or (None,) * 3), None, None, None, name, *(static or (None,) * 8))

    schema = "mmsi string, ts timestamp, is_static boolean, lat double, lon double, speed double, course double, heading double, nav_status string, name string, static_name string, imo string, call_sign string, ship_type string, destination string, draught double, length_m double, beam_m double"
    tanker = ("OLD NAME", "9074729", "CALL", "Tanker", "ROTTERDAM", 9.0, 200.0, 30.0)
    rows = [message("1", hours(-9)), message("1", hours(-8), tanker), message("1", hours(-7)), message("2", hours(-6.5), ("RIVAL", "9074729", None, "Cargo", None, None, None, None)), message("2", hours(-6)), message("1", hours(-5), ("NEW NAME", *tanker[1:])), message("1", hours(-4)), message("1", hours(-3), name="SENT")]
    got = events_of(spark, tmp_path, spark.createDataFrame(rows, schema), war_zone(spark), 2).collect()
    assert sorted((r.mmsi, r.event_type, r.detail) for r in got) == [("1", "name_change", "NEW NAME"), ("1", "name_change", "OLD NAME"), ("2", "identity_conflict", "9074729:1")]
    kept = {(r.mmsi, r.name, r.ship_type, r.imo) for r in spark.read.parquet(str(tmp_path / "out_state/fixes/slot=1")).collect()}
    assert kept == {("1", "SENT", "Tanker", "9074729"), ("2", "RIVAL", "Cargo", "9074729")}


def test_dark_hulls_and_new_ones(spark, tmp_path):
    vessels = spark.createDataFrame([("000000001", "breach_ofac", 0.9), ("000000002", "clear", 0.9), ("000000003", "clear", 0.1), ("000000004", "flagged", 0.2)], "mmsi string, sanctioned_status string, risk_score double")
    rows = [fix(m, hours(-20), lat=10.0 if m != "000000002" else 50.0, name=f"SHIP {m[-1]}") for m in ("000000001", "000000002", "000000003", "000000004")]
    rows += [fix("000000009", hours(h), name="OCEAN GRACE", flag="IR", imo="9179414") for h in (-13, -10)] + [fix("000000001", hours(-9), name="SHIP 1")] + [fix("000000009", hours(h), name="OCEAN GRACE", flag="IR", imo="9179414") for h in (-8, -2)]
    positions = fixes(spark, rows).select(*COLUMNS)
    got = events_of(spark, tmp_path, positions, war_zone(spark), 3, vessels=vessels)
    dark = sorted((r.mmsi, r.event_type, r.ts) for r in got.where(F.col("event_type").startswith("dark")).collect())
    # the first one is breached and in the zone, speaks again and falls silent again; the second is risky but far from any zone
    assert dark == sorted([("000000001", "dark_in_zone", hours(-20).replace(tzinfo=None)), ("000000001", "dark_in_zone", hours(-9).replace(tzinfo=None)), ("000000004", "dark_in_zone", hours(-20).replace(tzinfo=None))])
    (tmp_path / "once").mkdir()
    events_of(spark, tmp_path / "once", positions.where("mmsi >= '000000004'"), war_zone(spark), 1, listings=listings(spark))
    matches = spark.read.parquet(str(tmp_path / "once/out_matches")).collect()
    assert {(r.mmsi, r.match_type) for r in matches} == {("000000009", "imo"), ("000000009", "name_exact"), ("000000009", "flag_program")}


def test_one_hull_may_send_most_reports(spark, tmp_path):
    n = 300_000
    many = spark.range(n).select(F.lit("001").alias("mmsi"), F.timestamp_seconds(F.col("id") * 5 + 1_700_000_000).alias("ts"), (F.col("id") % 1000 * 1e-5).alias("lat"), F.lit(10.0).alias("lon"), F.lit(5.0).alias("speed"), F.lit("A").alias("name"), F.lit("PA").alias("flag"), F.lit("Cargo").alias("ship_type"), F.lit("9074729").alias("imo"))
    many.coalesce(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(many.schema).parquet(str(tmp_path / "in"))
    ships.start_vessel_events(stream, str(tmp_path / "cp"), str(tmp_path / "out"), war_zone(spark), 6.0, available_now=True).awaitTermination()
    assert spark.read.schema(ships.STATE["fixes"]).parquet(str(tmp_path / "out_state/fixes/slot=0")).count() == 1


def test_cascades_survive_batch_borders(spark, tmp_path):
    rows = [("BTC", "x", "sell", 100.0 - i, 400_000.0, minutes(i)) for i in range(9)] + [("BTC", "x", "buy", 50.0, 1.0, minutes(600)), ("BTC", "x", "buy", 50.0, 1.0, minutes(900))]
    orders = spark.createDataFrame(rows, "asset string, exchange string, side string, price double, usd double, ts timestamp")
    jobs.start_cascades(as_stream(spark, orders, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("count", "total_usd", "side").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in market.cascades(orders).select("count", "total_usd", "side").collect()] == [(9, 3_600_000.0, "sell")]


def test_sightings_equal_batch(spark, tmp_path):
    rows = [(i, f"EP-{i % 2}", minutes(i * 0.7), "adsb" if i % 5 else "opensky", f"CS{i // 12}") for i in range(48)]
    sightings = spark.createDataFrame(rows, "id long, registration string, ts timestamp, source string, callsign string")
    ships.start_sightings(as_stream(spark, sightings, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), available_now=True).awaitTermination()
    columns = ["id", "flight_key", "new_flight"]
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect())
    assert got == sorted(tuple(r) for r in monitors.flights(sightings).select(*columns).collect())


def test_candles_are_replaced_by_day(spark, tmp_path):
    schema = "asset string, exchange string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"
    rows = [("BTC", "x", "1m", minutes(i), 1.0, 1.0, 1.0, float(i), 1.0) for i in range(6)] + [("BTC", "x", "1m", minutes(2), 1.0, 1.0, 1.0, 99.0, 1.0)]
    candles = spark.createDataFrame(rows, schema).withColumn("n", F.monotonically_increasing_id())
    stream = as_stream(spark, candles, str(tmp_path / "in"), parts=2, order="n").drop("n")
    jobs.start_candles(stream, str(tmp_path / "cp"), str(tmp_path / "out"), available_now=True).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 6 and out.where(F.col("close") == 99.0).count() == 1


def test_event_urls_once(spark, tmp_path):
    events = spark.createDataFrame([(1, "u1", minutes(0)), (2, "u1", minutes(5)), (3, "u2", minutes(6)), (4, "u1", hours(24))], "id long, url string, ts timestamp")
    jobs.start_event_ingest(as_stream(spark, events, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), available_now=True).awaitTermination()
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]


def test_token_flows_and_watch_hits_store_once(spark, tmp_path):
    labels = spark.createDataFrame([("ethereum", "0xbad", "sanctioned", "L", "O")], "chain string, address string, wallet_type string, label string, owner string")
    rows = [("ethereum", f"t{i % 3}", minutes(i), "0xBAD" if i % 2 else "0xok", "0xto", 100.0, "USDT") for i in range(6)]
    transfers = spark.createDataFrame(rows, "chain string, tx_hash string, ts timestamp, src string, dst string, usd double, token string")
    jobs.start_token_flows(as_stream(spark, transfers, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), labels, available_now=True).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert stored.count() == stored.select("tx_hash").distinct().count() == 3
    items = spark.createDataFrame([(1, "wallet", "0xBAD")], "id long, kind string, key string")
    records = transfers.select(F.lit("wallet").alias("kind"), F.col("src").alias("key"), F.lit("transfer").alias("record_type"), F.col("tx_hash").alias("record_id"), "ts", F.lit("high").alias("severity"))
    jobs.start_watch_hits(as_stream(spark, records, str(tmp_path / "in2")), str(tmp_path / "cp2"), str(tmp_path / "out2"), items, available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 3


def test_mempool_screen(spark, tmp_path):
    labels = spark.createDataFrame([("bitcoin", "bad", "sanctioned"), ("bitcoin", "ex", "exchange")], "chain string, address string, wallet_type string")
    rows = [("a", NOW, [("bad", 3.0)], [("x", 3.0)], 3.0), ("b", NOW, [("y", 5.0)], [("bad", 2.0), ("z", 3.0)], 5.0), ("c", NOW, [("y", 500.0)], [("ex", 500.0)], 500.0), ("d", NOW, [("y", 1.0)], [("z", 1.0)], 1.0)]
    txs = spark.createDataFrame(rows, "tx_hash string, ts timestamp, inputs array<struct<addr:string,value:double>>, outputs array<struct<addr:string,value:double>>, total_out double")
    jobs.start_mempool_screen(as_stream(spark, txs, str(tmp_path / "in"), order="tx_hash"), str(tmp_path / "cp"), str(tmp_path / "out"), labels, available_now=True).awaitTermination()
    got = {r.tx_hash: (r.focus, r.direction, r.amount) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"a": ("bad", "out", 3.0), "b": ("bad", "in", 2.0), "c": (None, "in", 500.0)}


def test_listing_feed_snapshots(spark, tmp_path):
    schema = "authority string, source_id string, name string, entity_type string, programs array<string>, imo string"
    first = spark.createDataFrame([("OFAC", str(i), f"E{i}", "company", ["X"], None) for i in range(4)], schema)
    second = spark.createDataFrame([("OFAC", str(i), f"E{i}" if i != 2 else "RENAMED", "company", ["X"], None) for i in range(1, 5)], schema)
    for k, frame in enumerate((first, second)):
        frame.coalesce(1).write.parquet(str(tmp_path / "in" / f"d{k}"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "d*"))
        jobs.start_listing_feed(stream, str(tmp_path / "cp"), str(tmp_path / "table"), str(tmp_path / "log"), NOW, available_now=True).awaitTermination()
    log = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(r.update_type for r in log.collect()) == ["delisting", "initial_import", "name_change", "new_designation"]
    last = spark.read.parquet(str(tmp_path / "table")).where("snapshot = 1")
    assert last.where("is_active").count() == 4 and last.where("NOT is_active").count() == 1


def signals_frame(spark, extra=False):
    rows = [("evasion_event", 1, "maritime", "high", ["E1"]), ("blockchain_tx", 2, "blockchain", "critical", ["E1"]), ("legal_event", 3, "legal", "medium", ["E1", "E2"]), ("market_alert", 4, "market", "low", ["ZZ"]), ("dark_oil", 5, "energy", "medium", ["E2"])]
    frame = spark.createDataFrame([(t, i, f"{t}:{i}", d, minutes(i), s, [("entity", k) for k in ks], f"summary {i}") for t, i, d, s, ks in rows], "type string, id long, ref string, domain string, ts timestamp, severity string, keys array<struct<kind:string,value:string>>, summary string")
    return frame


def test_fusion_cluster_batch_and_stream(spark, tmp_path):
    signals = signals_frame(spark)
    alerts = fusion.composite_alerts(signals).collect()
    assert len(alerts) == 1 and alerts[0].severity == "critical" and len(alerts[0].domains) == 4 and "MARITIME" in alerts[0].narrative
    assert fusion.composite_alerts(signals, min_domains=5).count() == 0
    stored = fusion.composite_alerts(signals)
    assert fusion.composite_alerts(signals, existing=stored).count() == 0
    jobs.start_fusion(as_stream(spark, signals, str(tmp_path / "in"), parts=1), str(tmp_path / "cp"), str(tmp_path / "store"), str(tmp_path / "out"), available_now=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


CANDLES = "asset string, exchange string, timeframe string, ts timestamp, open double, high double, low double, close double, volume double"


def test_market_alerts_once(spark, tmp_path):
    rows = [("BTC", "x", "1m", minutes(i), c, c, c, c, 10.0) for i, c in enumerate([100.0 + (i % 7) * 0.1 for i in range(100)] + [160.0])]
    candles = spark.createDataFrame(rows, CANDLES)
    candles.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(str(tmp_path / "history"))
    for run in ("a", "b"):
        stream = as_stream(spark, candles.limit(3), str(tmp_path / f"in{run}"), parts=1)
        jobs.start_market_alerts(stream, str(tmp_path / f"cp{run}"), str(tmp_path / "history"), str(tmp_path / "out"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.alert_type, r.severity) for r in got] == [("price_anomaly", "critical")]


def test_resample_equals_batch(spark, tmp_path):
    rows = [("BTC", "x", "1m", minutes(i * 5), float(i), float(i + 2), float(i - 2), float(i + 1), 1.0) for i in range(30)]
    candles = spark.createDataFrame(rows, CANDLES)
    jobs.start_resample(as_stream(spark, candles, str(tmp_path / "in")), str(tmp_path / "cp"), str(tmp_path / "out"), available_now=True).awaitTermination()
    columns = ["ts", "open", "high", "low", "close", "volume"]
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select(*columns).collect()}
    batch = {tuple(r) for r in market.resample(candles, "1h").select(*columns).collect()}
    assert len(got) >= 2 and got <= batch


def test_a_baseline_counts_candles_not_days(spark, tmp_path):
    # one candle every six hours: eight days hold 32 of them
    rows = [("BTC", "x", "6h", hours(6 * i), c, c, c, c, 10.0) for i, c in enumerate([100.0 + (i % 7) * 0.1 for i in range(200)] + [160.0])]
    candles = spark.createDataFrame(rows, CANDLES)
    candles.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(str(tmp_path / "history"))
    jobs.start_market_alerts(as_stream(spark, candles.orderBy(F.col("ts").desc()).limit(1), str(tmp_path / "in"), parts=1), str(tmp_path / "cp"), str(tmp_path / "history"), str(tmp_path / "out"), available_now=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where("alert_type = 'price_anomaly'").collect()
    want = market.price_anomalies(candles).collect()
    assert [(r.ts, r.severity) for r in got] == [(r.ts, r.severity) for r in want] and len(want) == 1


def test_watched_keys_words_and_checks(spark, tmp_path):
    items = [(1, "wallet", "0xBAD", hours(-100), None), (2, "keyword", "tanker", hours(-100), hours(-5)), (3, "company", "Blue Ocean", hours(0), None), (4, "domain", "evil.org", hours(-100), hours(-50))]
    items = spark.createDataFrame(items, "id long, kind string, key string, created_at timestamp, last_checked_at timestamp")
    schema = "kind string, key string, record_type string, record_id string, ts timestamp, severity string, text string, kinds array<string>"
    every = ["company", "domain", "keyword"]
    rows = [("wallet", "0xBAD", "transfer", "t1", hours(-20), "high", None, None), (None, None, "news", "n1", hours(-6), "low", "A TANKER seized", every), (None, None, "news", "n2", hours(-4), "low", "Tanker of Blue Ocean Ltd", every), (None, None, "news", "n3", hours(-3), "low", "see evil.org", ["keyword"]), (None, None, "news", "n4", hours(-2), "high", "see EVIL.ORG now", every), (None, None, "news", "n4", hours(-2), "high", "see EVIL.ORG now", every)]
    records = spark.createDataFrame(rows, schema)
    for run in ("a", "b"):
        jobs.start_watch_hits(as_stream(spark, records, str(tmp_path / f"in{run}")), str(tmp_path / f"cp{run}"), str(tmp_path / "out"), items, available_now=True).awaitTermination()
    got = sorted((r.item_id, r.record_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(1, "t1"), (2, "n2"), (3, "n2"), (4, "n4")]


def test_stores_are_read_by_day(spark, tmp_path):
    rows = spark.createDataFrame([(i, hours(24 * i)) for i in range(40)], "id long, ts timestamp")
    jobs.append_days(rows, str(tmp_path / "out"))
    first, last = jobs.span(rows.where("id between 3 and 4"))
    kept = jobs.stored_days(spark, str(tmp_path / "out"), rows, first, last)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert kept.count() == 2 and "PartitionFilters: [isnotnull(day" in plan
