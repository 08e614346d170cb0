"""Registered cargo-flow and wallet queries."""

from pyspark.sql import functions as F

from intel_spark.catalog.helpers import AS_OF, AS_OF_ORDERS, AS_OF_ORDERS_SQL, flagged_sql, hav, risky_sql
from intel_spark.catalog.registry import query, r4, ts
from intel_spark.catalog.scalars import DRAFT, DWT
from intel_spark.operators import chain as w
from intel_spark.operators import energy as e
from intel_spark.operators import names as n
from intel_spark.operators.timeline import asof

TANKER = "regexp_matches(lower({x}), 'tanker|crude|oil|chemical|lng|lpg|gas carrier|product')"


@query("l24_sync_facilities", inputs="facilities listings", oracle="SELECT id, name, owner, false AS owner_sanctioned FROM {facilities}")
def _(facilities, listings):
    stored = facilities.withColumn("owner_sanctioned", F.lit(True)).withColumn("owner", F.lit("earlier"))
    return e.sync_facilities(facilities, stored, listings).select("id", "name", "owner", "owner_sanctioned")


@query("j21_link_facilities", inputs="port_calls facilities vessels", oracle=f"""
    SELECT c.id, f.id AS linked_facility FROM {{port_calls}} c JOIN {{facilities}} f ON f.port_name = c.port JOIN {{vessels}} v ON v.id = c.vessel_id WHERE CASE WHEN f.commodity = 'lng' THEN regexp_matches(lower(v.ship_type), 'lng|gas') ELSE {TANKER.format(x='v.ship_type')} END""")
def _(calls, facilities, vessels):
    return e.link_facilities(calls, facilities, vessels).select("id", "linked_facility")


@query("j14_next_event", inputs="port_calls", oracle=f"""
    SELECT a.id, b.id AS next_id, {ts('b.arrival', 'next_arrival')} FROM {{port_calls}} a JOIN {{port_calls}} b ON a.vessel_id = b.vessel_id AND b.arrival > a.departure + INTERVAL 6 HOUR QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY b.arrival, b.id) = 1""")
def _(calls):
    probe = calls.where("departure IS NOT NULL").select("id", "vessel_id", F.timestamp_micros(F.unix_micros("departure") + 6 * 3_600_000_000 + 1).alias("ts"))
    found = asof(probe, calls.select("vessel_id", F.col("arrival").alias("ts"), F.col("id").alias("next_id")), ["vessel_id"], "ts", ["next_id"], "forward", tie="next_id")
    return found.where(F.col("match").isNotNull()).select("id", F.col("match.next_id").alias("next_id"), F.col("match.ts").alias("next_arrival"))


@query("j15_events_within", inputs="positions evasion", oracle="""
    SELECT p.id, e.id AS event_id FROM (SELECT id, vessel_id, ts FROM {positions} WHERE speed < 1) p JOIN {evasion} e ON e.vessel_id = p.vessel_id AND e.ts >= p.ts AND e.ts <= p.ts + INTERVAL 1 DAY""")
def _(positions, evasion):
    starts = positions.where("speed < 1").select("id", "vessel_id", F.col("ts").alias("begin"))
    events = evasion.select("vessel_id", "ts", F.col("id").alias("event_id"))
    return e.events_within(starts, events, "vessel_id", "begin", F.col("begin") + F.expr("INTERVAL 1 DAY")).select("id", "event_id")


FAC_OF = f"""SELECT p.id, p.mmsi, p.ts, coalesce(p.speed, 0) AS sp, p.draught, f.id AS fid, f.commodity, f.port_name, {hav('p.lat', 'p.lon', 'f.lat', 'f.lon')} / 1000 AS km, p.ship_type FROM {{positions}} p LEFT JOIN {{facilities}} f ON {hav('p.lat', 'p.lon', 'f.lat', 'f.lon')} / 1000 <= f.radius_km
    WHERE {TANKER.format(x='p.ship_type')} QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY km, f.id) = 1"""


@query("w16_facility_visits", inputs="positions facilities", oracle=f"""
    WITH RECURSIVE n AS ({FAC_OF}), fx AS (SELECT mmsi, ts, sp, CASE WHEN commodity = 'lng' THEN NULL ELSE fid END AS fid, port_name IS NULL AS own, row_number() OVER (PARTITION BY mmsi ORDER BY ts) AS k FROM n),
    wk AS (SELECT mmsi, ts, k, CASE WHEN fid IS NOT NULL AND sp <= 1.5 AND own THEN fid END AS op, CASE WHEN fid IS NOT NULL AND sp <= 1.5 AND own THEN ts END AS arr, CAST(NULL AS BIGINT) AS cf, CAST(NULL AS TIMESTAMP) AS carr, ts AS lst FROM fx WHERE k = 1
      UNION ALL SELECT f.mmsi, f.ts, f.k, CASE WHEN w.op IS NOT NULL THEN CASE WHEN f.fid IS NULL OR f.fid <> w.op OR f.sp >= 4 THEN NULL ELSE w.op END WHEN f.fid IS NOT NULL AND f.sp <= 1.5 AND f.own THEN f.fid END,
        CASE WHEN w.op IS NOT NULL THEN CASE WHEN f.fid IS NULL OR f.fid <> w.op OR f.sp >= 4 THEN NULL ELSE w.arr END WHEN f.fid IS NOT NULL AND f.sp <= 1.5 AND f.own THEN f.ts END,
        CASE WHEN w.op IS NOT NULL AND (f.fid IS NULL OR f.fid <> w.op OR f.sp >= 4) THEN w.op END, CASE WHEN w.op IS NOT NULL AND (f.fid IS NULL OR f.fid <> w.op OR f.sp >= 4) THEN w.arr END, f.ts FROM wk w JOIN fx f ON f.mmsi = w.mmsi AND f.k = w.k + 1),
    o AS (SELECT mmsi, op AS facility_id, arr, ts FROM wk WHERE op IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.mmsi = wk.mmsi AND fx.k > wk.k))
    SELECT mmsi, cf AS facility_id, {ts('carr', 'arrival')}, {ts('ts', 'departure')}, '' AS flags FROM wk WHERE cf IS NOT NULL
    UNION ALL SELECT mmsi, facility_id, {ts('arr')}, CASE WHEN ts < TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END, CASE WHEN ts < TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR THEN 'lost_contact' ELSE '' END FROM o""")
def _(positions, facilities):
    return e.facility_visits(positions, facilities, AS_OF).select("mmsi", "facility_id", "arrival", "departure", "flags")


SHIPS = f"""ld AS (SELECT c.id AS shipment_id, c.vessel_id, v.mmsi, v.sanctioned_status, v.risk_score AS vr, c.facility_id, f.name AS loading_location, f.type AS ft, f.country AS origin, f.sanctioned, c.departure AS loading_date, draught_arr AS da, draught_dep AS dd, v.length_m AS l, f.commodity AS cm
      FROM {{port_calls}} c JOIN {{facilities}} f ON f.id = c.facility_id JOIN {{vessels}} v ON v.id = c.vessel_id WHERE c.departure >= {AS_OF_ORDERS_SQL} - INTERVAL 600 DAY AND c.departure <= {AS_OF_ORDERS_SQL} AND {TANKER.format(x='v.ship_type')}),
    cl AS (SELECT *, {DRAFT} AS md, {DWT} AS dwt FROM ld), la AS (SELECT *, CASE WHEN cm = 'lng' THEN NULL WHEN abs(dd - da) >= 1 THEN dd > da WHEN md IS NOT NULL THEN dd >= 0.8 * md WHEN dd >= 12 THEN true END AS laden FROM cl),
    sh AS (SELECT *, CASE WHEN laden THEN round(round(dwt * 0.95 * CASE cm WHEN 'products' THEN 8.0 ELSE 7.3 END) * least(1.0, greatest(0.5, dd / md))) END AS barrels, sanctioned OR origin IN ('RU', 'IR') AS sanctioned_route FROM la WHERE laden IS NULL OR laden OR ft = 'sts_hub'),
    nx AS (SELECT s.shipment_id, c.id AS cid, c.arrival, c.port, c.country, c.facility_id AS tof FROM sh s JOIN {{port_calls}} c ON c.vessel_id = s.vessel_id AND c.arrival > s.loading_date + INTERVAL 6 HOUR QUALIFY row_number() OVER (PARTITION BY s.shipment_id ORDER BY c.arrival, c.id) = 1),
    sp AS (SELECT sh.*, nx.arrival AS discharge_date, nx.port AS discharge_location, nx.country AS destination, CASE WHEN cid IS NOT NULL THEN CASE WHEN h.type = 'sts_hub' THEN 'transshipped' ELSE 'discharged' END WHEN loading_date < {AS_OF_ORDERS_SQL} - INTERVAL 75 DAY THEN 'stale' ELSE 'underway' END AS status FROM sh LEFT JOIN nx USING (shipment_id) LEFT JOIN {{facilities}} h ON h.id = tof)"""


def ships(calls, vessels, facilities):
    return e.build_shipments(calls, vessels, facilities, AS_OF_ORDERS, 600)


@query("x13_build_shipments", inputs="port_calls vessels facilities", oracle=f"""
    WITH {SHIPS} SELECT shipment_id, {r4('barrels')}, laden, sanctioned_route, sanctioned_route AND {risky_sql().replace('risk_score', 'vr')} AS dark_oil_suspect, {r4("round(0.3 + CASE WHEN sanctioned_route THEN 0.4 ELSE 0 END + CASE WHEN " + flagged_sql() + " THEN 0.3 ELSE 0 END, 2)", "risk_score")}, status, {ts('discharge_date')}, discharge_location FROM sp""")
def _(calls, vessels, facilities):
    return ships(calls, vessels, facilities).select("shipment_id", "barrels", "laden", "sanctioned_route", "dark_oil_suspect", "risk_score", "status", "discharge_date", "discharge_location")


PATTERNS = f"""vy AS (SELECT * FROM sp WHERE sanctioned_route AND loading_date >= {AS_OF_ORDERS_SQL} - INTERVAL 500 DAY), wn AS (SELECT *, coalesce(discharge_date, {AS_OF_ORDERS_SQL}) + INTERVAL 2 DAY AS we FROM vy),
    st AS (SELECT wn.shipment_id, wn.vessel_id, min_by(CASE WHEN s.confidence >= 0.7 THEN 0.1 ELSE 0.0 END, (s.ts, s.id)) AS extra FROM wn JOIN {{sts}} s ON (s.vessel_a = wn.vessel_id OR s.vessel_b = wn.vessel_id) AND s.ts >= wn.loading_date AND s.ts <= wn.we GROUP BY 1, 2),
    lo AS (SELECT vessel_id, min_by(CASE WHEN f.sanctioned THEN 0.1 ELSE 0.0 END, (c.arrival, c.id)) AS extra FROM {{port_calls}} c JOIN {{facilities}} f ON f.id = c.facility_id AND f.type = 'sts_hub' WHERE c.departure IS NULL AND c.arrival <= {AS_OF_ORDERS_SQL} - INTERVAL 24 HOUR GROUP BY 1),
    pt AS (SELECT vessel_id, shipment_id, CASE WHEN {flagged_sql()} THEN 'sanctioned_vessel_loading' ELSE 'sanctioned_loading' END AS pattern, 0.0 AS extra FROM vy UNION ALL SELECT vessel_id, shipment_id, 'sts_transfer', extra FROM st UNION ALL SELECT vessel_id, NULL, 'sts_hub_loitering', extra FROM lo),
    sc AS (SELECT pt.*, round(least(1.0, CASE pattern WHEN 'sanctioned_loading' THEN 0.55 WHEN 'sts_transfer' THEN 0.7 WHEN 'sts_hub_loitering' THEN 0.6 ELSE 0.9 END + extra + CASE WHEN {flagged_sql('v.')} THEN 0.15 WHEN v.risk_score >= 0.5 THEN 0.05 ELSE 0 END), 2) AS score, CASE pattern WHEN 'sts_transfer' THEN 'high' WHEN 'sanctioned_vessel_loading' THEN 'critical' ELSE 'medium' END AS base
      FROM pt JOIN {{vessels}} v ON v.id = pt.vessel_id)"""


@query("x14_dark_oil", inputs="port_calls vessels facilities evasion sts", oracle=f"""
    WITH {SHIPS}, {PATTERNS} SELECT vessel_id, shipment_id, pattern, {r4('score', 'confidence')}, CASE WHEN score >= 0.85 THEN 'critical' WHEN score >= 0.7 AND base = 'medium' THEN 'high' ELSE base END AS severity FROM sc""")
def _(calls, vessels, facilities, evasion, sts):
    voyages = ships(calls, vessels, facilities)
    return e.dark_oil(voyages, evasion, sts, calls, vessels, facilities, AS_OF_ORDERS, 500).select("vessel_id", "shipment_id", "pattern", "confidence", "severity")


@query("x14_raise_shipment_risk", inputs="port_calls vessels facilities evasion sts", oracle=f"""
    WITH {SHIPS}, {PATTERNS}, ct AS (SELECT shipment_id, count(*) AS k FROM sc WHERE shipment_id IS NOT NULL GROUP BY 1)
    SELECT shipment_id, {r4("round(least(1.0, round(0.3 + CASE WHEN sanctioned_route THEN 0.4 ELSE 0 END + CASE WHEN " + flagged_sql() + " THEN 0.3 ELSE 0 END, 2) + 0.15 * coalesce(k, 0)), 2)", "risk_score")} FROM sp LEFT JOIN ct USING (shipment_id)""")
def _(calls, vessels, facilities, evasion, sts):
    voyages = ships(calls, vessels, facilities)
    return e.raise_shipment_risk(voyages, e.dark_oil(voyages, evasion, sts, calls, vessels, facilities, AS_OF_ORDERS, 500)).select("shipment_id", "risk_score")


FLOWS = f"""tc AS (SELECT c.*, CAST({risky_sql('v.')} AS INT) AS fl FROM {{port_calls}} c JOIN {{vessels}} v ON v.id = c.vessel_id WHERE {TANKER.format(x='v.ship_type')}),
    fa AS (SELECT facility_id, CAST(arrival AS DATE) AS day, 1 AS a, 0 AS d, 0 AS l, NULL AS b, fl AS f FROM tc WHERE arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY UNION ALL SELECT facility_id, CAST(departure AS DATE), 0, 1, 0, NULL, 0 FROM tc WHERE departure >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY
      UNION ALL SELECT facility_id, CAST(loading_date AS DATE), 0, 0, CAST(coalesce(laden, false) AS INT), barrels, 0 FROM sp WHERE loading_date >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY),
    fs AS (SELECT facility_id, day, sum(a) AS arrivals, sum(d) AS departures, sum(l) AS laden_departures, nullif(sum(b), 0) AS barrels, sum(f) AS flagged_tankers FROM fa GROUP BY 1, 2)"""


@query("g09_flow_snapshots", inputs="port_calls vessels facilities", oracle=f"WITH {SHIPS}, {FLOWS} SELECT facility_id, CAST(day AS VARCHAR) AS day, arrivals, departures, laden_departures, {r4('barrels')}, flagged_tankers FROM fs")
def _(calls, vessels, facilities):
    return e.flow_snapshots(calls, ships(calls, vessels, facilities), vessels, AS_OF_ORDERS, 400)


COUNTERS = f"""cn AS (SELECT facility_id, count(*) FILTER (arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 7 DAY) AS c7, count(*) FILTER (arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 30 DAY) AS c30, max(arrival) AS la FROM tc WHERE arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY GROUP BY 1),
    vo AS (SELECT facility_id, sum(barrels) AS bbl FROM sp WHERE loading_date >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY GROUP BY 1)"""


@query("g10_facility_counters", inputs="port_calls vessels facilities", oracle=f"""
    WITH {SHIPS}, {FLOWS}, {COUNTERS} SELECT f.id AS facility_id, coalesce(c7, 0) AS calls_7d, coalesce(c30, 0) AS calls_30d, {ts('la', 'last_activity')}, {r4("CASE WHEN bbl > 0 THEN round(least(1.5, bbl / (capacity_bpd * 30)), 3) END", "utilization")} FROM {{facilities}} f LEFT JOIN cn ON cn.facility_id = f.id LEFT JOIN vo ON vo.facility_id = f.id""")
def _(calls, vessels, facilities):
    return e.facility_counters(facilities, calls, ships(calls, vessels, facilities), vessels, AS_OF_ORDERS, 400).drop("name")


DAILY = f"""pr AS (SELECT CAST(l_shipdate AS DATE) AS day, round(avg(l_extendedprice), 2) AS price FROM lineitem WHERE l_shipdate >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY GROUP BY 1),
    fl AS (SELECT day, sum(laden_departures) AS ld, sum(coalesce(barrels, 0)) AS bb FROM fs WHERE day >= CAST({AS_OF_ORDERS_SQL} - INTERVAL 400 DAY AS DATE) AND facility_id IN (SELECT id FROM {{facilities}} WHERE sanctioned) GROUP BY 1), se AS (SELECT day, coalesce(ld, 0) AS ld, coalesce(bb, 0) AS bb, price FROM fl FULL JOIN pr USING (day))"""


@query("g11_price_context", inputs="port_calls vessels facilities oil_candles", oracle=f"WITH {SHIPS}, {FLOWS}, {DAILY} SELECT CAST(day AS VARCHAR) AS day, CAST(ld AS BIGINT) AS laden_departures, {r4('bb', 'barrels')}, price FROM se")
def _(calls, vessels, facilities, candles):
    snapshots = e.flow_snapshots(calls, ships(calls, vessels, facilities), vessels, AS_OF_ORDERS, 400)
    return e.price_context(snapshots, facilities, candles, AS_OF_ORDERS, 400)[0].select("day", "laden_departures", "barrels", "price")


@query("g11_price_correlation", inputs="port_calls vessels facilities oil_candles", oracle=f"WITH {SHIPS}, {FLOWS}, {DAILY} SELECT count(*) AS n, round(corr(ld, price), 3) AS correlation FROM se WHERE price IS NOT NULL")
def _(calls, vessels, facilities, candles):
    snapshots = e.flow_snapshots(calls, ships(calls, vessels, facilities), vessels, AS_OF_ORDERS, 400)
    return e.price_context(snapshots, facilities, candles, AS_OF_ORDERS, 400)[1]


@query("g12_energy_summary", inputs="port_calls vessels facilities evasion sts", oracle=f"""
    WITH {SHIPS}, {PATTERNS}, {FLOWS}, {COUNTERS}, re AS (SELECT * FROM sp WHERE loading_date >= {AS_OF_ORDERS_SQL} - INTERVAL 60 DAY)
    SELECT 'shipments' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM re UNION ALL SELECT 'sanctioned_shipments', '', count(*) FILTER (sanctioned_route) FROM re UNION ALL SELECT 'sanctioned_barrels', '', coalesce(sum(barrels) FILTER (sanctioned_route), 0) FROM re UNION ALL SELECT 'pattern', pattern, count(*) FROM sc GROUP BY 2
    UNION ALL SELECT 'origin', origin, count(*) FROM re GROUP BY 2 UNION ALL SELECT 'destination', destination, count(*) FROM re WHERE destination IS NOT NULL GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'most_active', f.name, c7 FROM cn JOIN {{facilities}} f ON f.id = cn.facility_id WHERE c7 > 0 ORDER BY c7 DESC, f.name LIMIT 8)""")
def _(calls, vessels, facilities, evasion, sts):
    voyages = ships(calls, vessels, facilities)
    indicators = e.dark_oil(voyages, evasion, sts, calls, vessels, facilities, AS_OF_ORDERS, 500)
    return e.energy_summary(voyages, indicators, e.facility_counters(facilities, calls, voyages, vessels, AS_OF_ORDERS, 400), AS_OF_ORDERS, 60)


LABELLED = """lb AS (SELECT t.*, f.wallet_type AS ft, coalesce(f.owner, f.label) AS fe, g.wallet_type AS gt, coalesce(g.owner, g.label) AS ge FROM {transfers} t LEFT JOIN {wallet_labels} f ON f.chain = t.chain AND f.address = t.src AND f.wallet_type IN ('sanctioned', 'exchange', 'mixer')
      LEFT JOIN {wallet_labels} g ON g.chain = t.chain AND g.address = t.dst AND g.wallet_type IN ('sanctioned', 'exchange', 'mixer')),
    fl AS (SELECT *, coalesce(ft = 'sanctioned', false) OR coalesce(gt = 'sanctioned', false) AS s, coalesce(ft = 'mixer', false) OR coalesce(gt = 'mixer', false) AS m, coalesce(ft = 'exchange', false) OR coalesce(gt = 'exchange', false) AS x FROM lb),
    sc AS (SELECT *, CASE WHEN s AND x THEN CASE WHEN gt = 'exchange' THEN 'exchange_cashout' ELSE 'exchange_withdrawal_to_sanctioned' END WHEN s AND m THEN 'sanctioned_mixer_usage' WHEN s THEN 'sanctioned_counterparty' WHEN m THEN 'mixer_usage' WHEN usd >= 60000 THEN 'whale_transfer' ELSE 'watched_wallet_activity' END AS pattern FROM fl),
    rs AS (SELECT *, round(least(1.0, CASE WHEN s AND (x OR m) THEN 0.95 WHEN s THEN 0.85 WHEN m THEN CASE WHEN usd >= 60000 THEN 0.8 ELSE 0.6 END WHEN usd >= 60000 THEN 0.4 + least(0.3, usd / 1200000) ELSE 0.3 END + CASE WHEN usd >= 300000 THEN 0.05 ELSE 0 END), 2) AS risk FROM sc)"""


@query("j19_label_transfers", inputs="transfers wallet_labels", oracle=f"WITH {LABELLED} SELECT tx_hash, ft AS from_type, gt AS to_type, fe AS source_entity, ge AS destination_entity FROM lb")
def _(transfers, labels):
    return w.label_transfers(transfers, labels).select("tx_hash", "from_type", "to_type", "source_entity", "destination_entity")


@query("x10_assess_transfers", inputs="transfers wallet_labels", oracle=f"WITH {LABELLED} SELECT tx_hash, pattern, {r4('risk', 'risk_score')}, s AS involves_sanctioned, m AS involves_mixer, x AS involves_exchange FROM rs")
def _(transfers, labels):
    return w.assess_transfers(transfers, labels, 60_000).select("tx_hash", "pattern", "risk_score", "involves_sanctioned", "involves_mixer", "involves_exchange")


@query("x11_capture", inputs="transfers wallet_labels", oracle=f"WITH {LABELLED} SELECT DISTINCT tx_hash, pattern FROM rs WHERE (s OR m OR pattern = 'whale_transfer') AND usd >= 20000")
def _(transfers, labels):
    return w.capture(transfers, labels, transfers.where("usd < 20000"), whale_usd=60_000).select("tx_hash", "pattern")


@query("x12_wallet_state", inputs="utxo_lines companies", oracle=f"""
    WITH tx AS (SELECT tx_hash, max(ts) AS ts FROM {{utxo_lines}} GROUP BY 1), i AS (SELECT tx_hash, tx.ts, src AS address, usd AS sent, 0 AS received FROM {{utxo_lines}} JOIN tx USING (tx_hash) UNION ALL SELECT tx_hash, tx.ts, dst, 0, usd FROM {{utxo_lines}} JOIN tx USING (tx_hash)),
    f AS (SELECT address, tx_hash, max(ts) AS ts, sum(sent) AS sent, sum(received) AS received FROM i WHERE address LIKE 'W%' GROUP BY 1, 2)
    SELECT address, {r4('round(sum(sent), 8)', 'outflow')}, {r4('round(sum(received), 8)', 'inflow')}, count(*) AS transactions, {ts('max(ts)', 'last_active')} FROM f GROUP BY 1""")
def _(lines, companies):
    side = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("addr"), F.col("usd").alias("value"))))
    utxo = lines.groupBy("tx_hash").agg(F.max("ts").alias("ts"), side("src").alias("inputs"), side("dst").alias("outputs"))
    wallets = companies.select(F.lit("bitcoin").alias("chain"), F.concat(F.lit("W"), F.col("id").cast("string")).alias("address"))
    return w.wallet_state(w.wallet_transfers(utxo, wallets)).select("address", "outflow", "inflow", "transactions", "last_active")


@query("x12_wallet_transfers", inputs="utxo_lines companies", oracle=f"""
    WITH s AS (SELECT tx_hash, src AS address, sum(usd) AS amount FROM {{utxo_lines}} GROUP BY 1, 2) SELECT tx_hash, address, 'out' AS direction, {r4('amount')} FROM s""")
def _(lines, companies):
    side = lambda c: F.array_sort(F.collect_list(F.struct(F.col(c).alias("addr"), F.col("usd").alias("value"))))
    utxo = lines.groupBy("tx_hash").agg(F.max("ts").alias("ts"), side("src").alias("inputs"), side("dst").alias("outputs"))
    wallets = companies.select(F.lit("bitcoin").alias("chain"), F.concat(F.lit("W"), F.col("id").cast("string")).alias("address"))
    return w.wallet_transfers(utxo, wallets).select("tx_hash", "address", "direction", "amount")


@query("j24_wallet_assets", inputs="listings wallet_labels", oracle="""
    WITH a AS (SELECT id, is_active, 'bitcoin' AS chain, concat('bc1qaddressnumber', lpad(CAST(id % 400 AS STRING), 8, '0')) AS address FROM {listings} UNION ALL SELECT id, is_active, 'ethereum', concat('0xabcdef', lpad(CAST(id % 700 AS STRING), 34, '0')) FROM {listings}),
    b AS (SELECT chain, address, max(id) AS id, max_by(is_active, id) AS act FROM a GROUP BY 1, 2) SELECT chain, address, CASE WHEN act THEN 'sanctioned' ELSE 'delisted' END AS wallet_type, id AS entity_id, act AS is_sanctioned FROM b UNION ALL SELECT chain, address, wallet_type, NULL, false FROM {wallet_labels}""")
def _(listings, labels):
    return w.wallet_assets(listings, labels).select("chain", "address", "wallet_type", "entity_id", "is_sanctioned")


@query("g15_chain_summary", inputs="transfers wallet_labels", oracle=f"""
    WITH {LABELLED}, wl AS (SELECT chain, address, wallet_type = 'sanctioned' AS is_s, length(label) * 10.5 AS bal FROM {{wallet_labels}}), rc AS (SELECT * FROM rs WHERE ts >= {AS_OF_ORDERS_SQL} - INTERVAL 2000 HOUR)
    SELECT 'sanctioned_wallets' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM wl WHERE is_s UNION ALL SELECT 'sanctioned_balance', '', round(sum(bal), 2) FROM wl WHERE is_s UNION ALL SELECT 'active_wallets', '', 0 UNION ALL SELECT 'by_chain', chain, count(*) FROM wl WHERE is_s GROUP BY 2
    UNION ALL SELECT 'by_pattern', pattern, count(*) FROM rc GROUP BY 2 UNION ALL SELECT 'sanctioned_volume', '', round(coalesce(sum(usd), 0), 2) FROM rc WHERE s""")
def _(transfers, labels):
    wallets = labels.select("chain", "address", (F.col("wallet_type") == "sanctioned").alias("is_sanctioned"), (F.length("label") * 10.5).alias("balance_usd"), F.lit(None).cast("timestamp").alias("last_active"))
    return w.chain_summary(wallets, w.assess_transfers(transfers, labels, 60_000), AS_OF_ORDERS, 2000)
