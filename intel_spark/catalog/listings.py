"""Registered read queries and briefs."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from intel_spark.catalog.helpers import AS_OF, AS_OF_ORDERS, AS_OF_ORDERS_SQL, AS_OF_SQL
from intel_spark.catalog.news import CLUSTERS, KEYS, RULES, keyed
from intel_spark.catalog.registry import ORACLES, query, r4, ts
from intel_spark.catalog.sanctions import OWNED
from intel_spark.operators import fusion, graph
from intel_spark.operators.links import signal_links
from intel_spark.plans import briefs as b
from intel_spark.plans import listings as q

RECENT = f"ts >= {AS_OF_SQL} - INTERVAL 240 HOUR AND ts <= {AS_OF_SQL}"
RECENT_O = f"ts >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY AND ts <= {AS_OF_ORDERS_SQL}"
RANK = "CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END"


@query("q02_list_alerts", inputs="raw_alerts", oracle=f"SELECT alert_id, severity FROM {{raw_alerts}} WHERE severity IN ('high', 'critical') AND asset = 'click' AND {RECENT} ORDER BY ts DESC, alert_id LIMIT 50 OFFSET 10")
def _(alerts):
    return q.list_alerts(alerts.withColumn("acknowledged", F.lit(False)), ["high", "critical"], "click", acknowledged=False, as_of=AS_OF, hours=240, limit=50, offset=10)[0].select("alert_id", "severity")


@query("q02_alert_total", inputs="raw_alerts", oracle=f"SELECT count(*) AS total FROM {{raw_alerts}} WHERE severity IN ('high', 'critical') AND {RECENT}")
def _(alerts):
    return q.list_alerts(alerts, ["high", "critical"], as_of=AS_OF, hours=240)[1]


@query("q03_list_coordination", inputs="raw_alerts", oracle="SELECT asset, alert_id FROM {raw_alerts} WHERE asset = 'view' AND alert_id % 100 >= 60 ORDER BY ts DESC, asset LIMIT 100")
def _(alerts):
    events = alerts.withColumn("confidence", (F.col("alert_id") % 100) / 100).withColumn("status", F.lit("flagged"))
    return q.list_coordination(events, "view", "flagged", 0.6).select("asset", "alert_id")


@query("q04_vessels_in_bbox", inputs="vessels", oracle="SELECT id FROM {vessels} WHERE lat BETWEEN 55.5 AND 56.2 AND lon BETWEEN 10 AND 12 AND (sanctioned_status = 'flagged' OR sanctioned_status LIKE 'breach%') ORDER BY risk_score DESC NULLS LAST, id LIMIT 60")
def _(vessels):
    return q.vessels_in_bbox(vessels, 55.5, 10, 56.2, 12, "flagged", limit=60).select("id")


@query("q05_vessel_table", inputs="vessels", oracle="SELECT id, name FROM {vessels} WHERE (contains(lower(name), '1') OR contains(lower(mmsi), '1') OR contains(lower(coalesce(imo, '')), '1') OR contains(lower(coalesce(owner, '')), '1')) AND flag = 'PA' AND risk_score >= 0.2 ORDER BY name, id LIMIT 30")
def _(vessels):
    return q.vessel_table(vessels, "1", "PA", min_risk=0.2, sort="name", limit=30)[0].select("id", "name")


@query("q06_list_breaches", inputs="breaches", oracle="SELECT id FROM {breaches} WHERE authority = 'OFAC' AND status = 'flagged' AND confidence >= 0.5 ORDER BY ts DESC, id LIMIT 100")
def _(breaches):
    return q.list_breaches(breaches, "OFAC", min_confidence=0.5)[0].select("id")


@query("q07_list_evasion", inputs="evasion", oracle=f"SELECT id FROM {{evasion}} WHERE severity = 'high' AND {RECENT} ORDER BY ts DESC, id LIMIT 200")
def _(evasion):
    return q.list_evasion(evasion, severity="high", as_of=AS_OF, hours=240)[0].select("id")


@query("q07_evasion_by_type", inputs="evasion", oracle=f"SELECT event_type, count(*) AS count FROM {{evasion}} WHERE {RECENT} GROUP BY 1")
def _(evasion):
    return q.list_evasion(evasion, as_of=AS_OF, hours=240)[1]


@query("q08_list_sts", inputs="sts vessels", oracle=f"""
    WITH p AS (SELECT * FROM {{sts}} WHERE {RECENT_O} AND confidence >= 0.5 ORDER BY confidence DESC, ts DESC, id LIMIT 100) SELECT p.id, a.name AS name_a, b.name AS name_b FROM p LEFT JOIN {{vessels}} a ON a.id = vessel_a LEFT JOIN {{vessels}} b ON b.id = vessel_b""")
def _(sts, vessels):
    return q.list_sts(sts, vessels, AS_OF_ORDERS, 400 * 24, 0.5, 100).select("id", "name_a", "name_b")


@query("q09_list_port_calls", inputs="port_calls", oracle=f"SELECT id FROM {{port_calls}} WHERE arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 300 DAY AND arrival <= {AS_OF_ORDERS_SQL} AND contains(lower(port), 'port 1') AND risk_level = 'high' AND departure IS NULL ORDER BY arrival DESC, id LIMIT 200")
def _(calls):
    return q.list_port_calls(calls, AS_OF_ORDERS, "300d", "port 1", "high", open_only=True)[0].select("id")


@query("q09_port_call_counts", inputs="port_calls", oracle=f"SELECT port, risk_level, count(*) AS count FROM {{port_calls}} WHERE arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 300 DAY AND arrival <= {AS_OF_ORDERS_SQL} GROUP BY 1, 2")
def _(calls):
    return q.list_port_calls(calls, AS_OF_ORDERS, "300d")[1]


@query("q10_list_zone_events", inputs="evasion vessels", oracle=f"""
    WITH p AS (SELECT vessel_id, id, event_type FROM {{evasion}} WHERE {RECENT} AND severity = 'high' ORDER BY ts DESC, vessel_id, event_type LIMIT 200) SELECT p.id, v.name, v.flag FROM p LEFT JOIN {{vessels}} v ON v.id = p.vessel_id""")
def _(evasion, vessels):
    events = evasion.select("id", "vessel_id", "ts", F.col("event_type").alias("lane_name"), F.col("severity").alias("context"))
    return q.list_zone_events(events, vessels, AS_OF, 240, "high")[0].select("id", "name", "flag")


@query("q11_search_audit", inputs="audit", oracle="SELECT id, action FROM {audit} WHERE ts >= TIMESTAMP '1996-01-01' AND ts <= TIMESTAMP '1997-01-01' AND action IN ('breach_detected', 'cleared') AND vessel_id = 42 ORDER BY ts DESC, id LIMIT 200")
def _(audit):
    start, end = datetime(1996, 1, 1, tzinfo=timezone.utc), datetime(1997, 1, 1, tzinfo=timezone.utc)
    return q.search_audit(audit, start, end, ["breach_detected", "cleared"], 42).select("id", "action")


@query("q11_audit_action_counts", inputs="audit", oracle="SELECT action, count(*) AS n FROM {audit} GROUP BY 1")
def _(audit):
    return q.audit_action_counts(audit)


@query("q12_search_listings", inputs="listings", oracle="""
    WITH f AS (SELECT * FROM {listings} WHERE is_active AND (contains(name_normalized, 'RED GEAR') OR list_bool_or(list_transform(aliases, lambda a: contains(upper(a), 'RED GEAR')))) AND list_bool_or(list_transform(programs, lambda p: contains(upper(p), 'PROG'))) ORDER BY name, id LIMIT 50)
    SELECT id, name, (SELECT string_agg(DISTINCT authority, ',' ORDER BY authority) FROM {listings} l WHERE l.name_normalized = f.name_normalized) AS listed_by FROM f""")
def _(listings):
    return q.search_listings(listings, "Red gear", program="prog")[0].select("id", "name", "listed_by")


@query("q13_list_updates", inputs="list_updates", oracle=f"SELECT authority, update_type, count(*) AS count FROM {{list_updates}} WHERE {RECENT_O} GROUP BY 1, 2")
def _(updates):
    return q.list_updates(updates, AS_OF_ORDERS, 400)[1]


@query("q14_list_programs", inputs="listings", oracle="WITH p AS (SELECT authority, program, count(*) AS n_entities FROM (SELECT authority, unnest(programs) AS program FROM {listings} WHERE is_active) GROUP BY 1, 2) SELECT *, CAST(sum(n_entities) OVER (PARTITION BY authority) AS BIGINT) AS authority_total FROM p")
def _(listings):
    from intel_spark.operators.sanctions import program_counts
    return q.list_programs(program_counts(listings)).drop("n_vessels")


@query("q15_list_geo_events", inputs="geo_events", oracle=f"""
    SELECT id FROM {{geo_events}} WHERE {RECENT} AND event_type IN ('sanctions', 'conflict') AND (coalesce(country = 'RU', false) OR coalesce(country_secondary = 'RU', false) OR list_contains(countries, 'RU')) AND {RANK} >= 1 AND source = 'wire' AND contains(title, 'title') ORDER BY ts DESC, id LIMIT 100""")
def _(events):
    return q.list_geo_events(events, AS_OF, 240, ["sanctions", "conflict"], "RU", "medium", "wire", text="Title")[0].select("id")


def linked(events):
    return events.withColumn("with_market", F.col("id") % 3 == 0).withColumn("with_maritime", F.col("id") % 5 == 0).withColumn("with_sanctions", F.lit(False))


@query("q16_geo_alerts", inputs="geo_events", oracle=f"SELECT id FROM {{geo_events}} WHERE {RECENT} AND severity IN ('high', 'critical') ORDER BY (id % 3 = 0 OR id % 5 = 0) DESC, ts DESC, id LIMIT 50")
def _(events):
    return q.geo_alerts(linked(events), AS_OF, 240).select("id")


@query("q16_geo_event_detail", inputs="geo_events evasion", oracle="SELECT 120 AS event_id, id AS alert_id FROM {evasion} WHERE id % 500 = 120 % 500")
def _(events, evasion):
    links = evasion.select((F.col("id") % 500).alias("event_id"), F.lit("evasion_event").alias("alert_type"), F.col("id").alias("alert_id"), F.col("confidence").alias("score"))
    return q.geo_event_detail(events, links, 120).select("event_id", "alert_id")


@query("q17_list_event_links", inputs="evasion", oracle=f"SELECT id AS alert_id FROM {{evasion}} WHERE {RECENT} AND confidence >= 0.7 ORDER BY confidence DESC, id % 500, id LIMIT 200")
def _(evasion):
    links = evasion.select((F.col("id") % 500).alias("event_id"), F.lit("evasion_event").alias("alert_type"), F.col("id").alias("alert_id"), F.col("confidence").alias("score"), F.col("ts").alias("alert_ts"))
    return q.list_event_links(links, AS_OF, 240, "evasion_event", 0.7).select("alert_id")


def wallets_of(labels):
    return labels.withColumn("is_sanctioned", F.col("wallet_type") == "sanctioned").withColumn("balance_usd", F.length("label") * 10.5).withColumn("risk_score", F.lit(0.5)).withColumn("last_active", F.lit(None).cast("timestamp"))


@query("q18_list_wallets", inputs="wallet_labels", oracle="SELECT chain, address FROM {wallet_labels} WHERE wallet_type = 'sanctioned' AND (contains(lower(address), 'p1') OR contains(lower(label), 'p1') OR contains(lower(coalesce(owner, '')), 'p1')) AND length(label) * 10.5 >= 50 ORDER BY length(label) DESC, chain, address LIMIT 40")
def _(labels):
    return q.list_wallets(wallets_of(labels), wallet_type="sanctioned", sanctioned=True, text="p1", min_balance=50, sort="balance", limit=40)[0].select("chain", "address")


@query("q18_wallet_detail", inputs="wallet_labels transfers spend_inputs", oracle="SELECT tx_hash FROM {transfers} WHERE chain = 'bitcoin' AND (src = 'W7' OR dst = 'W7') ORDER BY ts DESC, tx_hash LIMIT 100")
def _(labels, transfers, inputs):
    clusters = inputs.select("chain", "address", F.lit("c").alias("cluster_id"))
    return q.wallet_detail(wallets_of(labels), transfers, clusters, "bitcoin", "W7")[1].select("tx_hash")


@query("q19_list_transfers", inputs="transfers wallet_labels", oracle=f"SELECT tx_hash FROM {{transfers}} WHERE chain = 'bitcoin' AND usd >= 50000 AND src = 'W3' AND {RECENT_O} ORDER BY ts DESC, tx_hash LIMIT 100")
def _(transfers, labels):
    return q.list_transfers(transfers, "bitcoin", min_usd=50000, address="W3", as_of=AS_OF_ORDERS, hours=400 * 24)[0].select("tx_hash")


@query("q19_whales", inputs="transfers", oracle=f"SELECT tx_hash, {r4('usd')} FROM {{transfers}} WHERE {RECENT_O} ORDER BY usd DESC, tx_hash LIMIT 50")
def _(transfers):
    return q.whales(transfers, AS_OF_ORDERS, 400 * 24).select("tx_hash", "usd")


@query("q20_list_companies", inputs="companies", oracle="SELECT id FROM {companies} WHERE (contains(lower(name), 'unit') OR contains(lower(lei), 'unit')) AND country = 'PA' AND NOT listed ORDER BY creation_date DESC, id LIMIT 10")
def _(companies):
    return q.list_companies(companies, "unit", "PA", False, has_lei=True, sort="created", limit=10)[0].select("id")


@query("q20_list_chains", inputs="companies ownership", oracle=f"WITH RECURSIVE {OWNED} SELECT company, len(seen) AS chain_length FROM pt JOIN ab USING (company) WHERE ab.listed ORDER BY chain_length DESC, company LIMIT 20")
def _(companies, ownership):
    return q.list_chains(graph.ownership_chains(companies, ownership), True, limit=20).select("company", "chain_length")


@query("q20_company_detail", inputs="companies ownership", oracle="SELECT e.parent AS id, 'parent' AS relation FROM {ownership} e WHERE child = 20 UNION ALL SELECT child, 'subsidiary' FROM {ownership} WHERE parent = 20")
def _(companies, ownership):
    chains = ownership.select(F.col("child").alias("company"))
    return q.company_detail(companies, ownership, chains, 20)[1].select("id", "relation")


@query("q21_list_facilities", inputs="facilities", oracle="SELECT id, name FROM {facilities} WHERE type = 'refinery' AND NOT sanctioned")
def _(facilities):
    return q.list_facilities(facilities, facility_type="refinery", sanctioned=False).select("id", "name")


@query("q21_facility_detail", inputs="facilities port_calls", oracle=f"SELECT id FROM {{port_calls}} WHERE facility_id = 5 AND arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 300 DAY")
def _(facilities, calls):
    ships = calls.select("facility_id", F.col("facility_id").alias("discharge_facility"), F.col("arrival").alias("loading_date"), F.col("id").alias("shipment_id"))
    flows = calls.select("facility_id", F.to_date("arrival").alias("day"))
    return q.facility_detail(facilities, calls, ships, flows, 5, AS_OF_ORDERS, 300)[1].select("id")


@query("q22_list_shipments", inputs="port_calls vessels", oracle=f"SELECT c.id AS shipment_id FROM {{port_calls}} c JOIN {{vessels}} v ON v.id = c.vessel_id WHERE departure >= {AS_OF_ORDERS_SQL} - INTERVAL 400 DAY AND departure <= {AS_OF_ORDERS_SQL} AND is_sanctioned AND c.country = 'C4' ORDER BY departure DESC, c.id LIMIT 200")
def _(calls, vessels):
    ships = calls.join(vessels.select(F.col("id").alias("vessel_id"), "mmsi"), "vessel_id").select(F.col("id").alias("shipment_id"), "mmsi", F.col("departure").alias("loading_date"), F.col("is_sanctioned").alias("sanctioned_route"), F.col("country").alias("origin"))
    return q.list_shipments(ships, AS_OF_ORDERS, 400, True, origin="C4")[0].select("shipment_id")


@query("q23_list_dark_oil", inputs="evasion", oracle="SELECT id FROM {evasion} WHERE event_type = 'ais_gap' AND confidence >= 0.8 ORDER BY confidence DESC, vessel_id, event_type, id LIMIT 200")
def _(evasion):
    return q.list_dark_oil(evasion.withColumn("pattern", F.col("event_type")).withColumn("shipment_id", F.col("id")), "ais_gap", min_confidence=0.8).select("id")


@query("q23_list_flows", inputs="port_calls facilities", oracle="SELECT facility_id, CAST(CAST(arrival AS DATE) AS VARCHAR) AS day, count(*) AS n FROM {port_calls} WHERE facility_id IN (SELECT id FROM {facilities} WHERE country = 'RU' AND sanctioned) GROUP BY 1, 2")
def _(calls, facilities):
    flows = calls.groupBy("facility_id", F.to_date("arrival").alias("day")).agg(F.count("*").alias("n"))
    return q.list_flows(flows, facilities, country="RU", sanctioned=True)


@query("q24_list_aircraft", inputs="sightings", oracle="SELECT DISTINCT registration FROM {sightings} WHERE contains(lower(registration), 'ep-1')")
def _(sightings):
    aircraft = sightings.select("registration").distinct().withColumn("operator", F.lit("op")).withColumn("country", F.lit("IR")).withColumn("is_sanctioned", F.lit(True))
    return q.list_aircraft(aircraft, "IR", True, "EP-1").select("registration")


@query("q24_sightings_of", inputs="sightings", oracle="SELECT id FROM {sightings} WHERE registration = 'EP-33'")
def _(sightings):
    return q.sightings_of(sightings, "ep-33").select("id")


@query("q24_recent_sightings", inputs="sightings", oracle=f"SELECT id FROM {{sightings}} WHERE {RECENT} ORDER BY ts DESC, id LIMIT 200")
def _(sightings):
    return q.recent_sightings(sightings, AS_OF, 240).select("id")


@query("q25_list_infra", inputs="domains", oracle="SELECT id FROM {domains} WHERE is_live AND hosting_country = 'US' ORDER BY old_score DESC, id LIMIT 100")
def _(domains):
    return q.list_infra(domains.withColumn("risk_score", F.col("old_score")), True, "US").select("id")


@query("q25_list_breach_posts", inputs="posts", oracle="SELECT post_id FROM {posts} WHERE country = 'RU' ORDER BY records DESC, post_id LIMIT 100")
def _(posts):
    return q.list_breach_posts(posts.withColumn("score", F.col("records").cast("double")), country="RU").select("post_id")


@query("q25_list_narratives", inputs="posts", oracle="SELECT post_id AS story FROM {posts} WHERE sector = 'Energy' AND records >= 100000 ORDER BY records DESC, post_id LIMIT 50")
def _(posts):
    return q.list_narratives(posts.select(F.col("post_id").alias("story"), F.col("sector").alias("divergence"), F.col("records").cast("double").alias("score")), "Energy", 100_000).select("story")


@query("q25_list_legal", inputs="posts", oracle="SELECT post_id AS id FROM {posts} WHERE sector IS NOT NULL AND contains(lower(victim), 'rosneft') ORDER BY ts DESC, post_id LIMIT 100")
def _(posts):
    legal = posts.select(F.col("post_id").alias("id"), F.lit("doj").alias("source"), F.lit("docket").alias("event_type"), F.col("sector").alias("matched_entity"), F.col("victim").alias("title"), "ts")
    return q.list_legal(legal, "doj", "docket", True, "Rosneft").select("id")


@query("q25_list_psc", inputs="psc vessels", oracle="""
    WITH p AS (SELECT *, CAST(substr(ship_name, 6) AS BIGINT) AS vessel_id FROM {psc} WHERE event_type = 'detention' AND source = 'paris_mou' AND contains(lower(ship_name), 'ship 1') ORDER BY event_date DESC, id LIMIT 100) SELECT p.id, v.mmsi FROM p LEFT JOIN {vessels} v ON v.id = vessel_id""")
def _(psc, vessels):
    return q.list_psc(psc.withColumn("vessel_id", F.substring("ship_name", 6, 10).cast("long")), vessels, "detention", "paris_mou", text="ship 1").select("id", "mmsi")


@query("q25_psc_by_imo", inputs="psc", oracle="SELECT id FROM {psc} WHERE imo = '9000042'")
def _(psc):
    return q.psc_by_imo(psc, "9000042").select("id")


@query("q26_list_correlations", inputs="signals", oracle=f"WITH {KEYS} SELECT ar AS a_ref, br AS b_ref FROM pp ORDER BY score DESC, ar, br LIMIT 100")
def _(signals):
    return q.list_correlations(fusion.score_pairs(keyed(signals), RULES, best=100), None, 0.3).select("a_ref", "b_ref")


@query("q26_list_composite_alerts", inputs="signals", oracle=f"""
    WITH RECURSIVE {KEYS}, {CLUSTERS} SELECT anchor, confidence FROM (SELECT concat('entity:', ke) AS anchor, rk, {r4('round(least(1.0, mean * (1 + 0.1 * (nd - 3))), 3)', 'confidence')}, CASE WHEN nd >= 4 AND rk < 3 THEN rk + 1 ELSE rk END AS r,
      substr(sha1(concat('entity:', ke, '|', strftime(ws, '%Y-%m-%d'))), 1, 40) AS fingerprint, domains FROM fa JOIN ms USING (cluster)) WHERE r = 3 AND contains(domains, 'market') AND confidence >= 0.5 ORDER BY r DESC, confidence DESC, fingerprint LIMIT 50""")
def _(signals):
    return q.list_composites(fusion.composite_alerts(keyed(signals), RULES), "critical", "market", 0.5).select("anchor", "confidence")


@query("q26_list_composites", inputs="signals", oracle="SELECT id, severity FROM {signals} WHERE severity = 'critical' AND domain = 'legal' ORDER BY id % 100 DESC, substr(sha1(CAST(id AS STRING)), 1, 40) LIMIT 50")
def _(signals):
    alerts = signals.select("id", "severity", F.array("domain").alias("domains"), ((F.col("id") % 100) / 100).alias("confidence"), F.sha1(F.col("id").cast("string").cast("binary")).alias("fingerprint"))
    return q.list_composites(alerts, "critical", "legal").select("id", "severity")


@query("q27_global_search", inputs="vessels listings companies", oracle="""
    SELECT * FROM (SELECT 'vessel' AS kind, CAST(id AS STRING) AS id, name AS title FROM {vessels} WHERE contains(lower(name), '12') OR contains(mmsi, '12') ORDER BY 3, 2 LIMIT 8) UNION ALL SELECT * FROM (SELECT 'listing', CAST(id AS STRING), name FROM {listings} WHERE contains(lower(name), '12') ORDER BY 3, 2 LIMIT 8)
    UNION ALL SELECT * FROM (SELECT 'company', CAST(id AS STRING), name FROM {companies} WHERE contains(lower(name), '12') ORDER BY 3, 2 LIMIT 8)""")
def _(vessels, listings, companies):
    return q.global_search({"vessel": (vessels, "id", ["name", "mmsi"], "name"), "listing": (listings, "id", ["name"], "name"), "company": (companies, "id", ["name"], "name")}, "12")


@query("q28_entity_dossier", inputs="listings breaches companies wallet_labels transfers", oracle="""
    WITH w AS (SELECT chain, address FROM {wallet_labels} WHERE length(label) % 3 = 0 AND address LIKE 'W%' AND CAST(substr(address, 2) AS BIGINT) % 40 = 8) SELECT 'listing' AS section, source_id AS id, name AS text FROM {listings} WHERE id = 8 UNION ALL SELECT 'same_name', CAST(id AS STRING), authority FROM {listings} WHERE id <> 8 AND name_normalized = (SELECT name_normalized FROM {listings} WHERE id = 8)
    UNION ALL SELECT 'breach', CAST(id AS STRING), listed FROM {breaches} WHERE entity_id = 8 UNION ALL SELECT 'company', CAST(id AS STRING), name FROM {companies} WHERE entity_id = 8 UNION ALL SELECT 'wallet', address, chain FROM w
    UNION ALL SELECT DISTINCT 'transfer', tx_hash, 'p' FROM {transfers} t WHERE (chain, src) IN (SELECT chain, address FROM w) OR (chain, dst) IN (SELECT chain, address FROM w)""")
def _(listings, breaches, companies, labels, transfers):
    wallets = labels.where("length(label) % 3 = 0 AND address LIKE 'W%'").select("chain", "address", (F.substring("address", 2, 20).cast("long") % 40).alias("entity_id"), F.lit(0.5).alias("risk_score"))
    tables = {"listings": listings, "breaches": breaches, "companies": companies, "wallets": wallets, "transfers": transfers.withColumn("pattern", F.lit("p"))}
    return q.entity_dossier(tables, 8).select("section", "id", "text")


@query("q29_vessel_dossier", inputs="vessels breaches evasion port_calls positions sts psc", oracle="""
    SELECT 'vessel' AS section, '12' AS id, name AS text FROM {vessels} WHERE id = 12 UNION ALL SELECT * FROM (SELECT 'breaches', CAST(id AS STRING), listed FROM {breaches} WHERE vessel_id = 12 ORDER BY ts DESC, CAST(id AS STRING) LIMIT 30) UNION ALL SELECT * FROM (SELECT 'evasion', CAST(id AS STRING), event_type FROM {evasion} WHERE vessel_id = 12 ORDER BY ts DESC, CAST(id AS STRING) LIMIT 30)
    UNION ALL SELECT * FROM (SELECT 'port_calls', CAST(id AS STRING), port FROM {port_calls} WHERE vessel_id = 12 ORDER BY arrival DESC, CAST(id AS STRING) LIMIT 30) UNION ALL SELECT * FROM (SELECT 'psc', CAST(p.id AS STRING), event_type FROM {psc} p WHERE imo = (SELECT imo FROM {vessels} WHERE id = 12) ORDER BY event_date DESC, CAST(p.id AS STRING) LIMIT 30)""")
def _(vessels, breaches, evasion, calls, positions, sts, psc):
    return q.vessel_dossier({"vessels": vessels, "breaches": breaches, "evasion": evasion, "port_calls": calls, "psc": psc}, "210000012", 30).select("section", "id", "text")


@query("q30_watch_counts", inputs="watch_items evasion", oracle=f"""
    SELECT w.id, count(e.id) AS hits_total, count(e.id) FILTER (e.ts >= {AS_OF_SQL} - INTERVAL 168 HOUR) AS hits_7d FROM {{watch_items}} w LEFT JOIN {{evasion}} e ON e.vessel_id = w.id GROUP BY 1""")
def _(items, evasion):
    hits = evasion.select(F.col("vessel_id").alias("item_id"), F.col("id").alias("record_id"), "ts", "severity")
    return q.watch_items_with_counts(items, hits, AS_OF).select("id", "hits_total", "hits_7d")


@query("q30_list_hits", inputs="watch_items evasion", oracle="WITH h AS (SELECT vessel_id, id, ts FROM {evasion} WHERE severity = 'critical' ORDER BY ts DESC, vessel_id, id LIMIT 200) SELECT h.id AS record_id, w.key FROM h JOIN {watch_items} w ON w.id = h.vessel_id")
def _(items, evasion):
    hits = evasion.select(F.col("vessel_id").alias("item_id"), F.col("id").alias("record_id"), "ts", "severity")
    return q.list_hits(items, hits, severity="critical").select("record_id", "key")


@query("q30_is_watched", inputs="watch_items", oracle="SELECT count(*) > 0 AS watched FROM {watch_items} WHERE kind = 'vessel' AND key = '210000007'")
def _(items):
    return q.is_watched(items, "vessel", "210000007")


@query("q31_vessel_screen", inputs="fleet listings", oracle=f"""
    SELECT vessel_id, {r4('max(confidence)', 'confidence')}, count(*) AS matches, CASE WHEN max(confidence) >= 0.9 THEN 'Alert' WHEN max(confidence) >= 0.6 THEN 'Review' ELSE 'Monitor' END AS recommendation FROM ({ORACLES['j05_screen_vessels']}) GROUP BY vessel_id""")
def _(fleet, listings):
    from intel_spark.operators.names import screen_vessels
    return q.vessel_screen(screen_vessels(fleet, listings))


@query("q33_registry_search", inputs="companies listings", oracle="""
    SELECT concat('X', CAST(id AS STRING)) AS lei, name, CAST(NULL AS BIGINT) AS company_id, 0 AS screening_hits FROM {companies} WHERE contains(lower(name), 'rosneft') ORDER BY length(name), name, lei LIMIT 15""")
def _(companies, listings):
    registry = companies.select(F.concat(F.lit("X"), F.col("id").cast("string")).alias("lei"), "name", "country")
    return q.registry_search(registry, companies, listings, "Rosneft").drop("country")


@query("g22_status_counts", inputs="vessels breaches positions raw_alerts", oracle=f"""
    SELECT 'vessels_tracked' AS metric, count(*) AS value FROM {{vessels}} UNION ALL SELECT 'vessels_active_1h', count(*) FILTER (last_ais_update >= {AS_OF_SQL} - INTERVAL 1 HOUR) FROM {{vessels}} UNION ALL SELECT 'open_breaches', count(*) FROM {{breaches}} WHERE status = 'flagged' UNION ALL SELECT 'positions_stored', count(*) FROM {{positions}} UNION ALL SELECT 'open_alerts', count(*) FROM {{raw_alerts}} WHERE alert_id % 2 = 0""")
def _(vessels, breaches, positions, alerts):
    return q.status_counts(vessels, breaches, positions, alerts.withColumn("acknowledged", F.col("alert_id") % 2 == 1), AS_OF)


START, END = datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 25, tzinfo=timezone.utc)
BETWEEN = "BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"


@query("g20_maritime_brief", inputs="vessels breaches evasion sts port_calls", oracle=f"""
    WITH e AS (SELECT * FROM {{evasion}} WHERE ts {BETWEEN}) SELECT 'summary' AS section, 'vessels_tracked' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {{vessels}} UNION ALL SELECT 'summary', 'vessels_active_24h', count(*) FROM {{vessels}} WHERE last_ais_update >= TIMESTAMP '2024-01-24' UNION ALL SELECT 'summary', 'evasion_indicators', count(*) FROM e
    UNION ALL SELECT 'evasion', concat('type:', event_type), count(*) FROM e GROUP BY 2 UNION ALL SELECT 'recommendations', 'task_imagery_on_gaps', count(*) FROM e WHERE event_type = 'ais_gap' AND severity IN ('high', 'critical') UNION ALL SELECT 'recommendations', 'rescreen_renamed', count(*) FROM e WHERE event_type IN ('name_change', 'flag_change')
    UNION ALL SELECT unnest(['summary', 'summary', 'summary', 'recommendations', 'recommendations', 'recommendations', 'recommendations']), unnest(['sanctions_matches', 'sts_candidates', 'high_risk_port_calls', 'escalate_identity_matches', 'work_review_queue', 'cross_check_rendezvous', 'review_ownership_of_callers']), 0""")
def _(vessels, breaches, evasion, sts, calls):
    return b.maritime_brief({"vessels": vessels, "breaches": breaches, "evasion": evasion, "sts": sts, "port_calls": calls}, START, END)


@query("g20_market_brief", inputs="raw_alerts", oracle=f"""
    WITH a AS (SELECT * FROM {{raw_alerts}} WHERE ts {BETWEEN}) SELECT 'summary' AS section, 'alerts' AS metric, CAST(count(*) AS DOUBLE) AS value FROM a UNION ALL SELECT 'alerts', concat('type:', alert_type), count(*) FROM a GROUP BY 2 UNION ALL SELECT 'alerts', concat('severity:', severity), count(*) FROM a GROUP BY 2""")
def _(alerts):
    return b.market_brief(alerts, None, START, END)


@query("g20_sanctions_brief", inputs="listings list_updates", oracle="""
    WITH u AS (SELECT * FROM {list_updates} WHERE ts BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1998-01-01') SELECT 'summary' AS section, 'updates' AS metric, CAST(count(*) AS DOUBLE) AS value FROM u UNION ALL SELECT 'listings', concat('active:', authority), count(*) FROM {listings} WHERE is_active GROUP BY 2
    UNION ALL SELECT 'listings', concat('vessels:', authority), count(*) FROM {listings} WHERE is_active AND entity_type = 'vessel' GROUP BY 2 UNION ALL SELECT 'updates', concat('change:', authority, ':', update_type), count(*) FROM u GROUP BY 2""")
def _(listings, updates):
    return b.sanctions_brief(listings, updates, datetime(1997, 1, 1, tzinfo=timezone.utc), datetime(1998, 1, 1, tzinfo=timezone.utc))


@query("g20_cross_domain_brief", inputs="signals", oracle=f"""
    WITH RECURSIVE {KEYS}, {CLUSTERS}, r AS (SELECT * FROM {{signals}} WHERE ts {BETWEEN}), al AS (SELECT ['low', 'medium', 'high', 'critical'][CASE WHEN nd >= 4 AND rk < 3 THEN rk + 2 ELSE rk + 1 END] AS severity FROM fa) SELECT 'summary' AS section, 'signals' AS metric, CAST(count(*) AS DOUBLE) AS value FROM r UNION ALL SELECT 'signals', concat('domain:', domain), count(*) FROM r GROUP BY 2 UNION ALL SELECT 'signals', concat('severity:', severity), count(*) FROM r GROUP BY 2
    UNION ALL SELECT 'summary', 'correlations', count(*) FROM pp UNION ALL SELECT 'correlations', concat('type:', least(ad, bd), '_', greatest(ad, bd)), count(*) FROM pp GROUP BY 2 UNION ALL SELECT 'summary', 'composite_alerts', count(*) FROM al UNION ALL SELECT 'composite_alerts', concat('severity:', severity), count(*) FROM al GROUP BY 2""")
def _(signals):
    s = keyed(signals)
    return b.cross_domain_brief(s, signal_links(s, RULES, apart=True), fusion.composite_alerts(s, RULES), START, END)


@query("g20_daily_digest", inputs="vessels breaches evasion sts port_calls list_updates", oracle="""
    SELECT 'maritime' AS section, 'vessels_active' AS metric, CAST(count(*) AS DOUBLE) AS value FROM {vessels} WHERE last_ais_update BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30' UNION ALL SELECT 'evasion', concat('type:', event_type), count(*) FROM {evasion} WHERE ts BETWEEN TIMESTAMP '2024-01-29' AND TIMESTAMP '2024-01-30' GROUP BY 2
    UNION ALL SELECT 'maritime', unnest(['new_matches', 'sts_candidates', 'sanctioned_calls']), 0""")
def _(vessels, breaches, evasion, sts, calls, updates):
    return b.daily_digest({"vessels": vessels, "breaches": breaches, "evasion": evasion, "sts": sts, "port_calls": calls, "list_updates": updates}, datetime(2024, 1, 30, tzinfo=timezone.utc))
