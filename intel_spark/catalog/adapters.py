"""Inputs for the registered queries, projected from the given tables.

Each adapter is one SELECT whose text means the same in Spark SQL and in ANSI SQL, so that a query and its oracle start
from identical rows. ``{name}`` refers to another adapter.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations", "benchmark"]

ADAPTERS: dict[str, str] = {
    # hourly candles: asset = event type, exchange = one of three venues
    "candles": """SELECT event_type AS asset, concat('x', CAST(user_id % 3 AS STRING)) AS exchange, '1h' AS timeframe, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS ts,
        min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, sum(value) AS volume, sum(value) * max_by(value, event_id) AS volume_usd
        FROM events GROUP BY event_type, user_id % 3, date_trunc('hour', ts)""",
    # liquidation orders: side alternates, price moves with the event
    "liquidations": """SELECT event_id, event_type AS asset, concat('x', CAST(user_id % 3 AS STRING)) AS exchange, CASE WHEN event_id % 2 = 0 THEN 'sell' ELSE 'buy' END AS side,
        100 + event_id % 17 AS price, value * 1000 AS usd, CAST(ts AS TIMESTAMP) AS ts FROM events""",
    "external_events": """SELECT event_type AS asset, CAST(ts AS TIMESTAMP) AS ts, concat('price anomaly ', CAST(event_id AS STRING)) AS description FROM events WHERE value > 150""",
    "fixes": """SELECT event_id, event_type AS asset, CAST(ts AS TIMESTAMP) AS ts FROM events WHERE user_id % 2 = 0""",
    "quotes": """SELECT event_type AS asset, CAST(ts AS TIMESTAMP) AS ts, value AS price FROM events WHERE user_id % 2 = 1""",
    "raw_alerts": """SELECT event_id AS alert_id, event_type AS asset, concat('x', CAST(user_id % 3 AS STRING)) AS exchange, 'price_anomaly' AS alert_type, CAST(ts AS TIMESTAMP) AS ts,
        CASE WHEN value > 200 THEN 'critical' WHEN value > 120 THEN 'high' WHEN value > 60 THEN 'medium' ELSE 'low' END AS severity FROM events""",
    # vessel fixes: one vessel per user, wandering inside a box of a few degrees
    "positions": """SELECT event_id AS id, concat('21', lpad(CAST(user_id AS STRING), 7, '0')) AS mmsi, user_id AS vessel_id, CAST(ts AS TIMESTAMP) AS ts,
        55 + (user_id % 10) * 5e-1 + ((event_id * 37) % 100) / 199e0 AS lat, 10 + (user_id % 12) * 5e-1 + ((event_id * 53) % 100) / 199e0 AS lon,
        CASE WHEN event_id % 3 = 0 THEN 5e-1 WHEN event_id % 7 = 1 THEN CAST(NULL AS DOUBLE) ELSE value % 40 END AS speed, CAST(event_id % 360 AS DOUBLE) AS heading, CAST(event_id % 361 AS DOUBLE) AS course,
        CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('SHIP ', CAST(user_id AS STRING), CASE WHEN event_id % 11 = 1 THEN ' II' WHEN event_id % 11 = 2 THEN ' 2' WHEN event_id % 13 = 7 THEN ' STAR' WHEN event_id % 29 = 5 THEN ' MOON' ELSE '' END) END AS name,
        CASE WHEN event_id % 4 = 0 THEN concat('90000', lpad(CAST(user_id % 60 AS STRING), 2, '0')) END AS imo,
        CASE WHEN event_id % 23 = 3 THEN 'IR' WHEN event_id % 19 = 1 THEN 'XX' WHEN user_id % 3 = 0 THEN 'PA' WHEN user_id % 3 = 1 THEN 'LR' ELSE 'GA' END AS flag,
        CASE user_id % 5 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' WHEN 2 THEN 'Crude Oil Tanker' WHEN 3 THEN 'Fishing' ELSE 'Passenger' END AS ship_type,
        CASE WHEN event_id % 6 = 0 THEN concat('CS', CAST(event_id % 7 AS STRING)) END AS call_sign, CASE WHEN event_id % 6 = 1 THEN concat('DEST ', CAST(event_id % 9 AS STRING)) END AS destination,
        CASE WHEN event_id % 3 = 2 THEN CAST(event_id % 45 AS DOUBLE) END AS draught, CASE WHEN event_id % 8 = 0 THEN CAST(100 + (user_id % 30) * 10 AS DOUBLE) END AS length_m FROM events""",
    # latest state per vessel
    "vessels": """SELECT user_id AS id, concat('21', lpad(CAST(user_id AS STRING), 7, '0')) AS mmsi, CASE WHEN user_id % 7 <> 0 THEN concat('90000', lpad(CAST(user_id % 60 AS STRING), 2, '0')) END AS imo,
        concat('SHIP ', CAST(user_id AS STRING)) AS name, CASE WHEN user_id % 3 = 0 THEN 'PA' WHEN user_id % 3 = 1 THEN 'LR' ELSE 'GA' END AS flag,
        CASE user_id % 5 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' WHEN 2 THEN 'Crude Oil Tanker' WHEN 3 THEN 'Fishing' ELSE 'Passenger' END AS ship_type,
        CASE WHEN user_id % 2 = 0 THEN 56 + (user_id % 40) * 3e-3 ELSE 55 + (user_id % 50) * 2e-2 END AS lat, CASE WHEN user_id % 2 = 0 THEN 11 + floor(user_id / 40) * 4e-3 ELSE 10 + floor(user_id / 3) * 7e-3 END AS lon,
        CASE WHEN user_id % 9 = 0 THEN 5e0 ELSE 5e-1 END AS speed, CASE WHEN user_id % 10 = 0 THEN 'moored' ELSE 'underway' END AS nav_status, CAST(100 + (user_id % 30) * 10 AS DOUBLE) AS length_m,
        CASE WHEN user_id % 8 = 0 THEN 'breach_ofac' WHEN user_id % 8 = 1 THEN 'flagged' ELSE 'clear' END AS sanctioned_status, (user_id % 10) / 10e0 AS risk_score,
        CASE WHEN user_id % 4 <> 3 THEN concat('OWNER ', CAST(user_id % 17 AS STRING)) END AS owner, concat('OPERATOR ', CAST(user_id % 23 AS STRING)) AS operator,
        CASE WHEN user_id % 6 = 0 THEN concat('HOLDER ', CAST(user_id % 5 AS STRING)) END AS beneficial_owner, CAST(max(ts) AS TIMESTAMP) AS last_ais_update FROM events GROUP BY user_id""",
    # diamonds |x - cx| + |y - cy| < r around points of a grid
    "zones": """SELECT n_name AS name, CASE n_nationkey % 4 WHEN 0 THEN 'sanctions_zone' WHEN 1 THEN 'war_zone' WHEN 2 THEN 'piracy_zone' ELSE 'sts_hub' END AS kind, concat('note ', n_name) AS context, false AS choke_point,
        10.0137e0 + (n_nationkey % 5) * 1.3e0 AS cx, 55.0071e0 + floor(n_nationkey / 5) * 1.1e0 AS cy, 45e-2 AS r FROM nation""",
    "lanes": """SELECT r_name AS name, 'lane' AS kind, '' AS context, r_regionkey % 2 = 0 AS choke_point, 11.0219e0 + r_regionkey * 9e-1 AS cx, 56.0033e0 + r_regionkey * 7e-1 AS cy, 9e-1 AS r FROM region""",
    "land": """SELECT n_nationkey AS polygon_id, 10.4137e0 + (n_nationkey % 5) * 1.3e0 AS cx, 55.5071e0 + floor(n_nationkey / 5) * 1.1e0 AS cy, 6e-1 AS r, CASE WHEN n_nationkey % 2 = 0 THEN 2e-1 ELSE 0e0 END AS hole FROM nation""",
    "ports": """SELECT concat('PORT ', CAST(n_nationkey AS STRING)) AS name, concat('C', CAST(n_nationkey % 9 AS STRING)) AS country, 55.1e0 + floor(n_nationkey / 5) * 1.05e0 AS lat, 10.2e0 + (n_nationkey % 5) * 1.25e0 AS lon,
        CAST(15 + n_nationkey AS DOUBLE) AS radius_km, CASE n_nationkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'safe' END AS risk_level, n_nationkey % 6 = 0 AS sanctioned_facility FROM nation""",
    "facilities": """SELECT CAST(n_nationkey AS BIGINT) AS id, concat('FACILITY ', CAST(n_nationkey AS STRING)) AS name, CASE n_nationkey % 4 WHEN 0 THEN 'crude_export' WHEN 1 THEN 'refinery' WHEN 2 THEN 'sts_hub' ELSE 'lng_export' END AS type,
        CASE n_nationkey % 5 WHEN 0 THEN 'RU' WHEN 1 THEN 'IR' WHEN 2 THEN 'NL' WHEN 3 THEN 'TR' ELSE 'CN' END AS country, CASE n_nationkey % 4 WHEN 3 THEN 'lng' WHEN 1 THEN 'products' ELSE 'crude' END AS commodity, n_nationkey % 3 = 0 AS sanctioned,
        55.2e0 + floor(n_nationkey / 5) * 1.0e0 AS lat, 10.3e0 + (n_nationkey % 5) * 1.1e0 AS lon, CAST(10 + n_nationkey AS DOUBLE) AS radius_km, 100000e0 + n_nationkey * 1000e0 AS capacity_bpd,
        CASE WHEN n_nationkey % 2 = 0 THEN concat('PORT ', CAST(n_nationkey AS STRING)) END AS port_name, concat('OWNER ', CAST(n_nationkey AS STRING), ' (state)') AS owner FROM nation""",
    "evasion": """SELECT event_id AS id, user_id AS vessel_id, concat('21', lpad(CAST(user_id AS STRING), 7, '0')) AS mmsi, CAST(ts AS TIMESTAMP) AS ts,
        CASE event_type WHEN 'error' THEN 'spoofing_cluster' WHEN 'click' THEN 'ais_gap' WHEN 'view' THEN 'position_anomaly' WHEN 'signup' THEN 'name_change' ELSE 'flag_change' END AS event_type,
        CASE WHEN value > 120 THEN 'critical' WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity, (event_id % 100) / 100e0 AS confidence,
        55 + ((event_id * 37) % 400) / 100e0 AS lat, 10 + ((event_id * 53) % 600) / 100e0 AS lon, concat('event ', CAST(event_id AS STRING)) AS summary FROM events""",
    "anomalies": """SELECT event_id AS id, user_id AS vessel_id, CAST(ts AS TIMESTAMP) AS ts, 15 + ((event_id * 37) % 4000) / 100e0 + 5e-3 AS lat, 10 + ((event_id * 53) % 6000) / 100e0 + 5e-3 AS lon FROM events WHERE event_type = 'error'""",
    "sts": """SELECT ((l_orderkey * 10 + l_linenumber) * 10000 + l_partkey) * 1000 + l_suppkey AS id, l_suppkey AS vessel_a, l_partkey % 150 AS vessel_b, CAST(l_shipdate AS TIMESTAMP) AS ts, l_quantity * 10 AS proximity_m, CAST(l_quantity AS INT) * 12 AS duration_min, l_discount * 10 AS confidence,
        CASE WHEN l_returnflag = 'R' THEN 'cleared' ELSE 'possible' END AS status FROM lineitem WHERE l_suppkey <> l_partkey % 150""",
    "breaches": """SELECT o_orderkey AS id, o_custkey % 150 AS vessel_id, CASE WHEN o_orderkey % 3 = 0 THEN 'OFAC' WHEN o_orderkey % 3 = 1 THEN 'EU' ELSE 'UN' END AS authority, concat('ENTITY ', CAST(o_orderkey % 40 AS STRING)) AS listed, o_orderkey % 40 AS entity_id,
        'direct_match' AS breach_type, CASE WHEN o_orderkey % 5 = 0 THEN 'name_exact' ELSE 'imo' END AS match_type, (o_orderkey % 90) / 100e0 AS confidence, CASE WHEN o_orderstatus = 'F' THEN 'cleared' WHEN o_orderstatus = 'P' THEN 'review' ELSE 'flagged' END AS status,
        CASE WHEN o_orderkey % 4 = 0 THEN 'critical' WHEN o_orderkey % 4 = 1 THEN 'high' ELSE 'medium' END AS severity, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders""",
    "port_calls": """SELECT o_orderkey AS id, o_custkey % 150 AS vessel_id, concat('PORT ', CAST(o_custkey % 25 AS STRING)) AS port, concat('C', CAST(o_custkey % 9 AS STRING)) AS country, o_orderkey % 6 = 0 AS is_sanctioned,
        CASE o_custkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'safe' END AS risk_level, CAST(o_orderdate AS TIMESTAMP) AS arrival, CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS TIMESTAMP) + INTERVAL '1' HOUR * (o_orderkey % 120) END AS departure,
        5 + o_orderkey % 10 + 0e0 AS draught_arr, 5 + (o_orderkey * 7) % 13 + 0e0 AS draught_dep, CAST(o_custkey % 25 AS BIGINT) AS facility_id FROM orders""",
    "psc": """SELECT o_orderkey AS id, concat('90000', lpad(CAST(o_custkey % 90 AS STRING), 2, '0')) AS imo, CASE WHEN o_orderkey % 17 = 0 THEN 'ban' ELSE 'detention' END AS event_type, CAST(o_orderdate AS TIMESTAMP) AS event_date,
        concat('SHIP ', CAST(o_custkey % 150 AS STRING)) AS ship_name, CASE WHEN o_orderkey % 2 = 0 THEN 'Oil Tanker' ELSE 'Bulk carrier' END AS ship_type, CASE WHEN o_orderkey % 3 = 0 THEN 'tokyo_mou' ELSE 'paris_mou' END AS source, concat('S', CAST(o_orderkey AS STRING)) AS source_id, concat('C', CAST(o_custkey % 9 AS STRING)) AS port_country FROM orders""",
    # sanctions listings: part names with type and size, near-duplicates by construction
    "listings": """SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'OFAC' WHEN 1 THEN 'EU' ELSE 'UN' END AS authority, concat('L', CAST(p_partkey AS STRING)) AS source_id, concat(p_name, ' ', p_type, ' ', CAST(p_size AS STRING)) AS name,
        upper(concat(p_name, ' ', p_type, ' ', CAST(p_size AS STRING))) AS name_normalized, CASE p_partkey % 4 WHEN 0 THEN 'vessel' WHEN 1 THEN 'company' WHEN 2 THEN 'person' ELSE 'vessel' END AS entity_type,
        CASE p_partkey % 6 WHEN 0 THEN 'IR' WHEN 1 THEN 'RU' WHEN 2 THEN 'PA' WHEN 3 THEN 'LR' ELSE 'CY' END AS country, split(concat('PROG', CAST(p_partkey % 7 AS STRING), ';', 'LIST', CAST(p_size % 4 AS STRING)), ';') AS programs,
        split(concat(p_name, ' alias ', CAST(p_partkey % 50 AS STRING), ';', p_brand), ';') AS aliases, CASE WHEN p_partkey % 5 = 0 THEN concat('90', lpad(CAST(p_partkey AS STRING), 5, '0')) END AS imo, CASE WHEN p_partkey % 11 = 0 THEN concat('21', lpad(CAST(p_partkey AS STRING), 7, '0')) END AS mmsi,
        CASE WHEN p_partkey % 3 = 0 THEN 'PA' WHEN p_partkey % 3 = 1 THEN 'LR' END AS vessel_flag, CASE WHEN p_partkey % 2 = 0 THEN 'Crude tanker' ELSE 'Bulk carrier' END AS vessel_type, CASE WHEN p_partkey % 9 = 0 THEN concat(p_name, ' OWNERS ', CAST(p_size AS STRING)) END AS vessel_owner,
        p_partkey % 10 <> 9 AS is_active, CAST(DATE '2020-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * (p_partkey % 900) AS designation_date,
        concat('Vessel Registration Identification IMO 90', lpad(CAST(p_partkey AS STRING), 5, '0'), '; Website www.site', CAST(p_partkey % 300 AS STRING), '.example.com; Digital Currency Address - XBT bc1qaddressnumber', lpad(CAST(p_partkey % 400 AS STRING), 8, '0'),
          '; alt. Digital Currency Address - ETH 0xABCDEF', lpad(CAST(p_partkey % 700 AS STRING), 34, '0'), '; Aircraft Tail Number EP-', CAST(p_partkey AS STRING), '; Aircraft Model B7', CAST(p_size AS STRING), ';') AS remarks FROM part""",
    # vessels to screen: the same names with spelling changes
    "fleet": """SELECT p_partkey AS id, concat('21', lpad(CAST(p_partkey AS STRING), 7, '0')) AS mmsi, CASE WHEN p_partkey % 4 <> 1 THEN concat('90', lpad(CAST(p_partkey + p_partkey % 2 AS STRING), 5, '0')) END AS imo,
        concat(CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'a') ELSE p_name END, ' ', p_type, ' ', CAST(p_size + p_partkey % 2 AS STRING)) AS name, CASE p_partkey % 4 WHEN 0 THEN 'PA' WHEN 1 THEN 'IR' WHEN 2 THEN 'LR' ELSE 'MT' END AS flag,
        CASE p_partkey % 3 WHEN 0 THEN 'Tanker' WHEN 1 THEN 'Cargo' ELSE 'Fishing' END AS ship_type, CASE WHEN p_partkey % 2 = 0 THEN concat(p_name, ' ', p_type, ' ', CAST(p_size + 1 AS STRING)) END AS owner,
        concat(p_name, ' alias ', CAST(p_partkey % 60 AS STRING)) AS operator, CASE WHEN p_partkey % 5 = 0 THEN concat(p_name, ' OWNERS ', CAST(p_size AS STRING)) END AS beneficial_owner FROM part""",
    "companies": """SELECT s_suppkey AS id, concat(CASE s_suppkey % 4 WHEN 0 THEN 'ROSNEFT' WHEN 1 THEN 'OCEAN STAR' WHEN 2 THEN 'BALTIC FREIGHT' ELSE 'MERIDIAN' END, ' UNIT ', CAST(s_suppkey AS STRING), CASE s_suppkey % 3 WHEN 0 THEN ' LTD' WHEN 1 THEN ' TRADING S.A.' ELSE ' SHIPPING GMBH' END) AS name,
        concat('LEI', CAST(s_suppkey % 80 AS STRING)) AS lei, CASE s_suppkey % 6 WHEN 0 THEN 'PA' WHEN 1 THEN 'RU' WHEN 2 THEN 'DE' WHEN 3 THEN 'VG' WHEN 4 THEN 'CY' ELSE 'US' END AS country, CASE s_suppkey % 5 WHEN 0 THEN 'LAPSED' WHEN 1 THEN 'RETIRED' ELSE 'ISSUED' END AS registration_status,
        CASE WHEN s_suppkey % 9 = 0 THEN 'INACTIVE' ELSE 'ACTIVE' END AS entity_status, CAST(DATE '2023-01-01' AS TIMESTAMP) + INTERVAL '1' DAY * (s_suppkey % 600) AS creation_date, CASE s_suppkey % 7 WHEN 0 THEN 'NO_KNOWN_PERSON' WHEN 1 THEN 'NATURAL_PERSONS' WHEN 2 THEN 'NON_PUBLIC' END AS parent_exception,
        CAST(s_suppkey % 3 AS INT) AS children_count, s_suppkey % 8 = 0 AS listed, CASE WHEN s_suppkey % 8 = 0 THEN CASE WHEN s_suppkey % 16 = 0 THEN 'direct' ELSE 'vessel_owner' END END AS match_type, CASE WHEN s_suppkey % 8 = 0 THEN CASE WHEN s_suppkey % 16 = 0 THEN 1e0 ELSE 9e-1 END END AS confidence, s_suppkey % 50 AS entity_id FROM supplier""",
    "ownership": """SELECT s_suppkey AS child, CAST(floor(s_suppkey / 3) AS BIGINT) AS parent, 'direct' AS kind FROM supplier WHERE s_suppkey > 0 AND s_suppkey % 10 <> 7 UNION ALL SELECT s_suppkey, s_suppkey % 5, 'ultimate' FROM supplier WHERE s_suppkey >= 5 AND s_suppkey % 4 = 1""",
    "transfers": """SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'ethereum' ELSE 'bitcoin' END AS chain, concat('T', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING), '-', CAST(l_partkey AS STRING), '-', CAST(l_suppkey AS STRING)) AS tx_hash, CAST(l_shipdate AS TIMESTAMP) AS ts,
        concat('W', CAST(l_suppkey AS STRING)) AS src, concat('P', CAST(l_partkey AS STRING)) AS dst, l_extendedprice AS usd, 'USDT' AS token FROM lineitem""",
    "wallet_labels": """SELECT 'bitcoin' AS chain, concat('W', CAST(s_suppkey AS STRING)) AS address, CASE s_suppkey % 7 WHEN 0 THEN 'sanctioned' WHEN 1 THEN 'exchange' WHEN 2 THEN 'mixer' ELSE 'service' END AS wallet_type, s_name AS label, CASE WHEN s_suppkey % 2 = 0 THEN concat('HOLDER ', s_name) END AS owner FROM supplier
        UNION ALL SELECT 'bitcoin', concat('P', CAST(p_partkey AS STRING)), CASE p_partkey % 9 WHEN 0 THEN 'exchange' WHEN 1 THEN 'sanctioned' WHEN 2 THEN 'mixer' ELSE 'service' END, p_name, CAST(NULL AS STRING) FROM part""",
    # every line spends; wallets repeat only among neighbouring orders, so clusters stay local
    "spend_inputs": """SELECT 'bitcoin' AS chain, concat('O', CAST(l_orderkey AS STRING)) AS tx_hash, concat('A', CAST(l_partkey % 300 AS STRING), '-', CAST(CAST(floor(l_orderkey / 40) AS BIGINT) AS STRING)) AS address FROM lineitem""",
    # page titles, whole
    "headlines": """SELECT page_id AS item_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, split_part(url, '/', 3) AS outlet, regexp_extract(html, 'lang="([a-z]*)"', 1) AS lang, CAST(TIMESTAMP '2024-01-01 00:00:00' AS TIMESTAMP) + INTERVAL '1' MINUTE * (page_id % 40000) AS ts FROM pages""",
    "coded_events": """SELECT CAST(event_id AS STRING) AS id, CAST(ts AS TIMESTAMP) AS date, CAST(ts AS TIMESTAMP) AS added, lpad(CAST(10 + event_id % 11 AS STRING), 2, '0') AS root_code, CASE event_id % 9 WHEN 0 THEN '163' WHEN 1 THEN '172' WHEN 2 THEN '191' WHEN 3 THEN '145' ELSE concat(CAST(10 + event_id % 11 AS STRING), '0') END AS base_code,
        (user_id % 21) - 10e0 AS goldstein, CAST(floor(value) AS INT) AS mentions, CAST(1 + event_id % 7 AS INT) AS sources, 'actor one' AS actor1, CASE event_id % 5 WHEN 0 THEN 'RU' WHEN 1 THEN 'US' WHEN 2 THEN 'BR' END AS actor1_country, 'other party' AS actor2, CASE event_id % 4 WHEN 0 THEN 'IR' WHEN 1 THEN 'FR' END AS actor2_country,
        CASE event_id % 3 WHEN 0 THEN 'Tehran' WHEN 1 THEN '*' END AS location, CASE event_id % 6 WHEN 0 THEN 'RU' WHEN 1 THEN 'BR' WHEN 2 THEN 'CL' WHEN 3 THEN 'UA' WHEN 4 THEN 'PE' END AS country, 1e0 AS lat, 2e0 AS lon,
        concat('https://', CASE WHEN event_id % 17 = 0 THEN 'prnewswire' ELSE 'site' END, '.example.com/world/2024/', CASE event_id % 8 WHEN 0 THEN 'tanker-seized-near-hormuz-by-iranian-forces' WHEN 1 THEN 'missile-strike-hits-oil-refinery-pipeline' WHEN 2 THEN 'celebrity-couple-fights-over-custody' WHEN 3 THEN 'new-sanctions-hit-russian-shipping-fleet' WHEN 4 THEN 'port-of-odesa-closed-after-attack' WHEN 5 THEN '12345678-short' WHEN 6 THEN 'parliament-election-protest-in-france' ELSE 'index' END, '.html?x=1') AS url FROM events""",
    "geo_events": """SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS ts, CASE event_id % 5 WHEN 0 THEN 'sanctions' WHEN 1 THEN 'maritime_incident' WHEN 2 THEN 'conflict' WHEN 3 THEN 'port_closure' ELSE 'political' END AS event_type, concat('title ', CAST(event_id AS STRING)) AS title,
        CASE WHEN event_id % 4 = 0 THEN 'critical' WHEN event_id % 4 = 1 THEN 'high' WHEN event_id % 4 = 2 THEN 'medium' ELSE 'low' END AS severity, CASE event_id % 7 WHEN 0 THEN 'RU' WHEN 1 THEN 'IR' WHEN 2 THEN 'CN' WHEN 3 THEN 'PA' WHEN 4 THEN 'LR' WHEN 5 THEN 'US' END AS country, CASE WHEN event_id % 11 = 0 THEN 'UA' END AS country_secondary,
        split(CASE event_id % 3 WHEN 0 THEN 'energy;shipping' WHEN 1 THEN 'finance' ELSE 'shipping' END, ';') AS sectors, split(CASE event_id % 7 WHEN 0 THEN 'RU;UA' WHEN 1 THEN 'IR' WHEN 2 THEN 'CN;TW' WHEN 3 THEN 'PA' WHEN 4 THEN 'LR' WHEN 5 THEN 'US' ELSE 'XX' END, ';') AS countries,
        CASE WHEN event_id % 2 = 0 THEN 'coded_events' ELSE 'wire' END AS source, concat('S', CAST(event_id % 5000 AS STRING)) AS source_id, concat('http://e.example.com/', CAST(event_id % 3000 AS STRING)) AS url, CAST(floor(value) AS INT) AS mentions FROM events""",
    "geo_signals": """SELECT CASE event_type WHEN 'error' THEN 'evasion_event' WHEN 'click' THEN 'sanctions_breach' WHEN 'view' THEN 'transshipment' WHEN 'signup' THEN 'market_alert' ELSE 'sanctions_update' END AS kind, event_id AS id, CAST(ts AS TIMESTAMP) AS ts,
        CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'energy' ELSE 'finance' END WHEN 'purchase' THEN 'finance' ELSE 'shipping' END AS sector, split(CASE user_id % 4 WHEN 0 THEN 'RU' WHEN 1 THEN 'PA' WHEN 2 THEN 'LR' ELSE 'IR' END, ';') AS countries FROM events""",
    "posts": """SELECT o_orderkey AS post_id, concat(CASE o_custkey % 5 WHEN 0 THEN 'Rosneft Unit ' WHEN 1 THEN 'Ocean Star Unit ' WHEN 2 THEN 'City Hospital ' WHEN 3 THEN 'Plain Store ' ELSE 'Meridian Unit ' END, CAST(o_custkey % 120 AS STRING), ' Ltd') AS victim, concat('d', CAST(o_custkey AS STRING), '.example.com') AS domain,
        CASE o_custkey % 4 WHEN 0 THEN 'RU' WHEN 1 THEN 'DE' WHEN 2 THEN 'PA' END AS country, CASE o_custkey % 6 WHEN 0 THEN 'Energy' WHEN 1 THEN 'Banking' WHEN 2 THEN 'Retail' END AS sector, CAST(floor(o_totalprice) * 100 AS BIGINT) AS records, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders""",
    "domains": """SELECT c_custkey AS id, concat('d', CAST(c_custkey AS STRING), '.example.com') AS domain, c_custkey % 2 = 0 AS entity_linked, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_live, CASE c_nationkey % 6 WHEN 0 THEN 'RU' WHEN 1 THEN 'US' WHEN 2 THEN 'VG' WHEN 3 THEN 'NL' END AS hosting_country,
        CAST(c_custkey % 40 AS INT) AS certificate_count, split(concat('ns1.', CASE WHEN c_custkey % 5 = 0 THEN 'cloudflare' ELSE 'host' END, '.com;ns2.example.com'), ';') AS nameservers, CASE WHEN c_custkey % 4 <> 0 THEN concat('REG ', CAST(c_custkey % 9 AS STRING)) END AS registrar, c_name AS entity_name, c_acctbal / 10000 AS old_score FROM customer""",
    "domain_checks": """SELECT concat('d', CAST(user_id AS STRING), '.example.com') AS domain, CAST(ts AS TIMESTAMP) AS ts, event_type <> 'error' AS is_live, (event_id % 90) / 100e0 AS risk_score FROM events""",
    "sightings": """SELECT event_id AS id, concat('EP-', CAST(user_id AS STRING)) AS registration, CAST(ts AS TIMESTAMP) AS ts, CASE event_type WHEN 'error' THEN 'adsb' WHEN 'click' THEN 'opensky' ELSE 'adsb' END AS source, CASE WHEN event_id % 5 = 0 THEN CAST(NULL AS STRING) ELSE concat('CS', CAST(event_id % 3 AS STRING)) END AS callsign FROM events""",
    # signals of six domains over shared vessels, countries and sectors
    "signals": """SELECT CASE event_id % 6 WHEN 0 THEN 'evasion_event' WHEN 1 THEN 'blockchain_tx' WHEN 2 THEN 'dark_oil' WHEN 3 THEN 'sanctions_update' WHEN 4 THEN 'legal_event' ELSE 'market_alert' END AS type, event_id AS id,
        CASE event_id % 6 WHEN 0 THEN 'maritime' WHEN 1 THEN 'blockchain' WHEN 2 THEN 'energy' WHEN 3 THEN 'sanctions' WHEN 4 THEN 'legal' ELSE 'market' END AS domain, CAST(ts AS TIMESTAMP) AS ts,
        CASE WHEN value > 120 THEN 'critical' WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'medium' ELSE 'low' END AS severity, concat('signal ', CAST(event_id AS STRING)) AS summary,
        concat('E', CAST(CAST(floor(event_id / 5) AS BIGINT) % 1500 AS STRING)) AS k_entity, concat('C', CAST((event_id * 31) % 400 AS STRING)) AS k_country, concat('S', CAST(event_id % 3 AS STRING)) AS k_sector FROM events""",
    "list_updates": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'OFAC' WHEN 1 THEN 'EU' ELSE 'UN' END AS authority, CASE o_orderkey % 4 WHEN 0 THEN 'new_designation' WHEN 1 THEN 'delisting' WHEN 2 THEN 'relisted' ELSE 'name_change' END AS update_type, concat('ENTITY ', CAST(o_custkey AS STRING)) AS entity, o_custkey AS entity_id, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders""",
    # two editions of a list: keys, renames, reprogramming and returns decided by the key
    "list_old": """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'EU' ELSE 'OFAC' END AS authority, concat('K', CAST(c_custkey AS STRING)) AS source_id, concat('ENTITY ', CAST(c_custkey AS STRING)) AS name, 'company' AS entity_type, split(concat('P', CAST(c_nationkey % 3 AS STRING), ';Q'), ';') AS programs,
        CASE WHEN c_custkey % 3 = 0 THEN concat('9', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS imo, c_custkey % 13 <> 0 AS is_active FROM customer WHERE c_custkey % 10 <> 1""",
    "list_new": """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'EU' ELSE 'OFAC' END AS authority, concat('K', CAST(c_custkey AS STRING)) AS source_id, concat(CASE WHEN c_custkey % 17 = 0 THEN 'RENAMED ' WHEN c_custkey % 19 = 0 THEN 'entity, ' ELSE 'ENTITY ' END, CAST(c_custkey AS STRING)) AS name, 'company' AS entity_type,
        split(CASE WHEN c_custkey % 23 = 0 THEN 'Z' ELSE concat('Q;P', CAST(c_nationkey % 3 AS STRING)) END, ';') AS programs, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 29 <> 0 THEN concat('9', lpad(CAST(c_custkey AS STRING), 6, '0')) END AS imo
        FROM customer WHERE c_custkey % 7 <> 2 AND (c_custkey % 4 <> 0 OR c_custkey % 12 = 0)""",
    "texts": """SELECT doc_id, text, source, lang FROM documents""",
    "imo_texts": """SELECT concat('IMO ', CAST(1000000 + (l_partkey * 7919 + l_suppkey * 104729 + l_linenumber * 13) % 8999999 AS STRING)) AS raw FROM lineitem""",
    "slugs": """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN 'tanker seized near Hormuz by Iranian forces' WHEN 1 THEN 'missile strike hits oil refinery pipeline' WHEN 2 THEN 'North Korean couple fights in Equatorial Guinea' WHEN 3 THEN 'new sanctions hit Russian shipping fleet' WHEN 4 THEN 'port of Odesa closed after attack'
        WHEN 5 THEN 'french parliament votes' WHEN 6 THEN 'Romania and Oman talk trade' WHEN 7 THEN 'red sea blockade and nuclear lng tanker' ELSE props END AS slug FROM events""",
    "oil_candles": """SELECT 'OIL' AS asset, 'x' AS exchange, CAST(l_shipdate AS TIMESTAMP) AS ts, l_extendedprice AS close FROM lineitem""",
    "utxo_lines": """SELECT concat('O', CAST(l_orderkey AS STRING)) AS tx_hash, CAST(l_shipdate AS TIMESTAMP) AS ts, concat('W', CAST(l_suppkey AS STRING)) AS src, concat('P', CAST(l_partkey AS STRING)) AS dst, l_extendedprice AS usd FROM lineitem""",
    # two-word names taken from the benchmark prose, and single words of six letters or more
    "word_pairs": """SELECT DISTINCT concat('N', CAST(item_id AS STRING)) AS name_id, lower(concat(split_part(text, ' ', 2), ' ', split_part(text, ' ', 3))) AS name FROM benchmark WHERE regexp_replace(split_part(text, ' ', 2), '[a-z]+', '') = '' AND regexp_replace(split_part(text, ' ', 3), '[a-z]+', '') = ''""",
    "facility_words": """SELECT DISTINCT concat('F', CAST(item_id AS STRING)) AS name_id, lower(split_part(text, ' ', 4)) AS name FROM benchmark WHERE regexp_replace(split_part(text, ' ', 4), '[a-z]+', '') = '' AND length(split_part(text, ' ', 4)) >= 5""",
    "watch_items": """SELECT c_custkey AS id, CASE WHEN c_custkey % 20 = 0 THEN 'keyword' ELSE 'vessel' END AS kind, CASE WHEN c_custkey % 20 = 0 THEN substr('thereionerattionheren', CAST(1 + c_custkey % 15 AS INT), CAST(3 + c_custkey % 3 AS INT)) ELSE concat('21', lpad(CAST(c_custkey AS STRING), 7, '0')) END AS key,
        CAST(TIMESTAMP '2024-01-20 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * (c_custkey % 100) AS created_at, CASE WHEN c_custkey % 3 = 0 THEN CAST(TIMESTAMP '2024-01-24 00:00:00' AS TIMESTAMP) + INTERVAL '1' HOUR * (c_custkey % 90) END AS last_checked_at FROM customer""",
    "web_pages": """SELECT page_id, url, html FROM pages""",
    "audit": """SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'breach_detected' WHEN 1 THEN 'cleared' WHEN 2 THEN 'escalated' ELSE 'entity_check' END AS action, CAST(o_custkey % 150 AS BIGINT) AS vessel_id, CASE WHEN o_orderkey % 3 = 0 THEN 'system' ELSE 'analyst' END AS user_id, CAST(o_orderdate AS TIMESTAMP) AS ts FROM orders""",
}


def expand(name: str, seen: tuple[str, ...] = ()) -> str:
    body = ADAPTERS[name]
    return re.sub(r"\{([a-z_]+)\}", lambda m: "(" + expand(m.group(1), (*seen, name)) + ") AS " + m.group(1), body)


def load(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    """Register the given parquet tables as views; nothing is read until a query runs."""
    for table in tables or TABLES:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)


def adapter(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = expand(name)
    load(spark, sf_dir, *[t for t in TABLES if re.search(rf"\b{t}\b", sql)])
    return spark.sql(sql)


def with_adapters(sql: str) -> str:
    """Oracle SQL in which ``{name}`` stands for an adapter's rows."""
    names = list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", sql)))
    if not names:
        return sql
    body = re.sub(r"\{([a-z_]+)\}", r"in_\1", sql).strip()
    ctes = ", ".join(f"in_{n} AS MATERIALIZED ({expand(n)})" for n in names)
    if body[:5].upper() == "WITH ":
        recursive = body[5:15].upper().startswith("RECURSIVE ")
        return ("WITH RECURSIVE " if recursive else "WITH ") + ctes + ", " + (body[15:] if recursive else body[5:])
    return f"WITH {ctes} {body}"
