"""Parameterised read queries: filter, sort, page.

Filters are plain predicates on stored columns, so they reach the scan; sort with limit is a bounded top-n.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.scoring import severity_rank
from intel_spark.functions.text import normalize_name
from intel_spark.operators.maritime import flagged
from intel_spark.operators.names import screen_names

OPEN_STATUSES = ["flagged", "investigating", "escalated"]


def since(as_of: datetime, hours: float) -> Column:
    return F.lit(as_of) - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS")


def holds(col: str, text: str) -> Column:
    """Substring test ignoring case."""
    return F.contains(F.lower(F.coalesce(F.col(col), F.lit(""))), F.lit(text.lower()))


def page(df: DataFrame, order: Sequence[Column], limit: int | None = None, offset: int = 0) -> DataFrame:
    out = df.orderBy(*order)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def _apply(df: DataFrame, *conditions: Column | None) -> DataFrame:
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def _eq(col: str, value) -> Column | None:
    if value is None:
        return None
    return F.col(col).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(col) == value


def _at_least(col: str, value) -> Column | None:
    return None if value is None else F.coalesce(F.col(col), F.lit(0.0)) >= value


def _recent(col: str, as_of: datetime | None, hours: float | None) -> Column | None:
    return None if as_of is None or hours is None else (F.col(col) >= since(as_of, hours)) & (F.col(col) <= F.lit(as_of))


def _range(col: str, as_of: datetime, text: str) -> Column:
    """"24h" or "7d" before ``as_of``."""
    return F.col(col) >= since(as_of, float(text[:-1]) * (24 if text.endswith("d") else 1))


def list_alerts(alerts: DataFrame, severity=None, asset=None, alert_type=None, acknowledged=None, as_of=None, hours=None, limit=100, offset=0):
    """Q02: (page, total)"""
    rows = _apply(alerts, _eq("severity", severity), _eq("asset", asset), _eq("alert_type", alert_type), _eq("acknowledged", acknowledged), _recent("ts", as_of, hours))
    return page(rows, [F.col("ts").desc(), F.col("alert_id")], limit, offset), total(rows)


def list_coordination(events: DataFrame, asset=None, status=None, min_confidence=None, limit=100) -> DataFrame:
    """Q03"""
    return page(_apply(events, _eq("asset", asset), _eq("status", status), _at_least("confidence", min_confidence)), [F.col("ts").desc(), F.col("asset")], limit)


def vessels_in_bbox(vessels: DataFrame, south: float, west: float, north: float, east: float, risk_filter: str | None = None, as_of=None, max_age_hours=None, limit=5000) -> DataFrame:
    """Q04: ``risk_filter`` is "breach" or "flagged"; a box may cross the antimeridian."""
    lon = F.col("lon").between(west, east) if west <= east else (F.col("lon") >= west) | (F.col("lon") <= east)
    status = {None: None, "breach": F.startswith("sanctioned_status", F.lit("breach")), "flagged": (F.col("sanctioned_status") == "flagged") | F.startswith("sanctioned_status", F.lit("breach"))}[risk_filter]
    rows = _apply(vessels, F.col("lat").between(south, north), lon, status, _recent("last_ais_update", as_of, max_age_hours))
    return page(rows, [F.col("risk_score").desc_nulls_last(), F.col("id")], limit)


def vessel_table(vessels: DataFrame, q=None, flag=None, status=None, min_risk=None, sort="risk", limit=100, offset=0):
    """Q05: (page, total)"""
    text = None if not q else holds("name", q) | holds("mmsi", q) | holds("imo", q) | holds("owner", q)
    rows = _apply(vessels, text, _eq("flag", flag), _eq("sanctioned_status", status), _at_least("risk_score", min_risk))
    orders = {"risk": F.col("risk_score").desc_nulls_last(), "name": F.col("name").asc(), "updated": F.col("last_ais_update").desc_nulls_last()}
    return page(rows, [orders[sort], F.col("id")], limit, offset), total(rows)


def list_breaches(breaches: DataFrame, authority=None, severity=None, status=None, breach_type=None, min_confidence=None, limit=100, offset=0):
    """Q06: open statuses unless told otherwise."""
    rows = _apply(breaches, _eq("authority", authority), _eq("severity", severity), _eq("status", status or OPEN_STATUSES), _eq("breach_type", breach_type), _at_least("confidence", min_confidence))
    return page(rows, [F.col("ts").desc(), F.col("id")], limit, offset), total(rows)


def list_evasion(events: DataFrame, event_type=None, severity=None, as_of=None, hours=None, limit=200):
    """Q07: (page, counts by type)"""
    rows = _apply(events, _eq("event_type", event_type), _eq("severity", severity), _recent("ts", as_of, hours))
    return page(rows, [F.col("ts").desc(), F.col("id")], limit), rows.groupBy("event_type").count()


def list_sts(events: DataFrame, vessels: DataFrame, as_of: datetime, hours=72, min_confidence=0.0, limit=200) -> DataFrame:
    """Q08: the page is cut before both hulls are joined."""
    best = page(_apply(events, _recent("ts", as_of, hours), _at_least("confidence", min_confidence)), [F.col("confidence").desc(), F.col("ts").desc(), F.col("id")], limit)
    side = lambda p: vessels.select(F.col("id").alias(f"vessel_{p}"), F.col("name").alias(f"name_{p}"), F.col("mmsi").alias(f"mmsi_{p}"))
    return best.join(side("a"), "vessel_a", "left").join(side("b"), "vessel_b", "left")


def list_port_calls(calls: DataFrame, as_of: datetime, span="7d", port=None, risk=None, sanctioned=None, open_only=False, limit=200):
    """Q09: (page, counts by port and risk)"""
    rows = _apply(calls, _range("arrival", as_of, span), F.col("arrival") <= F.lit(as_of), holds("port", port) if port else None, _eq("risk_level", risk), _eq("is_sanctioned", sanctioned), F.col("departure").isNull() if open_only else None)
    return page(rows, [F.col("arrival").desc(), F.col("id")], limit), rows.groupBy("port", "risk_level").count()


def list_zone_events(events: DataFrame, vessels: DataFrame, as_of=None, hours=None, context=None, limit=200):
    """Q10: (page joined to vessels, counts by lane)"""
    rows = _apply(events, _recent("ts", as_of, hours), _eq("context", context))
    return page(rows, [F.col("ts").desc(), F.col("vessel_id"), F.col("lane_name")], limit).join(vessels.select(F.col("id").alias("vessel_id"), "name", "flag"), "vessel_id", "left"), rows.groupBy("lane_name").count()


def search_audit(audit: DataFrame, start=None, end=None, actions=None, vessel=None, user=None, limit=200, offset=0) -> DataFrame:
    """Q11"""
    rows = _apply(audit, None if start is None else F.col("ts") >= F.lit(start), None if end is None else F.col("ts") <= F.lit(end), _eq("action", actions), _eq("vessel_id", vessel), _eq("user_id", user))
    return page(rows, [F.col("ts").desc(), F.col("id")], limit, offset)


def audit_action_counts(audit: DataFrame) -> DataFrame:
    return audit.groupBy("action").agg(F.count("*").alias("n"))


def search_listings(listings: DataFrame, query=None, entity_type=None, authority=None, program=None, active=True, limit=50, offset=0):
    """Q12: seven digits search IMO, nine search MMSI, other text the normalised name and aliases; each hit carries every
    authority that lists the same name."""
    match = None
    if query:
        digits = query.strip()
        if digits.isdigit() and len(digits) in (7, 9):
            match = F.col("imo" if len(digits) == 7 else "mmsi") == digits
        else:
            wanted = normalize_name(F.lit(query))
            match = F.contains("name_normalized", wanted) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(normalize_name(a), wanted))
    by_program = None if program is None else F.exists("programs", lambda p: F.contains(F.upper(p), F.lit(program.upper())))
    rows = _apply(listings, _eq("is_active", active), match, _eq("entity_type", entity_type), _eq("authority", authority), by_program)
    found = page(rows, [F.col("name"), F.col("id")], limit, offset)
    shared = listings.join(found.select("name_normalized").distinct(), "name_normalized", "left_semi").groupBy("name_normalized").agg(F.array_sort(F.collect_set("authority")).alias("listed_by"))
    return found.join(shared, "name_normalized", "left"), total(rows)


def list_updates(updates: DataFrame, as_of: datetime, days=7, authority=None, update_type=None, limit=200):
    """Q13: (page, counts by authority and type)"""
    rows = _apply(updates, _recent("ts", as_of, days * 24), _eq("authority", authority), _eq("update_type", update_type))
    return page(rows, [F.col("ts").desc(), F.col("id")], limit), rows.groupBy("authority", "update_type").count()


def list_programs(programs: DataFrame, authority=None) -> DataFrame:
    """Q14"""
    rows = _apply(programs, _eq("authority", authority))
    return rows.withColumn("authority_total", F.sum("n_entities").over(Window.partitionBy("authority"))).orderBy(F.col("n_entities").desc(), "authority", "program")


def list_geo_events(events: DataFrame, as_of=None, hours=None, event_types=None, country=None, min_severity="low", source=None, correlated=None, text=None, limit=100, offset=0):
    """Q15: (page, total)"""
    touches = None if country is None else (F.coalesce(F.col("country") == country, F.lit(False)) | F.coalesce(F.col("country_secondary") == country, F.lit(False)) | F.array_contains("countries", country))
    linked = None if correlated is None else ((F.col("with_market") | F.col("with_maritime") | F.col("with_sanctions")) == F.lit(correlated))
    rows = _apply(events, _recent("ts", as_of, hours), _eq("event_type", event_types), touches, severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)), _eq("source", source), linked, holds("title", text) if text else None)
    return page(rows, [F.col("ts").desc(), F.col("id")], limit, offset), total(rows)


def geo_alerts(events: DataFrame, as_of: datetime, hours=48, limit=50) -> DataFrame:
    """Q16: high and critical events, correlated ones first."""
    linked = F.col("with_market") | F.col("with_maritime") | F.col("with_sanctions")
    rows = _apply(events, _recent("ts", as_of, hours), F.col("severity").isin("high", "critical"))
    return page(rows, [linked.desc(), F.col("ts").desc(), F.col("id")], limit)


def geo_event_detail(events: DataFrame, links: DataFrame, event_id: int) -> DataFrame:
    """Q16: one event with its links, strongest first."""
    return events.where(F.col("id") == event_id).select(F.col("id").alias("event_id"), "title", "severity").join(links, "event_id").orderBy(F.col("score").desc(), "alert_type", "alert_id")


def list_event_links(links: DataFrame, as_of=None, hours=None, alert_type=None, min_score=None, limit=200) -> DataFrame:
    """Q17"""
    return page(_apply(links, _recent("alert_ts", as_of, hours), _eq("alert_type", alert_type), _at_least("score", min_score)), [F.col("score").desc(), F.col("event_id"), F.col("alert_type"), F.col("alert_id")], limit)


def list_wallets(wallets: DataFrame, chain=None, wallet_type=None, sanctioned=None, as_of=None, active_hours=None, text=None, min_balance=None, sort="risk", limit=100, offset=0):
    """Q18: (page, total)"""
    found = None if not text else holds("address", text) | holds("label", text) | holds("owner", text)
    rows = _apply(wallets, _eq("chain", chain), _eq("wallet_type", wallet_type), _eq("is_sanctioned", sanctioned), _recent("last_active", as_of, active_hours), found, _at_least("balance_usd", min_balance))
    orders = {"risk": F.col("risk_score").desc_nulls_last(), "balance": F.col("balance_usd").desc_nulls_last(), "active": F.col("last_active").desc_nulls_last(), "label": F.col("label").asc_nulls_last()}
    return page(rows, [orders[sort], F.col("chain"), F.col("address")], limit, offset), total(rows)


def wallet_detail(wallets: DataFrame, transfers: DataFrame, clusters: DataFrame, chain: str, address: str, limit=100):
    """Q18: (wallet, newest transfers touching it, members of its cluster)"""
    mine = (F.col("chain") == chain) & ((F.col("src") == address) | (F.col("dst") == address))
    cluster = clusters.where((F.col("chain") == chain) & (F.col("address") == address)).select("cluster_id").distinct()
    return wallets.where((F.col("chain") == chain) & (F.col("address") == address)), page(transfers.where(mine), [F.col("ts").desc(), F.col("tx_hash")], limit), clusters.join(cluster, "cluster_id", "left_semi")


def list_transfers(transfers: DataFrame, chain=None, pattern=None, sanctioned=None, mixer=None, min_usd=None, address=None, as_of=None, hours=None, limit=100, offset=0):
    """Q19: (page, total)"""
    touches = None if address is None else (F.col("src") == address) | (F.col("dst") == address)
    rows = _apply(transfers, _eq("chain", chain), _eq("pattern", pattern), _eq("involves_sanctioned", sanctioned), _eq("involves_mixer", mixer), _at_least("usd", min_usd), touches, _recent("ts", as_of, hours))
    return page(rows, [F.col("ts").desc(), F.col("tx_hash")], limit, offset), total(rows)


def whales(transfers: DataFrame, as_of: datetime, hours=24, limit=50) -> DataFrame:
    """Q19: largest transfers of the period."""
    return page(_apply(transfers, _recent("ts", as_of, hours)), [F.col("usd").desc_nulls_last(), F.col("tx_hash")], limit)


def list_companies(companies: DataFrame, q=None, country=None, listed=None, match_type=None, shell=None, opaque=None, min_risk=None, has_lei=None, exposure_only=False, sort="risk", limit=100, offset=0):
    """Q20: (page, total)"""
    lei = None if has_lei is None else F.col("lei").isNotNull() == F.lit(has_lei)
    exposed = F.col("match_type").isin("parent", "ultimate_parent", "child") if exposure_only else None
    rows = _apply(companies, holds("name", q) | holds("lei", q) if q else None, _eq("country", country), _eq("listed", listed), _eq("match_type", match_type), _eq("is_shell", shell), _eq("opaque", opaque), _at_least("risk_score", min_risk), lei, exposed)
    orders = {"risk": F.col("risk_score").desc_nulls_last(), "name": F.col("name").asc(), "shell": F.col("shell_confidence").desc_nulls_last(), "created": F.col("creation_date").desc_nulls_last()}
    return page(rows, [orders[sort], F.col("id")], limit, offset), total(rows)


def company_detail(companies: DataFrame, edges: DataFrame, chains: DataFrame, company: int):
    """Q20: (company, parents and subsidiaries, ownership chain)"""
    from intel_spark.operators.graph import relations

    return companies.where(F.col("id") == company), relations(edges, companies, company), chains.where(F.col("company") == company)


def list_chains(chains: DataFrame, sanctioned=None, secrecy=None, limit=100) -> DataFrame:
    return page(_apply(chains, _eq("involves_sanctioned", sanctioned), _eq("secrecy", secrecy)), [F.col("chain_length").desc(), F.col("company")], limit)


def list_facilities(facilities: DataFrame, country=None, facility_type=None, sanctioned=None) -> DataFrame:
    """Q21"""
    return _apply(facilities, _eq("country", country), _eq("type", facility_type), _eq("sanctioned", sanctioned)).orderBy("name")


def facility_detail(facilities: DataFrame, calls: DataFrame, shipments: DataFrame, flows: DataFrame, facility: int, as_of: datetime, days=30):
    """Q21: (facility, calls, shipments on either leg, daily flows)"""
    start = since(as_of, days * 24)
    either = (F.col("facility_id") == facility) | (F.col("discharge_facility") == facility)
    return (
        facilities.where(F.col("id") == facility), calls.where((F.col("facility_id") == facility) & (F.col("arrival") >= start)).orderBy(F.col("arrival").desc(), "id"),
        shipments.where(either & (F.col("loading_date") >= start)).orderBy(F.col("loading_date").desc(), "shipment_id"), flows.where((F.col("facility_id") == facility) & (F.col("day") >= F.to_date(start))).orderBy("day"),
    )


def list_shipments(shipments: DataFrame, as_of: datetime, days=30, sanctioned=None, dark=None, origin=None, destination=None, status=None, mmsi=None, limit=200, offset=0):
    """Q22: (page, total)"""
    rows = _apply(shipments, _recent("loading_date", as_of, days * 24), _eq("sanctioned_route", sanctioned), _eq("dark_oil_suspect", dark), _eq("origin", origin), _eq("destination", destination), _eq("status", status), _eq("mmsi", mmsi))
    return page(rows, [F.col("loading_date").desc(), F.col("shipment_id")], limit, offset), total(rows)


def list_dark_oil(indicators: DataFrame, pattern=None, severity=None, min_confidence=None, limit=200) -> DataFrame:
    """Q23"""
    return page(_apply(indicators, _eq("pattern", pattern), _eq("severity", severity), _at_least("confidence", min_confidence)), [F.col("confidence").desc(), F.col("vessel_id"), F.col("pattern"), F.col("shipment_id").asc_nulls_last()], limit)


def list_flows(snapshots: DataFrame, facilities: DataFrame, facility=None, country=None, sanctioned=None) -> DataFrame:
    """Q23: daily flows of the chosen facilities; the choice is a semi join."""
    chosen = _apply(facilities, _eq("id", facility), _eq("country", country), _eq("sanctioned", sanctioned)).select(F.col("id").alias("facility_id"))
    return snapshots.join(chosen, "facility_id", "left_semi").orderBy("day", "facility_id")


def list_aircraft(aircraft: DataFrame, country=None, sanctioned=None, text=None, limit=200) -> DataFrame:
    """Q24"""
    return page(_apply(aircraft, _eq("country", country), _eq("is_sanctioned", sanctioned), holds("registration", text) | holds("operator", text) if text else None), [F.col("registration")], limit)


def sightings_of(sightings: DataFrame, registration: str, limit=200) -> DataFrame:
    return page(sightings.where(F.col("registration") == registration.upper()), [F.col("ts").desc(), F.col("id")], limit)


def recent_sightings(sightings: DataFrame, as_of: datetime, hours=24, limit=200) -> DataFrame:
    return page(_apply(sightings, _recent("ts", as_of, hours)), [F.col("ts").desc(), F.col("id")], limit)


def list_breach_posts(posts: DataFrame, relevance=None, severity=None, country=None, min_score=None, limit=100) -> DataFrame:
    """Q25"""
    return page(_apply(posts, _eq("relevance", relevance), _eq("severity", severity), _eq("country", country), _at_least("score", min_score)), [F.col("score").desc(), F.col("post_id")], limit)


def list_narratives(stories: DataFrame, divergence=None, min_score=None, limit=50) -> DataFrame:
    return page(_apply(stories, _eq("divergence", divergence), _at_least("score", min_score)), [F.col("score").desc(), F.col("story")], limit)


def list_infra(domains: DataFrame, live=None, country=None, min_risk=None, limit=100) -> DataFrame:
    return page(_apply(domains, _eq("is_live", live), _eq("hosting_country", country), _at_least("risk_score", min_risk)), [F.col("risk_score").desc(), F.col("id")], limit)


def list_legal(legal: DataFrame, source=None, event_type=None, matched=None, text=None, limit=100) -> DataFrame:
    hit = None if matched is None else F.col("matched_entity").isNotNull() == F.lit(matched)
    return page(_apply(legal, _eq("source", source), _eq("event_type", event_type), hit, holds("title", text) if text else None), [F.col("ts").desc_nulls_last(), F.col("id")], limit)


def list_psc(events: DataFrame, vessels: DataFrame, event_type=None, source=None, flagged_only=False, text=None, limit=100) -> DataFrame:
    """Q25: inspections with the hull where known."""
    rows = _apply(events, _eq("event_type", event_type), _eq("source", source), F.col("vessel_flagged") if flagged_only else None, holds("ship_name", text) | holds("imo", text) if text else None)
    hulls = vessels.select(F.col("id").alias("vessel_id"), F.col("mmsi"), F.col("sanctioned_status"))
    return page(rows, [F.col("event_date").desc_nulls_last(), F.col("id")], limit).join(hulls, "vessel_id", "left")


def psc_by_imo(events: DataFrame, imo: str) -> DataFrame:
    return events.where(F.col("imo") == imo).orderBy(F.col("event_date").desc(), "id")


def list_composites(alerts: DataFrame, severity=None, domain=None, min_confidence=None, limit=50) -> DataFrame:
    """Q26"""
    rows = _apply(alerts, _eq("severity", severity), None if domain is None else F.array_contains("domains", domain), _at_least("confidence", min_confidence))
    return page(rows, [severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), F.col("fingerprint")], limit)


def list_correlations(pairs: DataFrame, correlation_type=None, min_score=None, limit=100) -> DataFrame:
    return page(_apply(pairs, _eq("correlation_type", correlation_type), _at_least("score", min_score)), [F.col("score").desc(), F.col("a_ref"), F.col("b_ref")], limit)


def global_search(tables: dict[str, tuple[DataFrame, str, list[str], str]], q: str, per_kind: int = 8) -> DataFrame:
    """Q27: ``tables`` maps kind to (rows, id column, searched columns, title column); the first hits of every kind under one
    schema. Digits also match identifier columns exactly, since a substring test covers them."""
    parts = []
    for kind, (rows, id_col, searched, title) in tables.items():
        hit = holds(searched[0], q)
        for col in searched[1:]:
            hit = hit | holds(col, q)
        found = rows.where(hit).select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("id"), F.col(title).cast("string").alias("title"))
        parts.append(page(found, [F.col("title"), F.col("id")], per_kind))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def entity_dossier(tables: dict[str, DataFrame], entity_id: int) -> DataFrame:
    """Q28: everything tied to one listing as (section, id, text, value) rows. Each section is cut by the listing first."""
    listing = tables["listings"].where(F.col("id") == entity_id)
    section = lambda name, df, key, text, value=None: df.select(F.lit(name).alias("section"), F.col(key).cast("string").alias("id"), F.col(text).cast("string").alias("text"), (F.lit(None) if value is None else F.col(value)).cast("double").alias("value"))
    parts = [section("listing", listing, "source_id", "name")]
    peers = tables["listings"].join(listing.select("name_normalized"), "name_normalized", "left_semi").where(F.col("id") != entity_id)
    parts.append(section("same_name", peers, "id", "authority"))
    if "breaches" in tables:
        parts.append(section("breach", tables["breaches"].where(F.col("entity_id") == entity_id), "id", "listed", "confidence"))
    if "companies" in tables:
        parts.append(section("company", tables["companies"].where(F.col("entity_id") == entity_id), "id", "name", "confidence"))
    if "wallets" in tables:
        wallets = tables["wallets"].where(F.col("entity_id") == entity_id)
        parts.append(section("wallet", wallets, "address", "chain", "risk_score"))
        if "transfers" in tables:
            mine = wallets.select("chain", "address").distinct()
            ends = tables["transfers"].select("chain", "tx_hash", "pattern", "usd", F.explode(F.array_distinct(F.array("src", "dst"))).alias("address"))
            parts.append(section("transfer", ends.join(mine, ["chain", "address"], "left_semi").dropDuplicates(["chain", "tx_hash"]), "tx_hash", "pattern", "usd"))
    if "domains" in tables:
        parts.append(section("domain", tables["domains"].where(F.col("entity_id") == entity_id), "domain", "entity_name"))
    if "legal" in tables:
        parts.append(section("legal", tables["legal"].where(F.col("entity_id") == entity_id), "id", "title"))
    if "aircraft" in tables:
        parts.append(section("aircraft", tables["aircraft"].where(F.col("entity_id") == entity_id), "registration", "model"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def vessel_dossier(tables: dict[str, DataFrame], mmsi: str, per_section: int = 100) -> DataFrame:
    """Q29: one vessel's record as (section, id, ts, text) rows, newest first per section."""
    hull = tables["vessels"].where(F.col("mmsi") == mmsi)
    key = hull.select(F.col("id").alias("vessel_id"))
    section = lambda name, df, id_col, ts, text: page(df.select(F.lit(name).alias("section"), F.col(id_col).cast("string").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col(text).cast("string").alias("text")), [F.col("ts").desc(), F.col("id")], per_section)
    parts = [section("vessel", hull, "id", "last_ais_update", "name")]
    for name, id_col, ts, text in (("breaches", "id", "ts", "listed"), ("evasion", "id", "ts", "event_type"), ("port_calls", "id", "arrival", "port"), ("shipments", "shipment_id", "loading_date", "loading_location"), ("positions", "id", "ts", "speed"), ("zone_events", "lane_name", "ts", "context"), ("dark_oil", "evidence_id", "voyage_start", "pattern")):
        if name in tables:
            parts.append(section(name, tables[name].join(key, "vessel_id", "left_semi"), id_col, ts, text))
    if "sts" in tables:
        met = tables["sts"].withColumn("vessel_id", F.explode(F.array_distinct(F.array("vessel_a", "vessel_b"))))
        parts.append(section("sts", met.join(key, "vessel_id", "left_semi"), "id", "ts", "status"))
    if "psc" in tables:
        parts.append(section("psc", tables["psc"].join(hull.select("imo"), "imo", "left_semi"), "id", "event_date", "event_type"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def watch_items_with_counts(items: DataFrame, hits: DataFrame, as_of: datetime) -> DataFrame:
    """Q30: items with hits of the last week and in total."""
    counts = hits.groupBy("item_id").agg(F.count("*").alias("hits_total"), F.count_if(F.col("ts") >= since(as_of, 168)).alias("hits_7d"), F.max("ts").alias("last_hit"))
    return items.join(counts, items.id == counts.item_id, "left").select(items["*"], F.coalesce("hits_total", F.lit(0)).alias("hits_total"), F.coalesce("hits_7d", F.lit(0)).alias("hits_7d"), "last_hit")


def list_hits(items: DataFrame, hits: DataFrame, item=None, severity=None, limit=200) -> DataFrame:
    rows = _apply(hits, _eq("item_id", item), _eq("severity", severity))
    return page(rows, [F.col("ts").desc(), F.col("item_id"), F.col("record_id")], limit).join(items.select(F.col("id").alias("item_id"), "kind", "key"), "item_id")


def is_watched(items: DataFrame, kind: str, key: str) -> DataFrame:
    return items.where((F.col("kind") == kind) & (F.col("key") == key)).agg((F.count("*") > 0).alias("watched"))


def vessel_screen(matches: DataFrame) -> DataFrame:
    """Q31: recommendation per screened vessel from its best match."""
    best = matches.groupBy("vessel_id").agg(F.max("confidence").alias("confidence"), F.count("*").alias("matches"))
    return best.withColumn("recommendation", F.when(F.col("confidence") >= 0.9, "Alert").when(F.col("confidence") >= 0.6, "Review").otherwise("Monitor"))


def registry_search(registry: DataFrame, companies: DataFrame, listings: DataFrame, q: str, top: int = 15, min_ratio: float = 0.88) -> DataFrame:
    """Q33: registry records whose name holds the query, the tracked company's id, and how many listings each name matches."""
    found = page(registry.where(holds("name", q)), [F.length("name"), F.col("name"), F.col("lei")], top)
    tracked = companies.where(F.col("lei").isNotNull()).groupBy("lei").agg(F.min("id").alias("company_id"))
    hits = screen_names(found.select(F.col("lei").alias("name_id"), "name"), listings, min_ratio).groupBy(F.col("name_id").alias("lei")).agg(F.count("*").alias("screening_hits"))
    return found.join(tracked, "lei", "left").join(hits, "lei", "left").select("lei", "name", "country", "company_id", F.coalesce("screening_hits", F.lit(0)).alias("screening_hits"))


def status_counts(vessels: DataFrame, breaches: DataFrame, positions: DataFrame, alerts: DataFrame, as_of: datetime) -> DataFrame:
    """Tidy (metric, value) of the tracked state; every table is one aggregate."""
    v = vessels.agg(F.count("*").alias("vessels_tracked"), F.count_if(F.col("last_ais_update") >= since(as_of, 1)).alias("vessels_active_1h")).unpivot([], ["vessels_tracked", "vessels_active_1h"], "metric", "value")
    one = lambda df, name: df.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    return v.unionByName(one(breaches.where(F.col("status").isin(OPEN_STATUSES)), "open_breaches")).unionByName(one(positions, "positions_stored")).unionByName(one(alerts.where(~F.col("acknowledged")), "open_alerts"))
