"""Briefs as one tidy (section, metric, value) table plus bounded detail tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.session import checkpoint_ready


def _within(col: str, start: datetime, end: datetime) -> Column:
    return F.col(col).between(F.lit(start), F.lit(end))


def _count(df: DataFrame, section: str, metric: str) -> DataFrame:
    return df.agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), F.lit(metric).alias("metric"), "value")


def _by(df: DataFrame, section: str, prefix: str, *cols: str) -> DataFrame:
    return df.groupBy(F.concat_ws(":", F.lit(prefix), *[F.col(c).cast("string") for c in cols]).alias("metric")).agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "metric", "value")


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def maritime_brief(tables: dict[str, DataFrame], start: datetime, end: datetime) -> DataFrame:
    """Summary counts, breakdowns and the counts behind each recommendation."""
    breaches, evasion = tables["breaches"].where(_within("ts", start, end)), tables["evasion"].where(_within("ts", start, end))
    sts = tables["sts"].where(_within("ts", start, end))
    calls = tables["port_calls"].where(_within("arrival", start, end) & (F.col("is_sanctioned") | (F.col("risk_level") == "high")))
    vessels = tables["vessels"]
    parts = [
        _count(vessels, "summary", "vessels_tracked"), _count(vessels.where(F.col("last_ais_update") >= F.lit(end) - F.expr("INTERVAL 24 HOURS")), "summary", "vessels_active_24h"), _count(breaches, "summary", "sanctions_matches"), _count(evasion, "summary", "evasion_indicators"),
        _count(sts, "summary", "sts_candidates"), _count(calls, "summary", "high_risk_port_calls"), _by(breaches, "breaches", "authority", "authority"), _by(breaches, "breaches", "severity", "severity"), _by(evasion, "evasion", "type", "event_type"),
        _count(breaches.where(F.col("match_type").isin("imo", "mmsi") & (F.col("status") != "cleared")), "recommendations", "escalate_identity_matches"), _count(breaches.where(F.col("status") == "review"), "recommendations", "work_review_queue"),
        _count(evasion.where(F.col("event_type").isin("ais_gap", "dark_in_zone") & F.col("severity").isin("high", "critical")), "recommendations", "task_imagery_on_gaps"),
        _count(evasion.where(F.col("event_type").isin("name_change", "flag_change", "identity_conflict")), "recommendations", "rescreen_renamed"), _count(sts, "recommendations", "cross_check_rendezvous"), _count(calls, "recommendations", "review_ownership_of_callers"),
    ]
    if "zone_events" in tables:
        parts.append(_count(tables["zone_events"].where(_within("ts", start, end)), "summary", "zone_events"))
    return _union(parts)


def maritime_details(tables: dict[str, DataFrame], start: datetime, end: datetime) -> dict[str, DataFrame]:
    """Bounded detail tables of the maritime brief."""
    return {
        "breaches": tables["breaches"].where(_within("ts", start, end)).orderBy(F.col("confidence").desc(), "id").limit(60), "top_vessels": tables["vessels"].where("risk_score > 0").orderBy(F.col("risk_score").desc(), "id").limit(12),
        "evasion": tables["evasion"].where(_within("ts", start, end)).orderBy(F.col("ts").desc(), "id").limit(40), "sts": tables["sts"].where(_within("ts", start, end)).orderBy(F.col("confidence").desc(), "id").limit(40),
        "port_calls": tables["port_calls"].where(_within("arrival", start, end) & (F.col("is_sanctioned") | (F.col("risk_level") == "high"))).orderBy(F.col("arrival").desc(), "id").limit(40),
    }


def market_brief(alerts: DataFrame, coordinated: DataFrame | None, start: datetime, end: datetime) -> DataFrame:
    recent = alerts.where(_within("ts", start, end))
    parts = [_count(recent, "summary", "alerts"), _by(recent, "alerts", "type", "alert_type"), _by(recent, "alerts", "severity", "severity")]
    if coordinated is not None:
        parts.append(_count(coordinated.where(_within("ts", start, end)), "summary", "coordination_events"))
    return _union(parts)


def sanctions_brief(listings: DataFrame, updates: DataFrame, start: datetime, end: datetime) -> DataFrame:
    recent, active = updates.where(_within("ts", start, end)), listings.where("is_active")
    return _union([_count(recent, "summary", "updates"), _by(active, "listings", "active", "authority"), _by(active.where("entity_type = 'vessel'"), "listings", "vessels", "authority"), _by(recent, "updates", "change", "authority", "update_type")])


def cross_domain_brief(signals: DataFrame, links: DataFrame, alerts: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """``links`` counts passing links per signal and other domain; a link is named after its two domains in order."""
    recent = signals.where(_within("ts", start, end))
    # a link has two ends; the end of the lesser domain stands for it
    once = links.where("domain < other").withColumn("kind", F.concat_ws("_", "domain", "other"))
    # counted once, a row a kind and a severity
    checkpoint_ready(signals.sparkSession)
    kinds = once.groupBy("kind").agg(F.sum("links").cast("double").alias("value")).checkpoint()
    total = kinds.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit("summary").alias("section"), F.lit("correlations").alias("metric"), "value")
    kinds = kinds.select(F.lit("correlations").alias("section"), F.concat(F.lit("type:"), "kind").alias("metric"), "value")
    raised = _by(alerts, "composite_alerts", "severity", "severity").checkpoint()
    alerted = raised.agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value")).select(F.lit("summary").alias("section"), F.lit("composite_alerts").alias("metric"), "value")
    return _union([_count(recent, "summary", "signals"), _by(recent, "signals", "domain", "domain"), _by(recent, "signals", "severity", "severity"), total, kinds, alerted, raised])


def daily_digest(tables: dict[str, DataFrame], as_of: datetime) -> DataFrame:
    """The last day in one table."""
    day = lambda name, col: tables[name].where((F.col(col) >= F.lit(as_of) - F.expr("INTERVAL 24 HOURS")) & (F.col(col) <= F.lit(as_of)))
    return _union([
        _count(day("vessels", "last_ais_update"), "maritime", "vessels_active"), _count(day("breaches", "ts"), "maritime", "new_matches"), _count(day("sts", "ts"), "maritime", "sts_candidates"), _count(day("port_calls", "arrival").where("is_sanctioned"), "maritime", "sanctioned_calls"),
        _by(day("evasion", "ts"), "evasion", "type", "event_type"), _by(day("list_updates", "ts"), "sanctions", "change", "authority", "update_type"),
    ])
