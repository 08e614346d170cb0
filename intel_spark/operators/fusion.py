"""Cross-domain signals: shared keys, pair scores, clusters, watch-list hits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.functions.scoring import rank_severity, severity_rank
from intel_spark.functions.text import fingerprint
from intel_spark.functions.vessel import lookup
from intel_spark.operators.graph import connected_components
from intel_spark.operators.links import Rules, all_pairs, best_pairs, scored, strong_links, tied
from intel_spark.operators.sanctions import insert_if_absent
from intel_spark.operators.search import substring_join, word_join
from intel_spark.operators.timeline import top_per_key
from intel_spark.session import checkpoint_ready

# Which domain a kind of signal belongs to, and how keys are spoken of.
DOMAINS = {
    "market_alert": "market", "coordination_event": "market", "liquidation_cascade": "market", "sanctions_breach": "maritime", "evasion_event": "maritime", "transshipment": "maritime", "port_call": "maritime",
    "sanctions_update": "sanctions", "geopolitical_event": "geopolitical", "blockchain_tx": "blockchain", "corporate_exposure": "corporate", "dark_oil": "energy", "oil_shipment": "energy", "aircraft_sighting": "aviation",
    "breach": "cyber", "narrative": "information", "legal_event": "legal", "infra_asset": "infrastructure", "psc_event": "maritime",
}
LINK_TYPES = {"vessel": "entity", "entity": "entity", "wallet": "entity", "company": "entity", "aircraft": "entity", "domain": "entity", "facility": "geographic", "country": "geographic", "asset": "topical", "sector": "topical", "theme": "topical"}
KIND_LABELS = {"vessel": "Vessel", "entity": "Listed party", "wallet": "Wallet", "company": "Company", "aircraft": "Aircraft", "domain": "Domain", "facility": "Facility", "country": "Country", "asset": "Asset", "sector": "Sector", "theme": "Theme"}
UPPER_KINDS = ["entity", "company", "country", "asset"]
WATCH_BLOCK = 256  # items that travel together to the records they touch


def keys_of(*pairs: tuple[str, Column]) -> Column:
    """Array of struct(kind, value) from (kind, value or array of values); empty values drop out."""
    entries = []
    for kind, value in pairs:
        clean = F.trim(value.cast("string"))
        clean = F.upper(clean) if kind in UPPER_KINDS else clean
        entries.append(F.when(clean != "", F.struct(F.lit(kind).alias("kind"), clean.alias("value"))))
    return F.array_distinct(F.array_compact(F.array(*entries)))


def many_keys(kind: str, values: Column) -> Column:
    clean = lambda v: F.upper(F.trim(v)) if kind in UPPER_KINDS else F.trim(v)
    empty = F.array().cast("array<struct<kind:string,value:string>>")
    return F.coalesce(F.transform(F.filter(values, lambda v: v.isNotNull() & (F.trim(v) != "")), lambda v: F.struct(F.lit(kind).alias("kind"), clean(v).alias("value"))), empty)


def signal(df: DataFrame, kind: str, id_col: str, ts: str, severity: Column, keys: Column, summary: Column) -> DataFrame:
    """One detector's rows as signals."""
    return df.select(
        F.lit(kind).alias("type"), F.col(id_col).cast("long").alias("id"), F.concat(F.lit(kind + ":"), F.col(id_col).cast("string")).alias("ref"), F.lit(DOMAINS.get(kind, kind)).alias("domain"), F.col(ts).alias("ts"), severity.alias("severity"),
        F.array_distinct(keys).alias("keys"), summary.alias("summary"),
    )


def canonical_facility(df: DataFrame, facilities: DataFrame | None, *cols: str) -> DataFrame:
    """F32: names in ``cols`` replaced by the name of the facility (name, port_name) whose port they are, so that a call at a
    port and a shipment from its terminal carry the same key; other names stay."""
    if facilities is None:
        return df
    ports = facilities.where(F.col("port_name").isNotNull()).groupBy("port_name").agg(F.max("name").alias("_key"))
    for c in cols:
        df = df.join(ports.withColumnRenamed("port_name", c), c, "left").withColumn(c, F.coalesce("_key", F.col(c))).drop("_key")
    return df


def facility_mentions(texts: DataFrame, facilities: DataFrame, min_length: int = 5) -> DataFrame:
    """F32: (text_id, facility) where a text holds the distinctive first word of a facility's name as a whole word."""
    first = F.split(F.trim(F.split("name", r"\(")[0]), r"\s+")[0]
    needles = facilities.select(F.col("name").alias("needle_id"), F.lower(first).alias("needle")).where(F.length("needle") >= min_length)
    return word_join(texts, needles).select("text_id", F.col("needle_id").alias("facility"))


def _by_confidence(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "high").when(confidence >= 0.5, "medium").otherwise("low")


def collect_signals(tables: dict[str, DataFrame], since: datetime) -> DataFrame:
    """Signals of every given table since a moment, under one schema. Lookups (flags, listing countries) are joins."""
    from intel_spark.operators.events import ASSET_SECTORS

    start = F.lit(since)
    parts: list[DataFrame] = []
    sector_of = F.coalesce(F.try_element_at(lookup(ASSET_SECTORS), F.col("asset")), F.lit("finance"))
    vessels = tables.get("vessels")
    flags = None if vessels is None else vessels.select(F.col("id").alias("vessel_id"), F.col("mmsi").alias("v_mmsi"), F.col("flag").alias("v_flag"), F.col("name").alias("v_name"), F.col("sanctioned_status").alias("v_status"))
    entities = tables.get("listings")
    places = None if entities is None else entities.select(F.col("id").alias("entity_id"), F.col("country").alias("e_country"), F.col("name").alias("e_name"))

    def with_entity(df):
        return df.join(places, "entity_id", "left") if places is not None else df.withColumn("e_country", F.lit(None).cast("string")).withColumn("e_name", F.lit(None).cast("string"))

    def recent(name, ts):
        return tables[name].where(F.col(ts) >= start) if name in tables else None

    if (t := recent("market_alerts", "ts")) is not None:
        parts.append(signal(t, "market_alert", "id", "ts", F.col("severity"), keys_of(("asset", F.col("asset")), ("sector", sector_of)), F.concat_ws(" ", "asset", "alert_type", "severity")))
    if (t := recent("coordination", "ts")) is not None:
        parts.append(signal(t, "coordination_event", "id", "ts", _by_confidence(F.col("confidence")), keys_of(("asset", F.col("asset")), ("sector", sector_of)), F.concat_ws(" ", "asset", F.lit("coordinated move"))))
    if (t := recent("cascades", "ts")) is not None:
        parts.append(signal(t, "liquidation_cascade", "id", "ts", F.when(F.col("total_usd") >= 10_000_000, "high").otherwise("medium"), keys_of(("asset", F.col("asset")), ("sector", F.lit("finance"))), F.concat_ws(" ", "asset", F.lit("liquidation cascade"))))
    if (t := recent("breaches", "ts")) is not None:
        t = with_entity(t.where(F.col("status") != "cleared").join(flags, "vessel_id", "left"))
        keys = keys_of(("vessel", F.col("v_mmsi")), ("entity", F.col("listed")), ("entity", F.col("v_name")), ("country", F.col("v_flag")), ("country", F.col("e_country")), ("sector", F.lit("shipping")), ("theme", F.lit("sanctions")))
        parts.append(signal(t, "sanctions_breach", "id", "ts", F.col("severity"), keys, F.concat_ws(" ", "authority", F.lit("match:"), "v_name", F.lit("->"), "listed")))
    if (t := recent("evasion", "ts")) is not None:
        t = t.join(flags.select("vessel_id", "v_flag"), "vessel_id", "left")
        keys = keys_of(("vessel", F.col("mmsi")), ("country", F.col("v_flag")), ("sector", F.lit("shipping")), ("theme", F.when(F.col("event_type") == "spoofing_cluster", "gnss_interference")))
        if "members" in t.columns:
            keys = F.concat(keys, many_keys("vessel", F.transform("members", lambda m: m["mmsi"])), many_keys("country", F.transform("members", lambda m: m["flag"])))
        parts.append(signal(t, "evasion_event", "id", "ts", F.col("severity"), keys, F.coalesce("summary", F.concat_ws(" ", "event_type", "mmsi"))))
    if (t := recent("sts", "ts")) is not None:
        a = flags.select(F.col("vessel_id").alias("vessel_a"), F.col("v_mmsi").alias("am"), F.col("v_flag").alias("af"))
        b = flags.select(F.col("vessel_id").alias("vessel_b"), F.col("v_mmsi").alias("bm"), F.col("v_flag").alias("bf"))
        t = t.join(a, "vessel_a", "left").join(b, "vessel_b", "left")
        keys = keys_of(("vessel", F.col("am")), ("vessel", F.col("bm")), ("country", F.col("af")), ("country", F.col("bf")), ("sector", F.lit("shipping")), ("theme", F.lit("maritime")))
        parts.append(signal(t, "transshipment", "id", "ts", _by_confidence(F.col("confidence")), keys, F.concat_ws(" ", F.lit("STS candidate"), "am", F.lit("/"), "bm")))
    if (t := recent("port_calls", "arrival")) is not None:
        t = canonical_facility(t.where("is_sanctioned").join(flags, "vessel_id"), tables.get("facilities"), "port")
        keys = keys_of(("vessel", F.col("v_mmsi")), ("country", F.col("country")), ("country", F.col("v_flag")), ("facility", F.col("port")), ("sector", F.lit("shipping")), ("sector", F.lit("energy")))
        parts.append(signal(t, "port_call", "id", "arrival", F.when(F.coalesce("v_status", F.lit("clear")) != "clear", "high").otherwise("medium"), keys, F.concat_ws(" ", "v_name", F.lit("called at sanctioned facility"), "port")))
    if (t := recent("list_updates", "ts")) is not None:
        t = with_entity(t.where(F.col("update_type").isin("new_designation", "relisted")))
        keys = keys_of(("entity", F.col("entity")), ("country", F.col("e_country")), ("theme", F.lit("sanctions")), ("sector", F.lit("finance")))
        parts.append(signal(t, "sanctions_update", "id", "ts", F.lit("medium"), keys, F.concat_ws(" ", "authority", "update_type", "entity")))
    if (t := recent("geo_events", "ts")) is not None:
        t = t.where(F.col("severity").isin("medium", "high", "critical"))
        theme = F.when(F.col("event_type") == "sanctions", "sanctions").when(F.col("event_type").isin("maritime_incident", "port_closure"), "maritime")
        keys = F.concat(keys_of(("country", F.col("country")), ("country", F.col("country_secondary")), ("theme", theme)), many_keys("country", F.col("countries")), many_keys("sector", F.col("sectors")))
        # ships and facilities named in the title come from the mentions join
        for kind in ("vessel", "facility"):
            if f"{kind}_mentions" in t.columns:
                keys = F.concat(keys, many_keys(kind, F.col(f"{kind}_mentions")))
        parts.append(signal(t, "geopolitical_event", "id", "ts", F.col("severity"), keys, F.col("title")))
    if (t := recent("transfers", "ts")) is not None:
        t = t.where(F.col("involves_sanctioned") | F.col("involves_mixer"))
        severity = F.when(F.col("risk_score") >= 0.9, "critical").when(F.col("involves_sanctioned"), "high").otherwise("medium")
        keys = keys_of(("entity", F.col("source_entity")), ("entity", F.col("destination_entity")), ("wallet", F.col("src")), ("wallet", F.col("dst")), ("asset", F.col("token")), ("sector", F.lit("finance")), ("theme", F.when(F.col("involves_sanctioned"), "sanctions").otherwise("crypto")))
        parts.append(signal(t, "blockchain_tx", "id", "ts", severity, keys, F.col("summary")))
    if (t := recent("companies", "updated_at")) is not None:
        t = with_entity(t.where(F.col("listed") & F.col("match_type").isin("parent", "ultimate_parent", "child")))
        keys = keys_of(("company", F.col("name")), ("entity", F.col("e_name")), ("entity", F.col("name")), ("country", F.col("country")), ("country", F.col("e_country")), ("theme", F.lit("sanctions")))
        parts.append(signal(t, "corporate_exposure", "id", "updated_at", F.when(F.col("risk_score") >= 0.8, "high").otherwise("medium"), keys, F.concat_ws(" ", "name", F.lit("is"), "match_type", F.lit("of a listed party"))))
    if (t := recent("dark_oil", "ts")) is not None:
        t = canonical_facility(t.join(flags, "vessel_id", "left"), tables.get("facilities"), "facility")
        keys = keys_of(("vessel", F.col("v_mmsi")), ("country", F.col("origin")), ("country", F.col("destination")), ("facility", F.col("facility")), ("sector", F.lit("energy")), ("sector", F.lit("shipping")), ("theme", F.lit("maritime")))
        parts.append(signal(t, "dark_oil", "id", "ts", F.coalesce("severity", F.lit("medium")), keys, F.concat_ws(" ", "v_name", "pattern")))
    if (t := recent("shipments", "loading_date")) is not None:
        t = canonical_facility(t.where("sanctioned_route"), tables.get("facilities"), "loading_location", "discharge_location")
        keys = keys_of(("vessel", F.col("mmsi")), ("country", F.col("origin")), ("country", F.col("destination")), ("facility", F.col("loading_location")), ("facility", F.col("discharge_location")), ("sector", F.lit("energy")), ("sector", F.lit("shipping")))
        parts.append(signal(t, "oil_shipment", "shipment_id", "loading_date", F.when(F.col("dark_oil_suspect"), "high").otherwise("medium"), keys, F.concat_ws(" ", "mmsi", F.lit("loaded"), "cargo_type", F.lit("at"), "loading_location")))
    if (t := recent("sightings", "ts")) is not None:
        # the newest fix of a flight stands for it
        t = t.groupBy("flight_key").agg(F.max_by(F.struct(*[c for c in t.columns if c != "flight_key"]), F.struct("ts", "id")).alias("s")).select("s.*")
        keys = keys_of(("aircraft", F.col("registration")), ("entity", F.col("operator")), ("country", F.col("country")), ("sector", F.lit("aviation")))
        parts.append(signal(t, "aircraft_sighting", "id", "ts", F.when(F.col("is_sanctioned"), "high").otherwise("medium"), keys, F.concat_ws(" ", "registration", F.lit("airborne as"), "callsign")))
    if (t := recent("breach_posts", "ts")) is not None:
        t = t.where(F.col("score") >= 0.6)
        keys = keys_of(("company", F.col("victim")), ("entity", F.col("victim")), ("domain", F.col("domain")), ("country", F.col("country")), ("sector", F.lower("sector")), ("sector", F.lit("cyber")))
        parts.append(signal(t, "breach", "post_id", "ts", F.col("severity"), keys, F.concat_ws(" - ", "victim", "relevance")))
    if (t := recent("narratives", "last_seen")) is not None:
        topics = F.array_intersect("keywords", F.array(*[F.lit(k) for k in ("oil", "gas", "tanker", "sanctions", "pipeline", "port")]))
        keys = F.concat(keys_of(("theme", F.lit("narrative"))), many_keys("country", F.col("countries")), many_keys("sector", topics))
        parts.append(signal(t.where(F.col("score") >= 0.5), "narrative", "story", "last_seen", F.col("severity"), keys, F.concat(F.lit("State-media narrative: "), "topic")))
    if (t := recent("legal", "ts")) is not None:
        keys = F.concat(keys_of(("entity", F.col("matched_entity")), ("theme", F.when(F.col("source").isin("ofac_enforcement", "courtlistener"), "sanctions").otherwise("legal"))), many_keys("entity", F.col("parties")))
        parts.append(signal(t, "legal_event", "id", "ts", F.when(F.col("matched_entity").isNotNull() | (F.coalesce("penalty_usd", F.lit(0.0)) >= 1_000_000), "high").otherwise("medium"), keys, F.col("title")))
    if (t := recent("psc", "event_date")) is not None:
        t = t.where(F.col("relevance_score") >= 0.45).join(flags, "vessel_id", "left")
        keys = keys_of(("vessel", F.col("v_mmsi")), ("entity", F.when(F.col("vessel_flagged"), F.col("ship_name"))), ("country", F.col("port_country")), ("sector", F.lit("shipping")))
        parts.append(signal(t, "psc_event", "id", "event_date", F.when(F.col("vessel_flagged"), "high").otherwise("medium"), keys, F.concat_ws(" ", "ship_name", "event_type")))
    if (t := recent("domains", "last_checked")) is not None:
        t = t.where(F.col("is_live") & (F.col("risk_score") >= 0.6))
        keys = keys_of(("domain", F.col("domain")), ("entity", F.col("entity_name")), ("country", F.col("hosting_country")), ("theme", F.lit("sanctions")))
        parts.append(signal(t, "infra_asset", "id", "last_checked", F.lit("medium"), keys, F.concat_ws(" ", "domain", F.lit("live for listed party"), "entity_name")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def representative_pairs(signals: DataFrame, rules: Rules = Rules(), strong: bool = False) -> DataFrame:
    """For every signal that has a passing link, the nearest passing ones in time per key set, with score and type.

    The number of pairs grows with the signals, not with the square of a key's holders; ``signal_links`` counts all links.
    """
    return _described(scored(tied(signals, rules, strong), signals, rules))


def score_pairs(signals: DataFrame, rules: Rules = Rules(), best: int | None = None) -> DataFrame:
    """Every pair of signals that passes, with score and type; with ``best``, those that score no less than the ``best``-th,
    for a list that is ordered by score."""
    return _described(all_pairs(signals, rules) if best is None else best_pairs(signals, rules, best))


def _described(found: DataFrame) -> DataFrame:
    strongest = F.substring_index(F.col("shared")[0], ":", 1)
    return found.select(
        "a_ref", "a_type", "a_id", "a_domain", "a_ts", "a_severity", "a_summary", "b_ref", "b_type", "b_id", "b_domain", "b_ts", "b_severity", "b_summary", "score", "shared", "strong", "delta_min",
        F.coalesce(F.try_element_at(lookup(LINK_TYPES), strongest), F.lit("temporal")).alias("link_type"), F.concat_ws("_", "a_domain", "b_domain").alias("correlation_type"),
    )


def composite_alerts(signals: DataFrame, rules: Rules = Rules(), min_domains: int = 3, max_signals: int = 25, max_keys: int = 8, existing: DataFrame | None = None) -> DataFrame:
    """Signals joined by strong links into clusters over at least ``min_domains`` domains, with anchor, severity and text.

    Counts, scores and dates are over all members and all strong links, which are counted and not listed; an alert lists
    its ``max_signals`` worst signals and its ``max_keys`` commonest keys, so a cluster of any size stays spread out.
    """
    spark = signals.sparkSession
    checkpoint_ready(spark)
    # read many times: made once, and spread out however few pieces the input came in
    signals = signals.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "ref").checkpoint()
    edges = tied(signals, rules, strong=True).checkpoint()
    parts = connected_components(edges.select(F.col("a_ref").alias("src"), F.col("b_ref").alias("dst"))).withColumnRenamed("component", "cluster").checkpoint()
    members = parts.join(signals.select(F.col("ref").alias("node"), "type", "id", "domain", "ts", "severity", "summary"), "node")
    facts = members.groupBy("cluster").agg(F.array_sort(F.collect_set("domain")).alias("domains"), F.min("ts").alias("window_start"), F.max("ts").alias("window_end"), F.count("*").alias("members"), F.max(severity_rank(F.col("severity"))).alias("rank")).where(F.size("domains") >= min_domains)
    cluster_of = parts.withColumnRenamed("node", "ref")
    links, key_counts = strong_links(signals, rules)
    counted = links.join(cluster_of, "ref").groupBy("cluster").agg((F.sum("strong_links") / 2).cast("long").alias("pairs"), (F.sum("strong_score") / F.sum("strong_links")).alias("mean_score"))
    held = key_counts.join(cluster_of, "ref").groupBy("cluster", "key").agg(F.sum("n").alias("n")).withColumn("vague", F.col("key").rlike("^(sector|theme):"))
    ranked = top_per_key(held, ["cluster"], [F.col("vague"), F.col("n").desc(), F.col("key")], max_keys, "k")
    # strong links always share a specific key, so the first one is never a vague one
    keys = ranked.groupBy("cluster").agg(F.min_by("key", "k").alias("anchor"), F.transform(F.array_sort(F.collect_list(F.struct("k", "key", "vague"))), lambda x: F.when(~x["vague"], x["key"])).alias("shared"))
    best = top_per_key(members.withColumn("_s", severity_rank(F.col("severity"))), ["cluster"], [F.col("_s").desc(), F.col("ts"), F.col("node")], max_signals, "k")
    entry = F.struct("k", "type", "id", "summary", "ts", "severity", "domain")
    listed = best.groupBy("cluster").agg(F.array_sort(F.collect_list(entry)).alias("signals"))
    out = facts.join(counted, "cluster").join(keys, "cluster").join(listed, "cluster")
    n = F.size("domains")
    rank = F.when((n >= 4) & (F.col("rank") < 3), F.col("rank") + 1).otherwise(F.col("rank"))
    kind, value = F.substring_index("anchor", ":", 1), F.expr("substring(anchor, instr(anchor, ':') + 1)")
    clause = F.transform("domains", lambda d: _domain_clause(d))
    lead = F.concat(
        F.format_string("%d related reports from %d fields share ", F.col("members"), n), kind, F.lit(" "), value, F.lit(" (first "), F.date_format("window_start", "yyyy-MM-dd HH:mm"), F.lit(", last "), F.date_format("window_end", "yyyy-MM-dd HH:mm"), F.lit(" UTC).")
    )
    alerts = out.select(
        fingerprint(F.concat("anchor", F.lit("|"), F.date_format("window_start", "yyyy-MM-dd"))).alias("fingerprint"), "anchor", "domains", F.array_compact("shared").alias("shared_keys"), "window_start", "window_end", "members", "pairs",
        F.round(F.least(F.lit(1.0), F.col("mean_score") * (1 + 0.1 * (n - 3))), 3).alias("confidence"), rank_severity(rank).alias("severity"), "signals",
        F.concat(F.coalesce(F.try_element_at(lookup(KIND_LABELS), kind), kind), F.lit(" "), value, F.lit(": "), F.array_join("domains", " + ")).alias("title"),
        F.concat(lead, F.lit(" "), F.array_join(F.array_compact(clause), " | ")).alias("narrative"),
    )
    return alerts if existing is None else insert_if_absent(alerts, existing, ["fingerprint"])


def _domain_clause(domain: Column) -> Column:
    items = F.filter("signals", lambda s: s["domain"] == domain)
    more = F.when(F.size(items) > 1, F.format_string(" (+%d more)", F.size(items) - 1)).otherwise("")
    return F.when(F.size(items) > 0, F.concat(F.upper(domain), F.lit(": "), items[0]["summary"], more))


def fusion_timeline(signals: DataFrame, as_of: datetime, hours: int = 48, bucket_hours: int = 1) -> DataFrame:
    """Signals per time bucket and domain, one column per domain."""
    recent = signals.where(F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    slot = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / (bucket_hours * 3600)) * bucket_hours * 3600)
    return recent.groupBy(slot.alias("time")).pivot("domain", sorted(set(DOMAINS.values()))).count().fillna(0)


def fusion_queue(signals: DataFrame, links: DataFrame, min_severity: str = "low", domains: list[str] | None = None, limit: int | None = 200) -> DataFrame:
    """Signals with their number of correlations, worst, most linked and newest first; ``links`` is (ref, links)."""
    kept = signals.where(severity_rank(F.col("severity")) >= severity_rank(F.lit(min_severity)))
    if domains:
        kept = kept.where(F.col("domain").isin(domains))
    out = kept.join(links.select("ref", F.col("links").alias("correlations")), "ref", "left").withColumn("correlations", F.coalesce("correlations", F.lit(0))).orderBy(severity_rank(F.col("severity")).desc(), F.col("correlations").desc(), F.col("ts").desc(), "ref")
    return out if limit is None else out.limit(limit)


def watch_hits(items: DataFrame, records: DataFrame, texts: DataFrame, stored: DataFrame, as_of: datetime, first_days: int = 7) -> DataFrame:
    """New records touching watched things since the last check (a week back on the first one).

    ``items`` are (id, kind, key, created_at, last_checked_at); ``records`` are (kind, key, record_type, record_id, ts,
    severity) and hold every exact key; ``texts`` are (record_type, record_id, ts, severity, text, kinds) searched for the
    keys of company, domain and keyword items.
    """
    floor = F.greatest(F.col("created_at") - F.expr(f"INTERVAL {first_days} DAYS"), F.lit(as_of) - F.expr("INTERVAL 30 DAYS"))
    due = items.select(F.col("id").alias("item_id"), "kind", F.col("key"), F.coalesce("last_checked_at", floor).alias("since"), F.col("last_checked_at").isNotNull().alias("news"))
    # items of one kind and key touch the same records: these are found once, items come in behind the last shuffle
    checkpoint_ready(items.sparkSession)
    asked = due.groupBy("kind", "key").agg(F.count("*").alias("n"))
    by_text = asked.where(F.col("kind").isin("company", "domain", "keyword"))
    record, wanted = F.struct("record_type", "record_id", "ts", "severity", "kinds"), F.struct("kind", "key", "n")
    held = substring_join(texts.select(record.alias("text_id"), "text"), by_text.select(wanted.alias("needle_id"), F.col("key").alias("needle")))
    named = held.select("text_id.*", "needle_id.*").where(F.array_contains("kinds", F.col("kind"))).drop("kinds").checkpoint()
    exact = asked.join(records, ["kind", "key"]).select(named.columns)
    found = exact.unionByName(named)
    columns = ["item_id", "kind", "key", "record_type", "record_id", "ts", "severity", "news"]
    keys = ["item_id", "record_type", "record_id"]
    if not due.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        # an id of several items can touch a record in several ways
        return insert_if_absent(found.join(due, ["kind", "key"]).where(F.col("ts") >= F.col("since")).select(columns), stored, keys)

    most = named.groupBy("record_type", "record_id").agg(F.sum("n").alias("n")).select("n").union(asked.select("n")).agg(F.max("n")).first()[0]
    block = F.pmod(F.xxhash64("item_id"), F.lit(max(1, -(-(most or 0) // WATCH_BLOCK)))).alias("block")
    members = due.groupBy("kind", "key", block).agg(F.collect_list(F.struct("item_id", "since", "news")).alias("items"))
    blocks = members.groupBy("kind", "key").agg(F.collect_list("block").alias("blocks"))
    known = stored.groupBy("record_type", "record_id", block).agg(F.collect_set("item_id").alias("known"))
    # the least row of a record that an item has not passed stands for it
    seen = found.groupBy("record_type", "record_id", "kind", "key").agg(F.array_sort(F.collect_set(F.struct("ts", "severity"))).alias("seen"))
    met = seen.join(blocks, ["kind", "key"]).withColumn("block", F.explode("blocks")).drop("blocks").join(known, ["record_type", "record_id", "block"], "left")
    # a number of its own keeps adaptive execution from joining partitions that are small only until items are spread out
    spark = items.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    by = ["kind", "key", "block"]
    met = met.repartition(parts, *by).join(members.repartition(parts, *by), by)
    fresh = F.filter("items", lambda i: (F.element_at("seen", -1)["ts"] >= i["since"]) & ~F.coalesce(F.array_contains("known", i["item_id"]), F.lit(False)))
    out = met.select("record_type", "record_id", "kind", "key", "seen", F.explode(fresh).alias("i"))
    return out.withColumn("r", F.filter("seen", lambda r: r["ts"] >= F.col("i.since"))[0]).select("i.item_id", "kind", "key", "record_type", "record_id", "r.ts", "r.severity", "i.news").select(columns)


def watch_alerts(hits: DataFrame) -> DataFrame:
    """One alert per item with new hits and its worst severity; an item's first pass is context, not news."""
    return hits.where("news").groupBy("item_id", "kind", "key").agg(F.count("*").alias("hits"), rank_severity(F.max(severity_rank(F.col("severity")))).alias("severity"), F.max("ts").alias("last_hit"))
