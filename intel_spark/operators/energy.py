"""Cargo flows: facility calls, shipments and dark-oil indicators."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.vessel import dwell_hours, estimate_cargo, is_tanker, matches_commodity
from intel_spark.operators.maritime import flagged, risky, stays
from intel_spark.operators.names import screen_names
from intel_spark.operators.sanctions import upsert
from intel_spark.operators.spatial import facility_containing
from intel_spark.operators.timeline import asof

# Origins, facility kinds and pattern scores.
SANCTIONED_ORIGINS = ["RU", "IR", "VE", "SY", "KP", "CU"]
EXPORT_TYPES = ["crude_export", "product_export", "lng_export", "refinery"]
PATTERN_SCORES = {
    "sanctioned_loading": (0.55, "medium"), "ais_gap_after_loading": (0.75, "high"), "sts_transfer": (0.7, "high"), "sts_hub_loitering": (0.6, "medium"),
    "spoofed_position": (0.8, "high"), "identity_change": (0.65, "high"), "sanctioned_vessel_loading": (0.9, "critical"), "discharge_to_sanctioned_destination": (0.7, "high"),
}


def _days(n: float) -> Column:
    return F.expr(f"INTERVAL {int(n * 24)} HOURS")


def sync_facilities(dim: DataFrame, stored: DataFrame, listings: DataFrame, min_ratio: float = 0.9) -> DataFrame:
    """Facilities with a flag for owners that match a listing; the owner's name ends before a bracket."""
    owner = F.trim(F.substring_index("owner", "(", 1))
    names = dim.where(F.col("owner") != "").select(owner.alias("name_id"), owner.alias("name")).distinct()
    hit = screen_names(names, listings, min_ratio, ["company"]).select(F.col("name_id").alias("_owner")).distinct().withColumn("_hit", F.lit(True))
    flags = dim.withColumn("_owner", owner).join(hit, "_owner", "left").withColumn("owner_sanctioned", F.coalesce("_hit", F.lit(False))).drop("_owner", "_hit")
    return upsert(flags.withColumn("_at", F.lit(1)), stored.withColumn("_at", F.lit(0)), ["name"], "_at").drop("_at")


def link_facilities(calls: DataFrame, facilities: DataFrame, vessels: DataFrame) -> DataFrame:
    """Calls at a port that serves a facility, for ships that can carry its commodity."""
    dims = facilities.where(F.col("port_name").isNotNull()).select(F.col("id").alias("linked_facility"), F.col("port_name").alias("port"), "commodity")
    hulls = vessels.select(F.col("id").alias("vessel_id"), "ship_type")
    joined = calls.join(dims, "port").join(hulls, "vessel_id")
    return joined.where(matches_commodity(F.col("ship_type"), F.col("commodity"))).drop("commodity", "ship_type")


def facility_visits(positions: DataFrame, facilities: DataFrame, as_of: datetime, enter_speed: float = 1.5, leave_speed: float = 4.0, lost_hours: float = 48.0) -> DataFrame:
    """Tanker stays at facilities that are not ports; a hull silent for ``lost_hours`` has left coverage."""
    tankers = positions.where(is_tanker(F.col("ship_type"))).select("mmsi", "ts", "lat", "lon", "speed", "draught", "ship_type")
    own = facilities.select("id", F.col("port_name").isNull().alias("own_calls"))
    placed = facility_containing(tankers, facilities)
    fits = F.col("facility").isNotNull() & matches_commodity(F.col("ship_type"), F.col("facility.commodity"))
    placed = placed.withColumn("facility_id", F.when(fits, F.col("facility.id"))).drop("facility", "facility_km", "lat", "lon", "ship_type")
    placed = placed.join(own, placed.facility_id == own.id, "left").drop("id")
    found = stays(placed, "mmsi", "facility_id", enter_speed, leave_speed, F.coalesce("own_calls", F.lit(False)), ["draught"])
    lost = F.col("departure").isNull() & (F.col("last_inside") < F.lit(as_of) - _days(lost_hours / 24))
    found = found.withColumn("flags", F.when(lost, F.array(F.lit("lost_contact"))).otherwise(F.array().cast("array<string>"))).withColumn("departure", F.when(lost, F.col("last_inside")).otherwise(F.col("departure")))
    return found.withColumn("dwell_h", dwell_hours(F.col("arrival"), F.col("departure"))).drop("last_inside")


def build_shipments(calls: DataFrame, vessels: DataFrame, facilities: DataFrame, as_of: datetime, lookback_days: int = 60, stale_days: int = 75) -> DataFrame:
    """Laden departures from export facilities and hubs, closed by the vessel's next call more than six hours later."""
    f = facilities.select(F.col("id").alias("facility_id"), F.col("name").alias("loading_location"), F.col("type").alias("facility_type"), F.col("country").alias("origin"), "commodity", "sanctioned")
    v = vessels.select(F.col("id").alias("vessel_id"), "mmsi", "ship_type", "length_m", "sanctioned_status", "risk_score")
    departed = calls.where(F.col("facility_id").isNotNull() & (F.col("departure") >= F.lit(as_of) - _days(lookback_days)) & (F.col("departure") <= F.lit(as_of)))
    loaded = departed.join(f, "facility_id").join(v, "vessel_id").where(is_tanker(F.col("ship_type")) & (F.col("facility_type").isin(EXPORT_TYPES) | (F.col("facility_type") == "sts_hub")))
    loaded = loaded.withColumn("cargo", estimate_cargo(F.col("length_m"), F.col("draught_arr"), F.col("draught_dep"), F.col("commodity")))
    loaded = loaded.where(F.col("cargo.laden").isNull() | F.col("cargo.laden") | (F.col("facility_type") == "sts_hub"))
    route = F.coalesce("sanctioned", F.lit(False)) | F.col("origin").isin(SANCTIONED_ORIGINS)
    suspect = route & risky(F.col("sanctioned_status"), F.col("risk_score"))
    risk = F.round(0.3 + F.when(route, 0.4).otherwise(0.0) + F.when(flagged(F.col("sanctioned_status")), 0.3).otherwise(0.0), 2)
    ships = loaded.select(
        F.col("id").alias("shipment_id"), "vessel_id", "mmsi", "facility_id", "loading_location", "facility_type", "origin", F.col("departure").alias("loading_date"), F.coalesce("commodity", F.lit("unknown")).alias("cargo_type"),
        F.col("cargo.barrels").alias("barrels"), F.col("cargo.laden").alias("laden"), F.col("cargo.size_class").alias("size_class"), F.col("cargo.basis").alias("basis"), route.alias("sanctioned_route"), suspect.alias("dark_oil_suspect"), risk.alias("risk_score"),
    )
    hubs = facilities.select(F.col("id").alias("facility_id"), (F.col("type") == "sts_hub").alias("is_hub"))
    arrivals = calls.join(hubs, "facility_id", "left").select("vessel_id", F.col("arrival").alias("ts"), F.col("id").alias("call_id"), "port", "country", F.col("facility_id").alias("to_facility"), F.coalesce("is_hub", F.lit(False)).alias("is_hub"))
    probe = ships.withColumn("ts", F.timestamp_micros(F.unix_micros("loading_date") + 6 * 3_600_000_000 + 1))
    closed = asof(probe, arrivals, ["vessel_id"], "ts", ["call_id", "port", "country", "to_facility", "is_hub"], "forward", tie="call_id").drop("ts")
    done = F.col("match").isNotNull()
    status = F.when(done & F.col("match.is_hub"), "transshipped").when(done, "discharged").when(F.col("loading_date") < F.lit(as_of) - _days(stale_days), "stale").otherwise("underway")
    return closed.select(
        *ships.columns, status.alias("status"), F.col("match.ts").alias("discharge_date"), F.col("match.port").alias("discharge_location"), F.col("match.country").alias("destination"), F.col("match.to_facility").alias("discharge_facility"),
        F.coalesce("match.is_hub", F.lit(False)).alias("transshipment_suspect"),
    )


def events_within(left: DataFrame, events: DataFrame, by: str, start: str, end: Column) -> DataFrame:
    """Events of the same hull inside each left row's interval.

    The interval's days are part of the join key, so a hull's events only meet the intervals that touch their day; an
    event has one day and an interval each day once, so no pair repeats.
    """
    spread = left.withColumn("_end", end).where(F.col("_end") >= F.col(start)).withColumn("_day", F.explode(F.sequence(F.to_date(start), F.to_date("_end"))))
    dated = events.withColumn("_day", F.to_date("ts"))
    return spread.join(dated, [by, "_day"]).where((F.col("ts") >= F.col(start)) & (F.col("ts") <= F.col("_end"))).drop("_end", "_day")


def score_pattern(pattern: Column, vessel_flagged: Column, vessel_risk: Column, extra: Column) -> Column:
    """Struct(score, severity) of a dark-oil pattern for one vessel."""
    table = F.create_map(*[x for k, (b, s) in PATTERN_SCORES.items() for x in (F.lit(k), F.struct(F.lit(b).alias("base"), F.lit(s).alias("severity")))])
    entry = F.try_element_at(table, pattern)
    bonus = F.when(vessel_flagged, 0.15).when(F.coalesce(vessel_risk, F.lit(0.0)) >= 0.5, 0.05).otherwise(0.0)
    score = F.round(F.least(F.lit(1.0), F.coalesce(entry["base"], F.lit(0.5)) + extra + bonus), 2)
    severity = F.when(score >= 0.85, "critical").when((score >= 0.7) & (F.coalesce(entry["severity"], F.lit("medium")) == "medium"), "high").otherwise(F.coalesce(entry["severity"], F.lit("medium")))
    return F.struct(score.alias("score"), severity.alias("severity"))


def dark_oil(shipments: DataFrame, evasion: DataFrame, sts: DataFrame, calls: DataFrame, vessels: DataFrame, facilities: DataFrame, as_of: datetime, lookback_days: int = 30, loiter_hours: float = 24.0, existing: DataFrame | None = None) -> DataFrame:
    """Dark-oil patterns, one per (tanker, pattern, shipment), with score and severity.

    Events join shipments on the hull and the voyage interval and are reduced to one row per pattern at once.
    """
    hulls = vessels.select(F.col("id").alias("vessel_id"), "sanctioned_status", F.col("risk_score").alias("v_risk"))
    voyages = shipments.where(F.col("sanctioned_route") & (F.col("loading_date") >= F.lit(as_of) - _days(lookback_days))).select("shipment_id", "vessel_id", "origin", "destination", "loading_date", "discharge_date")
    end = F.coalesce("discharge_date", F.lit(as_of)) + _days(2)
    columns = ["vessel_id", "shipment_id", "pattern", "evidence_id", "extra", "voyage_start"]
    none = F.lit(None).cast("long")
    # sailing from a sanctioned place, told apart by the hull's own status
    loading = voyages.join(hulls, "vessel_id").select("vessel_id", "shipment_id", F.when(flagged(F.col("sanctioned_status")), "sanctioned_vessel_loading").otherwise("sanctioned_loading").alias("pattern"), none.alias("evidence_id"), F.lit(0.0).alias("extra"), F.col("loading_date").alias("voyage_start"))
    kind = F.when(F.col("event_type") == "ais_gap", "ais_gap_after_loading").when(F.col("event_type") == "position_anomaly", "spoofed_position").when(F.col("event_type").isin("name_change", "flag_change", "identity_conflict"), "identity_change")
    signs = evasion.withColumn("pattern", kind).where(F.col("pattern").isNotNull()).select("vessel_id", "ts", "pattern", F.col("id").alias("evidence_id"), F.lit(0.0).alias("extra"))
    ends = F.explode(F.array_distinct(F.array("vessel_a", "vessel_b")))
    met = sts.select("ts", F.col("id").alias("evidence_id"), F.when(F.coalesce("confidence", F.lit(0.0)) >= 0.7, 0.1).otherwise(0.0).alias("extra"), ends.alias("vessel_id")).withColumn("pattern", F.lit("sts_transfer"))
    during = events_within(voyages, signs.unionByName(met.select(*signs.columns)), "vessel_id", "loading_date", end)
    # the first event of a pattern on a voyage is the one reported
    during = during.groupBy("vessel_id", "shipment_id", "pattern").agg(F.min_by(F.struct("evidence_id", "extra"), F.struct("ts", "evidence_id")).alias("e"), F.min("loading_date").alias("voyage_start"))
    during = during.select("vessel_id", "shipment_id", "pattern", "e.evidence_id", "e.extra", "voyage_start")
    delivered = voyages.where(F.col("destination").isin(SANCTIONED_ORIGINS) & (F.col("destination") != F.col("origin"))).select("vessel_id", "shipment_id", F.lit("discharge_to_sanctioned_destination").alias("pattern"), none.alias("evidence_id"), F.lit(0.0).alias("extra"), F.col("loading_date").alias("voyage_start"))
    hubs = facilities.where(F.col("type") == "sts_hub").select(F.col("id").alias("facility_id"), F.when(F.col("sanctioned"), 0.1).otherwise(0.0).alias("extra"))
    waiting = calls.where(F.col("departure").isNull() & (F.col("arrival") <= F.lit(as_of) - _days(loiter_hours / 24))).join(hubs, "facility_id")
    # without a shipment the pattern counts once per vessel and week
    waiting = waiting.groupBy("vessel_id").agg(F.min_by(F.struct(F.col("id").alias("evidence_id"), "extra"), F.struct("arrival", "id")).alias("e")).select("vessel_id", none.alias("shipment_id"), F.lit("sts_hub_loitering").alias("pattern"), "e.evidence_id", "e.extra", F.lit(None).cast("timestamp").alias("voyage_start"))
    found = loading.select(columns).unionByName(during.select(columns)).unionByName(delivered.select(columns)).unionByName(waiting.select(columns))
    if existing is not None:
        same = found.vessel_id.eqNullSafe(existing.vessel_id) & (found.pattern == existing.pattern) & found.shipment_id.eqNullSafe(existing.shipment_id)
        found = found.join(existing.select("vessel_id", "pattern", "shipment_id"), same, "left_anti")
    scored = found.join(hulls, "vessel_id").withColumn("s", score_pattern(F.col("pattern"), flagged(F.col("sanctioned_status")), F.col("v_risk"), F.col("extra")))
    return scored.select("vessel_id", "shipment_id", "pattern", "evidence_id", "voyage_start", F.col("s.score").alias("confidence"), F.col("s.severity").alias("severity"))


def raise_shipment_risk(shipments: DataFrame, indicators: DataFrame) -> DataFrame:
    """Each indicator adds 0.15 to its shipment's risk, up to 1, and marks it suspect."""
    counts = indicators.where(F.col("shipment_id").isNotNull()).groupBy("shipment_id").agg(F.count("*").alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return shipments.join(counts, "shipment_id", "left").withColumn("risk_score", F.round(F.least(F.lit(1.0), F.col("risk_score") + 0.15 * n), 2)).withColumn("dark_oil_suspect", F.col("dark_oil_suspect") | (n > 0)).drop("_n")


def flow_snapshots(calls: DataFrame, shipments: DataFrame, vessels: DataFrame, as_of: datetime, days: int = 35) -> DataFrame:
    """Per facility and day: arrivals, departures, laden departures, barrels, flagged tankers. Facts of every kind
    become thin rows and meet in one aggregation."""
    since = F.lit(as_of) - _days(days)
    hulls = vessels.where(is_tanker(F.col("ship_type"))).select(F.col("id").alias("vessel_id"), risky(F.col("sanctioned_status"), F.col("risk_score")).cast("int").alias("flag"))
    tanker_calls = calls.where(F.col("facility_id").isNotNull()).join(hulls, "vessel_id")
    zero, none = F.lit(0), F.lit(None).cast("double")
    arrived = tanker_calls.where(F.col("arrival") >= since).select("facility_id", F.to_date("arrival").alias("day"), F.lit(1).alias("a"), zero.alias("d"), zero.alias("l"), none.alias("b"), F.col("flag").alias("f"))
    left = tanker_calls.where(F.col("departure") >= since).select("facility_id", F.to_date("departure").alias("day"), zero.alias("a"), F.lit(1).alias("d"), zero.alias("l"), none.alias("b"), zero.alias("f"))
    loaded = shipments.where(F.col("loading_date") >= since).select("facility_id", F.to_date("loading_date").alias("day"), zero.alias("a"), zero.alias("d"), F.coalesce(F.col("laden"), F.lit(False)).cast("int").alias("l"), F.col("barrels").alias("b"), zero.alias("f"))
    facts = arrived.unionByName(left).unionByName(loaded)
    return facts.groupBy("facility_id", "day").agg(F.sum("a").alias("arrivals"), F.sum("d").alias("departures"), F.sum("l").alias("laden_departures"), F.nullif(F.sum("b"), F.lit(0.0)).alias("barrels"), F.sum("f").alias("flagged_tankers"))


def facility_counters(facilities: DataFrame, calls: DataFrame, shipments: DataFrame, vessels: DataFrame, as_of: datetime, days: int = 35) -> DataFrame:
    """Calls in 7 and 30 days, last activity and utilisation per facility."""
    now = F.lit(as_of)
    tankers = vessels.where(is_tanker(F.col("ship_type"))).select(F.col("id").alias("vessel_id"))
    seen = calls.where(F.col("facility_id").isNotNull() & (F.col("arrival") >= now - _days(days))).join(tankers, "vessel_id", "left_semi")
    counts = seen.groupBy("facility_id").agg(F.count_if(F.col("arrival") >= now - _days(7)).alias("c7"), F.count_if(F.col("arrival") >= now - _days(30)).alias("c30"), F.max("arrival").alias("last_activity"))
    volume = shipments.where(F.col("loading_date") >= now - _days(days)).groupBy("facility_id").agg(F.sum("barrels").alias("bbl"))
    joined = facilities.select(F.col("id").alias("facility_id"), "name", "capacity_bpd").join(counts, "facility_id", "left").join(volume, "facility_id", "left")
    use = F.when((F.coalesce("capacity_bpd", F.lit(0.0)) > 0) & (F.coalesce("bbl", F.lit(0.0)) > 0), F.round(F.least(F.lit(1.5), F.col("bbl") / (F.col("capacity_bpd") * 30)), 3))
    return joined.select("facility_id", "name", F.coalesce("c7", F.lit(0)).alias("calls_7d"), F.coalesce("c30", F.lit(0)).alias("calls_30d"), "last_activity", use.alias("utilization"))


def price_context(snapshots: DataFrame, facilities: DataFrame, candles: DataFrame, as_of: datetime, days: int = 30, assets: tuple[str, ...] = ("BRENT", "OIL")) -> tuple[DataFrame, DataFrame]:
    """Daily flows of sanctioned facilities beside the daily mean close of the first asset with data, and their correlation."""
    since = F.lit(as_of) - _days(days)
    places = facilities.where("sanctioned").select(F.col("id").alias("facility_id"))
    flows = snapshots.where(F.col("day") >= F.to_date(since)).join(places, "facility_id", "left_semi").groupBy("day").agg(F.sum("laden_departures").alias("laden_departures"), F.sum(F.coalesce("barrels", F.lit(0.0))).alias("barrels"), F.sum("arrivals").alias("arrivals"), F.sum("flagged_tankers").alias("flagged"))
    rank = F.array_position(F.array(*[F.lit(a) for a in assets]), F.col("asset"))
    daily = candles.where(F.col("asset").isin(list(assets)) & (F.col("ts") >= since)).groupBy("asset", F.to_date("ts").alias("day")).agg(F.avg("close").alias("price"))
    # daily rows number at most the period times the assets
    first = daily.agg(F.min(rank).alias("best"))
    prices = daily.join(first, rank == F.col("best")).select("day", F.round("price", 2).alias("price"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    series = flows.join(prices, "day", "full_outer").select("day", zero("laden_departures"), F.coalesce("barrels", F.lit(0.0)).alias("barrels"), zero("arrivals"), zero("flagged"), "price")
    paired = series.where(F.col("price").isNotNull())
    stat = paired.agg(F.count("*").alias("n"), F.corr(F.col("laden_departures").cast("double"), F.col("price")).alias("c"), F.var_pop("laden_departures").alias("vx"), F.var_pop("price").alias("vy"))
    return series, stat.select("n", F.when((F.col("n") >= 5) & (F.col("vx") > 0) & (F.col("vy") > 0), F.round("c", 3)).alias("correlation"))


def energy_summary(shipments: DataFrame, indicators: DataFrame, counters: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Tidy (metric, key, value): totals, patterns, origins, destinations, busiest facilities."""
    recent = shipments.where(F.col("loading_date") >= F.lit(as_of) - _days(days))
    totals = recent.agg(
        F.count("*").cast("double").alias("shipments"), F.count_if("sanctioned_route").cast("double").alias("sanctioned_shipments"), F.round(F.coalesce(F.sum(F.when(F.col("sanctioned_route"), F.col("barrels"))), F.lit(0.0))).alias("sanctioned_barrels")
    ).unpivot([], ["shipments", "sanctioned_shipments", "sanctioned_barrels"], "metric", "value").select("metric", F.lit("").alias("key"), "value")
    count = lambda df, metric, key: df.groupBy(F.lit(metric).alias("metric"), F.col(key).alias("key")).agg(F.count("*").cast("double").alias("value"))
    busy = counters.where("calls_7d > 0").orderBy(F.col("calls_7d").desc(), "name").limit(8).select(F.lit("most_active").alias("metric"), F.col("name").alias("key"), F.col("calls_7d").cast("double").alias("value"))
    return totals.unionByName(count(indicators, "pattern", "pattern")).unionByName(count(recent, "origin", "origin")).unionByName(count(recent.where(F.col("destination").isNotNull()), "destination", "destination")).unionByName(busy)
