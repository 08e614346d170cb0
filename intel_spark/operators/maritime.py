"""Vessel-track detectors, rendezvous, port calls and risk."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.geo import cell, haversine_m, neighbour_offsets, wrapped_column
from intel_spark.functions.scoring import hours_between, noisy_or
from intel_spark.functions.text import name_token
from intel_spark.functions.vessel import dwell_hours, lookup, plausible_max_speed, predicted_cargo, tanker_hull
from intel_spark.operators.graph import reachable
from intel_spark.session import checkpoint_ready
from intel_spark.operators.spatial import KM_PER_DEGREE, POLAR_LATITUDE, areas_at, areas_containing, port_containing, with_inland
from intel_spark.operators.timeline import (
    around_row, asof, asof_nearest, drop_bucket, gap_islands, islands, last_known, latest_per_key, previous_row, previous_rows, running_max, running_sum,
)

# Zone kinds that raise severity, flags, weights.
HIGH_RISK_KINDS = ["sanctions_zone", "war_zone"]
CONVENIENCE_FLAGS = ["GA", "CM", "SL", "KM", "PW", "CK", "LR", "MH", "PA"]
UNKNOWN_FLAG = "XX"
SHADOW_FLEET_FLAGS = ["GA", "CM", "SL", "KM", "PW", "CK", "SM", "GM", "TZ", "MN", "XX"]
SEVERITY_WEIGHT = {"low": 0.05, "medium": 0.12, "high": 0.25, "critical": 0.4}
LINK_WEIGHTS = {"shared_owner": 0.6, "shared_beneficial_owner": 0.7, "shared_operator": 0.5, "shared_sanctions_entity": 0.8, "transshipment_partner": 0.7, "shared_high_risk_port": 0.3}
MAX_IMPLIED_KNOTS = 60.0


def flagged(status: Column) -> Column:
    return F.coalesce(status, F.lit("clear")) != "clear"


def risky(status: Column, risk: Column) -> Column:
    return flagged(status) | (F.coalesce(risk, F.lit(0.0)) >= 0.5)


def _risk_zones(areas: Column) -> Column:
    return F.transform(F.filter(areas, lambda a: a["kind"].isin(HIGH_RISK_KINDS)), lambda a: a["name"])


def ais_gaps(positions: DataFrame, zones: DataFrame, hours: float = 6.0) -> DataFrame:
    """Silences of at least ``hours``, graded by speed before them, length, and risk zones at either end."""
    return grade_gaps(drop_bucket(previous_row(positions, ["mmsi"], "ts", ["ts", "speed", "lat", "lon"])), zones, hours)


def grade_gaps(seen: DataFrame, zones: DataFrame, hours: float = 6.0) -> DataFrame:
    """W08 on fixes that carry ``prev``; zones are looked up only for the few rows that end a gap."""
    gaps = seen.withColumn("gap_hours", hours_between(F.col("prev.ts"), F.col("ts"))).where(F.col("gap_hours") >= hours)
    gaps = gaps.select("mmsi", "ts", "lat", "lon", "gap_hours", F.col("prev.ts").alias("last_seen"), (F.coalesce("prev.speed", F.lit(0.0)) >= 1.0).alias("underway"), F.col("prev.lat").alias("plat"), F.col("prev.lon").alias("plon"))
    both = areas_containing(areas_at(gaps, zones, F.col("plat"), F.col("plon"), "before"), zones, "after")
    zones_hit = F.concat(_risk_zones(F.col("before")), _risk_zones(F.col("after")))
    in_zone, long_gap = F.size("zones") > 0, F.col("gap_hours") >= 4 * hours
    rank = F.when(in_zone & long_gap, 0).when(in_zone, 1).when(F.col("underway") & long_gap, 2).when(F.col("underway"), 3).otherwise(4)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), rank + 1)
    return both.withColumn("zones", zones_hit).select(
        "mmsi", "ts", "lat", "lon", F.lit("ais_gap").alias("event_type"), F.round("gap_hours", 2).alias("gap_hours"), "last_seen", "underway", "zones",
        pick(["critical", "high", "high", "medium", "low"]).alias("severity"), pick([0.85, 0.7, 0.6, 0.45, 0.25]).alias("confidence"),
    )


def position_anomalies(positions: DataFrame) -> DataFrame:
    """Speeds no such ship makes, and jumps over 5 nm implying more than 60 knots."""
    return grade_positions(drop_bucket(previous_row(positions, ["mmsi"], "ts", ["ts", "lat", "lon"])))


def grade_positions(seen: DataFrame) -> DataFrame:
    """W09 on fixes that carry ``prev``."""
    limit = plausible_max_speed(F.col("ship_type"))
    hours = hours_between(F.col("prev.ts"), F.col("ts"))
    nm = haversine_m(F.col("prev.lat"), F.col("prev.lon"), F.col("lat"), F.col("lon")) / 1852
    moved = seen.withColumn("limit", limit).withColumn("hours", F.when(hours > 0, hours)).withColumn("distance_nm", F.when(F.col("hours").isNotNull(), nm))
    moved = moved.withColumn("implied_kn", F.col("distance_nm") / F.col("hours"))
    fast = F.coalesce(F.col("speed") > F.col("limit"), F.lit(False))
    jump = F.coalesce((F.col("distance_nm") > 5) & (F.col("implied_kn") > MAX_IMPLIED_KNOTS), F.lit(False))
    implied = F.round("implied_kn", 1)
    severe = (fast & jump) | (F.coalesce(implied, F.lit(0.0)) > 200) | (F.coalesce("speed", F.lit(0.0)) > 2 * F.col("limit"))
    reasons = F.array_compact(F.array(F.when(fast, "speed"), F.when(jump, "jump")))
    return moved.where(fast | jump).select(
        "mmsi", "ts", "lat", "lon", "speed", F.lit("position_anomaly").alias("event_type"), reasons.alias("reasons"), F.round("distance_nm", 1).alias("distance_nm"), implied.alias("implied_kn"),
        F.when(severe, "high").otherwise("medium").alias("severity"), F.when(severe, 0.65).otherwise(0.45).alias("confidence"),
    )


def identity_changes(positions: DataFrame) -> DataFrame:
    """Renames that are not spelling variants or a return to one of the last three names, and flag changes."""
    named = positions.where(F.col("name").isNotNull()).withColumn("token", name_token(F.col("name")))
    runs = drop_bucket(previous_row(named.select("mmsi", "ts", "name", "token"), ["mmsi"], "ts", ["name", "token"]))
    runs = runs.where(F.col("prev").isNull() | (F.col("prev.token") != F.col("token"))).withColumnRenamed("prev", "last")
    history = drop_bucket(previous_rows(runs, ["mmsi"], "ts", ["token"], 4))
    # the array's last entry is the name being replaced; the three before it are the recent history
    recent = F.transform(F.slice("prev", 1, F.greatest(F.size("prev") - 1, F.lit(0))), lambda p: p["token"])
    renames = history.where(F.col("last").isNotNull() & ~F.array_contains(recent, F.col("token")) & ~F.startswith(F.col("last.name"), F.lit("MMSI "))).select(
        "mmsi", "ts", F.lit("name_change").alias("event_type"), F.lit("medium").alias("severity"), F.lit(0.5).alias("confidence"), F.col("last.name").alias("old_value"), F.col("name").alias("new_value")
    )
    flags = positions.where(F.col("flag").isNotNull() & (F.col("flag") != UNKNOWN_FLAG)).select("mmsi", "ts", "flag")
    moves = drop_bucket(previous_row(flags, ["mmsi"], "ts", ["flag"])).where(F.col("prev.flag") != F.col("flag")).select(
        "mmsi", "ts", F.lit("flag_change").alias("event_type"), F.lit("high").alias("severity"), F.lit(0.6).alias("confidence"), F.col("prev.flag").alias("old_value"), F.col("flag").alias("new_value")
    )
    return renames.unionByName(moves)


def imo_conflicts(positions: DataFrame, silence_hours: float = 24.0) -> DataFrame:
    """An IMO reported by a second MMSI. A holder silent for longer than ``silence_hours`` hands the identity over
    (transfer); a live holder keeps it (conflict, one per pair and day).

    Reports shrink to live intervals per (IMO, MMSI). Each interval hands over to the one holding the first report
    after its silence, so holders form chains that are followed by doubling links instead of walking each IMO in order.
    """
    day = int(silence_hours * 3_600_000_000)
    reports = positions.where(F.col("imo").isNotNull()).select("imo", "mmsi", "ts", "flag")
    live = drop_bucket(gap_islands(reports, ["imo", "mmsi"], "ts", silence_hours * 3600))
    live = cut(live.withColumn("interval", F.concat_ws("|", "imo", "mmsi", F.col("island").cast("string"))))
    spans = live.groupBy("imo", "mmsi", "interval").agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
    ends = spans.select("imo", "interval", F.timestamp_micros(F.unix_micros("end") + day + 1).alias("ts"))
    handover = cut(asof(ends, live.select("imo", "ts", "mmsi", "interval"), ["imo"], "ts", ["interval"], "forward", tie="mmsi"))
    links = handover.where(F.col("match").isNotNull()).select(F.col("interval").alias("id"), F.col("match.interval").alias("next"))
    heads = spans.groupBy("imo").agg(F.min_by("interval", F.struct("start", "mmsi")).alias("id"))
    held = reachable(links, heads.select("id"))
    # the moment each holding interval took over: the report that followed the silence, or the first report of all
    took = handover.where(F.col("match").isNotNull()).join(held, F.col("interval") == F.col("id"), "left_semi").select(F.col("match.interval").alias("interval"), F.col("match.ts").alias("ts"))
    took = took.unionByName(spans.join(heads, spans.interval == heads.id, "left_semi").select("interval", F.col("start").alias("ts"))).groupBy("interval").agg(F.min("ts").alias("ts"))
    owners = took.join(spans.select("interval", "imo", "mmsi"), "interval").select("imo", "ts", F.col("mmsi").alias("holder"))
    owners = drop_bucket(previous_row(owners, ["imo"], "ts", ["holder"]))
    flags = reports.groupBy("mmsi").agg(F.max_by("flag", F.struct("ts", "flag")).alias("flag"))
    transfers = owners.where(F.col("prev.holder") != F.col("holder")).select("imo", "ts", F.col("holder").alias("mmsi"), F.col("prev.holder").alias("holder"), F.lit("identity_transfer").alias("kind"))
    claimed = asof(reports, owners.select("imo", "ts", "holder"), ["imo"], "ts", ["holder"], tie="holder").where(F.col("match.holder") != F.col("mmsi"))
    conflicts = claimed.groupBy("imo", "mmsi", F.col("match.holder").alias("holder"), F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts")).select("imo", "ts", "mmsi", "holder", F.lit("identity_conflict").alias("kind"))
    found = transfers.unionByName(conflicts)
    found = found.join(flags, "mmsi", "left").join(flags.select(F.col("mmsi").alias("holder"), F.col("flag").alias("holder_flag")), "holder", "left")
    changed = ~F.col("flag").eqNullSafe(F.col("holder_flag"))
    return found.select("imo", "ts", "mmsi", "holder", "kind", F.when(changed, "high").otherwise("medium").alias("severity"), F.when(changed, 0.65).otherwise(0.5).alias("confidence"))


def fold_anomalies(events: DataFrame, hours: float = 6.0) -> DataFrame:
    """Repeats within ``hours`` of the previous one become a single event with a counter.

    Sessions are merged inside each map task first, so a vessel that holds most events ships sessions, not rows.
    """
    return events.groupBy("mmsi", F.session_window("ts", f"{int(hours * 3600)} seconds").alias("w")).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("ts"), F.count("*").alias("repeats"), F.max("confidence").alias("confidence"), F.max_by("lat", "ts").alias("lat"), F.max_by("lon", "ts").alias("lon")
    ).drop("w")


def contact_duration(pairs: DataFrame, positions: DataFrame, as_of: datetime, metres: float = 500.0, window_hours: float = 8.0, tolerance_s: int = 900, break_minutes: int = 20) -> DataFrame:
    """Minutes each pair (a_id, b_id) has stayed close up to its last close fix, and when that began.

    Only fixes inside the look-back take part, so a pair's history is bounded by the reporting rate.
    """
    recent = positions.where((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {int(window_hours * 60)} MINUTES")) & (F.col("ts") <= F.lit(as_of)))
    ids = pairs.select("a_id", "b_id").distinct()
    a = ids.join(recent.select(F.col("vessel_id").alias("a_id"), "ts", "lat", "lon"), "a_id")
    b = ids.join(recent.select(F.col("vessel_id").alias("b_id"), "ts", "lat", "lon"), "b_id")
    met = asof_nearest(a, b, ["a_id", "b_id"], "ts", ["lat", "lon"], tolerance_s, tie="lat").where(F.col("match").isNotNull())
    close = haversine_m(F.col("lat"), F.col("lon"), F.col("match.lat"), F.col("match.lon")) <= metres * 1.5
    fixes = met.select("a_id", "b_id", "ts", close.alias("close"))
    pair = Window.partitionBy("a_id", "b_id").orderBy("ts")
    last_close = F.last(F.when(F.col("close"), F.col("ts")), ignorenulls=True).over(pair.rowsBetween(Window.unboundedPreceding, -1))
    broke = ~F.col("close") & F.col("last_close").isNotNull() & (F.unix_micros("ts") - F.unix_micros("last_close") > break_minutes * 60_000_000)
    runs = fixes.withColumn("last_close", last_close).withColumn("island", F.sum(F.when(broke, 1).otherwise(0)).over(pair))
    spans = runs.groupBy("a_id", "b_id", "island").agg(F.min(F.when(F.col("close"), F.col("ts"))).alias("start"), F.max(F.when(F.col("close"), F.col("ts"))).alias("end"))
    final = spans.groupBy("a_id", "b_id").agg(F.max_by(F.struct("start", "end"), "island").alias("s")).where(F.col("s.start").isNotNull())
    return final.select("a_id", "b_id", F.col("s.start").alias("started_at"), F.floor((F.unix_micros("s.end") - F.unix_micros("s.start")) / 6e7).cast("int").alias("duration_min"))


def merge_contacts(candidates: DataFrame, slack_hours: float = 2.0, ceiling_hours: float = 48.0) -> DataFrame:
    """Candidates (a_id, b_id, start, end, distance_m, confidence) of one pair joined while they overlap or follow within the slack."""
    reach = F.unix_micros("end") + int(slack_hours * 3_600_000_000)
    seen = running_max(candidates, ["a_id", "b_id"], "start", reach, "_reach", tie=["end"])
    runs = islands(seen, ["a_id", "b_id"], "start", F.col("_reach").isNull() | (F.unix_micros("start") > F.col("_reach")), tie=["end"])
    merged = runs.groupBy("a_id", "b_id", "island").agg(
        F.min("start").alias("ts"), F.max("end").alias("end"), F.min("distance_m").alias("proximity_m"), F.max("confidence").alias("confidence"), F.count("*").alias("candidates")
    ).withColumn("duration_min", F.floor((F.unix_micros("end") - F.unix_micros("ts")) / 6e7))
    return merged.withColumn("status", F.when(F.col("duration_min") > ceiling_hours * 60, "dismissed").otherwise("possible")).drop("island")


def cut(df: DataFrame) -> DataFrame:
    """Write a step to the checkpoint folder so that the ones after it start from its result."""
    checkpoint_ready(df.sparkSession)
    return df.checkpoint()


def stays(fixes: DataFrame, key: str, place: str, enter_speed: float, leave_speed: float, may_open: Column, keep: list[str]) -> DataFrame:
    """Episodes in which a hull is held at one place: opened by a slow fix there, closed by the first fix elsewhere or at
    ``leave_speed``. The closing fix never opens the next stay.

    ``fixes`` hold one row per (key, ts) with ``place`` null when at none. Each episode carries ``keep`` values at the
    opening and at the closing fix.
    """
    slow = F.coalesce("speed", F.lit(0.0))
    marker = F.when(F.col(place).isNull() | (slow >= leave_speed), 0).when((slow <= enter_speed) & may_open, 1)
    rows = fixes.withColumn("m", marker)
    rows = previous_row(rows, [key], "ts", [place])
    first = F.col("prev").isNull() | ~F.col(f"prev.{place}").eqNullSafe(F.col(place))
    # each helper reads its input twice, so the chain is cut where the next steps build on it
    rows = cut(islands(rows.withColumn("first", first).drop("prev"), [key], "ts", F.col("first"), "run"))
    # What a run's end looks like before knowing whether its first fix was spent on closing the stay before it: either
    # settled by later fixes, or open exactly when that first fix was free to open. The latter flips with each run.
    later = F.when(~F.col("first"), F.col("m"))
    ends = rows.groupBy(key, "run").agg(F.min("ts").alias("run_ts"), F.max(F.when(F.col("first"), F.col("m"))).alias("m0"), F.max_by(later, F.when(later.isNotNull(), F.col("ts"))).alias("m1"))
    settled = F.when(F.col("m1").isNotNull(), F.col("m1")).when(F.coalesce("m0", F.lit(0)) != 1, F.lit(0))
    ends = ends.withColumn("settled", settled)
    ends = running_sum(ends, [key], "run_ts", F.when(F.col("settled").isNull(), 1).otherwise(0), "flips")
    ends = last_known(ends, [key], "run_ts", {"base": F.col("settled"), "base_flips": F.when(F.col("settled").isNotNull(), F.col("flips"))})
    ends = cut(ends)
    open_at_end = (F.coalesce("base", F.lit(0)) + F.col("flips") - F.coalesce("base_flips", F.lit(0))) % 2
    spent = drop_bucket(previous_row(ends.withColumn("open_end", open_at_end), [key], "run_ts", ["open_end"])).select(key, "run", (F.coalesce("prev.open_end", F.lit(0)) == 1).alias("spent"))
    rows = rows.join(spent, [key, "run"]).withColumn("m", F.when(F.col("first") & F.col("spent"), 0).otherwise(F.col("m")))
    rows = cut(last_known(rows, [key, "run"], "ts", {"state": F.col("m")}).withColumn("state", F.coalesce("state", F.lit(0))))
    rows = cut(around_row(rows, [key], "ts", ["ts", "state", "run", *keep]))
    opens = (F.col("state") == 1) & (F.col("prev").isNull() | (F.col("prev.state") == 0) | (F.col("prev.run") != F.col("run")))
    rows = islands(rows.withColumn("opens", opens), [key], "ts", F.col("opens"), "stay").where(F.col("state") == 1)
    at_open = [F.min_by(c, "ts").alias(f"{c}_arr") for c in keep]
    episodes = rows.groupBy(key, "stay", place).agg(F.min("ts").alias("arrival"), F.max_by("next", "ts").alias("n"), F.max("ts").alias("last_inside"), *at_open)
    return episodes.select(key, place, "arrival", F.col("n.ts").alias("departure"), "last_inside", *[f"{c}_arr" for c in keep], *[F.col(f"n.{c}").alias(f"{c}_dep") for c in keep])


def port_calls(positions: DataFrame, ports: DataFrame, vessels: DataFrame | None = None, unusual_dwell: float = 72.0) -> DataFrame:
    """Calls at ports with dwell and draughts; with ``vessels`` also X04 flags and the predicted cargo."""
    placed = port_containing(positions.select("mmsi", "ts", "lat", "lon", "speed", "draught"), ports).withColumn("port_name", F.col("port.name"))
    calls = stays(placed.drop("port", "port_km", "lat", "lon"), "mmsi", "port_name", 1.0, 3.0, F.lit(True), ["draught"])
    calls = calls.withColumn("dwell_h", dwell_hours(F.col("arrival"), F.col("departure"))).drop("last_inside")
    facts = ports.select(F.col("name").alias("port_name"), F.col("country").alias("port_country"), "risk_level", "sanctioned_facility")
    calls = calls.join(facts, "port_name")
    if vessels is None:
        return calls
    return port_flags(calls.join(vessels.select("mmsi", "flag", "ship_type", "sanctioned_status"), "mmsi", "left"), unusual_dwell)


def port_flags(calls: DataFrame, unusual_dwell: float = 72.0) -> DataFrame:
    """Warning flags of a call and the cargo its ship type suggests."""
    high = F.col("risk_level") == "high"
    convenience = high & F.col("flag").isNotNull() & F.col("port_country").isNotNull() & (F.col("flag") != F.col("port_country")) & F.col("flag").isin(CONVENIENCE_FLAGS)
    flags = F.array_compact(F.array(
        F.when(F.col("sanctioned_facility"), "sanctioned_facility"), F.when(high, "high_risk_port"), F.when(F.col("dwell_h") >= unusual_dwell, "unusual_dwell_time"),
        F.when(flagged(F.col("sanctioned_status")), "vessel_flagged"), F.when(convenience, "flag_of_convenience_at_high_risk_port"),
    ))
    return calls.withColumn("flags", flags).withColumn("cargo", predicted_cargo(F.col("ship_type"), F.col("sanctioned_facility")))


def zone_events(positions: DataFrame, zones: DataFrame, lanes: DataFrame, vessels: DataFrame) -> DataFrame:
    """First entry per vessel, area and UTC day; lanes only at choke points and only for risky vessels."""
    hulls = vessels.select(F.col("id").alias("vessel_id"), "mmsi", risky(F.col("sanctioned_status"), F.col("risk_score")).alias("risky"))
    inside = areas_containing(areas_containing(positions.select("mmsi", "ts", "lat", "lon"), zones, "zones"), lanes, "lanes")
    entry = lambda a, kind: F.struct(a["name"].alias("name"), kind.alias("kind"))
    kept = F.concat(
        F.transform(F.filter("zones", lambda a: a["kind"].isin(HIGH_RISK_KINDS)), lambda a: entry(a, a["kind"])),
        F.transform(F.filter("lanes", lambda a: a["choke_point"]), lambda a: entry(a, F.lit("choke_point"))),
    )
    days = inside.select("mmsi", "ts", F.explode(kept).alias("a")).groupBy("mmsi", F.col("a.name").alias("lane_name"), F.col("a.kind").alias("context"), F.to_date("ts").alias("day")).agg(F.min("ts").alias("ts"))
    joined = days.join(hulls, "mmsi").where(F.col("risky") | (F.col("context") != "choke_point"))
    zone = F.col("context") == "sanctions_zone"
    return joined.select("vessel_id", "mmsi", "lane_name", "context", "day", "ts", F.when(zone & F.col("risky"), "high").when(F.col("risky") | zone, "medium").otherwise("low").alias("severity"))


def dark_vessels(vessels: DataFrame, zones: DataFrame, as_of: datetime, hours: float = 6.0, max_days: int = 7) -> DataFrame:
    """Flagged or risky vessels last heard between ``hours`` and ``max_days`` ago, in a risk zone or breached."""
    silent = F.round(hours_between(F.col("last_ais_update"), F.lit(as_of)), 1)
    aged = vessels.where(F.col("lat").isNotNull()).withColumn("silent", hours_between(F.col("last_ais_update"), F.lit(as_of)))
    aged = aged.where((F.col("silent") > hours) & (F.col("silent") <= max_days * 24) & risky(F.col("sanctioned_status"), F.col("risk_score")))
    found = areas_containing(aged.select("id", "mmsi", "lat", "lon", "last_ais_update", "sanctioned_status", "silent"), zones, "areas").withColumn("zones", _risk_zones(F.col("areas")))
    in_zone = F.size("zones") > 0
    breach = F.startswith(F.coalesce("sanctioned_status", F.lit("clear")), F.lit("breach"))
    return found.where(in_zone | breach).select(
        F.col("id").alias("vessel_id"), "mmsi", F.col("last_ais_update").alias("ts"), F.when(in_zone, "dark_in_zone").otherwise("dark_vessel").alias("event_type"),
        F.when(in_zone, "high").otherwise("medium").alias("severity"), F.when(in_zone, 0.6).otherwise(0.4).alias("confidence"), silent.alias("hours_silent"), "zones",
    )


def spaced_out(rows: DataFrame, key: str, row_id: str, gap_seconds: int) -> DataFrame:
    """Ids of rows kept when each kept row must lie at least ``gap_seconds`` after the one kept before it. Exact.

    Every kept row points at the first row past its gap; the rows reached from the starts of dense runs are the answer.
    """
    slim = rows.select(key, "ts", row_id)
    seen = drop_bucket(previous_row(slim, [key], "ts", ["ts"], tie=[row_id]))
    # a row at least one gap after its predecessor is kept whatever came before it
    heads = seen.where(F.col("prev").isNull() | (F.unix_micros("ts") - F.unix_micros("prev.ts") >= gap_seconds * 1_000_000)).select(F.col(row_id).alias("id"))
    targets = slim.withColumn("ts", F.timestamp_micros(F.unix_micros("ts") + gap_seconds * 1_000_000))
    following = asof(targets, slim.select(key, "ts", F.col(row_id).alias("next_id")), [key], "ts", ["next_id"], "forward", tie="next_id")
    links = following.where(F.col("match").isNotNull()).select(F.col(row_id).alias("id"), F.col("match.next_id").alias("next"))
    return reachable(links, heads)


def thin_positions(positions: DataFrame, as_of: datetime, retention_days: int = 180, compress_after_days: int = 7, interval_minutes: int = 30) -> DataFrame:
    """Positions past retention dropped; older ones thinned to one per interval since the last one kept."""
    kept = positions.where(F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {retention_days} DAYS"))
    cutoff = F.lit(as_of) - F.expr(f"INTERVAL {compress_after_days} DAYS")
    old = kept.where(F.col("ts") < cutoff)
    ids = spaced_out(old, "mmsi", "id", interval_minutes * 60)
    return kept.where(F.col("ts") >= cutoff).unionByName(old.join(ids, "id", "left_semi").select(*kept.columns))


def rendezvous_candidates(positions: DataFrame, degrees: float = 0.01, max_speed: float = 2.0) -> DataFrame:
    """Slow vessels with another slow vessel in the 3 x 3 block of cells."""
    slow = positions.where(F.col("speed") <= max_speed).select("mmsi", cell(F.col("lat"), degrees).alias("row"), cell(F.col("lon"), degrees).alias("col"))
    counts = slow.groupBy("row", "col").count()
    spread = counts.select(F.explode(F.transform(neighbour_offsets(), lambda o: F.struct((F.col("row") + o["dr"]).alias("row"), wrapped_column(F.col("col") + o["dc"], degrees).alias("col")))).alias("n"), "count")
    around = spread.groupBy(F.col("n.row").alias("row"), F.col("n.col").alias("col")).agg(F.sum("count").alias("near")).where("near > 1")
    return slow.join(around, ["row", "col"], "left_semi").select("mmsi").distinct()


def sample_history(positions: DataFrame, vessels: DataFrame, ports: DataFrame, risk_floor: float = 0.3, slow_minutes: int = 10, other_minutes: int = 60) -> DataFrame:
    """Every fix of vessels of interest, one per ``slow_minutes`` for slow hulls near another outside port, one per
    ``other_minutes`` for the rest (first fix of each clock interval)."""
    interest = vessels.where(flagged(F.col("sanctioned_status")) | (F.coalesce("risk_score", F.lit(0.0)) >= risk_floor)).select("mmsi", F.lit(True).alias("interest"))
    near = rendezvous_candidates(latest_per_key(positions.select("mmsi", "ts", "lat", "lon", "speed"), ["mmsi"], "ts")).withColumn("near", F.lit(True))
    classed = port_containing(positions.join(interest, "mmsi", "left").join(near, "mmsi", "left"), ports)
    minutes = F.when(F.col("interest"), 0).when(F.col("near") & F.col("port").isNull(), slow_minutes).otherwise(other_minutes)
    classed = classed.withColumn("_m", minutes.cast("long"))
    slot = F.when(F.col("_m") == 0, F.unix_micros("ts")).otherwise(F.floor(F.unix_micros("ts") / (F.col("_m") * 60_000_000)))
    whole = F.struct(*positions.columns)
    return classed.groupBy("mmsi", "_m", slot.alias("_slot"), F.when(F.col("_m") == 0, F.col("id")).alias("_each")).agg(F.min_by(whole, F.struct("ts", "id")).alias("r")).select("r.*")


def enrich_static(positions: DataFrame) -> DataFrame:
    """Per vessel the first known IMO, call sign, type (a specific one replaces "Other") and length, and the latest
    destination and plausible draught."""
    def first(col, keep=None):
        value = F.when(keep, F.col(col)) if keep is not None else F.col(col)
        return F.min_by(value, F.when(value.isNotNull(), F.col("ts")))

    def last(col, keep=None):
        value = F.when(keep, F.col(col)) if keep is not None else F.col(col)
        return F.max_by(value, F.when(value.isNotNull(), F.col("ts")))

    specific = first("ship_type", F.col("ship_type") != "Other")
    return positions.groupBy("mmsi").agg(
        first("imo").alias("imo"), first("call_sign").alias("call_sign"), F.coalesce(specific, first("ship_type")).alias("ship_type"), first("length_m").alias("length_m"),
        last("destination").alias("destination"), last("draught", (F.col("draught") > 0) & (F.col("draught") < 40)).alias("draught"), F.max("ts").alias("last_ais_update"),
    )


def assess_sts(pairs: DataFrame, durations: DataFrame, vessels: DataFrame, zones: DataFrame, min_minutes: int = 30, crowd: int = 8) -> DataFrame:
    """Confidence of a rendezvous from types, duration, crowding, zone and the risk of either hull."""
    long = pairs.join(durations.where(F.col("duration_min") >= min_minutes), ["a_id", "b_id"])
    hull = vessels.select("id", risky(F.col("sanctioned_status"), F.col("risk_score")).alias("r"))
    joined = long.join(hull.withColumnsRenamed({"id": "a_id", "r": "ra"}), "a_id").join(hull.withColumnsRenamed({"id": "b_id", "r": "rb"}), "b_id")
    placed = areas_containing(joined, zones, "areas")
    hub = F.exists("areas", lambda a: a["kind"] == "sts_hub")
    score = (
        F.when(F.col("a_typed") & F.col("b_typed"), 0.4).otherwise(0.3) + F.least(F.lit(0.25), F.col("duration_min") / 480 * 0.25)
        + F.when(F.col("a_tanker") | F.col("b_tanker"), 0.15).otherwise(0.0) - F.when(F.col("neighbours") >= crowd, 0.1).otherwise(0.0)
        + F.when(hub, 0.2).when(F.size("areas") > 0, 0.1).otherwise(0.0) + F.when(F.col("ra") | F.col("rb"), 0.1).otherwise(0.0)
    )
    return placed.select("a_id", "b_id", "lat", "lon", F.round("distance_m").alias("proximity_m"), "duration_min", "started_at", "neighbours", F.transform("areas", lambda a: a["name"]).alias("zones"), F.round(F.least(F.lit(0.97), score), 2).alias("confidence"))


def spoofing_clusters(anomalies: DataFrame, land: DataFrame | None, zones: DataFrame | None, min_vessels: int = 3, degrees: float = 0.1, max_rounds: int = 50) -> DataFrame:
    """Places where several hulls report impossible positions: densest 3 x 3 blocks first, taken until none is dense.

    Taking the densest block over and over equals, in parallel rounds, taking every block that beats all blocks within
    two cells of it (more hulls, then the lower cell): a taken block changes counts only within that reach.
    """
    checkpoint_ready(anomalies.sparkSession)
    # one row per (cell, hull) carries the sums the centroid needs, so a hull reporting all day weighs little
    placed = anomalies.where(F.col("lat").isNotNull()).withColumn("row", cell(F.col("lat"), degrees)).withColumn("col", wrapped_column(cell(F.col("lon"), degrees), degrees))
    facts = placed.groupBy("row", "col", "vessel_id").agg(F.count("*").alias("n"), F.sum("lat").alias("slat"), F.sum("lon").alias("slon"), F.min("ts").alias("t0"), F.max("ts").alias("t1")).checkpoint()
    taken_all = None
    left = facts
    for round_no in range(max_rounds):
        spread = left.select("vessel_id", "row", "col", F.explode(neighbour_offsets()).alias("o")).select("vessel_id", (F.col("row") + F.col("o.dr")).alias("row"), wrapped_column(F.col("col") + F.col("o.dc"), degrees).alias("col"))
        counts = left.select("row", "col").distinct().join(spread, ["row", "col"]).groupBy("row", "col").agg(F.countDistinct("vessel_id").alias("hulls")).where(F.col("hulls") >= min_vessels)
        rank = F.struct(F.col("hulls").alias("hulls"), (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))
        reach = counts.select(rank.alias("k"), F.explode(neighbour_offsets(2)).alias("o"), "row", "col").select("k", (F.col("row") + F.col("o.dr")).alias("row"), wrapped_column(F.col("col") + F.col("o.dc"), degrees).alias("col"))
        best = reach.groupBy("row", "col").agg(F.max("k").alias("top"))
        centres = counts.withColumn("k", rank).join(best, ["row", "col"]).where("k = top").select(F.col("row").alias("crow"), F.col("col").alias("ccol"), "hulls")
        blocks = centres.select("*", F.explode(neighbour_offsets()).alias("o")).select("crow", "ccol", (F.col("crow") + F.col("o.dr")).alias("row"), wrapped_column(F.col("ccol") + F.col("o.dc"), degrees).alias("col"))
        marked = left.join(blocks, ["row", "col"], "left").checkpoint()
        members = marked.where(F.col("crow").isNotNull())
        if members.isEmpty():
            break
        taken_all = members if taken_all is None else taken_all.unionByName(members)
        left = marked.where(F.col("crow").isNull()).drop("crow", "ccol")
    else:
        raise RuntimeError("clusters are left; raise max_rounds")
    if taken_all is None:
        taken_all = facts.withColumn("crow", F.col("row")).withColumn("ccol", F.col("col")).limit(0)
    found = taken_all.groupBy("crow", "ccol").agg(
        F.countDistinct("vessel_id").alias("vessels"), F.sum("n").alias("reports"), F.round(F.sum("slat") / F.sum("n"), 4).alias("lat"), F.round(F.sum("slon") / F.sum("n"), 4).alias("lon"), F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen")
    )
    found = with_inland(found, land, 5.0) if land is not None else found.withColumn("inland", F.lit(False))
    found = areas_containing(found, zones, "areas").withColumn("zones", F.transform("areas", lambda a: a["name"])).drop("areas") if zones is not None else found
    n, inland = F.col("vessels"), F.col("inland")
    severity = F.when((n >= 10) | (inland & (n >= 5)), "critical").when((n >= 5) | inland, "high").otherwise("medium")
    return found.drop("crow", "ccol").withColumn("severity", severity).withColumn("confidence", F.round(F.least(F.lit(0.95), 0.5 + 0.05 * n + F.when(inland, 0.15).otherwise(0.0)), 2))


def vessel_risk(vessels: DataFrame, breaches: DataFrame, evasion: DataFrame, calls: DataFrame, sts: DataFrame, psc: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Independent evidence combined as one minus the product of the misses; every source shrinks to one row per vessel first."""
    since = F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")
    year = F.lit(as_of) - F.expr("INTERVAL 365 DAYS")
    best = breaches.where(F.col("status") != "cleared").groupBy("vessel_id").agg(F.max("confidence").alias("w_match"))
    weight = F.coalesce(F.try_element_at(lookup(SEVERITY_WEIGHT), F.col("severity")), F.lit(0.1))
    behaviour = evasion.where(F.col("ts") >= since).groupBy("vessel_id").agg(F.least(F.lit(0.7), F.sum(weight)).alias("w_evasion"), F.max(F.when(F.col("event_type") == "spoofing_cluster", 0.1)).alias("w_spoof"))
    risky_calls = calls.where((F.col("arrival") >= since) & (F.col("is_sanctioned") | (F.col("risk_level") == "high"))).groupBy("vessel_id").agg(F.least(F.lit(0.45), 0.15 * F.count("*")).alias("w_calls"))
    met = sts.where((F.col("ts") >= since) & (F.col("status") != "cleared")).select(F.explode(F.array_distinct(F.array("vessel_a", "vessel_b"))).alias("vessel_id")).groupBy("vessel_id").agg(F.least(F.lit(0.5), 0.2 * F.count("*")).alias("w_sts"))
    port_state = psc.where((F.col("event_date") >= year) | (F.col("event_type") == "ban")).groupBy("imo").agg(
        F.least(F.lit(0.5), 0.15 * F.count_if(F.col("event_type") == "detention") + 0.35 * F.count_if(F.col("event_type") == "ban")).alias("w_psc")
    )
    joined = vessels.select(F.col("id").alias("vessel_id"), "imo", "flag", "ship_type").join(best, "vessel_id", "left").join(behaviour, "vessel_id", "left").join(risky_calls, "vessel_id", "left").join(met, "vessel_id", "left").join(port_state, "imo", "left")
    foc = F.when(F.col("flag").isin(SHADOW_FLEET_FLAGS) & tanker_hull(F.col("ship_type")), 0.1)
    factors = ["w_match", "w_evasion", "w_calls", "w_sts", "w_spoof", "w_psc", "w_foc"]
    return joined.withColumn("w_foc", foc).select("vessel_id", noisy_or(F.array(*factors)).alias("risk_score"), *factors)


def shared_party_links(vessels: DataFrame, focus: DataFrame) -> DataFrame:
    """Other vessels with the same owner, operator or beneficial owner as the focus vessels (vessel_id).

    Links start from named vessels of interest; fleets as a whole are ``fleet_groups``, which never forms pairs.
    """
    parties = vessels.select(F.col("id").alias("vessel_id"), F.expr("stack(3, 'shared_owner', owner, 'shared_operator', operator, 'shared_beneficial_owner', beneficial_owner) AS (reason, party)")).where(F.col("party") != "")
    mine = parties.join(focus, "vessel_id", "left_semi")
    return mine.join(parties.withColumnRenamed("vessel_id", "other_id"), ["reason", "party"]).where("vessel_id <> other_id").select("vessel_id", "other_id", "reason", F.col("party").alias("detail"))


LINK_BLOCK = 4096  # vessels of one party, listing or port that meet in one task


def _link_profiles(vessels: DataFrame, breaches: DataFrame, calls: DataFrame, focus: DataFrame, since: Column) -> tuple[DataFrame, DataFrame]:
    """Focus vessels (vessel_id) and all vessels (other_id) with what a pair is compared on: parties, listings and ports.

    A focus vessel's ports are the risky ones of its recent calls, any other vessel's are all of them with their number of calls.
    """
    parties = [F.when(F.col(c) != "", F.col(c)).alias(c) for c in ("owner", "operator", "beneficial_owner")]
    listed = breaches.where(F.col("vessel_id").isNotNull() & F.col("entity_id").isNotNull()).groupBy("vessel_id").agg(F.collect_set("entity_id").alias("listings"))
    recent = calls.where((F.col("arrival") >= since) & F.col("vessel_id").isNotNull() & F.col("port").isNotNull())
    risky_ports = recent.where(F.col("is_sanctioned") | (F.col("risk_level") == "high")).groupBy("vessel_id").agg(F.collect_set("port").alias("ports"))
    called = recent.groupBy("vessel_id", "port").agg(F.count("*").alias("k")).groupBy("vessel_id").agg(F.map_from_entries(F.collect_list(F.struct("port", "k"))).alias("calls"))
    known = vessels.where("id is not null").select(F.col("id").alias("vessel_id"), *parties, "mmsi", "name", "flag", "risk_score").join(listed, "vessel_id", "left")
    mine = focus.where("vessel_id is not null").select("vessel_id").distinct().join(vessels.select(F.col("id").alias("vessel_id"), *parties), "vessel_id", "left").join(listed, "vessel_id", "left").join(risky_ports, "vessel_id", "left")
    others = known.join(called, "vessel_id", "left").withColumnRenamed("vessel_id", "other_id")
    return mine, others


def linked_vessels(vessels: DataFrame, breaches: DataFrame, sts: DataFrame, calls: DataFrame, focus: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Vessels tied to the focus vessels by party, shared listing, rendezvous or risky port, with combined strength.

    The pairs of a party grow with the square of its fleet, so they are listed where they meet and nothing is shuffled,
    sorted or held behind that: both vessels carry all that a pair is compared on, and a pair that meets under several keys is kept
    under the first. Vessels of a key meet in blocks, so a task's memory and a group's work do not grow with the key. Shared
    listings count once each, as do rendezvous and calls.
    """
    spark = vessels.sparkSession
    checkpoint_ready(spark)
    since = F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")
    mine, others = (side.checkpoint() for side in _link_profiles(vessels, breaches, calls, focus, since))

    def keyed(side: DataFrame, ports: Column) -> DataFrame:
        many = lambda kind, values: F.transform(F.coalesce(values, F.array()), lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("string").alias("value")))
        one = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in enumerate(("owner", "operator", "beneficial_owner"))]), lambda x: x["value"].isNotNull())
        return side.withColumn("key", F.explode(F.concat(one, many(3, F.col("listings")), many(4, ports))))

    focal, met = keyed(mine, F.col("ports")), keyed(others, F.map_keys("calls"))
    # blocks are as many as the fullest key needs that both sides hold
    sizes = focal.groupBy("key").agg(F.count("*").alias("f")).join(met.groupBy("key").agg(F.count("*").alias("o")), "key").agg(F.max("f"), F.max("o")).first()
    rows, blocks = (max(1, -(-(n or 0) // LINK_BLOCK)) for n in sizes)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")

    both_ways = F.explode(F.array(F.struct(F.col("vessel_a").alias("vessel_id"), F.col("vessel_b").alias("other_id")), F.struct(F.col("vessel_b").alias("vessel_id"), F.col("vessel_a").alias("other_id"))))
    rendezvous = sts.where(F.col("ts") >= since).select(both_ways.alias("p")).select("p.*").join(focus.select("vessel_id").distinct(), "vessel_id", "left_semi")
    rendezvous = rendezvous.where("vessel_id <> other_id").groupBy("vessel_id", "other_id").agg(F.count("*").alias("k")).checkpoint()
    partners = rendezvous.groupBy("vessel_id", block("other_id", blocks).alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("other_id", "k"))).alias("partners"))

    left = ["vessel_id", "owner", "operator", "beneficial_owner", "listings", "ports"]
    right = ["other_id", "owner", "operator", "beneficial_owner", "listings", "calls", "mmsi", "name", "flag", "risk_score"]
    as_left = [F.col(c).alias(c if c == "vessel_id" else f"a_{c}") for c in left]
    as_right = [F.col(c).alias(f"b_{c}" if c in left or c == "calls" else c) for c in right]
    # a number of its own keeps adaptive execution from joining partitions that are small only until pairs are listed
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asking = focal.select("key", *as_left, block("vessel_id", rows).alias("row"), spread(blocks).alias("block")).join(partners, ["vessel_id", "block"], "left")
    meeting = met.select("key", *as_right, block("other_id", blocks).alias("block"), spread(rows).alias("row"))
    at = ["key", "row", "block"]
    pairs = asking.repartition(parts, *at).join(meeting.hint("merge").repartition(parts, *at), at).where("vessel_id <> other_id").withColumn("met", F.try_element_at("partners", F.col("other_id")))
    same = lambda c: F.coalesce(F.col(f"a_{c}") == F.col(f"b_{c}"), F.lit(False))
    none = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as {kind})"))
    entity = breaches.schema["entity_id"].dataType.simpleString()

    def compared(pairs: DataFrame) -> DataFrame:
        shared = F.when(F.col("a_listings").isNotNull() & F.col("b_listings").isNotNull(), F.array_intersect("a_listings", "b_listings"))
        ports = F.when(F.col("a_ports").isNotNull() & F.col("b_calls").isNotNull(), F.array_intersect("a_ports", F.map_keys("b_calls")))
        return pairs.withColumns({"shared": none(shared, f"array<{entity}>"), "common": none(ports, "array<string>")})

    def graded(pairs: DataFrame) -> DataFrame:
        port_calls = F.aggregate("common", F.lit(0).cast("long"), lambda n, p: n + F.col("b_calls")[p])
        counts = [
            ("shared_beneficial_owner", same("beneficial_owner").cast("long")), ("shared_high_risk_port", F.when(F.size("common") > 0, port_calls).otherwise(0)), ("shared_operator", same("operator").cast("long")),
            ("shared_owner", same("owner").cast("long")), ("shared_sanctions_entity", F.size("shared").cast("long")), ("transshipment_partner", F.coalesce("met", F.lit(0).cast("long"))),
        ]
        miss = reduce(lambda x, y: x * y, [F.pow(F.lit(1 - LINK_WEIGHTS[reason]), k) for reason, k in counts])
        reasons = F.array_compact(F.array(*[F.when(k > 0, reason) for reason, k in counts]))
        return pairs.select("other_id", "vessel_id", F.round(1 - miss, 2).alias("link_strength"), reasons.alias("reasons"), "mmsi", "name", "flag", "risk_score")

    listed = compared(pairs)
    least = F.when(same("owner"), 0).when(same("operator"), 1).when(same("beneficial_owner"), 2).when(F.size("shared") > 0, 3).otherwise(4)
    value = F.when(F.col("key.kind") == 3, F.array_min("shared").cast("string")).when(F.col("key.kind") == 4, F.array_min("common"))
    first = (F.col("key.kind") == least) & F.coalesce(value == F.col("key.value"), F.lit(True))
    # rendezvous of vessels that share nothing else
    alone = compared(rendezvous.withColumnRenamed("k", "met").join(mine.select(*as_left), "vessel_id").join(others.select(*as_right), "other_id"))
    alone = alone.where(~same("owner") & ~same("operator") & ~same("beneficial_owner") & (F.size("shared") == 0) & (F.size("common") == 0))
    return graded(listed.where(first)).unionByName(graded(alone))


def fleet_groups(vessels: DataFrame, min_size: int = 2, members: int = 25) -> DataFrame:
    """Fleets by shared party with size, highest risk, flagged count and a bounded member list."""
    parties = vessels.select("mmsi", "risk_score", "sanctioned_status", F.expr("stack(3, 'owner', owner, 'operator', operator, 'beneficial_owner', beneficial_owner) AS (link, entity)")).where(F.col("entity") != "")
    stats = parties.groupBy("link", "entity").agg(F.count("*").alias("size"), F.max(F.coalesce("risk_score", F.lit(0.0))).alias("max_risk"), F.count_if(flagged(F.col("sanctioned_status"))).alias("flagged")).where(F.col("size") >= min_size)
    ranked = parties.withColumn("_r", F.row_number().over(Window.partitionBy("link", "entity").orderBy("mmsi"))).where(F.col("_r") <= members)
    listed = ranked.groupBy("link", "entity").agg(F.sort_array(F.collect_list("mmsi")).alias("vessels"))
    return stats.join(listed, ["link", "entity"])


def upsert_breaches(matches: DataFrame, existing: DataFrame, as_of: datetime, review: float = 0.4, visible: float = 0.6) -> DataFrame:
    """Breach rows keyed by (vessel, authority, listed name, breach type): highest confidence kept, new ones dated."""
    keys = ["vessel_id", "authority", "listed", "breach_type"]
    new = matches.where(F.col("confidence") >= review).groupBy(*keys).agg(F.max("confidence").alias("c_new"), F.max_by("listing_id", "confidence").alias("l_new"), F.max_by("match_type", F.struct("confidence", "match_type")).alias("m_new"))
    merged = existing.join(new, keys, "full_outer")
    fresh = F.when(F.col("c_new") >= visible, "flagged").otherwise("review")
    return merged.select(
        *keys, F.coalesce("listing_id", "l_new").alias("listing_id"), F.coalesce("match_type", "m_new").alias("match_type"), F.greatest("confidence", "c_new").alias("confidence"), F.coalesce("status", fresh).alias("status"),
        F.coalesce("ts", F.lit(as_of)).alias("ts"), F.when(F.col("c_new").isNotNull() & F.col("confidence").isNotNull(), F.lit(as_of)).otherwise(F.col("last_confirmed")).alias("last_confirmed"),
    )


def reconcile_imo(breaches: DataFrame, vessels: DataFrame, listings: DataFrame, visible: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Name-only matches are cleared once the hull's IMO is known to differ; returns breaches and vessel statuses."""
    facts = breaches.join(vessels.select(F.col("id").alias("vessel_id"), F.col("imo").alias("v_imo")), "vessel_id", "left").join(listings.select(F.col("id").alias("listing_id"), F.col("imo").alias("l_imo")), "listing_id", "left")
    namesake = F.coalesce(F.col("match_type").isin("name_exact", "name_fuzzy") & (F.col("v_imo") != F.col("l_imo")), F.lit(False))
    after = facts.withColumn("status", F.when(namesake, "cleared").otherwise(F.col("status"))).select(*breaches.columns)
    return after, vessel_status(after, visible)


def vessel_status(breaches: DataFrame, visible: float = 0.6) -> DataFrame:
    """Status per vessel with breaches: the strongest visible authority, else flagged, else clear."""
    still = F.col("status") != "cleared"
    shown = F.when(still & (F.col("confidence") >= visible), F.struct("confidence", "authority"))
    agg = breaches.groupBy("vessel_id").agg(F.max(shown).alias("top"), F.max(still).alias("any_open"))
    return agg.select("vessel_id", F.when(F.col("top").isNotNull(), F.concat(F.lit("breach_"), F.lower("top.authority"))).when(F.col("any_open"), "flagged").otherwise("clear").alias("sanctioned_status"))


def refresh_clusters(new: DataFrame, old: DataFrame, metres: float = 25_000.0) -> DataFrame:
    """A cluster near an existing one updates it when at least as large; otherwise it is added.

    ``old`` and ``new`` have (cluster_id, lat, lon, vessels, ts); cells of the distance give an equi-join. Each new
    cluster meets the oldest existing one within reach.
    """
    step = metres / 1000 / KM_PER_DEGREE * 1.01
    wide = lambda lat: step / F.cos(F.radians(F.least((F.floor(F.abs(lat) / 5) + 1) * 5 + 0.0, F.lit(POLAR_LATITUDE))))
    o = old.select(F.col("cluster_id").alias("old_id"), F.col("lat").alias("olat"), F.col("lon").alias("olon"), F.col("vessels").alias("ovessels"), F.col("ts").alias("ots"))
    zones = F.array_distinct(F.array(F.floor(F.abs(F.col("olat") - step) / 5), F.floor(F.abs(F.col("olat") + step) / 5)))
    o = o.withColumn("_z", F.explode(zones)).withColumn("_w", step / F.cos(F.radians(F.least((F.col("_z") + 1) * 5 + 0.0, F.lit(POLAR_LATITUDE))))).withColumn("o", F.explode(neighbour_offsets()))
    o = o.select("old_id", "olat", "olon", "ovessels", "ots", "_z", (F.floor(F.col("olat") / step) + F.col("o.dr")).alias("_r"), (F.floor(F.col("olon") / F.col("_w")) + F.col("o.dc")).alias("_c"))
    n = new.withColumn("_z", F.floor(F.abs(F.col("lat")) / 5)).withColumn("_r", F.floor(F.col("lat") / step)).withColumn("_c", F.floor(F.col("lon") / wide(F.col("lat"))))
    near = n.join(o, ["_z", "_r", "_c"], "left").withColumn("hit", haversine_m(F.col("lat"), F.col("lon"), F.col("olat"), F.col("olon")) <= metres)
    best = near.groupBy("cluster_id").agg(F.min(F.when(F.col("hit"), F.struct("ots", "old_id", "ovessels"))).alias("m"))
    return new.join(best, "cluster_id").select(
        "cluster_id", "lat", "lon", "vessels", "ts", F.col("m.old_id").alias("updates"),
        F.when(F.col("m").isNull(), "add").when(F.col("vessels") >= F.col("m.ovessels"), "update").otherwise("skip").alias("action"),
    )
