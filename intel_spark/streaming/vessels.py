"""Streams of ships and aircraft as micro-batches over a snapshot of what is known of every hull.

A detector needs the fix before the current one, a few names, the last static message, who holds an IMO. These are kept as
tables of a few rows a hull, written once a batch. A batch is joined to them as if they were older reports, the batch
detectors run on the two together, and what they find for the batch's own reports is written out. So stream and batch
cannot differ in their rules, nothing is held in Python, and a hull with a million reports in one batch is cut into time
buckets like any other history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from intel_spark.functions.text import name_token
from intel_spark.operators.maritime import UNKNOWN_FLAG, dark_vessels, grade_gaps, grade_positions, identity_changes, imo_conflicts
from intel_spark.operators.monitors import flights
from intel_spark.operators.names import screen_vessels
from intel_spark.operators.timeline import drop_bucket, last_known, latest_per_key, previous_row, top_per_key
from intel_spark.sources.ais import STATIC

EVENT_COLUMNS = ["mmsi", "ts", "event_type", "severity", "confidence", "detail"]
FIX = "mmsi string, ts timestamp, lat double, lon double, speed double, name string, flag string, ship_type string, imo string"
STATE = {
    "fixes": FIX + ", dark boolean",  # the newest fix of a hull, and whether it was reported dark there
    "names": "mmsi string, ts timestamp, name string",  # the first reports of its last names
    "flags": "mmsi string, ts timestamp, flag string",
    "static": "mmsi string, ts timestamp, static_name string, imo string, call_sign string, ship_type string, destination string, draught double, length_m double, beam_m double",
    "holders": "imo string, mmsi string, ts timestamp, flag string",  # who holds an IMO and when it was last heard
    "conflicts": "imo string, mmsi string, holder string, day date",  # the last day a conflict was reported
}
NAMES_KEPT = 5


class Snapshots:
    """Tables written once a batch into one of two slots; a batch reads the other, so a replay finds what it found before."""

    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, str]):
        self.spark, self.path, self.schemas = spark, path, schemas

    def before(self, batch_id: int) -> dict[str, DataFrame]:
        if batch_id == 0:
            return {name: self.spark.createDataFrame([], schema) for name, schema in self.schemas.items()}
        return {name: self.spark.read.schema(schema).parquet(f"{self.path}/{name}/slot={(batch_id - 1) % 2}") for name, schema in self.schemas.items()}

    def write(self, batch_id: int, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
        out = {}
        for name, df in tables.items():
            schema = self.spark.createDataFrame([], self.schemas[name]).schema
            path = f"{self.path}/{name}/slot={batch_id % 2}"
            df.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(path)
            out[name] = self.spark.read.schema(schema).parquet(path)
        return out


def enriched(batch: DataFrame, static: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positions of a batch of messages with the static fields last sent before them, and the newest static message of each hull."""
    if "is_static" not in batch.columns:
        return batch, static
    known = static.withColumn("is_static", F.lit(True))
    rows = batch.unionByName(known, allowMissingColumns=True)
    filled = drop_bucket(last_known(rows, ["mmsi"], "ts", {"st": F.when(F.col("is_static"), F.struct(*STATIC))}, tie=["is_static"]))
    own = filled.where(~F.col("is_static"))
    positions = own.withColumns({**{c: F.coalesce(F.col(f"st.{c}"), F.col(c)) for c in STATIC[1:]}, "name": F.coalesce("name", "st.static_name")}).drop("st", "static_name", "is_static")
    return positions, latest_per_key(rows.where("is_static").select(*static.columns), ["mmsi"], "ts")


def _holders(reports: DataFrame, transfers: DataFrame) -> DataFrame:
    """Who holds each IMO after these reports: the last one it was handed to, else the first to report it."""
    first = reports.groupBy("imo").agg(F.min_by("mmsi", F.struct("ts", "mmsi")).alias("first"))
    last = transfers.groupBy("imo").agg(F.max_by("mmsi", F.struct("ts", "mmsi")).alias("last"))
    holds = first.join(last, "imo", "left").select("imo", F.coalesce("last", "first").alias("mmsi"))
    return latest_per_key(reports.join(holds, ["imo", "mmsi"], "left_semi"), ["imo", "mmsi"], "ts", ["flag"])


def vessel_step(batch: DataFrame, state: dict[str, DataFrame], zones: DataFrame, gap_hours: float, vessels: DataFrame | None) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """(events, new hulls, next state) of a batch of positions or messages after what ``state`` holds.

    Reports that are not newer than a hull's last one are dropped. Dark hulls are judged at the newest moment heard.
    """
    positions, static = enriched(batch, state["static"])
    shaped = positions.select(*[F.col(c) if c in positions.columns else F.lit(None).cast("string").alias(c) for c in (f.split()[0] for f in FIX.split(", "))])
    last = state["fixes"]
    fresh = shaped.join(last.select("mmsi", F.col("ts").alias("_last")), "mmsi", "left").where(F.col("_last").isNull() | (F.col("ts") > F.col("_last"))).drop("_last").dropDuplicates(["mmsi", "ts"])
    fresh = fresh.persist()

    # the fix before: the stored one is older than all of a hull's fresh ones
    both = last.drop("dark").withColumn("_old", F.lit(True)).unionByName(fresh.withColumn("_old", F.lit(False)))
    seen = drop_bucket(previous_row(both, ["mmsi"], "ts", ["ts", "lat", "lon", "speed"])).where(~F.col("_old")).drop("_old")
    gaps = grade_gaps(seen, zones, gap_hours).withColumn("detail", F.col("gap_hours").cast("string"))
    jumps = grade_positions(seen).withColumn("detail", F.array_join("reasons", ","))

    named = state["names"].withColumn("flag", F.lit(None).cast("string"))
    flagged = state["flags"].withColumn("name", F.lit(None).cast("string"))
    identity = named.unionByName(flagged).unionByName(fresh.select("mmsi", "ts", "name", "flag"))
    changes = identity_changes(identity).join(fresh.select("mmsi", "ts"), ["mmsi", "ts"], "left_semi").withColumn("detail", F.col("old_value"))

    reports = state["holders"].unionByName(fresh.where(F.col("imo").isNotNull()).select("imo", "mmsi", "ts", "flag"))
    # only a number that several hulls report can be in conflict, which few batches have
    contested = reports.groupBy("imo").agg(F.min("mmsi").alias("a"), F.max("mmsi").alias("b")).where("a <> b").select("imo").persist()
    if contested.isEmpty():
        claims = batch.sparkSession.createDataFrame([], "imo string, ts timestamp, mmsi string, holder string, kind string, severity string, confidence double")
    else:
        claims = imo_conflicts(reports.join(contested, "imo", "left_semi")).join(fresh.select("mmsi", "ts"), ["mmsi", "ts"], "left_semi").persist()
    days = claims.where("kind = 'identity_conflict'").select("imo", "mmsi", "holder", F.to_date("ts").alias("day"))
    claimed = claims.withColumn("day", F.when(F.col("kind") == "identity_conflict", F.to_date("ts"))).join(state["conflicts"], ["imo", "mmsi", "holder", "day"], "left_anti")
    claimed = claimed.select("mmsi", "ts", F.col("kind").alias("event_type"), "severity", "confidence", F.concat_ws(":", "imo", "holder").alias("detail"))

    newest_fix = latest_per_key(last.unionByName(fresh.withColumn("dark", F.lit(False))), ["mmsi"], "ts")
    events = gaps.select(EVENT_COLUMNS)
    for part in (jumps, changes, claimed):
        events = events.unionByName(part.select(EVENT_COLUMNS))
    now = newest_fix.agg(F.max("ts")).first()[0]
    if vessels is not None and now is not None:
        known = newest_fix.where(~F.col("dark")).join(vessels.select("mmsi", "sanctioned_status", "risk_score"), "mmsi")
        known = known.select(F.lit(None).cast("long").alias("id"), "mmsi", "lat", "lon", F.col("ts").alias("last_ais_update"), "sanctioned_status", "risk_score")
        dark = dark_vessels(known, zones, now, gap_hours).withColumn("detail", F.col("hours_silent").cast("string"))
        events = events.unionByName(dark.select(EVENT_COLUMNS))
        newest_fix = newest_fix.join(dark.select("mmsi", F.lit(True).alias("_dark")), "mmsi", "left").withColumn("dark", F.col("dark") | F.coalesce("_dark", F.lit(False))).drop("_dark")

    runs = state["names"].unionByName(fresh.where(F.col("name").isNotNull()).select("mmsi", "ts", "name")).withColumn("token", name_token(F.col("name")))
    starts = drop_bucket(previous_row(runs, ["mmsi"], "ts", ["token"])).where(F.col("prev").isNull() | (F.col("prev.token") != F.col("token")))
    # the spelling that a later rename replaces is the one before it, so the newest report of the current name stays too
    current = latest_per_key(runs, ["mmsi"], "ts")
    names = top_per_key(starts.select("mmsi", "ts", "name"), ["mmsi"], [F.col("ts").desc()], NAMES_KEPT).drop("_rank").unionByName(current.select("mmsi", "ts", "name")).distinct()
    following = {
        "fixes": newest_fix, "names": names, "static": static,
        "flags": latest_per_key(state["flags"].unionByName(fresh.where(F.col("flag").isNotNull() & (F.col("flag") != UNKNOWN_FLAG)).select("mmsi", "ts", "flag")), ["mmsi"], "ts"),
        "holders": _holders(reports, claims.where("kind = 'identity_transfer'").select("imo", "mmsi", "ts")),
        "conflicts": state["conflicts"].unionByName(days).groupBy("imo", "mmsi", "holder").agg(F.max("day").alias("day")),
    }
    first = fresh.join(last.select("mmsi"), "mmsi", "left_anti")
    hulls = latest_per_key(first, ["mmsi"], "ts")
    return events, hulls, following


def _screened(hulls: DataFrame, listings: DataFrame) -> DataFrame:
    """Matches of new hulls against the lists; their owners are not known yet."""
    none = F.lit(None).cast("string")
    subject = hulls.select(F.col("mmsi").cast("long").alias("id"), "mmsi", "imo", "name", "flag", "ship_type", none.alias("owner"), none.alias("operator"), none.alias("beneficial_owner"))
    return screen_vessels(subject, listings).select(F.lpad(F.col("vessel_id").cast("string"), 9, "0").alias("mmsi"), "listing_id", "match_type", "matched_value", "confidence", "severity", "summary")


def start_vessel_events(positions: DataFrame, checkpoint: str, path: str, zones: DataFrame, gap_hours: float = 6.0, vessels: DataFrame | None = None, listings: DataFrame | None = None, matches: str | None = None, available_now: bool = False) -> StreamingQuery:
    """T01, T02. ``positions`` are (mmsi, ts, lat, lon, speed, name, flag, ship_type[, imo]) or messages as ``parse_messages``
    gives them. Events go to ``path``; with ``vessels`` (mmsi, sanctioned_status, risk_score) hulls that fell silent are judged
    too, and with ``listings`` new hulls are screened, their hits written to ``matches``."""
    from intel_spark.streaming.jobs import _each

    spark = positions.sparkSession
    snapshots = Snapshots(spark, f"{path}_state", STATE)

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        events, hulls, following = vessel_step(batch, snapshots.before(batch_id), zones, gap_hours, vessels)
        # a replayed batch replaces its own folder
        events.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        if listings is not None:
            _screened(hulls, listings).write.mode("overwrite").parquet(f"{matches or path + '_matches'}/batch={batch_id}")
        snapshots.write(batch_id, following)
        batch.unpersist()

    return _each(positions, checkpoint, handle, available_now)


def sighting_step(batch: DataFrame, kept: DataFrame, min_gap_s: int) -> tuple[DataFrame, DataFrame]:
    """(kept sightings, next state): what ``flights`` keeps of a batch after the last kept one of each aircraft."""
    columns = ["id", "registration", "ts", "source", "callsign"]
    slim = batch.select(*columns).join(kept.select("registration", F.col("ts").alias("_last"), F.col("id").alias("_id")), "registration", "left")
    slim = slim.where(F.col("_last").isNull() | (F.struct("ts", "id") > F.struct("_last", "_id"))).drop("_last", "_id")
    both = flights(kept.select(*columns).unionByName(slim), min_gap_s)
    new = both.join(kept.select("id"), "id", "left_anti")
    return new.select("id", "registration", "ts", "source", "flight_key", "new_flight"), latest_per_key(both.select(*columns), ["registration"], "ts", ["id"])


def start_sightings(sightings: DataFrame, checkpoint: str, path: str, min_gap_s: int = 120, available_now: bool = False) -> StreamingQuery:
    """Aircraft sightings without repeats, with flight keys; reports older than the last kept one are dropped."""
    from intel_spark.streaming.jobs import _each

    snapshots = Snapshots(sightings.sparkSession, f"{path}_state", {"kept": "id long, registration string, ts timestamp, source string, callsign string"})

    def handle(batch: DataFrame, batch_id: int) -> None:
        found, kept = sighting_step(batch, snapshots.before(batch_id)["kept"], min_gap_s)
        found.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        snapshots.write(batch_id, {"kept": kept})

    return _each(sightings, checkpoint, handle, available_now)

