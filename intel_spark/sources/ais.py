"""AIS messages to normalised positions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.functions.text import clean_ais_name
from intel_spark.functions.vessel import nav_status_name, ship_type_name, valid_imo
from intel_spark.operators.timeline import drop_bucket, last_known

MESSAGE_JSON = (
    "MessageType string, MetaData struct<MMSI:string,ShipName:string,latitude:double,longitude:double,time_utc:string>, Message struct<PositionReport:struct<Sog:double,Cog:double,TrueHeading:double,NavigationalStatus:int>,"
    "ShipStaticData:struct<Name:string,ImoNumber:string,CallSign:string,Type:int,Destination:string,MaximumStaticDraught:double,Dimension:struct<A:double,B:double,C:double,D:double>>>"
)
STATIC = ["static_name", "imo", "call_sign", "ship_type", "destination", "draught", "length_m", "beam_m"]


def _text(c) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _size(a: Column, b: Column) -> Column:
    total = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    return F.when((total > 0) & (total < 500), total)


def parse_messages(messages: DataFrame) -> DataFrame:
    """Position and static messages (value: JSON text) as one row each; batch or stream."""
    m = F.from_json(F.col("value").cast("string"), MESSAGE_JSON)
    rows = messages.select(m.alias("m")).where(F.col("m.MetaData.MMSI").isNotNull() & F.col("m.MessageType").isin("PositionReport", "ShipStaticData"))
    pos, static, dim = F.col("m.Message.PositionReport"), F.col("m.Message.ShipStaticData"), F.col("m.Message.ShipStaticData.Dimension")
    is_static = F.col("m.MessageType") == "ShipStaticData"
    known = static["ImoNumber"]
    return rows.select(
        F.col("m.MetaData.MMSI").alias("mmsi"), F.try_to_timestamp(F.substring("m.MetaData.time_utc", 1, 19)).alias("ts"), is_static.alias("is_static"), F.col("m.MetaData.latitude").alias("lat"), F.col("m.MetaData.longitude").alias("lon"), pos["Sog"].alias("speed"), pos["Cog"].alias("course"), pos["TrueHeading"].alias("heading"),
        nav_status_name(pos["NavigationalStatus"]).alias("nav_status"), _text("m.MetaData.ShipName").alias("name"), _text(static["Name"]).alias("static_name"), F.when(known != "0", known).alias("imo"), _text(static["CallSign"]).alias("call_sign"), ship_type_name(static["Type"]).alias("ship_type"),
        _text(static["Destination"]).alias("destination"), F.nullif(static["MaximumStaticDraught"], F.lit(0.0)).alias("draught"), _size(dim["A"], dim["B"]).alias("length_m"), _size(dim["C"], dim["D"]).alias("beam_m"),
    ).where(F.col("ts").isNotNull())


def load_ais(messages: DataFrame, max_age_minutes: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """Positions carrying the latest static message sent before them; older than ``max_age_minutes`` dropped."""
    rows = parse_messages(messages)
    # a static message replaces all static fields at once
    static = F.when(F.col("is_static"), F.struct(*STATIC))
    filled = drop_bucket(last_known(rows, ["mmsi"], "ts", {"st": static}, tie=["is_static"]))
    out = filled.where(~F.col("is_static")).select("mmsi", "ts", "lat", "lon", "speed", "course", "heading", "nav_status", F.coalesce("name", "st.static_name").alias("name"), *[F.col(f"st.{c}").alias(c) for c in STATIC[1:]])
    if max_age_minutes is not None:
        out = out.where(F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {max_age_minutes} MINUTES"))
    return out


def load_locations(features: DataFrame, metadata: DataFrame, as_of: datetime, max_age_minutes: int = 30) -> DataFrame:
    """The REST shape: locations (mmsi, lat, lon, ts_ms, sog, cog, heading, nav_stat) joined to vessel metadata, whose
    draught is in decimetres."""
    meta = metadata.select(
        "mmsi", _text("name").alias("name"), F.when(F.col("imo").cast("string") != "0", F.col("imo").cast("string")).alias("imo"), _text("callSign").alias("call_sign"), ship_type_name(F.col("shipType")).alias("ship_type"), _text("destination").alias("destination"),
        (F.nullif("draught", F.lit(0)) / 10).alias("draught"), F.nullif(F.coalesce("referencePointA", F.lit(0)) + F.coalesce("referencePointB", F.lit(0)), F.lit(0)).cast("double").alias("length_m"))
    at = F.timestamp_millis("ts_ms")
    fresh = features.withColumn("ts", at).where(F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {max_age_minutes} MINUTES"))
    return fresh.select("mmsi", "ts", "lat", "lon", F.col("sog").alias("speed"), F.when(F.col("cog") != 360, F.col("cog")).alias("course"), "heading", nav_status_name(F.col("nav_stat")).alias("nav_status")).join(meta, "mmsi", "left")


# feeds give numbers as such or as text
STATION_ROW = "array<struct<MMSI:string,LATITUDE:string,LONGITUDE:string,TIME:string,SOG:string,COG:string,HEADING:string,NAVSTAT:string,NAME:string,IMO:string,CALLSIGN:string,TYPE:string,DEST:string>>"
AREA_ROW = "array<struct<MMSI:string,LAT:string,LON:string,TIMESTAMP:string,SPEED:string,COURSE:string,HEADING:string,STATUS:string,SHIPNAME:string,IMO:string,CALLSIGN:string,SHIPTYPE:string,FLAG:string,DESTINATION:string>>"


def _known(number: Column) -> Column:
    """Identifiers that are given as 0 are not known."""
    return F.when((number != "0") & (number != ""), number)


def _number(c: str, kind: str = "double") -> Column:
    return F.col(c).try_cast(kind)


def _refused(payloads: DataFrame, refusal: Column) -> DataFrame:
    """A payload that says it failed stops the load with what it says."""
    return payloads.where(F.when(refusal.isNotNull(), F.raise_error(F.concat(F.lit("the feed refused: "), refusal)).cast("boolean")).otherwise(F.lit(True)))


def load_station_feed(payloads: DataFrame) -> DataFrame:
    """The shape of station networks (value: a JSON array of a header and an array of positions, times in epoch seconds)."""
    value = F.col("value").cast("string")
    failed = F.lower(F.get_json_object(value, "$[0].ERROR")).isin("true", "1")
    good = _refused(payloads, F.when(failed, F.coalesce(F.get_json_object(value, "$[0].ERROR_MESSAGE"), F.lit("no reason given"))))
    r = good.select(F.explode(F.from_json(F.get_json_object(value, "$[1]"), STATION_ROW)).alias("r")).where(F.col("r.MMSI").isNotNull())
    out = r.select(
        F.col("r.MMSI").alias("mmsi"), F.timestamp_seconds(_number("r.TIME", "bigint")).alias("ts"), _number("r.LATITUDE").alias("lat"), _number("r.LONGITUDE").alias("lon"), _number("r.SOG").alias("speed"), _number("r.COG").alias("course"), _number("r.HEADING").alias("heading"), nav_status_name(_number("r.NAVSTAT", "int")).alias("nav_status"),
        _text("r.NAME").alias("name"), _known(F.col("r.IMO")).alias("imo"), _text("r.CALLSIGN").alias("call_sign"), F.when(_number("r.TYPE", "int") != 0, ship_type_name(_number("r.TYPE", "int"))).alias("ship_type"), _text("r.DEST").alias("destination"),
    )
    return out.where(F.col("ts").isNotNull())


def load_area_feed(payloads: DataFrame) -> DataFrame:
    """The shape of area exports (value: a JSON array of positions with times as text and speeds in tenths of a knot, or an
    object with errors). Rows without a readable time are left out; 0 stands for a value that is not known."""
    value = F.col("value").cast("string")
    good = _refused(payloads, F.get_json_object(value, "$.errors"))
    r = good.select(F.explode(F.from_json(value, AREA_ROW)).alias("r"))
    given = lambda c: F.when(_number(c) != 0, _number(c))
    out = r.select(
        F.col("r.MMSI").alias("mmsi"), F.try_to_timestamp("r.TIMESTAMP", F.lit("yyyy-MM-dd'T'HH:mm:ss")).alias("ts"), _number("r.LAT").alias("lat"), _number("r.LON").alias("lon"), (given("r.SPEED") / 10).alias("speed"), given("r.COURSE").alias("course"), given("r.HEADING").alias("heading"),
        nav_status_name(_number("r.STATUS", "int")).alias("nav_status"), F.col("r.SHIPNAME").alias("name"), _known(F.col("r.IMO")).alias("imo"), F.col("r.CALLSIGN").alias("call_sign"), F.when(_number("r.SHIPTYPE", "int") != 0, ship_type_name(_number("r.SHIPTYPE", "int"))).alias("ship_type"), F.col("r.FLAG").alias("flag"), F.col("r.DESTINATION").alias("destination"),
    )
    return out.where(F.col("ts").isNotNull())


def normalise_ais(positions: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Unavailable heading and speed become null, the flag comes from the MMSI prefix (prefix, iso), the IMO is
    validated and names are cleaned."""
    dim = prefixes.select(F.col("prefix").alias("_p"), F.col("iso").alias("_iso"))
    # a row a prefix of three digits; positions, most of which share a few prefixes, stay where they are
    joined = positions.withColumn("_p", F.substring(F.col("mmsi").cast("string"), 1, 3)).join(F.broadcast(dim), "_p", "left")
    flag = F.coalesce("flag", "_iso", F.lit("XX")) if "flag" in positions.columns else F.coalesce("_iso", F.lit("XX"))
    changed = {"heading": F.when(F.col("heading") < 511, F.col("heading")), "speed": F.when(F.col("speed") < 102.3, F.col("speed")), "imo": valid_imo(F.col("imo")), "name": clean_ais_name(F.col("name")), "destination": clean_ais_name(F.col("destination")), "flag": flag}
    return joined.withColumns({k: v for k, v in changed.items() if k == "flag" or k in positions.columns}).drop("_p", "_iso")
