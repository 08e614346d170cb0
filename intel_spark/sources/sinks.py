"""Exports and append-only writes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def export_rows(df: DataFrame) -> DataFrame:
    """Arrays joined with ";", other nested values as JSON, so every column fits a CSV cell."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType):
            c = F.array_join(c, ";")
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        out.append(c.alias(field.name))
    return df.select(*out)


def export_csv(df: DataFrame, path: str) -> None:
    export_rows(df).write.mode("overwrite").option("header", "true").csv(path)


def to_geojson(df: DataFrame, lon: str, lat: str, props: list[str]) -> DataFrame:
    """One point feature per row as JSON text; a file of them is a feature sequence."""
    point = F.struct(F.lit("Point").alias("type"), F.array(F.col(lon), F.col(lat)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*props).alias("properties"))
    return df.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(F.to_json(feature).alias("feature"))


def polygons_geojson(areas: DataFrame) -> DataFrame:
    """Polygon features under each authority that names them; rendezvous hubs and unnamed ones apart."""
    ring = F.transform("ring", lambda p: F.array(p["lon"], p["lat"]))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct("name", "kind", "context").alias("properties"))
    groups = F.when(F.col("kind") == "sts_hub", F.array(F.lit("sts_hubs"))).when(F.size("authorities") == 0, F.array(F.lit("other"))).otherwise(F.transform("authorities", F.lower))
    return areas.select(F.explode(groups).alias("authority"), "name", F.to_json(feature).alias("feature"))


def audit_rows(df: DataFrame, action: str, rationale: Column, user: str = "system", as_of: datetime | None = None, vessel: str | None = None) -> DataFrame:
    """One audit row per input row, its evidence kept as JSON."""
    return df.select(
        F.lit(action).alias("action"), F.lit(user).alias("user_id"), (F.col(vessel) if vessel else F.lit(None)).cast("long").alias("vessel_id"), rationale.alias("rationale"), F.to_json(F.struct(*df.columns)).alias("evidence"), (F.lit(as_of) if as_of else F.current_timestamp()).alias("ts")
    )


def append_audit(rows: DataFrame, path: str) -> None:
    """Append only: existing files are never rewritten."""
    rows.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(path)


def write_partitions(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Replace only the days present in ``df``; relies on dynamic partition overwrite."""
    df.withColumn("day", F.to_date(ts)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
