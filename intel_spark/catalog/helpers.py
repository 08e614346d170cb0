"""Shared pieces of the registered queries: polygon rings from adapter boxes, and SQL fragments for the oracles."""

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31, tzinfo=timezone.utc)
AS_OF_ORDERS = datetime(2001, 6, 30, tzinfo=timezone.utc)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
AS_OF_ORDERS_SQL = "TIMESTAMP '2001-06-30 00:00:00'"


def diamond(cx, cy, r):
    points = [(1, 0), (0, 1), (-1, 0), (0, -1), (1, 0)]
    return F.array(*[F.struct((cx + dx * r).alias("lon"), (cy + dy * r).alias("lat")) for dx, dy in points])


def rings(areas: DataFrame) -> DataFrame:
    return areas.withColumn("ring", diamond(F.col("cx"), F.col("cy"), F.col("r"))).drop("cx", "cy", "r")


def land_rings(land: DataFrame) -> DataFrame:
    # open rings: the last vertex joins the first
    outer = land.select("polygon_id", F.lit(0).alias("ring_no"), F.slice(diamond(F.col("cx"), F.col("cy"), F.col("r")), 1, 4).alias("ring"))
    hole = land.where("hole > 0").select("polygon_id", F.lit(1).alias("ring_no"), F.slice(diamond(F.col("cx"), F.col("cy"), F.col("hole")), 1, 4).alias("ring"))
    return outer.unionByName(hole)


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    return (
        f"(2 * 6371000.0 * asin(sqrt(least(1.0, power(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * power(sin(radians({lon2} - {lon1}) / 2), 2)))))"
    )


def in_diamond(lat: str, lon: str, area: str) -> str:
    return f"abs({lon} - {area}.cx) + abs({lat} - {area}.cy) < {area}.r"


def flagged_sql(prefix: str = "") -> str:
    return f"(coalesce({prefix}sanctioned_status, 'clear') <> 'clear')"


def risky_sql(prefix: str = "") -> str:
    return f"(coalesce({prefix}sanctioned_status, 'clear') <> 'clear' OR coalesce({prefix}risk_score, 0) >= 0.5)"
