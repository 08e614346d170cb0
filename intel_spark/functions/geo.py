"""Distances, grid cells and point-in-ring tests as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """great-circle metres."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def cell(value: Column, degrees: float) -> Column:
    return F.floor(value / degrees)


def wrapped_column(col: Column, degrees: float) -> Column:
    """Longitude cell folded onto one turn, so neighbours meet across the antimeridian."""
    turn = int(round(360 / degrees))
    return F.pmod(col + turn // 2, F.lit(turn)) - turn // 2


def neighbour_offsets(reach: int = 1) -> Column:
    """Array of (dr, dc) covering the block of cells within ``reach``."""
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r in range(-reach, reach + 1) for c in range(-reach, reach + 1)])


def inside_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd crossing test over an array<struct<lon,lat>> whose last vertex repeats the first.

    A point exactly on an edge or vertex does not count as inside.
    """
    edges = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(F.element_at(ring, i).alias("a"), F.element_at(ring, i + 1).alias("b")))

    def crosses(e):
        a, b = e["a"], e["b"]
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        # the division only runs for an edge that straddles the latitude, so it never divides by zero
        return F.when(straddles, lon < (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]).otherwise(F.lit(False))

    def touches(e):
        a, b = e["a"], e["b"]
        area = (b["lon"] - a["lon"]) * (lat - a["lat"]) - (b["lat"] - a["lat"]) * (lon - a["lon"])
        return (area == 0) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"])) & lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"]))

    odd = F.size(F.filter(edges, crosses)) % 2 == 1
    return odd & ~F.exists(edges, touches)
