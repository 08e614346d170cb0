"""Proximity and containment joins keyed by grid cells, so every one of them is an equi-join.

Dimensions (ports, zones, facilities) become one row per grid cell they can reach. Spark measures that table and
broadcasts it only while it is under its own size limit; beyond it the same join runs as a shuffle on the cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.geo import cell, haversine_m, inside_ring, neighbour_offsets, wrapped_column
from intel_spark.session import checkpoint_ready

KM_PER_DEGREE = 111.0
POLAR_LATITUDE = 89.5


def _cells(rows: Column, cols: Column) -> Column:
    return F.flatten(F.transform(rows, lambda r: F.transform(cols, lambda c: F.struct(r.alias("r"), c.alias("c")))))


def _lookup(dim: DataFrame, cells: Column, entry: Column, name: str, degrees: float) -> DataFrame:
    """Cell -> array of dimension entries. The array is bounded by how many dims reach one cell, not by the points."""
    spread = dim.select(entry.alias("_entry"), F.explode(cells).alias("_key")).select("_entry", F.col("_key.r").alias("_row"), wrapped_column(F.col("_key.c"), degrees).alias("_col"))
    return spread.groupBy("_row", "_col").agg(F.collect_list("_entry").alias(name))


def _join_lookup(points: DataFrame, lookup: DataFrame, degrees: float) -> DataFrame:
    keyed = points.withColumn("_row", cell(F.col("lat"), degrees)).withColumn("_col", wrapped_column(cell(F.col("lon"), degrees), degrees))
    return keyed.join(lookup, ["_row", "_col"], "left").drop("_row", "_col")


def _lon_gap(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 180, F.lit(360.0)) - 180)


def _port_lookup(ports: DataFrame, name: str) -> DataFrame:
    entry = F.struct("name", "country", "lat", "lon", "radius_km", "risk_level", "sanctioned_facility")
    cells = _cells(F.sequence(F.floor(F.col("lat")) - 2, F.floor(F.col("lat")) + 2), F.sequence(F.floor(F.col("lon")) - 3, F.floor(F.col("lon")) + 3))
    return _lookup(ports, cells, entry, name, 1.0)


def nearest_port(points: DataFrame, ports: DataFrame, within_km: float | None = None) -> DataFrame:
    """Add struct ``port`` (nearest port inside 2 degrees of latitude and 3 of longitude) and ``port_km``."""
    def measured(p):
        km = haversine_m(F.col("lat"), F.col("lon"), p["lat"], p["lon"]) / 1000
        return F.struct(km.alias("km"), p["name"].alias("name"), p.alias("port"))

    near = F.filter("_ports", lambda p: (F.abs(p["lat"] - F.col("lat")) <= 2) & (_lon_gap(p["lon"], F.col("lon")) <= 3))
    joined = _join_lookup(points, _port_lookup(ports, "_ports"), 1.0).withColumn("_best", F.array_min(F.transform(near, measured)))
    if within_km is not None:
        joined = joined.withColumn("_best", F.when(F.col("_best.km") <= within_km, F.col("_best")))
    return joined.select(*points.columns, F.col("_best.port").alias("port"), F.col("_best.km").alias("port_km"))


def port_containing(points: DataFrame, ports: DataFrame) -> DataFrame:
    """The nearest port, kept only while the point lies within that port's radius."""
    found = nearest_port(points, ports)
    inside = F.col("port_km") <= F.col("port.radius_km")
    return found.withColumn("port", F.when(inside, F.col("port"))).withColumn("port_km", F.when(inside, F.col("port_km")))


def facility_containing(points: DataFrame, facilities: DataFrame) -> DataFrame:
    """Add struct ``facility``, the nearest facility whose own radius reaches the point, and ``facility_km``."""
    lat, lon, reach = F.col("lat"), F.col("lon"), F.col("radius_km") / KM_PER_DEGREE
    wide = reach / F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(POLAR_LATITUDE))))
    cells = _cells(F.sequence(F.floor(lat - reach), F.floor(lat + reach)), F.sequence(F.floor(lon - wide), F.floor(lon + wide)))
    entry = F.struct("id", "name", "type", "country", "commodity", "sanctioned", "lat", "lon", "radius_km")

    def measured(f):
        return F.struct((haversine_m(F.col("lat"), F.col("lon"), f["lat"], f["lon"]) / 1000).alias("km"), f["id"].alias("id"), f.alias("facility"))

    joined = _join_lookup(points, _lookup(facilities, cells, entry, "_facilities", 1.0), 1.0)
    best = F.array_min(F.filter(F.transform("_facilities", measured), lambda m: m["km"] <= m["facility"]["radius_km"]))
    return joined.withColumn("_best", best).select(*points.columns, F.col("_best.facility").alias("facility"), F.col("_best.km").alias("facility_km"))


def areas_containing(points: DataFrame, areas: DataFrame, name: str = "areas") -> DataFrame:
    """Add array ``name`` of struct(name, kind, context, choke_point) for every polygon around the point."""
    box = areas.select(
        "*", F.array_min("ring.lat").alias("_s"), F.array_max("ring.lat").alias("_n"), F.array_min("ring.lon").alias("_w"), F.array_max("ring.lon").alias("_e")
    )
    cells = _cells(F.sequence(F.floor("_s"), F.floor("_n")), F.sequence(F.floor("_w"), F.floor("_e")))
    entry = F.struct("name", "kind", "context", "choke_point", "ring", "_s", "_n", "_w", "_e")
    joined = _join_lookup(points, _lookup(box, cells, entry, "_areas", 1.0), 1.0)

    def inside(a):
        boxed = F.col("lat").between(a["_s"], a["_n"]) & F.col("lon").between(a["_w"], a["_e"])
        return F.when(boxed, inside_ring(F.col("lon"), F.col("lat"), a["ring"])).otherwise(F.lit(False))

    kept = F.transform(F.filter("_areas", inside), lambda a: F.struct(a["name"].alias("name"), a["kind"].alias("kind"), a["context"].alias("context"), a["choke_point"].alias("choke_point")))
    empty = F.array().cast("array<struct<name:string,kind:string,context:string,choke_point:boolean>>")
    return joined.select(*points.columns, F.coalesce(F.array_sort(kept), empty).alias(name))


def describe_location(points: DataFrame, ports: DataFrame, zones: DataFrame, lanes: DataFrame) -> DataFrame:
    """add ``place``: nearest port within 40 km, else a zone, else a lane, else the coordinates."""
    found = areas_containing(areas_containing(nearest_port(points, ports, 40), zones, "_zones"), lanes, "_lanes")
    place = (
        F.when(F.col("port").isNotNull(), F.format_string("%.0f km from %s (%s)", F.col("port_km"), F.col("port.name"), F.col("port.country")))
        .when(F.size("_zones") > 0, F.col("_zones")[0]["name"])
        .when(F.size("_lanes") > 0, F.col("_lanes")[0]["name"])
        .otherwise(F.format_string("%.3f, %.3f", F.col("lat"), F.col("lon")))
    )
    return found.select(*points.columns, place.alias("place"))


DENSE = 64  # edges of a ring in one cell beyond which the cell is cut in four
FINEST = 8  # times a cell is cut


def _crossings(edges: Column, x0: Column, y0: Column, x: Column, y: Column) -> Column:
    """How many edges of a cell the way from its corner crosses: first north or south along x0, then east or west along y.

    An edge counts where its ends lie on different sides, ends on the line counting as west or south of it.
    """
    def crossed(e):
        up = e["y1"] + (e["y2"] - e["y1"]) * (x0 - e["x1"]) / (e["x2"] - e["x1"])
        along = e["x1"] + (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"])
        first = ((e["x1"] > x0) != (e["x2"] > x0)) & ((up > y0) != (up > y))
        then = ((e["y1"] > y) != (e["y2"] > y)) & ((along > x0) != (along > x))
        return F.when(first, 1).otherwise(0) + F.when(then, 1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda n, e: n + crossed(e))


def land_index(land: DataFrame, dense: int = DENSE) -> tuple[DataFrame, int]:
    """Cells (level, row, col) that a ring of land (polygon_id, ring_no, ring) passes through or covers, one row a ring.

    A row holds the parity of the cell's south-west corner, whether it lies inside the ring, and the ring's edges in the cell.
    A point's own parity follows from the few edges between the corner and the point. Cells are whole degrees; where a ring
    has many edges its cell is cut in four, and again, so that a point meets about ``dense`` edges of a ring at most. The finest
    level is returned with the cells.
    """
    n = F.size("ring")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.col("ring")[i]["lon"].alias("x1"), F.col("ring")[i]["lat"].alias("y1"), F.col("ring")[(i + 1) % n]["lon"].alias("x2"), F.col("ring")[(i + 1) % n]["lat"].alias("y2")))
    edges = land.where(n > 0).select("polygon_id", "ring_no", F.explode(pieces).alias("e")).where((F.col("e.x1") != F.col("e.x2")) | (F.col("e.y1") != F.col("e.y2")))
    key = ["polygon_id", "ring_no"]
    x1, y1, x2, y2 = (F.col(f"e.{c}") for c in ("x1", "y1", "x2", "y2"))
    # where a ring crosses the southern border of a row of cells: corners between two crossings lie inside
    at = x1 + (x2 - x1) * (F.col("row") - y1) / (y2 - y1)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    rows = F.when(F.ceil(low) <= F.floor(high), F.sequence(F.ceil(low), F.floor(high))).otherwise(F.array().cast("array<bigint>"))
    meets = edges.withColumn("row", F.explode(rows)).where((y1 > F.col("row")) != (y2 > F.col("row"))).groupBy(*key, "row").agg(F.array_sort(F.collect_list(at)).alias("xs"))
    spans = F.transform(F.sequence(F.lit(0), (F.size("xs") / 2).cast("int") - 1), lambda i: F.when(F.ceil(F.col("xs")[2 * i]) < F.ceil(F.col("xs")[2 * i + 1]), F.sequence(F.ceil(F.col("xs")[2 * i]), F.ceil(F.col("xs")[2 * i + 1]) - 1)).otherwise(F.array().cast("array<bigint>")))
    inside = meets.select(*key, "row", F.explode(F.array_distinct(F.flatten(spans))).alias("col")).withColumn("parity", F.lit(1))
    # the cells an edge passes through, row by row
    x_at = lambda y: F.when(y1 == y2, x1).otherwise(x1 + (x2 - x1) * (y - y1) / (y2 - y1))
    strip = edges.withColumn("row", F.explode(F.sequence(F.floor(low), F.floor(high))))
    south, north = x_at(F.greatest(low, F.col("row").cast("double"))), x_at(F.least(high, F.col("row") + 1.0))
    west, east = F.when(y1 == y2, F.least(x1, x2)).otherwise(F.least(south, north)), F.when(y1 == y2, F.greatest(x1, x2)).otherwise(F.greatest(south, north))
    # rounding may put a border crossing beside its cell: the neighbours within a millionth of a degree hold the edge too
    touched = strip.withColumn("col", F.explode(F.sequence(F.floor(west - 1e-6), F.floor(east + 1e-6)))).groupBy(*key, "row", "col").agg(F.collect_list("e").alias("edges"))
    cells = touched.join(inside, [*key, "row", "col"], "full").select(*key, F.lit(0).alias("level"), "row", "col", F.coalesce("parity", F.lit(0)).alias("parity"), F.coalesce("edges", F.array().cast(touched.schema["edges"].dataType)).alias("edges"))
    checkpoint_ready(land.sparkSession)
    cells = cells.checkpoint()
    done, finest = cells.where(F.size("edges") <= dense), 0
    for level in range(1, FINEST + 1):
        cells = cells.where(F.size("edges") > dense)
        if cells.isEmpty():
            break
        finest = level
        quarters = F.array(*[F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1)])
        size, outer = 2.0**-level, 2.0 ** (1 - level)
        cut = cells.withColumn("q", F.explode(quarters)).withColumns({"x0": F.col("col") * outer, "y0": F.col("row") * outer}).withColumns({"x": F.col("x0") + F.col("q.c") * size, "y": F.col("y0") + F.col("q.r") * size})
        parity = (F.col("parity") + _crossings(F.col("edges"), F.col("x0"), F.col("y0"), F.col("x"), F.col("y"))) % 2
        kept = F.filter("edges", lambda e: (F.greatest(e["x1"], e["x2"]) >= F.col("x") - 1e-6) & (F.least(e["x1"], e["x2"]) <= F.col("x") + size + 1e-6) & (F.greatest(e["y1"], e["y2"]) >= F.col("y") - 1e-6) & (F.least(e["y1"], e["y2"]) <= F.col("y") + size + 1e-6))
        cells = cut.select(*key, F.lit(level).alias("level"), (F.col("row") * 2 + F.col("q.r")).alias("row"), (F.col("col") * 2 + F.col("q.c")).alias("col"), parity.cast("int").alias("parity"), kept.alias("edges")).checkpoint()
        done = done.unionByName(cells if level == FINEST else cells.where(F.size("edges") <= dense))
    return done, finest


def is_land(spots: DataFrame, land: DataFrame, dense: int = DENSE) -> DataFrame:
    """Distinct spots (lat, lon) that lie inside a land polygon and outside its holes."""
    index, finest = land_index(land, dense)
    levels = F.array(*[F.struct(F.lit(v).alias("level"), F.floor(F.col("lat") * 2.0**v).alias("row"), F.floor(F.col("lon") * 2.0**v).alias("col")) for v in range(finest + 1)])
    asked = spots.select("lat", "lon").where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).distinct().select("lat", "lon", F.explode(levels).alias("c")).select("lat", "lon", "c.*")
    # a ring's cells do not overlap, so a spot meets each ring once
    met = asked.join(index, ["level", "row", "col"])
    size = F.pow(F.lit(2.0), -F.col("level"))
    odd = (F.col("parity") + _crossings(F.col("edges"), F.col("col") * size, F.col("row") * size, F.col("lon"), F.col("lat"))) % 2
    polygons = met.select("lat", "lon", "polygon_id", "ring_no", odd.alias("odd")).groupBy("lat", "lon", "polygon_id").agg(
        F.max(F.when(F.col("ring_no") == 0, F.col("odd"))).alias("outer"), F.max(F.when(F.col("ring_no") > 0, F.col("odd"))).alias("hole")
    )
    return polygons.where((F.col("outer") == 1) & (F.coalesce("hole", F.lit(0)) == 0)).select("lat", "lon").distinct()


def coast_distance(spots: DataFrame, land: DataFrame) -> DataFrame:
    """Kilometres from each distinct spot to the nearest coastline vertex in the 3 x 3 block of whole-degree cells."""
    vertices = land.select(F.explode("ring").alias("v")).select(F.col("v.lat").alias("vy"), F.col("v.lon").alias("vx"))
    cells = vertices.select("*", F.explode(neighbour_offsets()).alias("o")).select("vy", "vx", (F.floor("vy") + F.col("o.dr")).alias("_row"), wrapped_column(F.floor("vx") + F.col("o.dc"), 1.0).alias("_col"))
    placed = spots.select("lat", "lon").distinct().withColumn("_row", F.floor("lat")).withColumn("_col", wrapped_column(F.floor("lon"), 1.0))
    return placed.join(cells, ["_row", "_col"]).groupBy("lat", "lon").agg(F.min(haversine_m(F.col("lat"), F.col("lon"), F.col("vy"), F.col("vx")) / 1000).alias("coast_km"))


def with_inland(points: DataFrame, land: DataFrame, margin_km: float = 3.0, lat: str = "lat", lon: str = "lon", name: str = "inland") -> DataFrame:
    """Add ``name``: on land and further than the margin from the coast, judged on a 0.01-degree raster."""
    raster = points.withColumn("_la", F.round(lat, 2)).withColumn("_lo", F.round(lon, 2))
    spots = raster.select(F.col("_la").alias("lat"), F.col("_lo").alias("lon")).distinct()
    dry = is_land(spots, land)
    judged = dry.join(coast_distance(dry, land), ["lat", "lon"], "left").where(F.col("coast_km").isNull() | (F.col("coast_km") > margin_km))
    judged = judged.select(F.col("lat").alias("_la"), F.col("lon").alias("_lo"), F.lit(True).alias("_in"))
    joined = raster.join(judged, ["_la", "_lo"], "left")
    return joined.select(*points.columns, F.coalesce("_in", F.lit(False)).alias(name))


def neighbourhood_counts(points: DataFrame, degrees: float, key: str) -> DataFrame:
    """Distinct keys in the 3 x 3 block around every occupied cell.

    Rows shrink to distinct (cell, key) before they are spread over nine cells.
    """
    placed = points.select(cell(F.col("lat"), degrees).alias("row"), cell(F.col("lon"), degrees).alias("col"), F.col(key).alias("_k")).distinct()
    occupied = placed.select("row", "col").distinct()
    spread = placed.select("_k", "row", "col", F.explode(neighbour_offsets()).alias("o")).select("_k", (F.col("row") + F.col("o.dr")).alias("row"), wrapped_column(F.col("col") + F.col("o.dc"), degrees).alias("col"))
    counts = spread.groupBy("row", "col").agg(F.countDistinct("_k").alias("neighbours"))
    return occupied.join(counts, ["row", "col"])


def proximity_pairs(vessels: DataFrame, ports: DataFrame | None, land: DataFrame | None, metres: float = 500.0, max_speed: float = 1.5, port_km: float = 3.0, crowd: int = 8) -> DataFrame:
    """Pairs of slow, plausible hulls within ``metres`` of each other, away from ports and inland water.

    Crowding is counted on 0.02-degree blocks first. Pairs then form on cells just wide enough for the distance, and a
    hull that could not belong to any pair (untyped in a crowd, or nothing typed nearby) is dropped before the join,
    so a packed anchorage yields only the tanker pairs that the result keeps.
    """
    from intel_spark.functions.vessel import rendezvous_plausible, tanker_hull, typed_hull

    grid = 0.02
    slow = vessels.where(F.col("lat").isNotNull() & (F.col("speed") <= max_speed) & rendezvous_plausible(F.col("ship_type"), F.col("name"), F.col("nav_status")))
    slow = slow.select("id", "lat", "lon", "ship_type", typed_hull(F.col("ship_type")).alias("typed"), tanker_hull(F.col("ship_type")).alias("tanker"))
    slow = slow.withColumn("row", cell(F.col("lat"), grid)).withColumn("col", cell(F.col("lon"), grid))
    crowds = slow.groupBy("row", "col").count().select(F.explode(F.transform(neighbour_offsets(), lambda o: F.struct((F.col("row") + o["dr"]).alias("row"), wrapped_column(F.col("col") + o["dc"], grid).alias("col")))).alias("n"), "count")
    crowds = crowds.groupBy(F.col("n.row").alias("row"), F.col("n.col").alias("col")).agg(F.sum("count").alias("neighbours"))
    slow = slow.join(crowds, ["row", "col"]).where((F.col("neighbours") < crowd) | F.col("typed"))
    if ports is not None:
        slow = nearest_port(slow, ports, port_km).withColumn("in_port", F.col("port").isNotNull()).drop("port", "port_km")
    else:
        slow = slow.withColumn("in_port", F.lit(False))
    # one cell is at least the distance in latitude; longitude cells widen towards the poles
    step = metres / 1000 / KM_PER_DEGREE * 1.01
    zone = F.floor(F.abs(F.col("lat")) / 5)
    lon_step = step / F.cos(F.radians(F.least((zone + 1) * 5 + 0.0, F.lit(POLAR_LATITUDE))))
    placed = slow.withColumn("_r", F.floor(F.col("lat") / step)).withColumn("_w", lon_step)
    a = placed.withColumn("_c", F.floor(F.col("lon") / F.col("_w"))).withColumn("_z", F.floor(F.abs(F.col("lat")) / 5))
    # the partner side is placed in the neighbouring cells of every latitude zone its own distance can reach
    zones = F.array_distinct(F.array(F.floor(F.abs(F.col("lat") - step) / 5), F.floor(F.abs(F.col("lat") + step) / 5)))
    b = placed.withColumn("_z", F.explode(zones)).withColumn("_w", step / F.cos(F.radians(F.least((F.col("_z") + 1) * 5 + 0.0, F.lit(POLAR_LATITUDE)))))
    b = b.withColumn("o", F.explode(neighbour_offsets())).select(
        F.col("id").alias("b_id"), F.col("lat").alias("b_lat"), F.col("lon").alias("b_lon"), F.col("typed").alias("b_typed"), F.col("tanker").alias("b_tanker"),
        "_z", (F.col("_r") + F.col("o.dr")).alias("_r"), (F.floor(F.col("lon") / F.col("_w")) + F.col("o.dc")).alias("_c"),
    )
    a = a.select(F.col("id").alias("a_id"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.col("typed").alias("a_typed"), F.col("tanker").alias("a_tanker"), "neighbours", "in_port", "_z", "_r", "_c")
    both, any_tanker = F.col("a_typed") & F.col("b_typed"), F.col("a_tanker") | F.col("b_tanker")
    allowed = F.when(F.col("neighbours") >= crowd, both & any_tanker).otherwise(F.col("a_typed") | F.col("b_typed"))
    near = haversine_m(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon"))
    pairs = a.where(~F.col("in_port")).join(b, ["_z", "_r", "_c"]).where((F.col("a_id") < F.col("b_id")) & allowed).withColumn("distance_m", near).where(F.col("distance_m") <= metres)
    pairs = pairs.select("a_id", "b_id", "a_lat", "a_lon", "b_lat", "b_lon", "a_typed", "b_typed", "a_tanker", "b_tanker", "distance_m", "neighbours").withColumn("lat", (F.col("a_lat") + F.col("b_lat")) / 2).withColumn("lon", (F.col("a_lon") + F.col("b_lon")) / 2)
    if land is not None:
        pairs = with_inland(pairs, land).where(~F.col("inland")).drop("inland")
    return pairs


def areas_at(df: DataFrame, areas: DataFrame, lat: Column, lon: Column, name: str) -> DataFrame:
    """``areas_containing`` for coordinates other than the frame's own lat and lon."""
    moved = df.withColumnsRenamed({"lat": "_lat0", "lon": "_lon0"}) if "lat" in df.columns else df
    moved = moved.withColumn("lat", lat).withColumn("lon", lon)
    found = areas_containing(moved, areas, name).drop("lat", "lon")
    return found.withColumnsRenamed({"_lat0": "lat", "_lon0": "lon"})
