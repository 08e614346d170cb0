"""Registered vessel-tracking queries."""

from pyspark.sql import functions as F

from intel_spark.catalog.helpers import AS_OF, AS_OF_ORDERS, AS_OF_ORDERS_SQL, AS_OF_SQL, flagged_sql, hav, in_diamond, land_rings, rings, risky_sql
from intel_spark.catalog.registry import query, r4, ts
from intel_spark.operators import maritime as v
from intel_spark.operators import spatial as g
from intel_spark.operators.timeline import asof_nearest, drop_bucket, latest_per_key

PORT_OF = f"""SELECT p.id, p.mmsi, p.ts, p.lat, p.lon, p.speed, p.draught, q.name AS near, {hav('p.lat', 'p.lon', 'q.lat', 'q.lon')} / 1000 AS km, q.radius_km
    FROM {{positions}} p LEFT JOIN {{ports}} q ON abs(p.lat - q.lat) <= 2 AND abs(p.lon - q.lon) <= 3 QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY km, q.name) = 1"""


@query("f11_haversine", inputs="positions", oracle=f"SELECT id, {r4(hav('lat', 'lon', '56.0', '11.5'), 'metres')} FROM {{positions}}")
def _(positions):
    from intel_spark.functions.geo import haversine_m
    return positions.select("id", haversine_m(F.col("lat"), F.col("lon"), F.lit(56.0), F.lit(11.5)).alias("metres"))


@query("j09_nearest_port", inputs="positions ports", oracle=f"WITH n AS ({PORT_OF}) SELECT id, near AS port, {r4('km', 'port_km')} FROM n")
def _(positions, ports):
    return g.nearest_port(positions.select("id", "lat", "lon"), ports).select("id", F.col("port.name").alias("port"), "port_km")


@query("j09_port_containing", inputs="positions ports", oracle=f"WITH n AS ({PORT_OF}) SELECT id, near AS port, {r4('km', 'port_km')} FROM n WHERE km <= radius_km")
def _(positions, ports):
    return g.port_containing(positions.select("id", "lat", "lon"), ports).where(F.col("port").isNotNull()).select("id", F.col("port.name").alias("port"), "port_km")


@query("j09_facility_containing", inputs="positions facilities", oracle=f"""
    SELECT p.id, f.id AS facility, {r4(hav('p.lat', 'p.lon', 'f.lat', 'f.lon') + ' / 1000', 'km')} FROM {{positions}} p JOIN {{facilities}} f ON {hav('p.lat', 'p.lon', 'f.lat', 'f.lon')} / 1000 <= f.radius_km
    QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY {hav('p.lat', 'p.lon', 'f.lat', 'f.lon')}, f.id) = 1""")
def _(positions, facilities):
    return g.facility_containing(positions.select("id", "lat", "lon"), facilities).where(F.col("facility").isNotNull()).select("id", F.col("facility.id").alias("facility"), F.col("facility_km").alias("km"))


@query("j10_areas_containing", inputs="positions zones", oracle=f"SELECT p.id, string_agg(z.name, ',' ORDER BY z.name) AS areas FROM {{positions}} p JOIN {{zones}} z ON {in_diamond('p.lat', 'p.lon', 'z')} GROUP BY p.id")
def _(positions, zones):
    found = g.areas_containing(positions.select("id", "lat", "lon"), rings(zones))
    return found.where(F.size("areas") > 0).select("id", F.transform("areas", lambda a: a["name"]).alias("areas"))


INLAND = f"""s AS (SELECT DISTINCT round(lat, 2) AS lat, round(lon, 2) AS lon FROM {{positions}}),
    dry AS (SELECT DISTINCT s.lat, s.lon FROM s JOIN {{land}} l ON abs(s.lon - cx) + abs(s.lat - cy) < r AND NOT (hole > 0 AND abs(s.lon - cx) + abs(s.lat - cy) < hole)),
    vx AS (SELECT cx + dx * k AS x, cy + dy * k AS y FROM (SELECT cx, cy, unnest([r, hole]) AS k FROM {{land}}), (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) d(dx, dy) WHERE k > 0),
    cd AS (SELECT dry.lat, dry.lon, min({hav('dry.lat', 'dry.lon', 'y', 'x')}) / 1000 AS km FROM dry JOIN vx ON abs(floor(dry.lat) - floor(y)) <= 1 AND abs(floor(dry.lon) - floor(x)) <= 1 GROUP BY 1, 2),
    inl AS (SELECT dry.lat, dry.lon FROM dry LEFT JOIN cd USING (lat, lon) WHERE km IS NULL OR km > 5)"""


@query("j11_is_land", inputs="positions land", oracle=f"WITH {INLAND} SELECT {r4('lat')}, {r4('lon')} FROM dry")
def _(positions, land):
    spots = positions.select(F.round("lat", 2).alias("lat"), F.round("lon", 2).alias("lon"))
    return g.is_land(spots, land_rings(land))


@query("j11_is_inland", inputs="positions land", oracle=f"WITH {INLAND} SELECT p.id FROM {{positions}} p JOIN inl ON round(p.lat, 2) = inl.lat AND round(p.lon, 2) = inl.lon")
def _(positions, land):
    return g.with_inland(positions.select("id", "lat", "lon"), land_rings(land), 5.0).where("inland").select("id")


@query("f34_describe_location", inputs="positions ports zones lanes", oracle=f"""
    WITH n AS ({PORT_OF}), z AS (SELECT p.id, min(z.name) AS zone FROM {{positions}} p JOIN {{zones}} z ON {in_diamond('p.lat', 'p.lon', 'z')} GROUP BY 1),
    l AS (SELECT p.id, min(z.name) AS lane FROM {{positions}} p JOIN {{lanes}} z ON {in_diamond('p.lat', 'p.lon', 'z')} GROUP BY 1)
    SELECT n.id, CASE WHEN km <= 40 THEN printf('%.0f km from %s (%s)', km, near, (SELECT country FROM {{ports}} q WHERE q.name = near)) WHEN zone IS NOT NULL THEN zone WHEN lane IS NOT NULL THEN lane ELSE printf('%.3f, %.3f', lat, lon) END AS place
    FROM n LEFT JOIN z ON z.id = n.id LEFT JOIN l ON l.id = n.id""")
def _(positions, ports, zones, lanes):
    return g.describe_location(positions.select("id", "lat", "lon"), ports, rings(zones), rings(lanes)).select("id", "place")


@query("g21_neighbourhood_counts", inputs="evasion", oracle="""
    WITH c AS (SELECT DISTINCT CAST(floor(lat / 0.5) AS BIGINT) AS row, CAST(floor(lon / 0.5) AS BIGINT) AS col, vessel_id FROM {evasion}), o AS (SELECT DISTINCT row, col FROM c)
    SELECT o.row, o.col, count(DISTINCT vessel_id) AS neighbours FROM o JOIN c ON abs(o.row - c.row) <= 1 AND abs(o.col - c.col) <= 1 GROUP BY 1, 2""")
def _(evasion):
    return g.neighbourhood_counts(evasion, 0.5, "vessel_id")


PAIRS = f"""sl AS (SELECT *, CAST(floor(lat / 0.02) AS BIGINT) AS rw, CAST(floor(lon / 0.02) AS BIGINT) AS cl, regexp_matches(lower(ship_type), 'tanker|cargo') AS typed, contains(lower(ship_type), 'tanker') AS tanker
      FROM {{vessels}} WHERE speed <= 1.5 AND nav_status <> 'moored' AND NOT regexp_matches(lower(ship_type), 'fishing|passenger')),
    nb AS (SELECT a.id, count(*) AS neighbours FROM sl a JOIN sl b ON abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 GROUP BY 1),
    pr AS (SELECT a.id AS a_id, b.id AS b_id, {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_m, neighbours, a.typed AS ta, b.typed AS tb, a.tanker AS ka, b.tanker AS kb, (a.lat + b.lat) / 2 AS lat, (a.lon + b.lon) / 2 AS lon
      FROM sl a JOIN sl b ON a.id < b.id AND abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1 JOIN nb ON nb.id = a.id
      WHERE (a.typed OR b.typed) AND (neighbours < 8 OR (a.typed AND b.typed AND (a.tanker OR b.tanker))) AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 900
      AND NOT EXISTS (SELECT 1 FROM {{ports}} q WHERE {hav('a.lat', 'a.lon', 'q.lat', 'q.lon')} <= 3000))"""


# pairs whose midpoint, on the raster, is not inland
AFLOAT = f"""vx AS (SELECT cx + dx * k AS x, cy + dy * k AS y FROM (SELECT cx, cy, unnest([r, hole]) AS k FROM {{land}}), (VALUES (1, 0), (0, 1), (-1, 0), (0, -1)) d(dx, dy) WHERE k > 0),
    dry AS (SELECT DISTINCT la, lo FROM (SELECT round(lat, 2) AS la, round(lon, 2) AS lo FROM pr) JOIN {{land}} l ON abs(lo - cx) + abs(la - cy) < r AND NOT (hole > 0 AND abs(lo - cx) + abs(la - cy) < hole)),
    cd AS (SELECT la, lo, min({hav('la', 'lo', 'y', 'x')}) / 1000 AS km FROM dry JOIN vx ON abs(floor(la) - floor(y)) <= 1 AND abs(floor(lo) - floor(x)) <= 1 GROUP BY 1, 2),
    wet AS (SELECT pr.* FROM pr LEFT JOIN (SELECT dry.la, dry.lo FROM dry LEFT JOIN cd USING (la, lo) WHERE km IS NULL OR km > 3) i ON i.la = round(pr.lat, 2) AND i.lo = round(pr.lon, 2) WHERE i.la IS NULL)"""


@query("j08_proximity_pairs", inputs="vessels ports land", oracle=f"WITH {PAIRS}, {AFLOAT} SELECT a_id, b_id, {r4('distance_m')}, neighbours FROM wet")
def _(vessels, ports, land):
    return g.proximity_pairs(vessels, ports, land_rings(land), 900.0).select("a_id", "b_id", "distance_m", "neighbours")


HIGH = "z.kind IN ('sanctions_zone', 'war_zone')"


@query("w08_ais_gaps", inputs="positions zones", oracle=f"""
    WITH l AS (SELECT *, lag(ts) OVER s AS pts, lag(speed) OVER s AS psp, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon FROM {{positions}} WINDOW s AS (PARTITION BY mmsi ORDER BY ts)),
    gp AS (SELECT *, (epoch_us(ts) - epoch_us(pts)) / 3.6e9 AS gh, coalesce(psp, 0) >= 1 AS uw FROM l WHERE (epoch_us(ts) - epoch_us(pts)) / 3.6e9 >= 12),
    zz AS (SELECT gp.*, (SELECT count(*) FROM {{zones}} z WHERE {HIGH} AND {in_diamond('gp.lat', 'gp.lon', 'z')}) + (SELECT count(*) FROM {{zones}} z WHERE {HIGH} AND {in_diamond('gp.plat', 'gp.plon', 'z')}) AS nz FROM gp)
    SELECT mmsi, {ts('ts')}, {r4('round(gh, 2)', 'gap_hours')}, nz AS zones, CASE WHEN nz > 0 AND gh >= 48 THEN 'critical' WHEN nz > 0 OR (uw AND gh >= 48) THEN 'high' WHEN uw THEN 'medium' ELSE 'low' END AS severity,
    {r4("CASE WHEN nz > 0 AND gh >= 48 THEN 0.85 WHEN nz > 0 THEN 0.7 WHEN uw AND gh >= 48 THEN 0.6 WHEN uw THEN 0.45 ELSE 0.25 END", "confidence")} FROM zz""")
def _(positions, zones):
    return v.ais_gaps(positions, rings(zones), 12).select("mmsi", "ts", "gap_hours", F.size("zones").alias("zones"), "severity", "confidence")


ANOMALY = f"""l AS (SELECT *, lag(ts) OVER s AS pts, lag(lat) OVER s AS plat, lag(lon) OVER s AS plon, CASE WHEN ship_type = 'Passenger' THEN 45 ELSE 30 END AS lim FROM {{positions}} WINDOW s AS (PARTITION BY mmsi ORDER BY ts)),
    m AS (SELECT *, (epoch_us(ts) - epoch_us(pts)) / 3.6e9 AS h, CASE WHEN epoch_us(ts) > epoch_us(pts) THEN {hav('plat', 'plon', 'lat', 'lon')} / 1852 END AS nm FROM l),
    k AS (SELECT *, coalesce(speed > lim, false) AS fast, coalesce(nm > 5 AND nm / h > 60, false) AS jump FROM m),
    an AS (SELECT *, (fast AND jump) OR coalesce(round(nm / h, 1), 0) > 200 OR coalesce(speed, 0) > 2 * lim AS severe FROM k WHERE fast OR jump)"""


@query("w09_position_anomalies", inputs="positions", oracle=f"""
    WITH {ANOMALY} SELECT mmsi, {ts('ts')}, CASE WHEN severe THEN 'high' ELSE 'medium' END AS severity, {r4("CASE WHEN severe THEN 0.65 ELSE 0.45 END", "confidence")}, {r4("round(nm, 1)", "distance_nm")}, concat_ws(',', CASE WHEN fast THEN 'speed' END, CASE WHEN jump THEN 'jump' END) AS reasons FROM an""")
def _(positions):
    return v.position_anomalies(positions).select("mmsi", "ts", "severity", "confidence", "distance_nm", "reasons")


@query("w12_fold_anomalies", inputs="positions", oracle=f"""
    WITH {ANOMALY}, f AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY mmsi ORDER BY ts) <= 36 * 3600000000 THEN 0 ELSE 1 END AS brk, CASE WHEN severe THEN 0.65 ELSE 0.45 END AS conf FROM an),
    i AS (SELECT *, sum(brk) OVER (PARTITION BY mmsi ORDER BY ts) AS island FROM f)
    SELECT mmsi, {ts('min(ts)', 'first_ts')}, {ts('max(ts)', 'ts')}, count(*) AS repeats, {r4('max(conf)', 'confidence')}, {r4('max_by(lat, ts)', 'lat')} FROM i GROUP BY mmsi, island""")
def _(positions):
    return v.fold_anomalies(v.position_anomalies(positions), 36).select("mmsi", "first_ts", "ts", "repeats", "confidence", "lat")


@query("w10_identity_changes", inputs="positions", oracle=f"""
    WITH nm AS (SELECT mmsi, ts, name, replace(replace(name, ' II', ' 2'), ' ', '') AS tok FROM {{positions}} WHERE name IS NOT NULL), lg AS (SELECT *, lag(tok) OVER s AS pt, lag(name) OVER s AS pn FROM nm WINDOW s AS (PARTITION BY mmsi ORDER BY ts)),
    ru AS (SELECT *, lag(tok, 2) OVER s AS t2, lag(tok, 3) OVER s AS t3, lag(tok, 4) OVER s AS t4 FROM lg WHERE pt IS NULL OR pt <> tok WINDOW s AS (PARTITION BY mmsi ORDER BY ts)),
    fl AS (SELECT mmsi, ts, flag, lag(flag) OVER (PARTITION BY mmsi ORDER BY ts) AS pf FROM {{positions}} WHERE flag <> 'XX')
    SELECT mmsi, {ts('ts')}, 'name_change' AS event_type, pn AS old_value, name AS new_value FROM ru WHERE pt IS NOT NULL AND tok IS DISTINCT FROM t2 AND tok IS DISTINCT FROM t3 AND tok IS DISTINCT FROM t4
    UNION ALL SELECT mmsi, {ts('ts')}, 'flag_change', pf, flag FROM fl WHERE pf <> flag""")
def _(positions):
    return v.identity_changes(positions).select("mmsi", "ts", "event_type", "old_value", "new_value")


@query("w11_imo_conflicts", inputs="positions", oracle=f"""
    WITH RECURSIVE rp AS (SELECT imo, mmsi, ts, row_number() OVER (PARTITION BY imo ORDER BY ts, mmsi) AS k FROM {{positions}} WHERE imo IS NOT NULL),
    wk AS (SELECT imo, mmsi, ts, k, mmsi AS holder, ts AS seen, CAST(NULL AS VARCHAR) AS prev_holder, 'first' AS kind FROM rp WHERE k = 1
      UNION ALL SELECT r.imo, r.mmsi, r.ts, r.k, CASE WHEN r.mmsi = w.holder OR epoch_us(r.ts) - epoch_us(w.seen) > 86400000000 THEN r.mmsi ELSE w.holder END, CASE WHEN r.mmsi = w.holder OR epoch_us(r.ts) - epoch_us(w.seen) > 86400000000 THEN r.ts ELSE w.seen END,
        w.holder, CASE WHEN r.mmsi = w.holder THEN 'same' WHEN epoch_us(r.ts) - epoch_us(w.seen) > 86400000000 THEN 'identity_transfer' ELSE 'identity_conflict' END FROM wk w JOIN rp r ON r.imo = w.imo AND r.k = w.k + 1)
    SELECT imo, mmsi, prev_holder AS holder, kind, {ts('ts')} FROM wk WHERE kind = 'identity_transfer'
    UNION ALL SELECT imo, mmsi, prev_holder, kind, {ts('min(ts)')[:-8]}ts FROM wk WHERE kind = 'identity_conflict' GROUP BY imo, mmsi, prev_holder, kind, CAST(ts AS DATE)""")
def _(positions):
    return v.imo_conflicts(positions).select("imo", "mmsi", "holder", "kind", "ts")


@query("j13_asof_nearest", inputs="positions anomalies", oracle=f"""
    SELECT p.id, {ts('q.ts', 'near_ts')}, CAST(floor(abs(epoch_us(p.ts) - epoch_us(q.ts)) / 1e6) AS BIGINT) AS gap_s FROM {{positions}} p JOIN {{anomalies}} q ON q.vessel_id = p.vessel_id AND abs(epoch_us(p.ts) - epoch_us(q.ts)) <= 21600000000
    QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY abs(epoch_us(p.ts) - epoch_us(q.ts)), q.ts DESC) = 1""")
def _(positions, anomalies):
    found = asof_nearest(positions.select("id", "vessel_id", "ts"), anomalies.select("vessel_id", "ts", "lat"), ["vessel_id"], "ts", ["lat"], 21_600)
    return found.where(F.col("match").isNotNull()).select("id", F.col("match.ts").alias("near_ts"), F.floor("gap_s").alias("gap_s"))


DURATION = f"""hp AS (SELECT a.id AS a_id, b.id AS b_id FROM {{vessels}} a JOIN {{vessels}} b ON b.id = a.id + 10),
    mt AS (SELECT a_id, b_id, x.ts, {hav('x.lat', 'x.lon', 'y.lat', 'y.lon')} <= 60000 AS close FROM hp JOIN {{positions}} x ON x.vessel_id = a_id JOIN {{positions}} y ON y.vessel_id = b_id AND abs(epoch_us(x.ts) - epoch_us(y.ts)) <= 43200000000
      QUALIFY row_number() OVER (PARTITION BY a_id, b_id, x.ts ORDER BY abs(epoch_us(x.ts) - epoch_us(y.ts)), y.ts DESC) = 1),
    lc AS (SELECT *, last_value(CASE WHEN close THEN ts END IGNORE NULLS) OVER (PARTITION BY a_id, b_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lst FROM mt),
    il AS (SELECT *, sum(CASE WHEN NOT close AND epoch_us(ts) - epoch_us(lst) > 86400000000 THEN 1 ELSE 0 END) OVER (PARTITION BY a_id, b_id ORDER BY ts) AS island FROM lc),
    sp AS (SELECT a_id, b_id, island, min(ts) FILTER (close) AS st, max(ts) FILTER (close) AS en FROM il GROUP BY 1, 2, 3),
    du AS (SELECT * FROM sp QUALIFY row_number() OVER (PARTITION BY a_id, b_id ORDER BY island DESC) = 1)"""


@query("w13_contact_duration", inputs="vessels positions", oracle=f"WITH {DURATION} SELECT a_id, b_id, {ts('st', 'started_at')}, CAST(floor((epoch_us(en) - epoch_us(st)) / 6e7) AS BIGINT) AS duration_min FROM du WHERE st IS NOT NULL")
def _(vessels, positions):
    pairs = vessels.select(F.col("id").alias("a_id")).join(vessels.select(F.col("id").alias("b_id")), F.col("b_id") == F.col("a_id") + 10)
    return v.contact_duration(pairs, positions, AS_OF, 40_000.0, 24 * 40, 43_200, 1440)


@query("w14_merge_contacts", inputs="sts", oracle=f"""
    WITH c AS (SELECT vessel_a AS a, vessel_b AS b, ts, ts + INTERVAL '1' MINUTE * (duration_min * 60) AS e, proximity_m, confidence FROM {{sts}}),
    x AS (SELECT *, max(e) OVER (PARTITION BY a, b ORDER BY ts, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR ts > reach + INTERVAL 2 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY a, b ORDER BY ts, e) AS island FROM x)
    SELECT a AS a_id, b AS b_id, {ts('min(ts)', 'ts')}, {ts('max(e)', '"end"')}, {r4('min(proximity_m)', 'proximity_m')}, {r4('max(confidence)', 'confidence')}, count(*) AS candidates, CAST(floor((epoch_us(max(e)) - epoch_us(min(ts))) / 6e7) AS BIGINT) AS duration_min,
    CASE WHEN (epoch_us(max(e)) - epoch_us(min(ts))) / 6e7 > 2880 THEN 'dismissed' ELSE 'possible' END AS status FROM i GROUP BY a, b, island""")
def _(sts):
    c = sts.select(F.col("vessel_a").alias("a_id"), F.col("vessel_b").alias("b_id"), F.col("ts").alias("start"), F.timestamp_micros(F.unix_micros("ts") + F.col("duration_min").cast("long") * 3_600_000_000).alias("end"), F.col("proximity_m").alias("distance_m"), "confidence")
    return v.merge_contacts(c)


CALLS = f"""n AS ({PORT_OF}), fx AS (SELECT mmsi, ts, CASE WHEN km <= radius_km THEN near END AS port, coalesce(speed, 0) AS sp, draught, row_number() OVER (PARTITION BY mmsi ORDER BY ts) AS k FROM n),
    wk AS (SELECT mmsi, ts, k, CASE WHEN port IS NOT NULL AND sp <= 1 THEN port END AS op, CASE WHEN port IS NOT NULL AND sp <= 1 THEN ts END AS arr, CAST(NULL AS VARCHAR) AS cp, CAST(NULL AS TIMESTAMP) AS carr, draught FROM fx WHERE k = 1
      UNION ALL SELECT f.mmsi, f.ts, f.k, CASE WHEN w.op IS NOT NULL THEN CASE WHEN f.port IS NULL OR f.port <> w.op OR f.sp >= 3 THEN NULL ELSE w.op END WHEN f.port IS NOT NULL AND f.sp <= 1 THEN f.port END,
        CASE WHEN w.op IS NOT NULL THEN CASE WHEN f.port IS NULL OR f.port <> w.op OR f.sp >= 3 THEN NULL ELSE w.arr END WHEN f.port IS NOT NULL AND f.sp <= 1 THEN f.ts END,
        CASE WHEN w.op IS NOT NULL AND (f.port IS NULL OR f.port <> w.op OR f.sp >= 3) THEN w.op END, CASE WHEN w.op IS NOT NULL AND (f.port IS NULL OR f.port <> w.op OR f.sp >= 3) THEN w.arr END, f.draught
      FROM wk w JOIN fx f ON f.mmsi = w.mmsi AND f.k = w.k + 1)"""


@query("w15_port_calls", inputs="positions ports", oracle=f"""
    WITH RECURSIVE {CALLS}, done AS (SELECT mmsi, cp AS port_name, carr AS arrival, ts AS departure FROM wk WHERE cp IS NOT NULL), still AS (SELECT mmsi, op, arr FROM wk WHERE op IS NOT NULL QUALIFY k = max(k) OVER (PARTITION BY mmsi) AND NOT EXISTS (SELECT 1 FROM fx WHERE fx.mmsi = wk.mmsi AND fx.k > wk.k))
    SELECT mmsi, port_name, {ts('arrival')}, {ts('departure')}, round((epoch_us(departure) - epoch_us(arrival)) / 3.6e9, 2) AS dwell_h FROM done UNION ALL SELECT mmsi, op, {ts('arr')}, NULL, NULL FROM still""")
def _(positions, ports):
    return v.port_calls(positions, ports).select("mmsi", "port_name", "arrival", "departure", "dwell_h")


@query("x04_port_flags", inputs="port_calls vessels ports", oracle=f"""
    SELECT c.id, round((epoch_us(departure) - epoch_us(arrival)) / 3.6e9, 2) AS dwell_h, concat_ws(',', CASE WHEN sanctioned_facility THEN 'sanctioned_facility' END, CASE WHEN p.risk_level = 'high' THEN 'high_risk_port' END,
    CASE WHEN round((epoch_us(departure) - epoch_us(arrival)) / 3.6e9, 2) >= 72 THEN 'unusual_dwell_time' END, CASE WHEN {flagged_sql()} THEN 'vessel_flagged' END, CASE WHEN p.risk_level = 'high' AND v.flag <> p.country AND v.flag IN ('GA', 'CM', 'SL', 'KM', 'PW', 'CK', 'LR', 'MH', 'PA') THEN 'flag_of_convenience_at_high_risk_port' END) AS flags,
    CASE WHEN contains(lower(ship_type), 'tanker') THEN CASE WHEN sanctioned_facility THEN 'crude/products' ELSE 'petroleum/chemicals' END WHEN contains(lower(ship_type), 'cargo') THEN 'dry bulk/general cargo' END AS cargo
    FROM {{port_calls}} c JOIN {{ports}} p ON p.name = c.port JOIN {{vessels}} v ON v.id = c.vessel_id""")
def _(calls, vessels, ports):
    from intel_spark.functions.vessel import dwell_hours
    facts = ports.select(F.col("name").alias("port"), F.col("country").alias("port_country"), "risk_level", "sanctioned_facility")
    joined = calls.drop("risk_level").join(facts, "port").join(vessels.select(F.col("id").alias("vessel_id"), "flag", "ship_type", "sanctioned_status"), "vessel_id").withColumn("dwell_h", dwell_hours(F.col("arrival"), F.col("departure")))
    return v.port_flags(joined).select("id", "dwell_h", "flags", "cargo")


@query("w17_zone_events", inputs="positions zones lanes vessels", oracle=f"""
    WITH e AS (SELECT p.mmsi, z.name AS lane_name, z.kind AS context, p.ts FROM {{positions}} p JOIN {{zones}} z ON {HIGH} AND {in_diamond('p.lat', 'p.lon', 'z')} UNION ALL SELECT p.mmsi, z.name, 'choke_point', p.ts FROM {{positions}} p JOIN {{lanes}} z ON z.choke_point AND {in_diamond('p.lat', 'p.lon', 'z')}),
    d AS (SELECT mmsi, lane_name, context, CAST(ts AS DATE) AS day, min(ts) AS ts FROM e GROUP BY 1, 2, 3, 4)
    SELECT v.id AS vessel_id, d.mmsi, lane_name, context, {ts('d.ts', 'ts')}, CASE WHEN context = 'sanctions_zone' AND {risky_sql('v.')} THEN 'high' WHEN {risky_sql('v.')} OR context = 'sanctions_zone' THEN 'medium' ELSE 'low' END AS severity
    FROM d JOIN {{vessels}} v ON v.mmsi = d.mmsi WHERE {risky_sql('v.')} OR context <> 'choke_point'""")
def _(positions, zones, lanes, vessels):
    return v.zone_events(positions, rings(zones), rings(lanes), vessels).drop("day")


@query("w18_dark_vessels", inputs="vessels zones", oracle=f"""
    WITH a AS (SELECT *, (epoch_us({AS_OF_SQL}) - epoch_us(last_ais_update)) / 3.6e9 AS h FROM {{vessels}}), z AS (SELECT a.*, (SELECT count(*) FROM {{zones}} z WHERE {HIGH} AND {in_diamond('a.lat', 'a.lon', 'z')}) AS nz FROM a WHERE h > 6 AND h <= 168 AND {risky_sql()})
    SELECT id AS vessel_id, CASE WHEN nz > 0 THEN 'dark_in_zone' ELSE 'dark_vessel' END AS event_type, CASE WHEN nz > 0 THEN 'high' ELSE 'medium' END AS severity, {r4('round(h, 1)', 'hours_silent')} FROM z WHERE nz > 0 OR sanctioned_status LIKE 'breach%'""")
def _(vessels, zones):
    return v.dark_vessels(vessels, rings(zones), AS_OF).select("vessel_id", "event_type", "severity", "hours_silent")


@query("w19_thin_positions", inputs="positions", oracle=f"""
    WITH RECURSIVE o AS (SELECT id, mmsi, ts, row_number() OVER (PARTITION BY mmsi ORDER BY ts, id) AS k FROM {{positions}} WHERE ts >= {AS_OF_SQL} - INTERVAL 25 DAY AND ts < {AS_OF_SQL} - INTERVAL 7 DAY),
    w AS (SELECT id, mmsi, k, true AS keep, ts AS lk FROM o WHERE k = 1 UNION ALL SELECT o.id, o.mmsi, o.k, epoch_us(o.ts) - epoch_us(w.lk) >= 43200000000, CASE WHEN epoch_us(o.ts) - epoch_us(w.lk) >= 43200000000 THEN o.ts ELSE w.lk END FROM w JOIN o ON o.mmsi = w.mmsi AND o.k = w.k + 1)
    SELECT id FROM w WHERE keep UNION ALL SELECT id FROM {{positions}} WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY""")
def _(positions):
    return v.thin_positions(positions, AS_OF, 25, 7, 720).select("id")


@query("w20_sample_history", inputs="positions vessels ports", oracle=f"""
    WITH n AS ({PORT_OF}), lt AS (SELECT mmsi, max_by(lat, ts) AS lat, max_by(lon, ts) AS lon, max_by(CASE WHEN speed IS NULL THEN -1 ELSE speed END, ts) AS speed FROM {{positions}} GROUP BY 1),
    sl AS (SELECT mmsi, floor(lat / 0.01) AS rw, floor(lon / 0.01) AS cl FROM lt WHERE speed BETWEEN 0 AND 2), nr AS (SELECT DISTINCT a.mmsi FROM sl a JOIN sl b ON a.mmsi <> b.mmsi AND abs(a.rw - b.rw) <= 1 AND abs(a.cl - b.cl) <= 1),
    c AS (SELECT n.id, n.mmsi, n.ts, CASE WHEN {flagged_sql('v.')} OR v.risk_score >= 0.3 THEN 0 WHEN nr.mmsi IS NOT NULL AND NOT (km <= radius_km) THEN 10 ELSE 1440 END AS m FROM n LEFT JOIN {{vessels}} v ON v.mmsi = n.mmsi LEFT JOIN nr ON nr.mmsi = n.mmsi)
    SELECT id FROM c WHERE m = 0 UNION ALL SELECT min_by(id, (ts, id)) FROM c WHERE m > 0 GROUP BY mmsi, m, floor(epoch_us(ts) / (m * 6e7))""")
def _(positions, vessels, ports):
    return v.sample_history(positions, vessels, ports, other_minutes=1440).select("id")


@query("w21_latest_per_key", inputs="positions", oracle=f"SELECT mmsi, id, {ts('ts')}, {r4('lat')}, {r4('speed')} FROM {{positions}} QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY ts DESC, id DESC) = 1")
def _(positions):
    return latest_per_key(positions, ["mmsi"], "ts", ["id"]).select("mmsi", "id", "ts", "lat", "speed")


@query("w23_enrich_static", inputs="positions", oracle=f"""
    SELECT mmsi, min_by(imo, ts) FILTER (imo IS NOT NULL) AS imo, min_by(call_sign, ts) FILTER (call_sign IS NOT NULL) AS call_sign, min_by(ship_type, ts) AS ship_type, {r4('min_by(length_m, ts) FILTER (length_m IS NOT NULL)', 'length_m')},
    max_by(destination, ts) FILTER (destination IS NOT NULL) AS destination, {r4('max_by(draught, ts) FILTER (draught > 0 AND draught < 40)', 'draught')}, {ts('max(ts)', 'last_ais_update')} FROM {{positions}} GROUP BY mmsi""")
def _(positions):
    return v.enrich_static(positions)


@query("x02_assess_sts", inputs="vessels ports zones land", oracle=f"""
    WITH {PAIRS}, {AFLOAT}, d AS (SELECT *, 30 + (a_id * 7 + b_id) % 500 AS dur FROM wet), z AS (SELECT d.*, (SELECT count(*) FROM {{zones}} z WHERE {in_diamond('d.lat', 'd.lon', 'z')}) AS nz, (SELECT count(*) FROM {{zones}} z WHERE z.kind = 'sts_hub' AND {in_diamond('d.lat', 'd.lon', 'z')}) AS nh FROM d)
    SELECT a_id, b_id, {r4("round(least(0.97, CASE WHEN ta AND tb THEN 0.4 ELSE 0.3 END + least(0.25, dur / 480.0 * 0.25) + CASE WHEN ka OR kb THEN 0.15 ELSE 0 END - CASE WHEN neighbours >= 8 THEN 0.1 ELSE 0 END + CASE WHEN nh > 0 THEN 0.2 WHEN nz > 0 THEN 0.1 ELSE 0 END + CASE WHEN " + risky_sql('a.') + " OR " + risky_sql('b.') + " THEN 0.1 ELSE 0 END), 2)", "confidence")}
    FROM z JOIN {{vessels}} a ON a.id = a_id JOIN {{vessels}} b ON b.id = b_id""")
def _(vessels, ports, zones, land):
    pairs = g.proximity_pairs(vessels, ports, land_rings(land), 900.0)
    minutes = pairs.select("a_id", "b_id", (30 + (F.col("a_id") * 7 + F.col("b_id")) % 500).cast("int").alias("duration_min"), F.lit(AS_OF).alias("started_at"))
    return v.assess_sts(pairs, minutes, vessels, rings(zones)).select("a_id", "b_id", "confidence")


# blocks are taken one after the other, the one with most hulls first, then the lowest cell
TAKEN = """f AS MATERIALIZED (SELECT CAST(floor(lat / 0.5) AS BIGINT) AS row, CAST(floor(lon / 0.5) AS BIGINT) AS col, vessel_id, count(*) AS n, sum(lat) AS slat, sum(lon) AS slon, min(ts) AS t0, max(ts) AS t1 FROM {anomalies} GROUP BY 1, 2, 3),
    s AS (SELECT 0 AS i, CAST([] AS STRUCT(r BIGINT, c BIGINT)[]) AS taken UNION ALL
      SELECT i + 1, list_append(taken, {'r': -b.r, 'c': -b.c}) FROM (SELECT i, taken, (SELECT max({'h': hulls, 'r': -row, 'c': -col}) FROM (SELECT o.row, o.col, count(DISTINCT l.vessel_id) AS hulls FROM (SELECT DISTINCT row, col FROM f) o JOIN f l ON abs(o.row - l.row) <= 1 AND abs(o.col - l.col) <= 1
        WHERE len(list_filter(s.taken, lambda t: abs(t.r - o.row) <= 1 AND abs(t.c - o.col) <= 1)) = 0 AND len(list_filter(s.taken, lambda t: abs(t.r - l.row) <= 1 AND abs(t.c - l.col) <= 1)) = 0 GROUP BY 1, 2) WHERE hulls >= 4) AS b FROM s) WHERE b IS NOT NULL),
    k AS (SELECT unnest(taken) AS t, generate_subscripts(taken, 1) AS i FROM (SELECT taken FROM s ORDER BY i DESC LIMIT 1)),
    m AS (SELECT f.*, min(k.i) AS i FROM f JOIN k ON abs(k.t.r - f.row) <= 1 AND abs(k.t.c - f.col) <= 1 GROUP BY ALL),
    pr AS (SELECT i, count(DISTINCT vessel_id) AS vessels, sum(n) AS reports, round(sum(slat) / sum(n), 4) AS lat, round(sum(slon) / sum(n), 4) AS lon, min(t0) AS t0, max(t1) AS t1 FROM m GROUP BY 1)"""


@query("x03_spoofing_clusters", inputs="anomalies land zones", oracle=f"""
    WITH RECURSIVE {TAKEN}, {AFLOAT.replace("km > 3", "km > 5")}, w AS (SELECT pr.*, NOT EXISTS (SELECT 1 FROM wet WHERE wet.i = pr.i) AS inland FROM pr)
    SELECT vessels, reports, {r4('lat')}, {r4('lon')}, {ts('t0', 'first_seen')}, {ts('t1', 'last_seen')}, inland, CASE WHEN vessels >= 10 OR (inland AND vessels >= 5) THEN 'critical' WHEN vessels >= 5 OR inland THEN 'high' ELSE 'medium' END AS severity,
    {r4("round(least(0.95e0, 0.5e0 + 0.05e0 * vessels + CASE WHEN inland THEN 0.15e0 ELSE 0 END), 2)", "confidence")} FROM w""")
def _(anomalies, land, zones):
    return v.spoofing_clusters(anomalies, land_rings(land), rings(zones), min_vessels=4, degrees=0.5).drop("zones")


RISK_SQL = f"""b AS (SELECT vessel_id, max(confidence) AS w1 FROM {{breaches}} WHERE status <> 'cleared' GROUP BY 1),
    e AS (SELECT vessel_id, least(0.7, sum(CASE severity WHEN 'low' THEN 0.05 WHEN 'medium' THEN 0.12 WHEN 'high' THEN 0.25 ELSE 0.4 END)) AS w2, max(CASE WHEN event_type = 'spoofing_cluster' THEN 0.1 END) AS w3 FROM {{evasion}} WHERE ts >= {AS_OF_SQL} - INTERVAL 3 DAY GROUP BY 1),
    c AS (SELECT vessel_id, least(0.45, 0.15 * count(*)) AS w4 FROM {{port_calls}} WHERE arrival >= {AS_OF_SQL} - INTERVAL 3 DAY AND (is_sanctioned OR risk_level = 'high') GROUP BY 1),
    s AS (SELECT x AS vessel_id, least(0.5, 0.2 * count(*)) AS w5 FROM (SELECT unnest([vessel_a, vessel_b]) AS x FROM {{sts}} WHERE ts >= {AS_OF_SQL} - INTERVAL 3 DAY AND status <> 'cleared') GROUP BY 1),
    p AS (SELECT imo, least(0.5, 0.15 * count(*) FILTER (event_type = 'detention') + 0.35 * count(*) FILTER (event_type = 'ban')) AS w6 FROM {{psc}} WHERE event_date >= {AS_OF_SQL} - INTERVAL 365 DAY OR event_type = 'ban' GROUP BY 1)"""


@query("x01_vessel_risk", inputs="vessels breaches evasion port_calls sts psc", oracle=f"""
    WITH {RISK_SQL}, j AS (SELECT v.id AS vessel_id, w1, w2, w3, w4, w5, w6, CASE WHEN flag = 'GA' AND contains(lower(ship_type), 'tanker') THEN 0.1 END AS w7 FROM {{vessels}} v LEFT JOIN b ON b.vessel_id = v.id LEFT JOIN e ON e.vessel_id = v.id LEFT JOIN c ON c.vessel_id = v.id LEFT JOIN s ON s.vessel_id = v.id LEFT JOIN p ON p.imo = v.imo)
    SELECT vessel_id, {r4("round(1 - (1 - least(0.99, coalesce(w1, 0))) * (1 - coalesce(w2, 0)) * (1 - coalesce(w3, 0)) * (1 - coalesce(w4, 0)) * (1 - coalesce(w5, 0)) * (1 - coalesce(w6, 0)) * (1 - coalesce(w7, 0)), 3)", "risk_score")} FROM j""")
def _(vessels, breaches, evasion, calls, sts, psc):
    return v.vessel_risk(vessels, breaches, evasion, calls, sts, psc, AS_OF, 3).select("vessel_id", "risk_score")


@query("j22_shared_party_links", inputs="vessels", oracle="""
    WITH p AS (SELECT id, 'shared_owner' AS reason, owner AS party FROM {vessels} UNION ALL SELECT id, 'shared_operator', operator FROM {vessels} UNION ALL SELECT id, 'shared_beneficial_owner', beneficial_owner FROM {vessels})
    SELECT a.id AS vessel_id, b.id AS other_id, a.reason, a.party AS detail FROM p a JOIN p b ON a.reason = b.reason AND a.party = b.party AND a.id <> b.id JOIN {vessels} f ON f.id = a.id WHERE f.sanctioned_status = 'breach_ofac'""")
def _(vessels):
    return v.shared_party_links(vessels, vessels.where("sanctioned_status = 'breach_ofac'").select(F.col("id").alias("vessel_id")))


@query("n05_linked_vessels", inputs="vessels breaches sts port_calls", oracle=f"""
    WITH fo AS (SELECT id FROM {{vessels}} WHERE sanctioned_status = 'breach_ofac'), pa AS (SELECT id, 'shared_owner' AS reason, owner AS party FROM {{vessels}} UNION ALL SELECT id, 'shared_operator', operator FROM {{vessels}} UNION ALL SELECT id, 'shared_beneficial_owner', beneficial_owner FROM {{vessels}}),
    br AS (SELECT DISTINCT vessel_id, entity_id FROM {{breaches}}), rc AS (SELECT * FROM {{port_calls}} WHERE arrival >= {AS_OF_ORDERS_SQL} - INTERVAL 60 DAY),
    lk AS (SELECT a.id AS v, b.id AS o, a.reason FROM pa a JOIN pa b ON a.reason = b.reason AND a.party = b.party UNION ALL SELECT a.vessel_id, b.vessel_id, 'shared_sanctions_entity' FROM br a JOIN br b USING (entity_id)
      UNION ALL SELECT vessel_a, vessel_b, 'transshipment_partner' FROM {{sts}} WHERE ts >= {AS_OF_ORDERS_SQL} - INTERVAL 60 DAY UNION ALL SELECT vessel_b, vessel_a, 'transshipment_partner' FROM {{sts}} WHERE ts >= {AS_OF_ORDERS_SQL} - INTERVAL 60 DAY
      UNION ALL SELECT a.vessel_id, b.vessel_id, 'shared_high_risk_port' FROM (SELECT DISTINCT vessel_id, port FROM rc WHERE is_sanctioned OR risk_level = 'high') a JOIN rc b USING (port)),
    w AS (SELECT v, o, reason, CASE reason WHEN 'shared_owner' THEN 0.6 WHEN 'shared_operator' THEN 0.5 WHEN 'shared_beneficial_owner' THEN 0.7 WHEN 'shared_sanctions_entity' THEN 0.8 WHEN 'transshipment_partner' THEN 0.7 ELSE 0.3 END AS w FROM lk WHERE v <> o AND v IN (SELECT id FROM fo))
    SELECT v AS vessel_id, o AS other_id, {r4("round(1 - product(1 - w), 2)", "link_strength")}, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM w JOIN {{vessels}} x ON x.id = w.o GROUP BY v, o""")
def _(vessels, breaches, sts, calls):
    focus = vessels.where("sanctioned_status = 'breach_ofac'").select(F.col("id").alias("vessel_id"))
    return v.linked_vessels(vessels, breaches, sts, calls, focus, AS_OF_ORDERS, 60).select("vessel_id", "other_id", "link_strength", "reasons")


@query("g08_fleet_groups", inputs="vessels", oracle=f"""
    WITH p AS (SELECT *, 'owner' AS link, owner AS entity FROM {{vessels}} UNION ALL SELECT *, 'operator', operator FROM {{vessels}} UNION ALL SELECT *, 'beneficial_owner', beneficial_owner FROM {{vessels}}), r AS (SELECT *, row_number() OVER (PARTITION BY link, entity ORDER BY mmsi) AS k FROM p WHERE entity IS NOT NULL)
    SELECT link, entity, count(*) AS size, {r4('max(risk_score)', 'max_risk')}, count(*) FILTER ({flagged_sql()}) AS flagged, string_agg(mmsi, ',' ORDER BY mmsi) FILTER (k <= 5) AS vessels FROM r GROUP BY 1, 2 HAVING count(*) >= 2""")
def _(vessels):
    return v.fleet_groups(vessels, 2, 5)


@query("d08_upsert_breaches", inputs="breaches", oracle=f"""
    WITH o AS (SELECT vessel_id, authority, listed, breach_type, max(confidence) AS confidence FROM {{breaches}} WHERE id % 2 = 0 GROUP BY 1, 2, 3, 4), n AS (SELECT vessel_id, authority, listed, breach_type, max(confidence) AS c FROM {{breaches}} WHERE id % 2 = 1 AND confidence >= 0.4 GROUP BY 1, 2, 3, 4)
    SELECT vessel_id, authority, listed, breach_type, {r4('greatest(confidence, c)', 'confidence')}, coalesce(CASE WHEN confidence IS NOT NULL THEN 'old' END, CASE WHEN c >= 0.6 THEN 'flagged' ELSE 'review' END) AS status, confidence IS NOT NULL AND c IS NOT NULL AS confirmed FROM o FULL JOIN n USING (vessel_id, authority, listed, breach_type)""")
def _(breaches):
    keys = ["vessel_id", "authority", "listed", "breach_type"]
    old = breaches.where("id % 2 = 0").groupBy(*keys).agg(F.max("confidence").alias("confidence"), F.max("entity_id").alias("listing_id"), F.max("match_type").alias("match_type"), F.lit("old").alias("status"), F.min("ts").alias("ts"), F.lit(None).cast("timestamp").alias("last_confirmed"))
    new = breaches.where("id % 2 = 1").withColumnRenamed("entity_id", "listing_id")
    return v.upsert_breaches(new, old, AS_OF).select(*keys, "confidence", "status", F.col("last_confirmed").isNotNull().alias("confirmed"))


@query("d09_reconcile_imo", inputs="breaches vessels", oracle=f"""
    WITH l AS (SELECT DISTINCT entity_id, concat('90000', lpad(CAST(entity_id AS STRING), 2, '0')) AS l_imo FROM {{breaches}}), f AS (SELECT b.*, CASE WHEN match_type = 'name_exact' AND v.imo <> l_imo THEN 'cleared' ELSE status END AS st FROM {{breaches}} b LEFT JOIN {{vessels}} v ON v.id = b.vessel_id LEFT JOIN l USING (entity_id)),
    g AS (SELECT vessel_id, max((confidence, authority)) FILTER (st <> 'cleared' AND confidence >= 0.6) AS top, bool_or(st <> 'cleared') AS op FROM f GROUP BY 1) SELECT vessel_id, CASE WHEN top IS NOT NULL THEN 'breach_' || lower(top[2]) WHEN op THEN 'flagged' ELSE 'clear' END AS sanctioned_status FROM g""")
def _(breaches, vessels):
    listings = breaches.select(F.col("entity_id").alias("id"), F.concat(F.lit("90000"), F.lpad(F.col("entity_id").cast("string"), 2, "0")).alias("imo")).distinct()
    return v.reconcile_imo(breaches.withColumnRenamed("entity_id", "listing_id"), vessels, listings)[1]


@query("d12_refresh_clusters", inputs="anomalies", oracle=f"""
    WITH o AS (SELECT id, lat, lon, id % 9 AS n, ts FROM {{anomalies}} WHERE id % 2 = 0), w AS (SELECT id, lat, lon, id % 9 AS n FROM {{anomalies}} WHERE id % 2 = 1),
    m AS (SELECT w.id, min((o.ts, o.id, o.n)) AS b FROM w JOIN o ON abs(w.lat - o.lat) < 0.3 AND {hav('w.lat', 'w.lon', 'o.lat', 'o.lon')} <= 25000 GROUP BY 1)
    SELECT w.id AS cluster_id, b[2] AS updates, CASE WHEN b IS NULL THEN 'add' WHEN w.n >= b[3] THEN 'update' ELSE 'skip' END AS action FROM w LEFT JOIN m ON m.id = w.id""")
def _(anomalies):
    c = anomalies.select(F.col("id").alias("cluster_id"), "lat", "lon", (F.col("id") % 9).alias("vessels"), "ts")
    return v.refresh_clusters(c.where("cluster_id % 2 = 1"), c.where("cluster_id % 2 = 0")).select("cluster_id", "updates", "action")
