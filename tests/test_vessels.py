import itertools
import math
import random
from collections import defaultdict

import pytest
from conftest import NOW, hours, minutes
from pyspark.sql import functions as F

from intel_spark.functions import text as t
from intel_spark.functions import vessel as v
from intel_spark.operators import maritime as m
from intel_spark.operators import spatial as g
from intel_spark.sources import ais

POSITION = "id long, mmsi string, vessel_id long, ts timestamp, lat double, lon double, speed double, heading double, name string, imo string, flag string, ship_type string, draught double"
ZONE = "name string, kind string, context string, choke_point boolean, ring array<struct<lon:double,lat:double>>"
PORT = "name string, country string, lat double, lon double, radius_km double, risk_level string, sanctioned_facility boolean"


def box(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def zones(spark):
    return spark.createDataFrame([("Restricted", "sanctions_zone", "", False, box(30.0, 40.0, 32.0, 42.0))], ZONE)


def fixes(spark, rows):
    full = [(i, mmsi, int(mmsi[-3:]), ts, lat, lon, speed, None, name, imo, flag, kind, draught) for i, (mmsi, ts, lat, lon, speed, name, imo, flag, kind, draught) in enumerate(rows)]
    return spark.createDataFrame(full, POSITION)


def fix(mmsi, ts, lat=10.0, lon=10.0, speed=10.0, name=None, imo=None, flag=None, kind="Cargo", draught=None):
    return (mmsi, ts, lat, lon, speed, name, imo, flag, kind, draught)


def test_gap_severities(spark):
    rows = [fix("001", hours(-2)), fix("001", NOW), fix("002", hours(-8)), fix("002", NOW), fix("003", hours(-8), speed=0.1), fix("003", NOW), fix("004", hours(-30), lat=41.0, lon=31.0), fix("004", NOW)]
    found = {r.mmsi: r.severity for r in m.ais_gaps(fixes(spark, rows), zones(spark)).collect()}
    assert found == {"002": "medium", "003": "low", "004": "critical"}


def test_gap_across_day_buckets(spark):
    rows = [fix("001", hours(-24 * 9)), fix("001", hours(-24 * 5)), fix("001", hours(-24 * 5 + 1)), fix("001", NOW)]
    assert sorted(r.gap_hours for r in m.ais_gaps(fixes(spark, rows), zones(spark)).collect()) == [96.0, 119.0]


def test_implausible_positions(spark):
    rows = [fix("001", NOW, speed=42.2, kind="Other"), fix("002", minutes(-30)), fix("002", NOW, lat=12.0, speed=42.2, kind="Other"), fix("003", NOW, speed=38.0, kind="High-speed craft")]
    found = {r.mmsi: (r.severity, len(r.reasons)) for r in m.position_anomalies(fixes(spark, rows)).collect()}
    assert found == {"001": ("medium", 1), "002": ("high", 2)}


def test_identity_changes(spark):
    rows = [fix("001", hours(-3), name="LOCA LOLA II", flag="PA"), fix("001", hours(-2), name="LOCA LOLA 2", flag="PA"), fix("001", hours(-1), name="NEW HOPE", flag="GA"), fix("001", NOW, name="LOCA LOLA II", flag="GA")]
    found = sorted((r.event_type, r.new_value) for r in m.identity_changes(fixes(spark, rows)).collect())
    assert found == [("flag_change", "GA"), ("name_change", "NEW HOPE")]


def test_imo_conflict_and_transfer(spark):
    live = [fix("001", hours(-2), imo="9074729", flag="PA"), fix("002", hours(-1), imo="9074729", flag="LR")]
    gone = [fix("003", hours(-48), imo="9319466", flag="PA"), fix("004", NOW, imo="9319466", flag="PA")]
    found = {r.mmsi: (r.kind, r.holder, r.severity) for r in m.imo_conflicts(fixes(spark, live + gone)).collect()}
    assert found == {"002": ("identity_conflict", "001", "high"), "004": ("identity_transfer", "003", "medium")}


def test_repeats_fold_into_one(spark):
    rows = [fix("001", hours(-5), lat=0.0), fix("001", hours(-4), lat=20.0), fix("001", hours(-2), lat=0.0), fix("001", hours(-1), lat=20.0)]
    folded = m.fold_anomalies(m.position_anomalies(fixes(spark, rows))).collect()
    assert len(folded) == 1 and folded[0].repeats == 3


HULL = "id long, mmsi string, imo string, name string, flag string, ship_type string, lat double, lon double, speed double, nav_status string, length_m double, sanctioned_status string, risk_score double, owner string, operator string, beneficial_owner string, last_ais_update timestamp"


def hull(i, kind, lat, lon, speed=0.2, status="underway", name="SHIP", sanctioned="clear", risk=0.0):
    return (i, str(i), None, name, "PA", kind, lat, lon, speed, status, 200.0, sanctioned, risk, None, None, None, NOW)


def test_rendezvous_pairs(spark):
    port = spark.createDataFrame([("P", "NL", 30.0, 30.0, 5.0, "safe", False)], PORT)
    rows = [hull(1, "Tanker", 10.0, 10.0), hull(2, "Cargo", 10.002, 10.0), hull(3, "Tanker", 10.0, 10.001, speed=8.0), hull(4, "Tug", 10.001, 10.0), hull(5, "Tanker", 30.0, 30.0), hull(6, "Cargo", 30.001, 30.0), hull(7, None, 15.0, 15.0), hull(8, None, 15.001, 15.0),
            hull(9, "Tanker", 17.0, 17.0, status="moored"), hull(10, "Cargo", 17.001, 17.0), hull(11, "Cargo", 18.0, 18.0, name="F/V MARIA"), hull(12, "Tanker", 18.001, 18.0)]
    found = g.proximity_pairs(spark.createDataFrame(rows, HULL), port, None).collect()
    assert [(r.a_id, r.b_id) for r in found] == [(1, 2)] and 200 < found[0].distance_m < 240


def test_crowd_keeps_tanker_pairs_only(spark):
    rows = [hull(i, "Tanker" if i == 0 else "Cargo", 10.0 + i * 0.0001, 10.0) for i in range(9)]
    found = g.proximity_pairs(spark.createDataFrame(rows, HULL), None, None).collect()
    assert len(found) == 8 and all(r.a_id == 0 for r in found)


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    rows = [hull(i, rng.choice(["Tanker", "Cargo"]), rng.choice([59.99, 0.0, 84.9, -4.999]) + rng.random() * 0.02, rng.choice([179.99, -179.999, 10.0]) + rng.random() * 0.008) for i in range(250)]
    found = {(r.a_id, r.b_id) for r in g.proximity_pairs(spark.createDataFrame(rows, HULL), None, None, crowd=10_000).collect()}

    def metres(a, b):
        la1, lo1, la2, lo2 = map(math.radians, (a[6], a[7], b[6], b[7]))
        x = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(x))

    same_side = lambda a, b: abs(a[7] - b[7]) < 180  # neighbouring longitudes only; the seam is checked apart
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if same_side(a, b) and metres(a, b) <= 500}
    assert want <= found


def test_contact_duration(spark):
    a = [fix("001", minutes(-k)) for k in (90, 60, 30, 0)]
    b = [fix("002", minutes(-k), lat=10.001) for k in (88, 58, 28, 1)]
    pairs = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    out = m.contact_duration(pairs, fixes(spark, a + b), NOW).collect()
    assert [r.duration_min for r in out] == [90]


def test_sts_assessment(spark):
    rows = [hull(1, "Tanker", 10.0, 10.0), hull(2, "Cargo", 10.002, 10.0)]
    vessels = spark.createDataFrame(rows, HULL)
    pairs = g.proximity_pairs(vessels, None, None)
    durations = spark.createDataFrame([(1, 2, 90, NOW)], "a_id long, b_id long, duration_min int, started_at timestamp")
    alone = m.assess_sts(pairs, durations, vessels, zones(spark)).collect()[0].confidence
    crowded = m.assess_sts(pairs.withColumn("neighbours", F.lit(9).cast("long")), durations, vessels, zones(spark)).collect()[0].confidence
    assert alone >= 0.55 and round(alone - crowded, 2) == 0.1
    assert m.assess_sts(pairs, durations.withColumn("duration_min", F.lit(10)), vessels, zones(spark)).count() == 0


def test_port_call_and_flags(spark):
    ports = spark.createDataFrame([("Terminal", "RU", 60.0, 28.0, 6.0, "high", True)], PORT)
    rows = [fix("001", hours(-82), 60.01, 28.0, 0.5, draught=8.0), fix("001", hours(-40), 60.01, 28.0, 2.0, draught=9.0), fix("001", hours(-2), 61.0, 28.0, 12.0, draught=14.0)]
    vessels = spark.createDataFrame([hull(1, "Tanker", 60.0, 28.0, sanctioned="flagged")], HULL).withColumn("mmsi", F.lit("001"))
    call = m.port_calls(fixes(spark, rows), ports, vessels).collect()
    assert len(call) == 1 and call[0].dwell_h == 80.0 and call[0].draught_arr == 8.0 and call[0].draught_dep == 14.0
    assert set(call[0].flags) == {"sanctioned_facility", "high_risk_port", "unusual_dwell_time", "vessel_flagged", "flag_of_convenience_at_high_risk_port"}


def test_stays_match_a_walk(spark):
    """Hysteresis over neighbouring places, against a fix-by-fix walk."""
    rng = random.Random(11)
    rows, want = [], []
    for k in range(12):
        state = None
        for i in range(60):
            place, speed = rng.choice(["A", "B", None]), rng.choice([0.0, 2.0, 5.0])
            rows.append((f"v{k}", hours(i * 9), place, speed))
            if state is not None and (place != state[0] or speed >= 3.0):
                want.append((f"v{k}", state[0], state[1], hours(i * 9)))
                state = None
            elif state is None and place is not None and speed <= 1.0:
                state = (place, hours(i * 9))
        if state is not None:
            want.append((f"v{k}", state[0], state[1], None))
    frame = spark.createDataFrame(rows, "k string, ts timestamp, place string, speed double").withColumn("d", F.lit(1.0))
    out = m.stays(frame, "k", "place", 1.0, 3.0, F.lit(True), ["d"]).select("k", "place", F.unix_seconds("arrival"), F.unix_seconds("departure")).collect()
    key = lambda r: (r[0], r[1], r[2], r[3] or 0)
    assert sorted(map(tuple, out), key=key) == sorted([(a, b, int(c.timestamp()), None if d is None else int(d.timestamp())) for a, b, c, d in want], key=key)


LAND = "polygon_id int, ring_no int, ring array<struct<lon:double,lat:double>>"


def land(spark):
    return spark.createDataFrame([(1, 0, box(0.0, 0.0, 40.0, 40.0)[:4]), (1, 1, box(10.0, 10.0, 20.0, 20.0)[:4])], LAND)


def test_land_and_inland(spark):
    spots = spark.createDataFrame([("canal", 5.5, 5.5), ("sea", 50.0, 50.0), ("enclosed", 15.0, 15.0), ("desert", 30.5, 30.5), ("shore", 0.005, 0.02)], "name string, lat double, lon double")
    dry = {(round(r.lat, 3), round(r.lon, 3)) for r in g.is_land(spots, land(spark)).collect()}
    assert dry == {(5.5, 5.5), (30.5, 30.5), (0.005, 0.02)}
    inland = {r.name for r in g.with_inland(spots, land(spark)).where("inland").collect()}
    assert inland == {"canal", "desert"}


def test_spoofing_cluster(spark):
    rows = [(i, i, NOW, 30.5 + i * 0.001, 30.5) for i in range(4)] + [(9, 9, NOW, -20.0, 5.0)]
    anomalies = spark.createDataFrame(rows, "id long, vessel_id long, ts timestamp, lat double, lon double")
    found = m.spoofing_clusters(anomalies, land(spark), zones(spark)).collect()
    assert len(found) == 1 and found[0].vessels == 4 and found[0].inland and found[0].severity == "high"


def test_spoofing_peel_matches_greedy(spark):
    rng = random.Random(2)
    points = [(i, i % 40, rng.randrange(12), rng.randrange(12)) for i in range(160)]
    frame = spark.createDataFrame([(i, h, NOW, r * 0.1 + 0.05, c * 0.1 + 0.05) for i, h, r, c in points], "id long, vessel_id long, ts timestamp, lat double, lon double")
    got = sorted((r.vessels, r.reports) for r in m.spoofing_clusters(frame, None, None, min_vessels=5).collect())
    cells = defaultdict(list)
    for i, h, r, c in points:
        cells[(r, c)].append(h)
    want = []
    while True:
        around = lambda k: [(k[0] + a, k[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
        ranked = sorted(cells, key=lambda k: (-len({h for n in around(k) for h in cells.get(n, [])}), k))
        if not ranked or len({h for n in around(ranked[0]) for h in cells.get(n, [])}) < 5:
            break
        members = [h for n in around(ranked[0]) for h in cells.pop(n, [])]
        want.append((len(set(members)), len(members)))
    assert got == sorted(want)


def test_names_and_numbers(spark):
    row = spark.createDataFrame([("Ocean-Stár  (Ltd.)", "IMO 9074729", "@@EVER GIVEN@@ -", "vessel IMO number: 9319466 built")], "a string, b string, c string, d string")
    out = row.select(t.normalize_name(F.col("a")), v.valid_imo(F.col("b")), t.clean_ais_name(F.col("c")), v.extract_imo(F.col("d")), t.is_name_variant(F.lit("STAR NO. 2"), F.lit("STAR NO2")), v.valid_imo(F.lit("1234567")), v.valid_imo(F.lit("9074728"))).collect()[0]
    assert list(out) == ["OCEAN STAR LTD", "9074729", "EVER GIVEN", "9319466", True, None, None]


def test_names_fold_like_unicode(spark):
    import unicodedata
    samples = ["Čeština ﬁnančí…x", "Ĳmuiden½", "Ｆｕｌｌ", "Ørsted ß", "Łódź", "北京 Star"]
    want = []
    for s in samples:
        folded = unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode().upper()
        want.append(" ".join("".join(ch if ch.isalnum() else " " for ch in folded).split()))
    got = [r[0] for r in spark.createDataFrame([(s,) for s in samples], "s string").select(t.normalize_name(F.col("s"))).collect()]
    assert got == want


def test_cargo(spark):
    def cargo(length, arrival, departure, commodity="crude"):
        return spark.range(1).select(v.estimate_cargo(F.lit(length), F.lit(arrival), F.lit(departure), F.lit(commodity)).alias("e")).collect()[0].e

    laden = cargo(245.0, 8.0, 14.5)
    assert laden.laden and laden.size_class == "aframax_lr2" and 650_000 <= laden.barrels <= 800_000
    assert cargo(245.0, 14.5, 8.0).laden is False
    assert cargo(275.0, None, 16.0).size_class == "suezmax" and cargo(275.0, None, 16.0).laden
    gas = cargo(290.0, 9.0, 12.0, "lng")
    assert gas.laden is None and gas.barrels is None


def test_land_parity_matches_ray_casting(spark):
    rng = random.Random(12)

    def ring(cx, cy, n, r):
        out = []
        for k in range(n):
            at, far = 2 * math.pi * k / n, r * rng.uniform(0.4, 1.0)
            out.append((cx + far * math.cos(at), cy + far * math.sin(at)))
        return out

    # a jagged coast with holes and a lake on cell corners, a long thin strip, a coast so fine that cells are cut several times
    rings = [(1, 0, ring(0.3, 0.7, 60, 4.0)), (1, 1, ring(0.0, 0.0, 9, 1.2)), (1, 2, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0)]), (2, 0, [(-9.0, 3.0), (9.0, 3.2), (9.0, 3.25), (-9.0, 3.1)]), (3, 0, ring(7.4, -2.6, 1500, 0.8)), (4, 0, [(-3.0, -5.0), (-1.0, -5.0), (-1.0, -4.0), (-3.0, -4.0)]), (5, 0, [])]
    land_ = spark.createDataFrame(rings, "polygon_id long, ring_no int, ring array<struct<lon:double,lat:double>>")
    points = [(rng.uniform(-6, 6), rng.uniform(-6, 10)) for _ in range(1500)] + [(rng.uniform(-3.5, -1.7), rng.uniform(6.6, 8.2)) for _ in range(1500)] + [(float(a) + 0.5 * b, float(c) + 0.25) for a in range(-5, 5) for b in (0, 1) for c in range(-5, 9)]

    def odd(poly, lat, lon):
        hit = False
        for (ax, ay), (bx, by) in zip(poly, poly[1:] + poly[:1]):
            if (ay > lat) != (by > lat) and lon < (bx - ax) * (lat - ay) / (by - ay) + ax:
                hit = not hit
        return hit

    want = {(lat, lon) for lat, lon in points if any(odd(r, lat, lon) and not any(odd(h, lat, lon) for q, no, h in rings if q == p and no) for p, no, r in rings if no == 0 and r)}
    spots = spark.createDataFrame(points, "lat double, lon double")
    for dense in (8, 64):
        assert {(r.lat, r.lon) for r in g.is_land(spots, land_, dense).collect()} == want
    assert len(want) > 400
    index = g.land_index(land_, 64)[0].groupBy("level").agg(F.max(F.size("edges")).alias("n")).collect()
    assert len(index) > 2 and max(r.n for r in index) <= 64


def test_feed_shapes(spark):
    def of(*values):
        return spark.createDataFrame([(v,) for v in values], "value string")

    station = '[{"ERROR":false,"RECORDS":2},[{"MMSI":230982000,"LATITUDE":60.1,"LONGITUDE":24.9,"TIME":"1767960000","SOG":0,"COG":12.5,"HEADING":511,"NAVSTAT":1,"NAME":" NORD ","IMO":9074729,"CALLSIGN":"OJ","TYPE":80,"DEST":""},{"MMSI":1,"LATITUDE":0,"LONGITUDE":0,"TIME":1767960000,"IMO":0}]]'
    rows = {r.mmsi: r for r in ais.load_station_feed(of(station, '[{"ERROR":false}]', None)).collect()}
    assert len(rows) == 2 and rows["230982000"].name == "NORD" and rows["230982000"].imo == "9074729" and rows["230982000"].ship_type.startswith("Tanker") and rows["230982000"].destination is None and rows["1"].imo is None
    with pytest.raises(Exception, match="too many requests"):
        ais.load_station_feed(of('[{"ERROR":true,"ERROR_MESSAGE":"too many requests"}]')).collect()
    area = '[{"MMSI":"230982000","LAT":"60.1","LON":24.9,"TIMESTAMP":"2026-01-09T12:00:00","SPEED":"123","COURSE":0,"HEADING":90,"STATUS":0,"SHIPNAME":"NORD","FLAG":"FI"},{"MMSI":"2","TIMESTAMP":"soon"},{"MMSI":"3"}]'
    found = ais.load_area_feed(of(area, "[]", None)).collect()
    assert [(r.mmsi, r.speed, r.course, r.heading, r.flag) for r in found] == [("230982000", 12.3, None, 90.0, "FI")]
    with pytest.raises(Exception, match="no such key"):
        ais.load_area_feed(of('{"errors":[{"detail":"no such key"}]}')).collect()
