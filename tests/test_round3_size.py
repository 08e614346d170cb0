"""Cases of the third round's findings on time, disk and memory."""

from datetime import timedelta

from conftest import NOW

from intel_spark.operators import events as v
from intel_spark.sources import ais


def test_crowded_moments_link_the_smaller_ids(spark):
    kinds = ["sanctions_update", "market_alert", "evasion_event"]
    # sixty signals of a kind at one moment, more than an event links, some before and some after it
    signals = [(kinds[m % 3], 1000 * m + i, NOW + timedelta(minutes=7 * m), "finance" if m % 2 else "shipping", ["RU"] if m % 4 else ["PA"]) for m in range(12) for i in range(60 if m % 5 == 0 else 9)]
    events = [(j, NOW + timedelta(minutes=11 * j), "sanctions" if j % 2 else "political", ["finance", "shipping"][: 1 + j % 2], ["RU"]) for j in range(9)]
    s = spark.createDataFrame(signals, "kind string, id long, ts timestamp, sector string, countries array<string>")
    e = spark.createDataFrame(events, "id long, ts timestamp, event_type string, sectors array<string>, countries array<string>")
    found = v.correlate_events(e, s, 24.0, 0.55, 40)
    want = {}
    for eid, at, kind, sectors, countries in events:
        scored = []
        for k, sid, ts, sector, places in signals:
            r = (0.3 if k == "evasion_event" else 0.45) * (sector in sectors) + 0.35 * bool(set(places) & set(countries)) + 0.4 * (kind == "sanctions" and k == "sanctions_update")
            gap = abs((ts - at).total_seconds())
            score = round(0.7 * min(1.0, r) + 0.3 * (1 - gap / 86_400), 3)
            if r > 0 and score >= 0.55:
                scored.append((-score, gap, k, sid))
        want[eid] = {x[2:] for x in sorted(scored)[:40]}
    got = {}
    for r in found.collect():
        got.setdefault(r.event_id, set()).add((r.alert_type, r.alert_id))
    assert got == {k: w for k, w in want.items() if w}


def test_positions_meet_their_prefix_where_they_are(spark):
    # too large to be sent out by its size alone
    positions = spark.range(40).selectExpr("concat('21', lpad(cast(id as string), 7, '0')) AS mmsi", "id", "cast(null as string) AS flag", "1.0D AS heading", "1.0D AS speed", "'A' AS name", "'B' AS destination", "cast(null as string) AS imo")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ais.normalise_ais(positions, spark.createDataFrame([("210", "CY")], "prefix string, iso string"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {r.flag for r in found.collect()} == {"CY"}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning(_p" not in plan
