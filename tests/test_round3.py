"""Cases of the third round of findings."""

import math
from datetime import timedelta

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from test_fusion import brute_pairs, busy

from intel_spark.operators import fusion, links, market, names, search, timeline


def test_a_price_of_zero_gives_infinite_returns(spark):
    closes = [0.0, 0.0, 4.0, 2.0, 3.0, 0.0, 5.0, 6.0, 6.0, 3.0]
    candles = spark.createDataFrame([("oil", "x", NOW + timedelta(hours=i), c) for i, c in enumerate(closes)], "asset string, exchange string, ts timestamp, close double")
    got = [r.ret for r in market.returns(candles).orderBy("ts").collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2] == got[6] == math.inf and got[3:6] == [-50.0, 50.0, -100.0] and got[7:] == [pytest.approx(20), 0.0, -50.0]
    row = market.volatility(candles, 360).first()
    assert row.candles == 10 and math.isnan(row.daily_percent) and math.isnan(row.max_window_move)
    series = market.volatility_series(candles, 120)
    assert series.count() == 4 and market.volatility_clusters(series, 1.5, 120).collect() == []  # the median is not a number


def test_next_known_reads_no_frame_to_its_end(spark):
    rows = spark.createDataFrame([("k", NOW + timedelta(hours=i), i, i if i % 7 == 3 else None) for i in range(100)], "key string, ts timestamp, id int, v int")
    found = timeline.next_known(rows, ["key"], "ts", {"after": F.col("v")}, ["id"])
    assert {r.id: r.after for r in found.collect()} == {i: next((j for j in range(i, 100) if j % 7 == 3), None) for i in range(100)}
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


LISTING = "id long, authority string, name string, name_normalized string, entity_type string, aliases array<string>, programs array<string>, imo string, mmsi string, country string, vessel_flag string, vessel_type string"


def copies(spark, n):
    listings = spark.createDataFrame([(i, "OFAC", "OCEAN STAR HOLDING", "OCEAN STAR HOLDING", "company", ["STAR GROUP"], ["P"], None, None, "PA", None, None) for i in range(n)], LISTING)
    vessels = spark.createDataFrame([(i, None, None, "SHIP", "PA", "Tanker", "OCEAN STAR HOLDING" if i % 2 else "OCEAN STAR HOLDINGS", None, None) for i in range(n)], "id long, mmsi string, imo string, name string, flag string, ship_type string, owner string, operator string, beneficial_owner string")
    return vessels, listings




def test_copies_of_names_are_spread_out_behind_the_last_shuffle(spark):
    vessels, listings = copies(spark, 40)
    asked = vessels.select(F.col("id").alias("name_id"), F.col("owner").alias("name"))
    exact, found = names.match_exact(asked, listings), names.screen_names(asked, listings)
    assert exact.count() == exact.distinct().count() == 20 * 40
    assert {(r.match_type, r["count"]) for r in found.groupBy("match_type").count().collect()} == {("name_exact", 800), ("name_fuzzy", 800)}
    screened = names.screen_vessels(vessels, listings)
    assert {(r.match_type, r.confidence, r["count"]) for r in screened.groupBy("match_type", "confidence").count().collect()} == {("owner", 0.65, 800), ("owner", 0.5, 800)}
    assert screened.where("authority = 'OFAC' and listed = 'OCEAN STAR HOLDING'").count() == 1600
    for frame in (exact, found):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" in plan and not any(w in plan.split("Generate")[0] for w in ("Join", "Window", "Aggregate", "RepartitionByExpression"))


def test_ids_of_several_rows_match_once(spark):
    vessels, listings = copies(spark, 2)
    twice = names.screen_vessels(vessels.union(vessels.withColumn("owner", F.lit("OCEAN STAR HOLDING"))), listings)
    assert sorted((r.vessel_id, r.listing_id, r.confidence) for r in twice.collect()) == [(v, x, 0.65) for v in range(2) for x in range(2)]


def test_every_pair_is_listed(spark):
    found, rows = busy(spark, 120, 7)
    rules = links.Rules(10, 0.3, 3)
    listed = [(r.a_ref, r.b_ref) for r in fusion.score_pairs(found, rules).collect()]
    assert len(listed) == len(set(listed)) and set(listed) == {p[:2] for p in brute_pairs(rows, rules)}
    spans = {}
    for r in links.key_links(found, 3).collect():
        spans.setdefault((r.kind, r.value), []).append(r)
    pairs = {(a.ref, b.ref) for held in spans.values() for a in held for b in held if a.domain != b.domain and a.ref < b.ref and a.first <= b.number <= a.last}
    assert pairs == {(a[0], b[0]) for a in rows for b in rows if a[3] != b[3] and a[0] < b[0] and abs(a[4] - b[4]) <= timedelta(hours=3)}


def test_ids_of_one_needle_multiply_hits_behind_the_last_shuffle(spark):
    texts = spark.createDataFrame([(i, "a tanker in port" if i % 2 else "a Port") for i in range(20)], "text_id int, text string")
    needles = spark.createDataFrame([(i, "PORT") for i in range(30)] + [(0, "tanker"), (31, "tanker")], "needle_id int, needle string")
    found = search.substring_join(texts, needles)
    assert sorted((r.text_id, r.needle_id) for r in found.collect()) == sorted([(t, n) for t in range(20) for n in range(30)] + [(t, 31) for t in range(1, 20, 2)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]
