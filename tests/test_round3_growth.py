"""Findings of the third round whose figures grew faster than the input, or with too large a share of it."""

from __future__ import annotations

import random
import re
from datetime import timedelta
from math import prod
from statistics import median

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from intel_spark.operators import chain, graph, links, maritime


@pytest.fixture
def checkpointed(spark, monkeypatch):
    """Rows of every checkpoint that is made."""
    kind = type(spark.range(0))
    rows, plain = [], kind.checkpoint

    def counted(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        rows.append(out.count())
        return out

    monkeypatch.setattr(kind, "checkpoint", counted)
    return rows


def test_component_rounds_shrink(spark, checkpointed):
    """Each round of components is a share of the one before; all rounds held every edge before."""
    order = random.Random(3).sample(range(2000), 2000)
    links = spark.createDataFrame([(f"n{order[i]}", f"n{order[i + 1]}") for i in range(1999) if i % 500 != 499], "src string, dst string")
    parts = {r.node: r.component for r in graph.connected_components(links).collect()}
    assert parts == {f"n{x}": min(f"n{y}" for y in order[i // 500 * 500 : i // 500 * 500 + 500]) for i, x in enumerate(order)}
    assert len(checkpointed) > 4 and median(checkpointed) < 400


def test_components_with_equal_hashes(spark):
    """Nodes that have the same hash stay apart: nulls inside a struct do not count in it."""
    node = "struct<a: int, b: int>"
    rows = [((None, 1), (5, 5)), ((1, None), (6, 6)), ((7, 7), (7, 7)), ((8, 8), None)]
    edges = spark.createDataFrame(rows, f"src {node}, dst {node}")
    got = [(r.node and tuple(r.node), r.component and tuple(r.component)) for r in graph.connected_components(edges).collect()]
    assert sorted(got, key=str) == sorted([((None, 1), (None, 1)), ((5, 5), (None, 1)), ((1, None), (1, None)), ((6, 6), (1, None)), ((7, 7), (7, 7)), ((8, 8), (8, 8)), (None, None)], key=str)
    assert edges.select(F.xxhash64("src").alias("h")).distinct().count() < 4


def test_components_of_stars_and_nothing(spark):
    star = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)], "src long, dst long")
    assert {(r.node, r.component) for r in graph.connected_components(star).collect()} == {(i, 0) for i in range(300)} | {(1000 + i, 1000) for i in range(300)} | {(5000, 5000)}
    assert graph.connected_components(star.limit(0)).collect() == []


def test_captured_transfers_travel_lean(spark, monkeypatch):
    """text is written for the rows that are left, and many labels are met without sorting the transfers."""
    moves = spark.createDataFrame(
        [("bitcoin", "t1", "a", "b", 9e6, "BTC"), ("bitcoin", "t1", "a", "c", 9e6, "BTC"), ("bitcoin", "t2", "x", "m", 5.0, None), ("bitcoin", "t3", "x", "y", 5.0, "BTC"), ("bitcoin", "t4", "s", None, None, "BTC"), ("bitcoin", "t5", "s", "e", 1.0, "BTC")],
        "chain string, tx_hash string, src string, dst string, usd double, token string",
    )
    labels = spark.createDataFrame([("bitcoin", "s", "sanctioned", "one", "who"), ("bitcoin", "s", "sanctioned", "two", "also"), ("bitcoin", "m", "mixer", "mix", None), ("bitcoin", "e", "exchange", "ex", None)], "chain string, address string, wallet_type string, label string, owner string")
    stored = spark.createDataFrame([("bitcoin", "t5")], "chain string, tx_hash string")
    want = [
        ("t1", "b", None, None, "whale_transfer", 0.49, "whale transfer: $9,000,000 BTC from unlabelled to unlabelled"),
        ("t2", "m", None, "mix", "mixer_usage", 0.6, "mixer usage: $5  from unlabelled to mix"),
        ("t4", None, "also", None, "sanctioned_counterparty", 0.85, "sanctioned counterparty: unknown value BTC from also to unlabelled"),
    ]
    for many in (100_000, 0):
        monkeypatch.setattr(chain, "MANY_LABELS", many)
        found = chain.capture(moves, labels, stored)
        got = [(r.tx_hash, r.dst, r.source_entity, r.destination_entity, r.pattern, r.risk_score, r.summary) for r in found.orderBy("tx_hash").collect()]
        assert got == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.index("format_string") < plan.index("Exchange") and plan.count("ShuffledHashJoin") == (0 if many else 2)
        assert "format_string" not in plan[plan.index("Exchange"):]


def test_counted_links_carry_no_members(spark):
    """rows that only count links name their key set; its members travel with them where keys are counted."""
    rows = [("a", "x", 0, "e1", "c1"), ("b", "y", 60, "e1", "c1"), ("c", "y", 120, "e1", "c2"), ("d", "z", 0, "e2", "c1")]
    signals = spark.createDataFrame(rows, "ref string, domain string, s int, e string, c string").selectExpr("ref", "domain", "timestamp_seconds(s) AS ts", "array(named_struct('kind', 'entity', 'value', e), named_struct('kind', 'country', 'value', c)) AS keys")
    signals = signals.selectExpr("*", "'t' AS type", "1 AS id", "'low' AS severity", "'s' AS summary")
    counted = links.signal_links(signals, links.Rules(48, 0.3, 6), apart=True)
    assert {(r.ref, r.other, r.links) for r in counted.collect()} == {("a", "y", 2), ("b", "x", 1), ("c", "x", 1)}  # a country alone does not pass
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not any("members#" in line for line in plan.split("\n") if "Aggregate" in line)
    shared = links.strong_links(signals, links.Rules(48, 0.3, 6))[1]
    assert {(r.ref, r.key, r.n) for r in shared.collect()} == {("a", "entity:e1", 2), ("a", "country:c1", 1), ("b", "entity:e1", 1), ("b", "country:c1", 1), ("c", "entity:e1", 1)}


def test_linked_vessels_are_listed_where_they_meet(spark, monkeypatch):
    """pairs were grouped, so that a task held a share of all of them."""
    monkeypatch.setattr(maritime, "LINK_BLOCK", 5, raising=False)
    draw = random.Random(17)
    pick = lambda name, n: draw.choice([None, "", *[f"{name}{i}" for i in range(n)]])
    fleet = [(i, f"m{i}", f"n{i}", "PA", 0.5, pick("o", 4), pick("p", 9), pick("b", 12)) for i in range(40)]
    listed = [(draw.choice([None, *range(45)]), draw.choice([None, 1, 2, 3, 10, 11])) for _ in range(60)]
    met = [(draw.randrange(45), draw.choice([None, *range(45)]), NOW - timedelta(days=draw.randrange(60))) for _ in range(150)]
    called = [(draw.randrange(45), draw.choice([None, *[f"port{i}" for i in range(8)]]), draw.random() < 0.2, draw.choice([None, "high", "safe", "safe"]), NOW - timedelta(days=draw.randrange(60))) for _ in range(120)]
    focus = [*range(0, 44, 3), 0]  # some are not in the fleet

    known, asked, since = {r[0]: r for r in fleet}, set(focus), NOW - timedelta(days=30)
    weights = {}

    def tie(v, o, reason):
        if v in asked and o in known and v != o:
            weights.setdefault((v, o), []).append(reason)

    for column, reason in ((5, "shared_owner"), (6, "shared_operator"), (7, "shared_beneficial_owner")):
        for a in fleet:
            for b in fleet:
                if a[column] and a[column] == b[column]:
                    tie(a[0], b[0], reason)
    for v, e in set(listed):
        for o, f in set(listed):
            if e is not None and e == f:
                tie(v, o, "shared_sanctions_entity")
    for a, b, at in met:
        if at >= since:
            tie(a, b, "transshipment_partner")
            tie(b, a, "transshipment_partner")
    for v, port in {(v, port) for v, port, sanctioned, risk, at in called if (sanctioned or risk == "high") and at >= since}:
        for o, other, _, _, at in called:
            if port is not None and port == other and at >= since:
                tie(v, o, "shared_high_risk_port")

    vessels = spark.createDataFrame(fleet, "id long, mmsi string, name string, flag string, risk_score double, owner string, operator string, beneficial_owner string")
    found = maritime.linked_vessels(
        vessels, spark.createDataFrame(listed, "vessel_id long, entity_id long"), spark.createDataFrame(met, "vessel_a long, vessel_b long, ts timestamp"),
        spark.createDataFrame(called, "vessel_id long, port string, is_sanctioned boolean, risk_level string, arrival timestamp"), spark.createDataFrame([(i,) for i in focus], "vessel_id long"), NOW, 30,
    )
    got = {(r.vessel_id, r.other_id): r for r in found.collect()}
    assert len(got) == found.count() and got.keys() == weights.keys()
    for pair, reasons in weights.items():
        assert got[pair].reasons == sorted(set(reasons)) and got[pair].mmsi == f"m{pair[1]}"
        assert got[pair].link_strength == pytest.approx(1 - prod(1 - maritime.LINK_WEIGHTS[r] for r in reasons), abs=0.0051)
    assert not re.search(r"Aggregate \[[^\]]*other_id", found._jdf.queryExecution().optimizedPlan().toString())


def test_a_signal_and_set_are_summed_three_times(spark, monkeypatch):
    """both ends of a reach and the moment itself; eight rows before, of which six were probes."""
    rows = [(f"r{i}", "abcd"[i * 7 % 4], 600 * i, f"e{i % 2}") for i in range(40)]
    signals = spark.createDataFrame(rows, "ref string, domain string, s int, e string").selectExpr("ref", "domain", "timestamp_seconds(s) AS ts", "e AS name", "'entity' AS shape")
    summed, plain = [], links.running_sums
    monkeypatch.setattr(links, "running_sums", lambda df, *args: summed.append(df.count()) or plain(df, *args))
    reach = 7_200_000_000
    found = {r.ref: (r.near, round(r.hours, 6)) for r in links.range_counts(signals, reach).collect()}
    near = {a: [abs(s - t) / 3600 for b, o, t, f in rows if e == f and d != o and abs(s - t) <= 7200] for a, d, s, e in rows}
    assert found == {a: (len(gaps), round(sum(gaps), 6)) for a, gaps in near.items() if gaps} and summed == [120]
    apart = {(r.ref, r.other): r.near for r in links.range_counts(signals, reach, apart=True).collect()}
    assert sum(apart.values()) == sum(n for n, _ in found.values()) and len({o for _, o in apart}) == 4
