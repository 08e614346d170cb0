"""Findings of the fourth round on time, disk or memory."""

from __future__ import annotations

import random
import re
import time
from datetime import timedelta
from decimal import ROUND_HALF_UP, Decimal
from pathlib import Path

import pytest
from conftest import NOW
from test_fusion import SIGNAL, brute_pairs, mixed_rows

from intel_spark.operators import events, fusion, graph, links
from intel_spark.session import shared_folder


@pytest.mark.parametrize("block", [2, 256])
def test_watch_hits_are_spread_out_behind_the_last_shuffle(spark, monkeypatch, block):
    """hits were made distinct and compared with the stored ones row by row, so all of them were shuffled."""
    monkeypatch.setattr(fusion, "WATCH_BLOCK", block, raising=False)
    draw = random.Random(23)
    day = lambda n: NOW - timedelta(days=n)
    items = [(i, *draw.choice([("keyword", "oil"), ("keyword", "Gas"), ("company", "oil"), ("vessel", "v1"), ("vessel", None), ("domain", "")]), day(40), draw.choice([None, day(1), day(3), day(9)])) for i in range(40)]
    records = [("vessel", "v1", "evasion", draw.randrange(9), day(draw.randrange(12)), draw.choice(["low", "high"])) for _ in range(25)] + [("company", "oil", "doc", 1, day(0), "low"), (None, "v1", "evasion", 1, day(0), "low")]
    texts = [("doc", i % 6, day(i % 5), "medium", draw.choice(["Oil spill", "gas and oil", "water", None]), draw.choice([["keyword"], ["keyword", "company"], None])) for i in range(12)]
    stored = [(draw.randrange(40), draw.choice(["doc", "evasion"]), draw.randrange(9)) for _ in range(60)] + [(None, "doc", 1), (3, None, 1)]
    want = {}
    for i, kind, key, created, checked in items:
        since = checked or max(created - timedelta(days=7), NOW - timedelta(days=30))
        met = [r[2:] for r in records if r[:2] == (kind, key) and kind and key]
        met += [t[:4] for t in texts if kind in ("company", "domain", "keyword") and key and t[4] and key.lower() in t[4].lower() and kind in (t[5] or [])]
        for type_, id_, ts, severity in met:
            if ts >= since and (i, type_, id_) not in stored:
                want[i, type_, id_] = min(want.get((i, type_, id_), (ts, severity)), (ts, severity))
    assert len({k[1] for k in want}) == 2
    find = lambda rows: fusion.watch_hits(
        spark.createDataFrame(rows, "id long, kind string, key string, created_at timestamp, last_checked_at timestamp"), spark.createDataFrame(records, "kind string, key string, record_type string, record_id long, ts timestamp, severity string"),
        spark.createDataFrame(texts, "record_type string, record_id long, ts timestamp, severity string, text string, kinds array<string>"), spark.createDataFrame(stored, "item_id long, record_type string, record_id long"), NOW,
    )
    found = find(items)
    rows = found.collect()
    at = lambda t: t.timestamp()
    spoken = {i: (kind, key, checked is not None) for i, kind, key, _, checked in items}
    assert len(rows) == len(want)
    assert {(r.item_id, r.record_type, r.record_id): (at(r.ts), r.severity) for r in rows} == {k: (at(ts), s) for k, (ts, s) in want.items()}
    assert all((r.kind, r.key, r.news) == spoken[r.item_id] for r in rows)
    assert not re.search(r"(Aggregate|Join)[^\n]*item_id#\d+(?=[^\n]*record_id)", found._jdf.queryExecution().optimizedPlan().toString())
    # an item that stands twice is met once
    twice = [(r.item_id, r.record_type, r.record_id, at(r.ts), r.severity) for r in find([*items, items[0]]).collect()]
    assert sorted(twice) == sorted((r.item_id, r.record_type, r.record_id, at(r.ts), r.severity) for r in rows)


@pytest.mark.parametrize("rules", [links.Rules(), links.Rules(240, 0.3, 60), links.Rules(12, 0.2, 12)])
def test_best_pairs_are_the_best_of_all(spark, rules):
    """all pairs were listed to find the best of them."""
    frame = spark.createDataFrame(mixed_rows(5, n=240, most=5), SIGNAL)
    order = lambda rows: sorted((-r.score, r.a_ref, r.b_ref) for r in rows)
    every = order(fusion.score_pairs(frame, rules).collect())
    assert [(p[0], p[1]) for p in sorted(brute_pairs(mixed_rows(5, n=240, most=5), rules))] == sorted((a, b) for _, a, b in every)
    for n in (1, 7, 60, len(every) + 1):
        best = order(fusion.score_pairs(frame, rules, best=n).collect())
        assert best[:n] == every[:n] and best == every[: len(best)]
        assert n > 7 or len(best) < len(every) / 4
    assert fusion.score_pairs(spark.createDataFrame([], SIGNAL), rules, best=3).collect() == []


def test_shared_keys_are_worked_out_once_a_pair(spark):
    """filters held the keys a pair shares in place of every mention of them."""
    plan = fusion.score_pairs(spark.createDataFrame(mixed_rows(2, n=20), SIGNAL))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect") == 1


def test_components_leave_little_on_the_disk(spark, monkeypatch):
    """shuffle files and checkpoints of all rounds lay on the disk until the driver collected its garbage."""
    draw = random.Random(12)
    edges = [(f"n{draw.randrange(900)}", f"n{draw.randrange(900)}") for _ in range(500)] + [("n0", f"s{i}") for i in range(200)]
    neighbours = {}
    for a, b in edges:
        neighbours.setdefault(a, set()).add(b)
        neighbours.setdefault(b, set()).add(a)
    want = {}
    for node in sorted(neighbours):
        found = [] if node in want else [node]
        want.setdefault(node, node)
        while found:
            for other in neighbours[found.pop()] - want.keys():
                want[other] = want[node]
                found.append(other)
    frame = spark.createDataFrame(edges, "src string, dst string")
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {b.toString() for b in spark.sparkContext._gateway.jvm.scala.jdk.javaapi.CollectionConverters.asJava(files.getAllBlocks()) if b.toString().startswith("shuffle_")}
    for large in (1, 1_000_000):
        monkeypatch.setattr(graph, "LARGE_ROUND", large, raising=False)
        before, folders = held(), set(Path(shared_folder(spark).removeprefix("file:")).glob("components-*"))
        parts = graph.connected_components(frame)
        end = time.time() + 20
        while held() - before and time.time() < end:
            time.sleep(0.2)
        assert not held() - before
        made = set(Path(shared_folder(spark).removeprefix("file:")).glob("components-*")) - folders
        assert [sorted(p.name for p in f.iterdir() if any(p.rglob("*.parquet"))) for f in made] == [["placed"]]
        assert {r.node: r.component for r in parts.collect()} == want


@pytest.mark.parametrize("kind_of_id", ["long", "string"])
def test_event_links_are_ranked_by_arrays(spark, monkeypatch, kind_of_id):
    """every signal near an event was a struct that Spark worked out, sorted and took apart one by one."""
    monkeypatch.setattr(events, "PIECE", 7, raising=False)
    draw = random.Random(9)
    name = (lambda i: i) if kind_of_id == "long" else (lambda i: f"s{i % 7}-{i}")
    kinds, sectors, places = ["evasion_event", "sanctions_breach", "market_alert", "transshipment", "sanctions_update"], ["shipping", "finance"], ["RU", "PA", "LR"]
    at = lambda: NOW + timedelta(minutes=draw.randrange(60) * 49, microseconds=draw.choice([0, 0, 1]))
    found = [(draw.choice(kinds), name(i), at(), draw.choice(sectors), draw.choice([["RU"], ["PA", "LR"], [], None])) for i in range(300)]
    asked = [(i, at(), draw.choice(["sanctions", "maritime_incident", "political"]), [draw.choice(sectors)], draw.sample(places, 2)) for i in range(30)] + [(99, None, "sanctions", ["finance"], ["RU"])]
    want = set()
    for i, when, type_, about, where in asked[:-1]:
        near = []
        for kind, id_, ts, sector, countries in found:
            r = (0.3 if kind in ("evasion_event", "transshipment") else 0.45) * (sector in about) + 0.35 * bool(set(where) & set(countries or []))
            r += 0.4 * (type_ == "sanctions" and kind in ("sanctions_breach", "sanctions_update")) + 0.3 * (type_ == "maritime_incident" and kind in ("evasion_event", "transshipment", "sanctions_breach"))
            hours = abs((ts - when) / timedelta(hours=1))
            score = Decimal(repr(0.7 * min(1.0, r) + 0.3 * (1 - hours / 24))).quantize(Decimal("0.001"), ROUND_HALF_UP)
            if r > 0 and hours < 24 and float(score) >= 0.55:
                near.append((-score, abs(ts - when), kind, id_))
        want |= {(i, kind, id_, float(-worse)) for worse, _, kind, id_ in sorted(near)[:11]}
    e = spark.createDataFrame(asked, "id long, ts timestamp, event_type string, sectors array<string>, countries array<string>")
    s = spark.createDataFrame(found, f"kind string, id {kind_of_id}, ts timestamp, sector string, countries array<string>")
    links_ = events.correlate_events(e, s, 24.0, 0.55, 11)
    got = [(r.event_id, r.alert_type, r.alert_id, r.score) for r in links_.collect()]
    assert len(got) == len(set(got)) == len(want) > 200 and set(got) == want
    assert "collect_list" not in links_._jdf.queryExecution().optimizedPlan().toString()
    assert events.correlate_events(e, s.limit(0)).collect() == events.correlate_events(e.limit(0), s).collect() == []


def test_links_by_domain_are_added_up_once(spark):
    """F8: ranges were added up per signal, set and other domain, and again per signal and other domain."""
    rows = mixed_rows(8)
    counted = links.signal_links(spark.createDataFrame(rows, SIGNAL), apart=True)
    domain, want = {r[0]: r[3] for r in rows}, {}
    for a, b, *_ in brute_pairs(rows, links.Rules()):
        for x, y in ((a, b), (b, a)):
            want[x, domain[y]] = want.get((x, domain[y]), 0) + 1
    assert {(r.ref, r.other): r.links for r in counted.collect()} == want
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[[^\]]*other#", plan) and len(re.findall(r"Aggregate \[ref#", plan)) == 1
