import itertools
import random
from collections import Counter
from datetime import timedelta

import pytest
from conftest import NOW

from intel_spark.operators import fusion, links

SIGNAL = "ref string, type string, id long, domain string, ts timestamp, severity string, keys array<struct<kind:string,value:string>>, summary string"
KINDS = ("evasion_event", "dark_oil", "legal_event")


def row(i, kind, at, keys):
    return (f"{kind}:{i:04d}", kind, i, fusion.DOMAINS[kind], at, "high", keys, f"s{i}")


def busy(spark, n, step_minutes, keys=(("vessel", "210000007"), ("country", "PA"))):
    rows = [row(i, KINDS[i % 3], NOW + timedelta(minutes=step_minutes * i), list(keys)) for i in range(n)]
    return spark.createDataFrame(rows, SIGNAL), rows


def brute_pairs(rows, rules):
    """(a, b, exact score, strong, shared keys) of all passing pairs."""
    out = []
    for a, b in itertools.combinations(sorted(rows), 2):
        shared = sorted(set(a[6]) & set(b[6]))
        kinds = tuple(k for k, _ in shared)
        hours = abs((a[4] - b[4]).total_seconds()) / 3600
        if shared and a[3] != b[3] and hours <= rules.window(kinds):
            exact = rules.raw(kinds) * (1 - 0.5 * hours / rules.window(kinds))
            if round(exact + 1e-9, 3) >= rules.min_score:
                out.append((a[0], b[0], exact, rules.strong(kinds), shared))
    return out


def parts_of(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b, *_ in pairs:
        parent[find(a)] = find(b)
    groups = {}
    for x in list(parent):
        groups.setdefault(find(x), set()).add(x)
    return sorted(map(sorted, groups.values()))


def mixed_rows(seed, n=160, most=4):
    """Signals with shared keys of several kinds, equal moments and keys held once and by nearly all."""
    rng = random.Random(seed)
    values = {"vessel": 6, "entity": 9, "facility": 3, "country": 3, "asset": 4, "sector": 2, "theme": 1}
    rows = []
    for i in range(n):
        keys = {(k, f"{k[0]}{rng.randrange(values[k])}") for k in rng.choices(list(values), k=rng.randrange(most + 1))}
        rows.append(row(i, rng.choice(["evasion_event", "dark_oil", "legal_event", "breach"]), NOW + timedelta(minutes=rng.randrange(40) * 97), sorted(keys)))
    return rows


@pytest.mark.parametrize(("seed", "rules", "most"), [(1, links.Rules(), 4), (3, links.Rules(30, 0.3, 6), 5), (4, links.Rules(48, 0.6, 48), 14)])
def test_links_are_counted_as_by_brute_force(spark, monkeypatch, seed, rules, most):
    monkeypatch.setattr(links, "MOST_KEYS", 5)  # with 14 draws some signals hold more
    rows = mixed_rows(seed, most=most)
    if most > 10:
        assert any(len(r[6]) > 5 for r in rows)
    frame = spark.createDataFrame(rows, SIGNAL)
    pairs = brute_pairs(rows, rules)
    count, strong, score, by_domain, keys = Counter(), Counter(), Counter(), Counter(), Counter()
    domain = {r[0]: r[3] for r in rows}
    for a, b, exact, is_strong, shared in pairs:
        for x, y in ((a, b), (b, a)):
            count[x] += 1
            strong[x] += is_strong
            score[x] += exact * is_strong
            by_domain[x, domain[y]] += 1
            keys.update((x, f"{k}:{v}") for k, v in shared if is_strong)
    got = links.signal_links(frame, rules).collect()
    assert {r.ref: (r.links, r.strong_links) for r in got} == {x: (n, strong[x]) for x, n in count.items()}
    assert all(r.strong_score == pytest.approx(score[r.ref], abs=1e-6) for r in got)
    assert {(r.ref, r.other): r.links for r in links.signal_links(frame, rules, apart=True).collect()} == by_domain
    sums, shared = links.strong_links(frame, rules)
    assert {r.ref: r.strong_links for r in sums.collect()} == {x: n for x, n in strong.items() if n}
    assert all(r.strong_score == pytest.approx(score[r.ref], abs=1e-6) for r in sums.collect())
    assert {(r.ref, r.key): r.n for r in shared.collect()} == keys
    ties = [(r.a_ref, r.b_ref) for r in links.tied(frame, rules).collect()]
    assert set(ties) <= {p[:2] for p in pairs} and parts_of(ties) == parts_of(pairs)
    only_strong = [p for p in pairs if p[3]]
    ties = [(r.a_ref, r.b_ref) for r in links.tied(frame, rules, strong=True).collect()]
    assert set(ties) <= {p[:2] for p in only_strong} and parts_of(ties) == parts_of(only_strong)


def test_partners_of_a_key(spark):
    found, rows = busy(spark, 401, 30)
    got = {(r.kind, r.ref): (r.partners, r.next_ref) for r in links.key_links(found, 10).collect()}
    for i, a in enumerate(rows):
        near = [b for b in rows if b[3] != a[3] and abs(a[4] - b[4]) <= timedelta(hours=10)]
        later = [b[0] for b in near if b[4] > a[4]]
        assert got["vessel", a[0]] == got["country", a[0]] == (len(near), later[0] if later else None)


@pytest.mark.parametrize("n", [40, 41, 1200])
def test_a_common_country_links_like_a_rare_one(spark, n):
    found, rows = busy(spark, n, 1, [("country", "PA"), ("sector", "shipping")])
    rules = links.Rules(48, 0.3, 6)
    got = {r.ref: r.links for r in links.signal_links(found, rules).collect()}
    reach = rules.reach(("country", "sector")) / 6e7
    assert got == {a[0]: sum(abs(i - j) <= reach and (i - j) % 3 != 0 for j in range(n)) for i, a in enumerate(rows)}
    assert links.tied(found, rules).count() <= 4 * n


def test_a_busy_vessel_still_raises_an_alert(spark):
    found, rows = busy(spark, 401, 1)
    alerts = fusion.composite_alerts(found).collect()
    # both keys are held by all pairs: the anchor is the lesser name
    assert [(r.members, r.pairs, r.anchor, len(r.signals)) for r in alerts] == [(401, len(brute_pairs(rows, links.Rules())), "country:PA", 25)]


def test_window_edges(spark):
    rows = [row(1, "evasion_event", NOW, [("vessel", "v")]), row(2, "dark_oil", NOW + timedelta(hours=48), [("vessel", "v")]), row(3, "legal_event", NOW + timedelta(hours=96, seconds=1), [("vessel", "v")]), row(4, "breach", NOW, None), row(5, "breach", NOW, [])]
    frame = spark.createDataFrame(rows, SIGNAL)
    assert [(r.a_ref, r.b_ref) for r in links.tied(frame).collect()] == [("dark_oil:0002", "evasion_event:0001")]
    assert {r.ref: r.partners for r in links.key_links(frame, 48).collect()} == {"evasion_event:0001": 1, "dark_oil:0002": 1, "legal_event:0003": 0}
    none = spark.createDataFrame([], SIGNAL)
    assert links.key_links(none).count() == links.signal_links(none).count() == links.tied(none).count() == fusion.composite_alerts(none).count() == 0


def test_hot_keys_are_cut_into_days(spark):
    plan = links.key_links(busy(spark, 30, 60)[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "_bucket" in plan and all("_bucket" in line for line in plan.splitlines() if "Window [" in line and "lead" in line)


def test_a_call_and_a_shipment_of_one_terminal_link(spark):
    facilities = spark.createDataFrame([("KOZMINO (crude terminal)", "NAKHODKA"), ("SITE (x)", None)], "name string, port_name string")
    vessels = spark.createDataFrame([(1, "210000001", "PA", "A", "clear"), (2, "210000002", "LR", "B", "clear")], "id long, mmsi string, flag string, name string, sanctioned_status string")
    calls = spark.createDataFrame([(7, 1, NOW, True, "NAKHODKA", "RU")], "id long, vessel_id long, arrival timestamp, is_sanctioned boolean, port string, country string")
    loads = spark.createDataFrame([(9, "210000002", None, None, "KOZMINO (crude terminal)", "NAKHODKA", NOW + timedelta(hours=3), True, True, "crude")], "shipment_id long, mmsi string, origin string, destination string, loading_location string, discharge_location string, loading_date timestamp, sanctioned_route boolean, dark_oil_suspect boolean, cargo_type string")
    found = fusion.collect_signals({"vessels": vessels, "port_calls": calls, "shipments": loads, "facilities": facilities}, NOW - timedelta(days=1))
    held = {(r.type, r.id): {k.value for k in r.keys if k.kind == "facility"} for r in found.collect()}
    assert held == {("port_call", 7): {"KOZMINO (crude terminal)"}, ("oil_shipment", 9): {"KOZMINO (crude terminal)"}}
    assert [(r.a_ref, r.b_ref, r.link_type) for r in fusion.representative_pairs(found).collect()] == [("oil_shipment:9", "port_call:7", "geographic")]
    texts = spark.createDataFrame([(1, "A tanker left Kozmino."), (2, "kozminox"), (3, "Site visit")], "text_id long, text string")
    assert [(r.text_id, r.facility) for r in fusion.facility_mentions(texts, facilities).collect()] == [(1, "KOZMINO (crude terminal)")]
