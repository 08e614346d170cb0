import random
import re

import pytest
from conftest import NOW
from pyspark.sql import functions as F

from intel_spark.functions import chain as c
from intel_spark.functions import news as nw
from intel_spark.functions import text as t
from intel_spark.functions.vessel import lookup
from intel_spark.operators import corporate, graph, search
from intel_spark.operators import maritime as m
from intel_spark.operators import names as n
from intel_spark.operators import sanctions as s
from intel_spark.sources import lists, news

LISTING = "id long, authority string, source_id string, name string, name_normalized string, entity_type string, country string, programs array<string>, aliases array<string>, imo string, mmsi string, vessel_flag string, vessel_type string, is_active boolean"
VESSEL = "id long, mmsi string, imo string, name string, flag string, ship_type string, owner string, operator string, beneficial_owner string"


def listings(spark):
    rows = [
        (1, "OFAC", "1", "OCEAN GRACE", "OCEAN GRACE", "vessel", None, ["IRAN"], ["GRACE OF THE SEA"], "9179414", None, "IR", "Crude Oil Tanker", True),
        (2, "EU", "2", "Volga Shipping Company", "VOLGA SHIPPING COMPANY", "company", "RU", ["UKR"], [], None, None, None, None, True),
    ]
    return spark.createDataFrame(rows, LISTING)


def screen(spark, mode="sequence", **values):
    row = {"id": 7, "mmsi": "210000007", "imo": None, "name": None, "flag": "PA", "ship_type": None, "owner": None, "operator": None, "beneficial_owner": None, **values}
    vessels = spark.createDataFrame([tuple(row[k] for k in ("id", "mmsi", "imo", "name", "flag", "ship_type", "owner", "operator", "beneficial_owner"))], VESSEL)
    return {r.match_type: r.confidence for r in n.screen_vessels(vessels, listings(spark), mode=mode).collect()}


def test_confidence_ladder(spark):
    assert screen(spark, imo="9179414", name="OTHER NAME") == {"imo": 0.95}
    assert screen(spark, name="Ocean Grace", flag="IR") == {"name_exact": 0.9, "flag_program": 0.55}
    assert screen(spark, name="OCEAN GRACF", flag="IR")["name_fuzzy"] == 0.7
    assert screen(spark, name="Grace of the Sea", flag="PA") == {"name_exact": 0.55}
    assert screen(spark, name="OCEAN GRACE", flag="IR", imo="9074729")["name_exact"] == 0.3
    assert screen(spark, name="OCEAN GRACE", flag="IR", ship_type="Fishing")["name_exact"] == 0.35
    assert screen(spark, owner="Volga Shipping Company", flag="RU") == {"owner": 0.65}
    assert screen(spark, name="HARMLESS", flag="NL") == {}


def similar(spark, left, right, ratio, mode):
    a = spark.createDataFrame([(x,) for x in left], "l string")
    b = spark.createDataFrame([(x,) for x in right], "r string")
    return {(r.a, r.b) for r in n.similar_names(a, b, "l", "r", ratio, mode).collect()}


def test_gram_filter_loses_no_pair(spark):
    from difflib import SequenceMatcher
    rng = random.Random(4)
    words = ["STAR", "OCEAN", "SHIPPING", "CO", "LTD", "AAAA", "ABAB", "MARINE"]
    base = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)]

    def typo(x):
        x = list(x)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(x))
            x[i:i + 1] = rng.choice(["", "Q", x[i] + x[i]])
        return "".join(x) or "A"

    left, right = sorted(set(base)), sorted({typo(x) for x in base for _ in range(3)})

    def levenshtein(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for ratio in (0.86, 0.92):
        want = {(a, b) for a in left for b in right if 1 - levenshtein(a, b) / max(len(a), len(b)) >= ratio - 1e-12}
        assert similar(spark, left, right, ratio, "levenshtein") == want
        want = {(a, b) for a in left for b in right if SequenceMatcher(None, a, b, autojunk=False).ratio() >= ratio - 1e-12}
        assert similar(spark, left, right, ratio, "sequence") == want


def edition(spark, rows):
    return spark.createDataFrame([("OFAC", *r) for r in rows], "authority string, source_id string, id long, name string, entity_type string, programs array<string>, imo string, is_active boolean")


def test_list_diff(spark):
    old = edition(spark, [("1", 1, "A CORP", "company", ["X"], None, True), ("2", 2, "B CORP", "company", ["X"], None, False), ("3", 3, "C CORP", "company", ["X"], None, True)])
    new = edition(spark, [("1", None, "A2 CORP", "company", ["Y"], None, True), ("2", None, "B CORP", "company", ["X"], None, True), ("4", None, "D CORP", "company", [], None, True)])
    diff = s.diff_listings(old, new)
    kinds = {r.source_id: (r.kind, sorted(r.changed)) for r in diff.collect()}
    assert kinds == {"1": ("changed", ["name", "programs"]), "2": ("relisted", []), "3": ("delisted", []), "4": ("new", [])}
    assert {r.update_type for r in s.change_log(diff, NOW).collect()} == {"name_change", "relisted", "delisting", "new_designation"}
    after = s.apply_diff(old.withColumn("delisting_date", F.lit(None).cast("timestamp")), new, diff, NOW)
    again = {r.kind for r in s.diff_listings(after, new).collect()}
    assert again == {"unchanged", "inactive"}


def test_truncated_list_delists_nothing(spark):
    old = edition(spark, [(str(i), i, f"E{i}", "company", [], None, True) for i in range(10)])
    new = edition(spark, [("1", None, "E1", "company", [], None, True)])
    assert {r.kind for r in s.diff_listings(old, new).collect()} == {"unchanged", "kept"}
    empty = edition(spark, [("1", None, "E1", "company", [], None, True)]).limit(0)
    assert [r.update_type for r in s.change_log(s.diff_listings(empty, new), NOW).collect()] == ["initial_import"]


def test_namesake_is_cleared(spark):
    breaches = spark.createDataFrame([(7, "OFAC", "OCEAN GRACE", "direct_match", 1, "name_exact", 0.9, "flagged")], "vessel_id long, authority string, listed string, breach_type string, listing_id long, match_type string, confidence double, status string")
    for imo, status in ((None, "breach_ofac"), ("9074729", "clear")):
        vessels = spark.createDataFrame([(7, imo)], "id long, imo string")
        assert m.reconcile_imo(breaches, vessels, listings(spark))[1].collect()[0].sanctioned_status == status


def test_company_names(spark):
    pairs = [("Rosneft Trading S.A.", "ROSNEFT"), ("JSC Rosneft Oil Company", "ROSNEFT OIL"), ("Ooo Holding Group Ltd", "OOO"), ("Public Joint Stock Company Gazprom", "GAZPROM")]
    frame = spark.createDataFrame(pairs, "raw string, want string")
    for r in frame.select("want", t.core_name(F.col("raw")).alias("got")).collect():
        assert r.got == r.want
    assert spark.range(1).select(t.company_similarity(F.lit("Rosneft Trading S.A."), F.lit("ROSNEFT LLC"))).collect()[0][0] == 1.0
    registry = spark.createDataFrame([("L1", "Other GmbH", []), ("L2", "ROSNEFT PJSC", ["x"])], "lei string, name string, other_names array<string>")
    queries = spark.createDataFrame([(1, ["Rosneft Trading S.A."])], "query_id long, names array<string>")
    assert n.best_registry_match(queries, registry).collect()[0].lei == "L2"


def test_shell(spark):
    from datetime import timedelta
    schema = "id long, name string, country string, registration_status string, entity_status string, creation_date timestamp, parent_exception string, children_count int, listed boolean"
    rows = [(1, "Global Trading FZE", "VG", "LAPSED", "ACTIVE", NOW - timedelta(days=100), "NO_KNOWN_PERSON", 0, True), (2, "Plain AG", "DE", "ISSUED", "ACTIVE", NOW - timedelta(days=5000), None, 3, False)]
    out = {r.id: r for r in corporate.assess_shell(spark.createDataFrame(rows, schema), NOW).collect()}
    assert out[1].is_shell and out[1].opaque and out[1].shell_confidence >= 0.8 and out[2].shell_confidence == 0


def test_wallet_addresses(spark):
    remarks = "Digital Currency Address - XBT bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4; alt. Digital Currency Address - ETH 0xAb5801a7D398351b8bE11C439e05C5B3259aeC9B; Digital Currency Address - USDT TR7NHqjeKQxGTCi8q8ZY4pL8otSzgjLj6t; Digital Currency Address - XMR 4AdUndXHHZ6cfufTMvppY6JwXNouMBzSkbLYfpAV5Usx"
    out = spark.createDataFrame([(remarks,)], "r string").select(F.explode(c.listed_addresses(F.col("r"))).alias("a")).select("a.*").collect()
    assert [r.chain for r in out] == ["bitcoin", "ethereum", "tron", "monero"] and out[1].address.islower()
    assert spark.createDataFrame([("no address",)], "r string").select(F.size(c.listed_addresses(F.col("r")))).collect()[0][0] == 0


def test_hex_amounts(spark):
    big = 123456789 * 10**22
    out = spark.createDataFrame([(hex(big),), ("0x0",), ("0x" + "f" * 40,)], "v string").select(c.hex_to_decimal(F.col("v"))).collect()
    assert int(out[0][0]) == big and int(out[1][0]) == 0 and out[2][0] is None


def test_components_match_union_find(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in {y for e in edges for y in e}}


def test_cospend(spark):
    inputs = spark.createDataFrame([("bitcoin", "t1", "seed"), ("bitcoin", "t1", "cospend"), ("bitcoin", "t2", "stranger"), ("bitcoin", "t3", "coinbase")], "chain string, tx_hash string, address string")
    seeds = spark.createDataFrame([("bitcoin", "seed")], "chain string, address string")
    assert {r.address for r in graph.cospend_clusters(inputs, seeds).collect()} == {"seed", "cospend"}


def test_list_files(spark, tmp_path):
    countries = lookup({"panama": "PA", "iran": "IR"})
    (tmp_path / "sdn.csv").write_text('306,"OCEAN GRACE","vessel","IRAN] [NPWMD","-0-","5BXX","Crude Oil Tanker","-0-","-0-","Panama","Owner Co","Vessel Registration Identification IMO 9179414"\n36,"AERO LTD","-0-","CUBA","-0-","-0-","-0-","-0-","-0-","-0-","-0-","-0-"\n')
    (tmp_path / "alt.csv").write_text('306,1,"aka","GRACE","-0-"\n')
    out = {r.source_id: r for r in lists.read_listing_csv(spark, str(tmp_path / "sdn.csv"), str(tmp_path / "alt.csv"), countries).collect()}
    assert out["306"].programs == ["IRAN", "NPWMD"] and out["306"].aliases == ["GRACE"] and out["306"].imo == "9179414" and out["306"].vessel_flag == "PA" and out["36"].entity_type == "company" and out["36"].remarks is None
    (tmp_path / "eu.xml").write_text('<export xmlns="http://eu.europa.ec/fpi/fsd/export"><sanctionEntity euReferenceNumber="EU.1" logicalId="1"><regulation programme="UKR" publicationDate="2022-02-25"/><regulation programme="IRN" publicationDate="2020-01-02"/><subjectType code="enterprise"/>'
        '<nameAlias wholeName="Компания" strong="true" nameLanguage="RU"/><nameAlias wholeName="The Company" strong="true" nameLanguage="EN"/><identification identificationTypeCode="imo" number="1234"/><address countryIso2Code="RU"/></sanctionEntity></export>')
    eu = lists.read_listing_eu(spark, str(tmp_path / "eu.xml")).collect()[0]
    assert eu.name == "The Company" and eu.programs == ["IRN", "UKR"] and str(eu.designation_date) == "2020-01-02" and eu.country == "RU" and eu.aliases == ["Компания"]
    (tmp_path / "un.xml").write_text('<L><INDIVIDUALS><INDIVIDUAL><DATAID>1</DATAID><FIRST_NAME>Ali</FIRST_NAME><SECOND_NAME>Baba</SECOND_NAME><UN_LIST_TYPE>DPRK</UN_LIST_TYPE><REFERENCE_NUMBER>K</REFERENCE_NUMBER><LISTED_ON>2016-03-02</LISTED_ON><NATIONALITY><VALUE>Iran</VALUE></NATIONALITY></INDIVIDUAL></INDIVIDUALS>'
        '<ENTITIES><ENTITY><DATAID>2</DATAID><FIRST_NAME>Ship Co</FIRST_NAME><UN_LIST_TYPE>DPRK</UN_LIST_TYPE><COMMENTS1>IMO number 9319466</COMMENTS1><ENTITY_ALIAS><ALIAS_NAME>SC</ALIAS_NAME></ENTITY_ALIAS></ENTITY></ENTITIES></L>')
    un = {r.source_id: r for r in lists.read_listing_un(spark, str(tmp_path / "un.xml"), countries).collect()}
    assert un["1"].name == "Ali Baba" and un["1"].country == "IR" and un["2"].imo == "9319466" and un["2"].aliases == ["SC"]


def test_feeds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("<rss><channel><item><title>Tanker &lt;b&gt;seized&lt;/b&gt;</title><link>http://a/1</link><pubDate>Tue, 06 Jan 2026 10:00:00 +0200</pubDate><description>x</description></item><item><title></title><link>l</link></item></channel></rss>")
    (tmp_path / "atom.xml").write_text('<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Notice</title><link rel="alternate" href="http://a/2"/><updated>2026-01-06T08:00:00Z</updated><id>id2</id></entry></feed>')
    rss = news.read_feed(spark, str(tmp_path / "rss.xml"), "wire").select("title", "guid", F.unix_seconds("published")).collect()
    atom = news.read_feed(spark, str(tmp_path / "atom.xml"), "gov", atom=True).select("title", "link", F.unix_seconds("published")).collect()
    assert [tuple(r) for r in rss] == [("Tanker seized", "http://a/1", 1767686400)] and [tuple(r) for r in atom] == [("Notice", "http://a/2", 1767686400)]
    page = spark.createDataFrame([(1, '<a href="/recent-actions/20260105" class="x"><b>Iran-related</b>\n Designations</a>')], "page_id long, html string")
    assert [(r.title, r.guid) for r in news.load_action_page(page).collect()] == [("Iran-related Designations", "ofac:20260105:Iran-related Designations")]


def test_headline_rules(spark):
    def one(*columns):
        return list(spark.range(1).select(*columns).collect()[0])

    names = {"iran": "IR", "guinea": "GN", "equatorial guinea": "GQ", "france": "FR"}
    assert one(nw.detect_countries(F.lit("Iranian tanker near Equatorial Guinea, US says"), names))[0] == ["GQ", "IR", "GN", "US"]
    assert one(nw.classify_text(F.lit("Tanker seized off Oman")), nw.classify_text(F.lit("Minister resigns")), nw.severity_from_text(F.lit("Tanker with LNG hit near Hormuz"), F.lit("medium"))) == ["maritime_incident", "political", "critical"]
    assert one(nw.title_from_url(F.lit("https://x.com/2026/09/15/tanker-seized-off-oman-coast.html?a=1")), nw.title_from_url(F.lit("https://x.com/2026/index.html"))) == ["Tanker seized off oman coast", None]
    assert one(nw.registration_country(F.lit("EP-GOL")), nw.registration_country(F.lit("N123AB")), nw.registration_country(F.lit("VP-BXX")), nw.registration_country(F.lit("P-881"))) == ["IR", "US", None, "KP"]
    assert one(nw.extract_domains(F.lit("Website www.a.com; Email x; Website http://b.org; Website a.com.")))[0] == ["a.com", "b.org"]


def test_mentions_of_long_names(spark):
    texts = spark.createDataFrame([(1, "The tanker Ever Given Star, adrift"), (2, "ever given moon"), (3, "EVER GIVEN")], "text_id long, text string")
    known = spark.createDataFrame([("a", "EVER GIVEN STAR"), ("b", "Ever Given"), ("c", "Star")], "name_id string, name string")
    assert {(r.text_id, r.name_id) for r in n.mentions(texts, known).collect()} == {(1, "a"), (1, "b"), (2, "b"), (3, "b")}


OWN = "child long, parent long, kind string"


def company_rows(spark, ids, listed=(), places=None):
    return spark.createDataFrame([(i, f"C{i}", f"L{i}", (places or {}).get(i, "DE"), i in listed) for i in ids], "id long, name string, lei string, country string, listed boolean")


def test_owners_over_both_kinds_and_rings(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(60), rng.randrange(60), rng.choice(["direct", "ultimate"])) for _ in range(70)} | {(100, 101, "direct"), (101, 102, "ultimate"), (102, 100, "direct"), (103, 100, "ultimate")}
    above = {}
    for child, parent, _ in edges:
        above.setdefault(child, set()).add(parent)
    want = {}
    for start in above:
        seen, ring, steps = {start: 0}, [start], 0
        while ring:
            steps += 1
            ring = [p for x in ring for p in above.get(x, ()) if p not in seen and not seen.update({p: steps})]
        want.update({(start, x): n for x, n in seen.items() if x != start})
    frame = spark.createDataFrame(list(edges), OWN)
    assert {(r.company, r.owner): r.steps for r in graph.owners(frame).collect()} == want
    companies = company_rows(spark, [*range(60), 100, 101, 102, 103, 104], listed={102}, places={101: "VG"})
    chains = {r.company: r for r in graph.ownership_chains(companies, frame).collect()}
    assert len(chains) == 65 and [h.name for h in chains[103].chain_path] == ["C103", "C100", "C101", "C102"]
    assert [h.relationship for h in chains[103].chain_path] == ["subject", "ultimate_parent", "direct_parent", "ultimate_parent"]
    assert chains[103].involves_sanctioned and chains[103].secrecy and chains[104].chain_length == 1 and chains[104].owners == 0
    assert all(r.owners == sum(c == i for c, _ in want) for i, r in chains.items())


def test_a_thousand_owners_take_few_rounds(spark):
    chain = spark.range(1000).select(F.col("id").alias("child"), (F.col("id") + 1).alias("parent"), F.lit("direct").alias("kind"))
    top = graph.primary_paths(chain, max_rounds=12).where("company = 0").select(F.size("path").alias("n"), F.element_at("path", -1)["id"].alias("top")).first()
    assert (top.n, top.top) == (1000, 1000)
    found = graph.owners(chain, max_rounds=12)
    assert found.count() == 1000 * 1001 // 2 and found.where("steps <> owner - company").count() == 0


def test_needles_in_texts(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choice("abAB é.") for _ in range(rng.randrange(60)))) for i in range(80)] + [(100, None), (101, ""), (102, "x" * 300_000 + "needle")]
    needles = [(i, "".join(rng.choice("abé ") for _ in range(rng.randrange(5)))) for i in range(60)] + [(90, None), (91, "needle"), (92, "ab")]
    t, k = spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(needles, "needle_id long, needle string")
    want = {(i, j) for i, x in texts for j, y in needles if x and y and y.lower() in x.lower()}
    for budget in (10, 1_000_000):
        assert {(r.text_id, r.needle_id) for r in search.substring_join(t, k, budget).collect()} == want
    assert search.substring_join(t, k.limit(0)).count() == 0 and search.word_join(t.limit(0), k).count() == 0
    plan = search.substring_join(t, k)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    words = lambda x: re.sub(r"[^a-z0-9é]+", " ", (x or "").lower()).strip()
    want = {(i, j) for i, x in texts for j, y in needles if x and words(y) and f" {words(y)} " in f" {words(x)} "}
    assert {(r.text_id, r.needle_id) for r in search.word_join(t, k).collect()} == want


@pytest.mark.parametrize(("ratio", "mode"), [(0.88, "levenshtein"), (0.7, "levenshtein"), (0.9, "sequence")])
def test_similar_names_match_all_pairs(spark, monkeypatch, ratio, mode):
    monkeypatch.setattr(n, "HOT_SEGMENT", 3)
    rng = random.Random(6)
    base = ["".join(rng.choice("ABC D") for _ in range(rng.randrange(1, 30))).strip() for _ in range(40)]
    def edited(x):
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(x) + 1)
            x = x[:at] + rng.choice(["", "Z", "A"]) + x[at + rng.randrange(2):]
        return x
    left, right = base + [edited(x) for x in base] + [""], [edited(x) for x in base for _ in range(3)] + ["SAME"] * 3
    a, b = spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string")
    pairs = a.distinct().crossJoin(b.distinct()).where("l <> '' and r <> ''").withColumn("ratio", t.name_ratio(F.col("l"), F.col("r"), mode)).where(F.col("ratio") >= ratio - 1e-12)
    want = {(x.l, x.r): round(x.ratio, 9) for x in pairs.collect()}
    got = {(x.a, x.b): round(x.ratio, 9) for x in n.similar_names(a, b, "l", "r", ratio, mode).collect()}
    assert got == want and len(want) > 40
