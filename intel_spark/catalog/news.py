"""Registered news, monitor and fusion queries."""

from pyspark.sql import functions as F

from intel_spark.catalog.helpers import AS_OF, AS_OF_ORDERS, AS_OF_ORDERS_SQL, AS_OF_SQL, risky_sql
from intel_spark.catalog.registry import ORACLES, half_up, query, r4, ts
from intel_spark.catalog.sanctions import RATIO
from intel_spark.catalog.scalars import COUNTRY_NAMES, DETECT, HITS, KINDS, SECTORS, TOPICS, normal
from intel_spark.operators import events as v
from intel_spark.operators import fusion as f
from intel_spark.operators import monitors as m
from intel_spark.operators import names as n
from intel_spark.operators import search
from intel_spark.operators.links import key_links, signal_links

WATCHED = ", ".join(f"'{c}'" for c in v.WATCHLIST)
SLUG = "CASE CAST(id AS BIGINT) % 8 WHEN 0 THEN 'Tanker seized near hormuz by iranian forces' WHEN 1 THEN 'Missile strike hits oil refinery pipeline' WHEN 2 THEN 'Celebrity couple fights over custody' WHEN 3 THEN 'New sanctions hit russian shipping fleet' WHEN 4 THEN 'Port of odesa closed after attack' WHEN 6 THEN 'Parliament election protest in france' END"
RAISE = "CASE WHEN {h} >= 3 THEN 'critical' WHEN {h} >= 2 THEN 'high' WHEN {h} = 1 AND sev0 = 'low' THEN 'medium' ELSE sev0 END".format(h=f"({HITS})")


CONF = "least(0.95e0, 0.35e0 + 0.05e0 * least(sources, 6) + 0.003e0 * least(mentions, 100))"


@query("x07_draft_events", inputs="coded_events", oracle=f"""
    WITH a AS (SELECT *, base_code IN ('163', '172') AS sanc, root_code IN ('15', '18', '19', '20') AS conf, coalesce(country IN ({WATCHED}), false) OR coalesce(actor1_country IN ({WATCHED}), false) OR coalesce(actor2_country IN ({WATCHED}), false) AS ow FROM {{coded_events}}
      WHERE mentions >= 8 AND country IS NOT NULL AND NOT contains(url, 'prnewswire')), b AS (SELECT * FROM a WHERE (sanc OR conf OR root_code IN ('10', '11', '12', '13', '14', '16', '17')) AND (ow OR sanc OR mentions >= 16)),
    c AS (SELECT *, CASE WHEN root_code IN ('18', '19', '20') AND mentions >= 50 THEN 3 WHEN root_code IN ('18', '19', '20') OR (sanc AND mentions >= 30) OR -goldstein >= 9 THEN 2 WHEN root_code IN ('15', '17') OR sanc OR -goldstein >= 5 THEN 1 ELSE 0 END AS r0, {SLUG} AS slug FROM b),
    d AS (SELECT *, CASE WHEN ow THEN r0 ELSE greatest(0, r0 - 1) END AS r1 FROM c), e AS (SELECT *, CASE WHEN r1 >= 2 AND sources < 2 AND mentions < 20 THEN 1 ELSE r1 END AS r2, lower(slug) AS x FROM d),
    g AS (SELECT *, CASE r2 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS sev0, CASE WHEN sanc THEN 'sanctions' WHEN conf OR base_code IN ('171', '191', '192') THEN 'conflict' ELSE 'political' END AS k0, CASE WHEN slug IS NULL THEN NULL ELSE nullif({KINDS}, CASE WHEN regexp_matches(x, '\\bcoup\\b|martial law|state of emergency|election|parliament|resign|protest|arrest|detained|impeach') THEN '' ELSE 'political' END) END AS tt FROM e),
    h AS (SELECT *, coalesce(tt IN ('maritime_incident', 'port_closure', 'infrastructure', 'trade', 'sanctions'), false) AS hd FROM g), i AS (SELECT *, NOT (slug IS NOT NULL AND NOT hd AND k0 IN ('conflict', 'sanctions') AND NOT coalesce(tt IN ('conflict', 'sanctions'), false)) AS corr FROM h)
    SELECT id AS source_id, CASE WHEN hd THEN tt ELSE k0 END AS event_type, CASE WHEN NOT corr THEN 'low' WHEN slug IS NOT NULL THEN {RAISE} ELSE sev0 END AS severity,
    {r4("CASE WHEN corr THEN " + half_up(CONF, 2) + " ELSE " + half_up(CONF + " * 0.6e0", 2) + " END", "confidence")} FROM i WHERE corr OR mentions >= 16""")
def _(coded):
    return v.draft_events(coded, COUNTRY_NAMES).select("source_id", "event_type", "severity", "confidence")


@query("x09_draft_articles", inputs="slugs", oracle=f"""
    WITH w AS (SELECT id, slug, lower(slug) AS x, id % 3 = 0 AS st FROM {{slugs}}), k AS (SELECT *, {SECTORS} AS sectors, {KINDS} AS kd FROM w), t AS (SELECT *, CASE WHEN kd IN ('sanctions', 'maritime_incident', 'port_closure', 'infrastructure') THEN 'medium' ELSE 'low' END AS sev0, regexp_matches(x, 'election|parliament|protest') OR kd <> 'political' AS typed FROM k)
    SELECT id, kd AS event_type, sectors, {RAISE} AS severity, st AS state_media FROM t WHERE NOT st OR typed OR sectors <> ''""")
def _(slugs):
    articles = slugs.select("id", F.col("slug").alias("title"), F.concat(F.lit("http://a/"), F.col("id").cast("string")).alias("url"), F.lit(AS_OF).alias("ts"), F.when(F.col("id") % 3 == 0, "tass").otherwise("wire").alias("source"), F.lit(None).cast("string").alias("topic"))
    out = v.draft_articles(articles, COUNTRY_NAMES, ["tass"])
    return out.select(F.substring_index("url", "/", -1).cast("long").alias("id"), "event_type", "sectors", "severity", (F.col("source") == "tass").alias("state_media"))


REL = """least(1.0, CASE WHEN list_contains(e.sectors, s.sector) THEN CASE WHEN s.kind IN ('evasion_event', 'transshipment') THEN 0.3 ELSE 0.45 END ELSE 0 END + CASE WHEN list_has_any(e.countries, s.countries) THEN 0.35 ELSE 0 END + CASE WHEN e.event_type = 'sanctions' AND s.kind IN ('sanctions_breach', 'sanctions_update') THEN 0.4 ELSE 0 END
    + CASE WHEN e.event_type IN ('maritime_incident', 'port_closure') AND s.kind IN ('evasion_event', 'transshipment', 'sanctions_breach') THEN 0.3 ELSE 0 END)"""
LINKS = f"""p AS (SELECT e.id AS event_id, s.kind, s.id, s.ts AS sts, e.ts AS ets, CAST({REL} AS DOUBLE) AS r, abs(epoch_us(s.ts) - epoch_us(e.ts)) / 3.6e9 AS h FROM {{geo_events}} e JOIN {{geo_signals}} s ON s.ts BETWEEN e.ts - INTERVAL 24 HOUR AND e.ts + INTERVAL 24 HOUR),
    q AS (SELECT *, round(0.7e0 * r + 0.3e0 * (1 - h / 24), 3) AS score FROM p WHERE r > 0 AND h < 24), k AS (SELECT * FROM q WHERE score >= 0.55 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY score DESC, h, kind, id) <= 40)"""


@query("j16_x08_correlate_events", inputs="geo_events geo_signals", oracle=f"""
    WITH {LINKS} SELECT event_id, kind AS alert_type, id AS alert_id, {r4('score')}, CASE WHEN h * 60 < 16 THEN 'simultaneous' WHEN sts > ets THEN 'after' ELSE 'before' END AS direction FROM k""")
def _(events, signals):
    return v.correlate_events(events, signals).select("event_id", "alert_type", "alert_id", "score", "direction")


@query("x08_mark_correlated", inputs="geo_events geo_signals", oracle=f"""
    WITH {LINKS}, fl AS (SELECT event_id, bool_or(kind = 'market_alert') AS wm, bool_or(kind IN ('sanctions_breach', 'evasion_event', 'transshipment')) AS wt FROM k GROUP BY 1) SELECT e.id, coalesce(wm, false) AS with_market, coalesce(wt, false) AS with_maritime FROM {{geo_events}} e LEFT JOIN fl ON fl.event_id = e.id""")
def _(events, signals):
    return v.mark_correlated(events, v.correlate_events(events, signals)).select("id", "with_market", "with_maritime")


@query("g13_geo_summary", inputs="geo_events", oracle=f"""
    WITH r AS (SELECT * FROM {{geo_events}} WHERE ts >= {AS_OF_SQL} - INTERVAL 240 HOUR) SELECT 'event_type' AS metric, event_type AS key, count(*) AS value FROM r GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM r GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'country', country, count(*) FROM r WHERE country IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def _(events):
    return v.geo_summary(events, AS_OF, 240)


@query("g14_country_timeline", inputs="geo_events", oracle="""
    WITH r AS (SELECT * FROM {geo_events} WHERE (country = 'UA' OR country_secondary = 'UA' OR list_contains(countries, 'UA')) AND ts >= TIMESTAMP '2024-01-01'), t AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, max(CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END) AS rk FROM r GROUP BY 1, 2)
    SELECT CAST(day AS VARCHAR) AS day, CAST(sum(n) AS BIGINT) AS total, string_agg(concat(event_type, '=', CAST(n AS VARCHAR)), ',' ORDER BY event_type) AS by_type, ['low', 'medium', 'high', 'critical'][max(rk) + 1] AS max_severity FROM t GROUP BY 1""")
def _(events):
    out = v.country_timeline(events, "UA", AS_OF, 30)
    return out.select("day", "total", F.transform(F.map_entries("by_type"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))).alias("by_type"), "max_severity")


@query("q32_news_source_health", inputs="geo_events", oracle=f"SELECT source, CAST(sum(mentions) AS BIGINT) AS items_total, max_by(severity, ts) AS last_status, max_by(id, ts) AS last_latency_ms, {ts('max(ts)', 'last_fetch')} FROM {{geo_events}} GROUP BY 1")
def _(events):
    return v.news_source_health(events.select("source", F.col("mentions").alias("items"), F.col("severity").alias("status"), F.col("id").alias("latency_ms"), "ts"))


COMPANY = f"""vc AS (SELECT DISTINCT victim, country, regexp_replace({normal('victim')}, ' LTD$', '') AS core FROM {{posts}}), cc AS (SELECT id, country, entity_id, CASE WHEN name LIKE '%GMBH' THEN regexp_replace({normal('name')}, ' GMBH$', '') ELSE regexp_replace({normal('name')}, '( LTD| TRADING S A)$', '') END AS cco FROM {{companies}}),
    pr AS (SELECT DISTINCT core, cco, round({RATIO.format(a='core', b='cco')}, 3) AS score FROM (SELECT DISTINCT core FROM vc WHERE length(core) >= 5), (SELECT DISTINCT cco FROM cc) WHERE {RATIO.format(a='core', b='cco')} >= 0.9195),
    bm AS (SELECT core, max_by((cc.id, cc.country, entity_id), (score, -cc.id)) AS b, max(score) AS sc FROM pr JOIN cc USING (cco) WHERE score >= 0.92 GROUP BY 1)"""


@query("j06_match_companies", inputs="posts companies", oracle=f"WITH {COMPANY} SELECT victim AS name, country, b[1] AS company_id, {r4('sc', 'score')}, CASE WHEN b IS NULL THEN 'none' ELSE 'strong' END AS strength FROM vc LEFT JOIN bm USING (core)")
def _(posts, companies):
    names = posts.select(F.col("victim").alias("name"), "country").distinct().withColumn("name_id", F.concat_ws("|", "name", F.coalesce("country", F.lit("-"))))
    out = n.match_companies(names, companies)
    return out.join(names.select("name_id", "country"), "name_id").select("name", "country", "company_id", "score", "strength")


@query("x15_breach_relevance", inputs="posts companies", oracle=f"""
    WITH {COMPANY}, j AS (SELECT p.*, b IS NOT NULL AS strong, b[3] IS NOT NULL AND b IS NOT NULL AS ent, lower(concat_ws(' ', p.victim, p.domain, coalesce(p.sector, ''))) AS tx FROM {{posts}} p JOIN vc ON vc.victim = p.victim AND vc.country IS NOT DISTINCT FROM p.country LEFT JOIN bm USING (core)),
    k AS (SELECT *, regexp_matches(tx, 'energy|oil|gas|petrol|utilit|power|nuclear|pipeline|maritime|shipping|port|logistic|vessel|marine|transport|bank|financ|insur|payment|exchange|crypto|government|ministry|public|defense|defence|military|municipal|telecom|network|internet|health|hospital|pharma|medical') AS sec, contains(tx, 'plain') AS kw FROM j),
    s AS (SELECT *, CASE WHEN ent THEN 0.95e0 WHEN strong THEN 0.85e0 ELSE 0.2e0 END AS s0 FROM k), s1 AS (SELECT *, CASE WHEN NOT sec THEN s0 WHEN strong THEN least(1, s0 + 0.05e0) ELSE 0.6e0 END AS v1 FROM s), s2 AS (SELECT *, CASE WHEN kw AND NOT strong THEN greatest(v1, 0.7e0) ELSE v1 END AS v2 FROM s1),
    s3 AS (SELECT *, CASE WHEN country = 'RU' THEN least(1, v2 + 0.1e0) ELSE v2 END AS v3 FROM s2), s4 AS (SELECT *, round(CASE WHEN records >= 10000000 THEN least(1, v3 + 0.1e0) ELSE v3 END, 2) AS score FROM s3)
    SELECT post_id, CASE WHEN ent THEN 'sanctioned_party' WHEN strong THEN 'tracked_company' WHEN kw THEN 'watch_keyword' WHEN sec THEN 'critical_sector' ELSE 'general' END AS relevance, {r4('score')}, CASE WHEN score >= 0.9 THEN 'critical' WHEN score >= 0.7 THEN 'high' ELSE 'medium' END AS severity FROM s4 WHERE score >= 0.5""")
def _(posts, companies):
    return m.breach_relevance(posts, companies, ["plain"]).select("post_id", "relevance", "score", "severity")


STORY = f"""w AS (SELECT item_id, outlet, ts, list_distinct({TOPICS.replace('text', 'title')}) AS toks FROM {{headlines}}), x AS (SELECT item_id, unnest(toks) AS t FROM w), dt AS (SELECT t FROM x GROUP BY 1 HAVING count(*) BETWEEN 2 AND greatest(3, (SELECT count(*) // 3 FROM w))),
    kp AS (SELECT item_id, t FROM x JOIN dt USING (t)), u AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM kp a JOIN kp b ON a.t = b.t AND a.item_id <> b.item_id GROUP BY 1, 2 HAVING count(*) >= 2), r AS (SELECT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node),
    pt AS (SELECT node AS item_id, min(root) AS story FROM r GROUP BY 1)"""


@query("x16_narratives", inputs="headlines", oracle=f"""
    WITH RECURSIVE {STORY} SELECT story, count(*) AS items, count(DISTINCT outlet) AS outlet_count, {ts('min(ts)', 'first_seen')}, {ts('max(ts)', 'last_seen')} FROM pt JOIN w USING (item_id) GROUP BY 1 HAVING count(*) >= 3""")
def _(headlines):
    return m.narratives(headlines.withColumn("countries", F.array("lang"))).select("story", "items", "outlet_count", "first_seen", "last_seen")


@query("x17_divergence", inputs="headlines texts", oracle=f"""
    WITH RECURSIVE {STORY}, ft AS (SELECT story, count(*) AS items, count(DISTINCT outlet) AS oc FROM pt JOIN w USING (item_id) GROUP BY 1 HAVING count(*) >= 3), kw AS (SELECT story, t FROM (SELECT story, t, count(*) AS n FROM pt JOIN kp USING (item_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY story ORDER BY n DESC, t) <= 4),
    ot AS (SELECT doc_id, unnest(list_distinct({TOPICS})) AS t FROM {{texts}}), mt AS (SELECT story, doc_id FROM ot JOIN kw USING (t) GROUP BY 1, 2 HAVING count(*) >= 2), om AS (SELECT ft.*, (SELECT count(*) FROM mt WHERE mt.story = ft.story) AS other FROM ft),
    z AS (SELECT *, least(1e0, 0.3e0 + 0.15e0 * oc + 0.05e0 * items) AS b FROM om)
    SELECT story, other AS other_matches, CASE WHEN other = 0 THEN 'state_only' WHEN items >= 2 * other THEN 'amplified' ELSE 'mirrored' END AS divergence, {r4("round(CASE WHEN other = 0 THEN least(1e0, b + 0.2e0) WHEN items >= 2 * other THEN least(1e0, b + 0.1e0) ELSE greatest(0.2e0, b - 0.2e0) END, 2)", "score")} FROM z""")
def _(headlines, texts):
    stories = m.narratives(headlines.withColumn("countries", F.array("lang")))
    return m.divergence(stories, texts.select(F.col("doc_id").alias("item_id"), F.col("text").alias("title"))).select("story", "other_matches", "divergence", "score")


@query("x18_domain_risk", inputs="domains", oracle=f"""
    SELECT id, {r4("round(least(1.0e0, CASE WHEN entity_linked THEN 0.3e0 ELSE 0.1e0 END + CASE WHEN is_live THEN 0.25e0 ELSE 0 END + CASE WHEN hosting_country IN ('RU', 'VG') THEN 0.15e0 ELSE 0 END + CASE WHEN hosting_country IN ('US', 'NL') AND entity_linked THEN 0.2e0 ELSE 0 END + CASE WHEN certificate_count >= 20 THEN 0.1e0 ELSE 0 END), 2)", "risk_score")},
    CAST(is_live IS NOT NULL AS INT) + CAST(coalesce(hosting_country IN ('RU', 'VG'), false) AS INT) + CAST(coalesce(hosting_country IN ('US', 'NL') AND entity_linked, false) AS INT) + CAST(certificate_count >= 20 AS INT) + CAST(list_contains(nameservers, 'ns1.cloudflare.com') AS INT) + CAST(registrar IS NOT NULL AS INT) AS findings FROM {{domains}}""")
def _(domains):
    return m.domain_risk(domains).select("id", "risk_score", F.size("findings").alias("findings"))


@query("w24_reactivated", inputs="domain_checks", oracle=f"""
    WITH l AS (SELECT *, lag(is_live) OVER (PARTITION BY domain ORDER BY ts) AS was FROM {{domain_checks}}) SELECT domain, {ts('ts')}, coalesce(NOT was AND is_live, false) AS reactivated, {r4("CASE WHEN NOT was AND is_live THEN least(1.0, risk_score + 0.2) ELSE risk_score END", "risk_score")} FROM l""")
def _(checks):
    return m.reactivated(checks).select("domain", "ts", "reactivated", "risk_score")


@query("j20_x19_psc_relevance", inputs="psc vessels port_calls", oracle=f"""
    WITH h AS (SELECT imo, min_by(id, id) AS vid, min_by(ship_type, id) AS vt, min_by(sanctioned_status, id) AS sanctioned_status, min_by(risk_score, id) AS risk_score FROM {{vessels}} WHERE imo IS NOT NULL GROUP BY 1), r AS (SELECT DISTINCT vessel_id FROM {{port_calls}} WHERE is_sanctioned AND vessel_id % 3 = 0),
    j AS (SELECT p.*, vid, contains(lower(p.ship_type), 'tank') OR coalesce(contains(lower(vt), 'tank'), false) AS tk, vid IS NOT NULL AND ({risky_sql('h.')} OR r.vessel_id IS NOT NULL) AS fl FROM {{psc}} p LEFT JOIN h ON h.imo = p.imo LEFT JOIN r ON r.vessel_id = vid)
    SELECT id, vid AS vessel_id, fl AS vessel_flagged, {r4("round(least(1.0, 0.3 + CASE WHEN event_type = 'ban' THEN 0.2 ELSE 0 END + CASE WHEN tk THEN 0.15 ELSE 0 END + CASE WHEN vid IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN fl THEN 0.4 ELSE 0 END), 2)", "relevance_score")} FROM j""")
def _(psc, vessels, calls):
    ships = calls.select("vessel_id", (F.col("is_sanctioned") & (F.col("vessel_id") % 3 == 0)).alias("sanctioned_route"))
    return m.psc_relevance(psc, vessels, ships).select("id", "vessel_id", "vessel_flagged", "relevance_score")


@query("w22_flights", inputs="sightings", oracle=f"""
    WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY registration ORDER BY ts, id) AS k FROM {{sightings}}), w AS (SELECT id, registration, k, true AS kept, ts AS lt, source AS ls FROM o WHERE k = 1
      UNION ALL SELECT o.id, o.registration, o.k, epoch_us(o.ts) - epoch_us(w.lt) >= 21600000000 OR o.source <> w.ls, CASE WHEN epoch_us(o.ts) - epoch_us(w.lt) >= 21600000000 OR o.source <> w.ls THEN o.ts ELSE w.lt END, CASE WHEN epoch_us(o.ts) - epoch_us(w.lt) >= 21600000000 OR o.source <> w.ls THEN o.source ELSE w.ls END
      FROM w JOIN o ON o.registration = w.registration AND o.k = w.k + 1),
    k AS (SELECT o.*, concat(o.registration, ':', strftime(o.ts, '%Y%m%d'), ':', coalesce(callsign, '-')) AS flight_key FROM w JOIN o USING (id) WHERE kept)
    SELECT id, flight_key, coalesce(lag(flight_key) OVER (PARTITION BY registration ORDER BY ts, id) <> flight_key, true) AS new_flight FROM k""")
def _(sightings):
    return m.flights(sightings, 21_600).select("id", "flight_key", "new_flight")


@query("j24_aircraft_assets", inputs="listings", oracle="SELECT concat('EP-', CAST(id AS STRING)) AS registration, regexp_extract(remarks, 'Aircraft Model ([^;]+)', 1) AS model, 'IR' AS country, id AS entity_id FROM {listings} WHERE entity_type = 'person'")
def _(listings):
    aircraft = listings.where("entity_type = 'person'").withColumn("entity_type", F.lit("aircraft"))
    return m.aircraft_assets(aircraft).select("registration", "model", "country", "entity_id")


@query("j24_new_domains", inputs="listings domains", oracle="""
    WITH d AS (SELECT concat('site', CAST(id % 300 AS STRING), '.example.com') AS domain, min(id) AS entity_id FROM {listings} WHERE is_active GROUP BY 1) SELECT domain, entity_id FROM d WHERE domain NOT IN (SELECT concat('site', substr(domain, 2)) FROM {domains} WHERE id % 2 = 0)""")
def _(listings, domains):
    tracked = domains.where("id % 2 = 0").select(F.concat(F.lit("site"), F.substring("domain", 2, 100)).alias("domain"))
    return m.new_assets(m.domain_assets(listings), tracked, "domain")[0].select("domain", "entity_id")


@query("x24_docket_candidates", inputs="listings", oracle=f"""
    SELECT id, {ts('designation_date')} FROM {{listings}} WHERE is_active AND entity_type = 'company' AND authority = 'OFAC' AND (list_contains(programs, 'PROG1') OR list_contains(programs, 'LIST2')) ORDER BY designation_date DESC, id LIMIT 40""")
def _(listings):
    return m.docket_candidates(listings, ["PROG1", "LIST2"], 40).select("id", "designation_date")


@query("x25_due_queue", inputs="port_calls", oracle="SELECT id FROM {port_calls} ORDER BY is_sanctioned DESC, departure ASC NULLS FIRST, id LIMIT 300")
def _(calls):
    return m.due_queue(calls, "departure", 300, [F.col("is_sanctioned").desc()]).select("id")


EVERY_DAY = 12_000  # back to before the oldest table


@query("g17_monitor_summaries", inputs="sightings psc domains posts headlines texts evasion", oracle=f"""
    SELECT 'aviation' AS monitor, 'sightings' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM {{sightings}} UNION ALL SELECT * FROM (SELECT 'aviation', 'by_aircraft', registration, count(*) FROM {{sightings}} GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 8) UNION ALL SELECT 'psc', 'by_type', event_type, count(*) FROM {{psc}} GROUP BY 3
    UNION ALL SELECT 'psc', 'by_source', source, count(*) FROM {{psc}} GROUP BY 3 UNION ALL SELECT 'psc', 'flagged', '', count(*) FROM {{psc}} WHERE id % 2 = 0
    UNION ALL SELECT * FROM (SELECT 'domains', 'by_country', hosting_country, count(*) FROM {{domains}} WHERE hosting_country IS NOT NULL GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 10) UNION ALL SELECT 'domains', 'live', '', count(*) FROM {{domains}} WHERE is_live
    UNION ALL SELECT 'breaches', 'by_relevance', coalesce(sector, 'general'), count(*) FROM {{posts}} GROUP BY 3 UNION ALL SELECT * FROM (SELECT 'breaches', 'by_country', country, count(*) FROM {{posts}} WHERE country IS NOT NULL GROUP BY 3 ORDER BY 4 DESC, 3 LIMIT 8)
    UNION ALL SELECT 'legal', 'by_source', CASE WHEN post_id % 3 = 0 THEN 'doj' ELSE 'courtlistener' END, count(*) FROM {{posts}} GROUP BY 3 UNION ALL SELECT 'legal', 'penalties_usd', '', round(sum(CAST(records AS DOUBLE))) FROM {{posts}} UNION ALL SELECT 'watchlist', 'by_severity', severity, count(*) FROM {{evasion}} GROUP BY 3
    UNION ALL SELECT 'narratives', 'by_divergence', divergence, count(*) FROM ({ORACLES['x17_divergence']}) GROUP BY 3
    UNION ALL SELECT 'narratives', 'outlet_items', outlet, count(*) FROM (WITH RECURSIVE {STORY} SELECT w.outlet FROM pt JOIN w USING (item_id) WHERE story IN (SELECT story FROM pt GROUP BY 1 HAVING count(*) >= 3)) GROUP BY 3""")
def _(sightings, psc, domains, posts, headlines, texts, evasion):
    stories = m.divergence(m.narratives(headlines.withColumn("countries", F.array("lang"))), texts.select(F.col("doc_id").alias("item_id"), F.col("text").alias("title")))
    legal = posts.select("ts", F.when(F.col("post_id") % 3 == 0, "doj").otherwise("courtlistener").alias("source"), F.col("records").cast("double").alias("penalty_usd"))
    tables = {
        "sightings": sightings, "psc": psc.withColumn("vessel_flagged", F.col("id") % 2 == 0), "domains": domains, "posts": posts.withColumn("relevance", F.coalesce("sector", F.lit("general"))),
        "legal": legal, "hits": evasion.select("ts", "severity"), "narratives": stories,
    }
    return m.monitor_summaries(tables, AS_OF, EVERY_DAY)


@query("j23_mentions", inputs="texts word_pairs", oracle="""
    WITH w AS (SELECT doc_id, concat(' ', trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ') AS x FROM {texts}) SELECT DISTINCT doc_id AS text_id, name_id FROM w JOIN {word_pairs} p ON contains(x, concat(' ', p.name, ' '))""")
def _(texts, pairs):
    return n.mentions(texts.select(F.col("doc_id").alias("text_id"), "text"), pairs).select("text_id", "name_id")


@query("f32_facility_mentions", inputs="texts facility_words", oracle="""
    WITH w AS (SELECT doc_id, concat(' ', trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ') AS x FROM {texts}) SELECT DISTINCT doc_id AS text_id, name_id, concat('site of ', name) AS facility FROM w JOIN {facility_words} p ON contains(x, concat(' ', p.name, ' '))""")
def _(texts, words):
    found = n.mentions(texts.select(F.col("doc_id").alias("text_id"), "text"), words, min_length=5)
    return found.select("text_id", "name_id", F.concat(F.lit("site of "), "name").alias("facility"))


def keyed(signals):
    keys = f.keys_of(("entity", F.col("k_entity")), ("country", F.col("k_country")), ("sector", F.col("k_sector")))
    return signals.select("type", "id", F.concat_ws(":", "type", F.col("id").cast("string")).alias("ref"), "domain", "ts", "severity", keys.alias("keys"), "summary")


KEYS = """sg AS (SELECT *, concat(type, ':', CAST(id AS STRING)) AS ref FROM {signals}), ky AS (SELECT ref, domain, ts, 'entity' AS kind, k_entity AS val FROM sg UNION ALL SELECT ref, domain, ts, 'country', k_country FROM sg UNION ALL SELECT ref, domain, ts, 'sector', k_sector FROM sg),
    cp AS (SELECT a.ref AS ar, b.ref AS br, a.domain AS ad, b.domain AS bd, a.ts AS ats, b.ts AS bts, a.k_entity = b.k_entity AS se, a.k_country = b.k_country AS sc, a.k_sector = b.k_sector AS ss, a.k_entity AS ke, a.k_country AS kc, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9 AS h
      FROM sg a JOIN sg b ON a.k_entity = b.k_entity AND a.ref < b.ref AND a.domain <> b.domain UNION ALL
      SELECT a.ref, b.ref, a.domain, b.domain, a.ts, b.ts, false, true, a.k_sector = b.k_sector, a.k_entity, a.k_country, abs(epoch_us(a.ts) - epoch_us(b.ts)) / 3.6e9 FROM sg a JOIN sg b ON a.k_country = b.k_country AND a.k_entity <> b.k_entity AND a.ref < b.ref AND a.domain <> b.domain),
    sr AS (SELECT *, least(1.0e0, CASE WHEN se THEN 0.8e0 ELSE 0 END + CASE WHEN sc THEN 0.35e0 * 0.8e0 ELSE 0 END + CASE WHEN ss THEN 0.25e0 * 0.8e0 ELSE 0 END) AS raw, CASE WHEN se THEN 240 ELSE 60 END AS win FROM cp), pz AS (SELECT *, raw * (1 - 0.5e0 * (h / win)) AS exact FROM sr WHERE h <= win), pp AS (SELECT *, round(exact, 3) AS score FROM pz WHERE round(exact, 3) >= 0.3)"""
RULES = f.Rules(240, 0.3, 60)


@query("j17_key_pairs", inputs="signals", oracle="""
    WITH sg AS (SELECT *, concat(type, ':', CAST(id AS STRING)) AS ref FROM {signals}), ky AS (SELECT ref, domain, ts, 'entity' AS kind, k_entity AS value FROM sg UNION ALL SELECT ref, domain, ts, 'country', k_country FROM sg UNION ALL SELECT ref, domain, ts, 'sector', k_sector FROM sg),
    m AS (SELECT a.kind, a.value, a.ref, count(*) AS n, min({'t': b.ts, 'r': b.ref}) FILTER (b.ts > a.ts OR (b.ts = a.ts AND b.ref > a.ref)) AS nx FROM ky a JOIN ky b ON a.kind = b.kind AND a.value = b.value AND a.domain <> b.domain AND b.ts BETWEEN a.ts - INTERVAL 240 HOUR AND a.ts + INTERVAL 240 HOUR GROUP BY 1, 2, 3)
    SELECT ky.kind, ky.value, ky.ref, ky.domain, coalesce(n, 0) AS partners, nx.r AS next_ref, row_number() OVER (PARTITION BY ky.kind, ky.value ORDER BY ky.ts, ky.ref) AS number,
      1 + count(*) OVER (PARTITION BY ky.kind, ky.value) - count(*) OVER (PARTITION BY ky.kind, ky.value ORDER BY ky.ts RANGE BETWEEN INTERVAL 240 HOUR PRECEDING AND UNBOUNDED FOLLOWING) AS first,
      count(*) OVER (PARTITION BY ky.kind, ky.value ORDER BY ky.ts RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 240 HOUR FOLLOWING) AS last FROM ky LEFT JOIN m USING (kind, value, ref)""")
def _(signals):
    return key_links(keyed(signals), 240).select("kind", "value", "ref", "domain", "partners", "next_ref", "number", "first", "last")


@query("x21_score_pairs", inputs="signals", oracle=f"WITH {KEYS} SELECT ar AS a_ref, br AS b_ref, {r4('score')}, se AS strong, CASE WHEN se THEN 'entity' WHEN sc THEN 'geographic' ELSE 'topical' END AS link_type FROM pp")
def _(signals):
    return f.score_pairs(keyed(signals), RULES).select("a_ref", "b_ref", "score", "strong", "link_type")


@query("x21_signal_links", inputs="signals", oracle=f"""
    WITH {KEYS}, e AS (SELECT ar AS ref, bd AS other, se, exact FROM pp UNION ALL SELECT br, ad, se, exact FROM pp) SELECT ref, count(*) AS links, count(*) FILTER (se) AS strong_links, {r4('round(coalesce(sum(exact) FILTER (se), 0), 4)', 'strong_score')} FROM e GROUP BY 1""")
def _(signals):
    return signal_links(keyed(signals), RULES).select("ref", "links", "strong_links", F.round("strong_score", 4).alias("strong_score"))


@query("x21_links_by_domain", inputs="signals", oracle=f"""
    WITH {KEYS} SELECT ref, other, count(*) AS links FROM (SELECT ar AS ref, bd AS other FROM pp UNION ALL SELECT br, ad FROM pp) GROUP BY 1, 2""")
def _(signals):
    return signal_links(keyed(signals), RULES, apart=True).select("ref", "other", "links")


# the key sets whose ties join everything: the entity alone, and country with sector
TIED = """gs AS (SELECT ref, domain, ts, concat('e', k_entity) AS g, 240 AS lim FROM sg UNION ALL SELECT ref, domain, ts, concat('c', k_country, '|', k_sector), 45 FROM sg),
    td AS (SELECT a.ref, a.lim, a.ts, unnest([max({'t': b.ts, 'r': b.ref}) FILTER (b.ts < a.ts OR (b.ts = a.ts AND b.ref < a.ref)), min({'t': b.ts, 'r': b.ref}) FILTER (b.ts > a.ts OR (b.ts = a.ts AND b.ref > a.ref))]) AS o FROM gs a JOIN gs b ON a.g = b.g AND a.domain <> b.domain GROUP BY a.ref, a.g, a.lim, a.ts),
    rp AS (SELECT pp.* FROM pp JOIN (SELECT DISTINCT least(ref, o.r) AS ar, greatest(ref, o.r) AS br FROM td WHERE o IS NOT NULL AND abs(epoch_us(ts) - epoch_us(o.t)) <= lim * 3600000000) USING (ar, br))"""


@query("x21_representative_pairs", inputs="signals", oracle=f"WITH {KEYS}, {TIED} SELECT ar AS a_ref, br AS b_ref, {r4('score')}, se AS strong, CASE WHEN se THEN 'entity' WHEN sc THEN 'geographic' ELSE 'topical' END AS link_type FROM rp")
def _(signals):
    return f.representative_pairs(keyed(signals), RULES).select("a_ref", "b_ref", "score", "strong", "link_type")


CLUSTERS = """st AS (SELECT * FROM pp WHERE se), un AS (SELECT ar AS a, br AS b FROM st UNION SELECT br, ar FROM st), rr AS (SELECT a AS node, a AS root FROM un UNION SELECT un.b, rr.root FROM rr JOIN un ON un.a = rr.node), cl AS (SELECT node, min(root) AS cluster FROM rr GROUP BY 1),
    me AS (SELECT cluster, sg.*, CASE severity WHEN 'low' THEN 0 WHEN 'medium' THEN 1 WHEN 'high' THEN 2 ELSE 3 END AS rk FROM cl JOIN sg ON sg.ref = node), fa AS (SELECT cluster, count(DISTINCT domain) AS nd, string_agg(DISTINCT domain, ',' ORDER BY domain) AS domains, min(ts) AS ws, max(ts) AS we, count(*) AS members, max(rk) AS rk FROM me GROUP BY 1 HAVING count(DISTINCT domain) >= 3),
    ms AS (SELECT cluster, avg(exact) AS mean, count(*) AS pairs, mode(ke) AS ke FROM st JOIN cl ON node = ar GROUP BY 1),
    sk AS (SELECT cluster, string_agg(concat(kind, ':', val), ',' ORDER BY n DESC, concat(kind, ':', val)) AS shared_keys FROM (SELECT cluster, kind, val, count(*) AS n, row_number() OVER (PARTITION BY cluster ORDER BY kind = 'sector', count(*) DESC, concat(kind, ':', val)) AS k FROM
      (SELECT cluster, 'entity' AS kind, ke AS val FROM st JOIN cl ON node = ar UNION ALL SELECT cluster, 'country', kc FROM st JOIN cl ON node = ar WHERE sc UNION ALL SELECT cluster, 'sector', sg.k_sector FROM st JOIN cl ON node = ar JOIN sg ON sg.ref = ar WHERE ss) GROUP BY 1, 2, 3) WHERE k <= 8 AND kind <> 'sector' GROUP BY 1)"""


@query("x22_composite_alerts", inputs="signals", oracle=f"""
    WITH RECURSIVE {KEYS}, {CLUSTERS} SELECT concat('entity:', ke) AS anchor, domains, {ts('ws', 'window_start')}, {ts('we', 'window_end')}, members, pairs, {r4('round(least(1.0, mean * (1 + 0.1 * (nd - 3))), 3)', 'confidence')}, ['low', 'medium', 'high', 'critical'][CASE WHEN nd >= 4 AND rk < 3 THEN rk + 2 ELSE rk + 1 END] AS severity,
    substr(sha1(concat('entity:', ke, '|', strftime(ws, '%Y-%m-%d'))), 1, 40) AS fingerprint, shared_keys FROM fa JOIN ms USING (cluster) JOIN sk USING (cluster)""")
def _(signals):
    return f.composite_alerts(keyed(signals), RULES).select("anchor", "domains", "window_start", "window_end", "members", "pairs", "confidence", "severity", "fingerprint", "shared_keys")


@query("x22_alert_signals", inputs="signals", oracle=f"""
    WITH RECURSIVE {KEYS}, {CLUSTERS}, ls AS (SELECT cluster, type, id, severity, domain, row_number() OVER (PARTITION BY cluster ORDER BY rk DESC, ts, ref) AS k FROM me) SELECT concat('entity:', ke) AS anchor, type, id, severity, domain FROM ls JOIN fa USING (cluster) JOIN ms USING (cluster) WHERE k <= 25""")
def _(signals):
    found = f.composite_alerts(keyed(signals), RULES).select("anchor", F.explode("signals").alias("s"))
    return found.select("anchor", "s.type", "s.id", "s.severity", "s.domain")


@query("g18_fusion_timeline", inputs="signals", oracle=f"""
    SELECT {ts("time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')", "time")}, count(*) FILTER (domain = 'maritime') AS maritime, count(*) FILTER (domain = 'market') AS market, count(*) FILTER (domain = 'legal') AS legal FROM {{signals}} WHERE ts >= {AS_OF_SQL} - INTERVAL 480 HOUR GROUP BY time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')""")
def _(signals):
    return f.fusion_timeline(keyed(signals), AS_OF, 480, 6).select("time", "maritime", "market", "legal")


@query("g19_fusion_queue", inputs="signals", oracle=f"""
    WITH {KEYS}, lk AS (SELECT ref, count(*) AS k FROM (SELECT ar AS ref FROM pp UNION ALL SELECT br FROM pp) GROUP BY 1) SELECT sg.ref, severity, coalesce(k, 0) AS correlations FROM sg LEFT JOIN lk USING (ref) WHERE severity IN ('high', 'critical')
    ORDER BY CASE severity WHEN 'high' THEN 1 ELSE 0 END, coalesce(k, 0) DESC, ts DESC, sg.ref LIMIT 200""")
def _(signals):
    s = keyed(signals)
    return f.fusion_queue(s, signal_links(s, RULES), "high").select("ref", "severity", "correlations")


@query("x20_collect_signals", inputs="vessels breaches evasion sts port_calls list_updates geo_events", oracle="""
    SELECT 'sanctions_breach' AS type, count(*) AS signals, sum(CASE WHEN v.id IS NOT NULL THEN 6 ELSE 3 END) AS keys FROM {breaches} b LEFT JOIN {vessels} v ON v.id = b.vessel_id WHERE b.status <> 'cleared' UNION ALL SELECT 'evasion_event', count(*), sum(3 + CAST(event_type = 'spoofing_cluster' AS INT)) FROM {evasion}
    UNION ALL SELECT 'transshipment', count(*), sum(2 + CASE WHEN a.id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN b.id IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN a.flag IS NOT NULL AND b.flag IS NOT NULL AND a.flag <> b.flag THEN 2 WHEN a.flag IS NOT NULL OR b.flag IS NOT NULL THEN 1 ELSE 0 END) FROM {sts} s LEFT JOIN {vessels} a ON a.id = s.vessel_a LEFT JOIN {vessels} b ON b.id = s.vessel_b
    UNION ALL SELECT 'port_call', count(*), count(*) * 6 FROM {port_calls} c JOIN {vessels} v ON v.id = c.vessel_id WHERE is_sanctioned UNION ALL SELECT 'sanctions_update', count(*), count(*) * 3 FROM {list_updates} WHERE update_type IN ('new_designation', 'relisted')
    UNION ALL SELECT 'geopolitical_event', count(*), sum(len(list_distinct(list_filter(list_concat(countries, [country, country_secondary]), lambda c: c IS NOT NULL))) + len(sectors) + CAST(event_type IN ('sanctions', 'maritime_incident', 'port_closure') AS INT)) FROM {geo_events} WHERE severity <> 'low'""")
def _(vessels, breaches, evasion, sts, calls, updates, events):
    from datetime import datetime, timezone
    tables = {"vessels": vessels, "breaches": breaches, "evasion": evasion, "sts": sts, "port_calls": calls, "list_updates": updates, "geo_events": events}
    found = f.collect_signals(tables, datetime(1990, 1, 1, tzinfo=timezone.utc))
    return found.groupBy("type").agg(F.count("*").alias("signals"), F.sum(F.size("keys")).alias("keys"))


@query("x20_facility_keys", inputs="vessels port_calls facilities", oracle="""
    WITH f AS (SELECT port_name, max(name) AS name FROM {facilities} WHERE port_name IS NOT NULL GROUP BY 1), c AS (SELECT c.id, coalesce(f.name, c.port) AS facility, c.country, v.mmsi, v.flag FROM {port_calls} c JOIN {vessels} v ON v.id = c.vessel_id LEFT JOIN f ON f.port_name = c.port WHERE is_sanctioned),
    s AS (SELECT c.id, coalesce(f.name, c.port) AS l, v.mmsi FROM {port_calls} c JOIN {vessels} v ON v.id = c.vessel_id LEFT JOIN f ON f.port_name = c.port WHERE c.id % 4 = 1)
    SELECT 'port_call' AS type, id, unnest([concat('vessel:', mmsi), concat('facility:', facility), concat('country:', country), concat('country:', flag), 'sector:shipping', 'sector:energy']) AS key FROM c UNION ALL SELECT 'oil_shipment', id, unnest([concat('vessel:', mmsi), concat('facility:', l), 'country:RU', 'sector:energy', 'sector:shipping']) FROM s""")
def _(vessels, calls, facilities):
    from datetime import datetime, timezone
    none = F.lit(None).cast("string")
    ships = calls.where("id % 4 = 1").join(vessels.select(F.col("id").alias("vessel_id"), "mmsi"), "vessel_id").select(F.col("id").alias("shipment_id"), "mmsi", F.lit("RU").alias("origin"), none.alias("destination"), F.col("port").alias("loading_location"), none.alias("discharge_location"), F.col("arrival").alias("loading_date"), F.lit(True).alias("sanctioned_route"), F.lit(False).alias("dark_oil_suspect"), F.lit("crude").alias("cargo_type"))
    found = f.collect_signals({"vessels": vessels, "port_calls": calls, "shipments": ships, "facilities": facilities}, datetime(1990, 1, 1, tzinfo=timezone.utc))
    return found.select("type", "id", F.explode("keys").alias("k")).select("type", "id", F.concat_ws(":", "k.kind", "k.value").alias("key"))


@query("f32_facilities_in_texts", inputs="texts facility_words", oracle="""
    WITH w AS (SELECT doc_id, concat(' ', trim(regexp_replace(lower(text), '[^\\pL\\pN]+', ' ', 'g')), ' ') AS x FROM {texts}) SELECT DISTINCT doc_id AS text_id, concat(name, ' terminal (', name_id, ')') AS facility FROM w JOIN {facility_words} p ON contains(x, concat(' ', p.name, ' '))""")
def _(texts, words):
    facilities = words.select(F.concat("name", F.lit(" terminal ("), "name_id", F.lit(")")).alias("name"))
    return f.facility_mentions(texts.select(F.col("doc_id").alias("text_id"), "text"), facilities)


@query("f35_alert_titles", inputs="signals", oracle=f"WITH RECURSIVE {KEYS}, {CLUSTERS} SELECT concat('Listed party ', ke, ': ', replace(domains, ',', ' + ')) AS title, members FROM fa JOIN ms USING (cluster)")
def _(signals):
    return f.composite_alerts(keyed(signals), RULES).select("title", "members")


@query("x23_watch_hits", inputs="watch_items evasion texts", oracle=f"""
    WITH d AS (SELECT *, coalesce(last_checked_at, greatest(created_at - INTERVAL 7 DAY, {AS_OF_SQL} - INTERVAL 30 DAY)) AS since FROM {{watch_items}}), x AS (SELECT d.id AS item_id, 'evasion_event' AS record_type, e.id AS record_id FROM d JOIN {{evasion}} e ON d.kind = 'vessel' AND e.mmsi = d.key AND e.ts >= since
      UNION ALL SELECT d.id, 'document', t.doc_id FROM d JOIN {{texts}} t ON d.kind = 'keyword' AND contains(lower(t.text), lower(d.key))) SELECT DISTINCT item_id, record_type, record_id FROM x WHERE NOT (record_type = 'document' AND record_id % 10 = 3)""")
def _(items, evasion, texts):
    records = evasion.select(F.lit("vessel").alias("kind"), F.col("mmsi").alias("key"), F.lit("evasion_event").alias("record_type"), F.col("id").alias("record_id"), "ts", "severity")
    bodies = texts.select(F.lit("document").alias("record_type"), F.col("doc_id").alias("record_id"), F.lit(AS_OF).alias("ts"), F.lit("medium").alias("severity"), "text", F.array(F.lit("keyword"), F.lit("company"), F.lit("domain")).alias("kinds"))
    seen = search.substring_join(texts.where("doc_id % 10 = 3").select(F.col("doc_id").alias("text_id"), "text"), items.where("kind = 'keyword'").select(F.col("id").alias("needle_id"), F.col("key").alias("needle")))
    stored = seen.select(F.col("needle_id").alias("item_id"), F.lit("document").alias("record_type"), F.col("text_id").alias("record_id"))
    return f.watch_hits(items, records, bodies, stored, AS_OF).select("item_id", "record_type", "record_id")


@query("x23_watch_alerts", inputs="watch_items evasion", oracle=f"""
    SELECT d.id AS item_id, count(*) AS hits, ['low', 'medium', 'high', 'critical'][max(CASE severity WHEN 'low' THEN 1 WHEN 'medium' THEN 2 WHEN 'high' THEN 3 ELSE 4 END)] AS severity FROM {{watch_items}} d JOIN {{evasion}} e ON d.kind = 'vessel' AND e.mmsi = d.key AND e.ts >= last_checked_at GROUP BY 1""")
def _(items, evasion):
    records = evasion.select(F.lit("vessel").alias("kind"), F.col("mmsi").alias("key"), F.lit("evasion_event").alias("record_type"), F.col("id").alias("record_id"), "ts", "severity")
    none = evasion.where("false").select(F.col("id").alias("item_id"), F.lit("").alias("record_type"), F.col("id").alias("record_id"))
    bodies = evasion.where("false").select(F.lit("").alias("record_type"), F.col("id").alias("record_id"), "ts", "severity", F.col("summary").alias("text"), F.array(F.lit("")).alias("kinds"))
    return f.watch_alerts(f.watch_hits(items, records, bodies, none, AS_OF)).select("item_id", "hits", "severity")
