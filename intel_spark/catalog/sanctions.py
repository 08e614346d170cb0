"""Registered screening, list-change and company queries."""

from pyspark.sql import functions as F

from intel_spark.catalog.helpers import AS_OF, AS_OF_ORDERS, AS_OF_ORDERS_SQL
from intel_spark.catalog.registry import ORACLES, query, r4, ts
from intel_spark.catalog.scalars import normal
from intel_spark.operators import corporate as c
from intel_spark.operators import graph
from intel_spark.operators import names as n
from intel_spark.operators import sanctions as s

LISTED = f"ln AS (SELECT DISTINCT id AS listing_id, entity_type, {normal('nm')} AS listed_name FROM (SELECT id, entity_type, name AS nm FROM {{listings}} UNION ALL SELECT id, entity_type, unnest(aliases) FROM {{listings}}))"
RATIO = "(1 - levenshtein({a}, {b}) / greatest(length({a}), length({b})))"
TOKEN_SQL = "list_filter(string_split({x}, ' '), lambda w: length(w) >= 3 AND NOT list_contains(['THE', 'OF', 'AND', 'CO', 'LTD', 'LLC', 'INC', 'SA', 'AO', 'OOO', 'COMPANY', 'LIMITED', 'SHIPPING', 'MV', 'MT'], w))"


def fuzzy(names: str, alias: str, minimum: float, types: str = "", top: int | None = None) -> str:
    """SQL for the closest listings per distinct probe name, the ``top`` ones or all; ``names`` yields column ``probe``."""
    best = f" QUALIFY row_number() OVER (PARTITION BY probe ORDER BY ratio DESC, listing_id) <= {top}" if top else ""
    return f"""{alias}_d AS (SELECT DISTINCT probe FROM ({names}) WHERE length(probe) >= 4),
    {alias}_n AS (SELECT DISTINCT listed_name FROM ln {types}),
    {alias}_p AS (SELECT probe, listed_name, {RATIO.format(a="probe", b="listed_name")} AS ratio FROM {alias}_d, {alias}_n WHERE abs(length(probe) - length(listed_name)) <= greatest(4, floor(length(probe) / 3)) AND {RATIO.format(a="probe", b="listed_name")} >= {minimum} - 1e-12
      AND list_has_any({TOKEN_SQL.format(x="probe")}, {TOKEN_SQL.format(x="listed_name")})),
    {alias}_l AS (SELECT probe, listing_id, max(ratio) AS ratio FROM {alias}_p JOIN ln USING (listed_name) {types} GROUP BY 1, 2 HAVING max(ratio) < 1),
    {alias} AS (SELECT * FROM {alias}_l{best})"""


@query("j01_match_identifiers", inputs="fleet listings", oracle="""
    SELECT v.id AS vessel_id, l.id AS listing_id, 'imo' AS match_type, v.imo AS matched_value FROM {fleet} v JOIN {listings} l ON v.imo = l.imo AND l.entity_type = 'vessel' UNION ALL SELECT v.id, l.id, 'mmsi', v.mmsi FROM {fleet} v JOIN {listings} l ON v.mmsi = l.mmsi""")
def _(fleet, listings):
    return n.match_identifiers(fleet, listings).select("vessel_id", "listing_id", "match_type", "matched_value")


@query("j02_match_exact", inputs="fleet listings", oracle=f"WITH {LISTED} SELECT DISTINCT v.id AS name_id, listing_id, entity_type FROM {{fleet}} v JOIN ln ON ln.listed_name = {normal('v.operator')}")
def _(fleet, listings):
    names = fleet.select(F.col("id").alias("name_id"), F.col("operator").alias("name"))
    return n.match_exact(names, listings).select("name_id", "listing_id", "entity_type")


@query("j03_match_fuzzy", inputs="fleet listings", oracle=f"""
    WITH {LISTED}, {fuzzy("SELECT " + normal("name") + " AS probe FROM {fleet}", "fz", 0.88, "WHERE entity_type = 'vessel'", 5)} SELECT v.id AS name_id, listing_id, {r4('ratio')} FROM {{fleet}} v JOIN fz ON fz.probe = {normal('v.name')}""")
def _(fleet, listings):
    names = fleet.select(F.col("id").alias("name_id"), "name")
    return n.match_fuzzy(names, listings, ["vessel"]).select("name_id", "listing_id", "ratio")


@query("j04_screen_names", inputs="fleet listings", oracle=f"""
    WITH {LISTED}, {fuzzy("SELECT " + normal("owner") + " AS probe FROM {fleet} WHERE owner IS NOT NULL", "fz", 0.88)}, nm AS (SELECT id AS name_id, {normal('owner')} AS probe FROM {{fleet}} WHERE owner IS NOT NULL), ex AS (SELECT DISTINCT name_id, listing_id FROM nm JOIN ln ON ln.listed_name = probe)
    SELECT name_id, listing_id, 'name_exact' AS match_type, 0.9 AS confidence FROM ex UNION ALL SELECT name_id, listing_id, 'name_fuzzy', round(0.6 + 0.3 * ratio, 2) FROM nm JOIN fz USING (probe) WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.name_id = nm.name_id AND ex.listing_id = fz.listing_id)""")
def _(fleet, listings):
    names = fleet.where("owner IS NOT NULL").select(F.col("id").alias("name_id"), F.col("owner").alias("name"))
    return n.screen_names(names, listings).select("name_id", "listing_id", "match_type", "confidence")


@query("j04_screen_summary", inputs="fleet listings", oracle=f"""
    SELECT name_id, {r4('max(confidence)', 'max_confidence')}, count(*) AS matches, round(max(confidence), 2) >= 0.85 AS is_sanctioned FROM ({ORACLES['j04_screen_names']}) GROUP BY name_id""")
def _(fleet, listings):
    names = fleet.where("owner IS NOT NULL").select(F.col("id").alias("name_id"), F.col("owner").alias("name"))
    return n.screen_summary(n.screen_names(names, listings))


PARTY = """SELECT v.id AS vessel_id, x.listing_id, '{kind}' AS match_type, max(CASE WHEN sim = 1 THEN {start} + CASE WHEN l.country = v.flag THEN 0.05 ELSE 0 END ELSE {start} - 0.1 END) AS confidence FROM {{{{fleet}}}} v
    JOIN (SELECT probe, listing_id, 1.0 AS sim FROM (SELECT DISTINCT {norm} AS probe FROM {{{{fleet}}}}) JOIN ln ON listed_name = probe AND entity_type IN ('company', 'person') UNION ALL SELECT probe, listing_id, ratio FROM {alias}) x ON x.probe = {norm} JOIN {{{{listings}}}} l ON l.id = x.listing_id GROUP BY 1, 2"""


def party(col: str, kind: str, start: float, alias: str) -> str:
    return PARTY.format(kind=kind, start=start, norm=normal(col), alias=alias).replace("{{", "{").replace("}}", "}")


SIMILAR = {col: fuzzy(f"SELECT {normal(col)} AS probe FROM {{fleet}} WHERE {col} IS NOT NULL", alias, 0.9, "WHERE entity_type IN ('company', 'person')") for col, alias in (("owner", "fo"), ("operator", "fp"), ("beneficial_owner", "fb"))}
CONFLICT = "coalesce((CASE WHEN l.vessel_type = 'Crude tanker' THEN 'tanker' ELSE 'cargo' END) <> (CASE v.ship_type WHEN 'Tanker' THEN 'tanker' WHEN 'Cargo' THEN 'cargo' ELSE 'fishing' END), false)"


@query("j05_screen_vessels", inputs="fleet listings", oracle=f"""
    WITH {LISTED}, {fuzzy("SELECT " + normal("name") + " AS probe FROM {fleet}", "fn", 0.9, "WHERE entity_type = 'vessel'")}, {SIMILAR["owner"]}, {SIMILAR["operator"]}, {SIMILAR["beneficial_owner"]},
    nm AS (SELECT v.id AS vessel_id, x.listing_id, CASE WHEN sim = 1 THEN 'name_exact' ELSE 'name_fuzzy' END AS match_type, least(CASE WHEN l.vessel_flag = v.flag THEN CASE WHEN sim = 1 THEN 0.9 ELSE 0.7 END WHEN l.vessel_flag IS NULL THEN CASE WHEN sim = 1 THEN 0.8 ELSE 0.5 END ELSE CASE WHEN sim = 1 THEN 0.55 ELSE 0.35 END END,
        CASE WHEN l.imo <> v.imo THEN 0.3 WHEN {CONFLICT} THEN 0.35 WHEN v.imo IS NULL AND length({normal('v.name')}) <= 6 THEN 0.5 ELSE 1 END) AS confidence
      FROM {{fleet}} v JOIN (SELECT probe, listing_id, 1.0 AS sim FROM (SELECT DISTINCT {normal('name')} AS probe FROM {{fleet}}) JOIN ln ON listed_name = probe AND entity_type = 'vessel' UNION ALL SELECT probe, listing_id, ratio FROM fn) x ON x.probe = {normal('v.name')} JOIN {{listings}} l ON l.id = x.listing_id),
    al AS (SELECT v.id AS vessel_id, l.id AS listing_id, 'imo' AS match_type, 0.95 AS confidence FROM {{fleet}} v JOIN {{listings}} l ON v.imo = l.imo AND l.entity_type = 'vessel' UNION ALL SELECT v.id, l.id, 'mmsi', 0.95 FROM {{fleet}} v JOIN {{listings}} l ON v.mmsi = l.mmsi UNION ALL SELECT * FROM nm
      UNION ALL {party('owner', 'owner', 0.6, 'fo')} UNION ALL {party('operator', 'operator', 0.6, 'fp')} UNION ALL {party('beneficial_owner', 'beneficial_owner', 0.4, 'fb')} UNION ALL SELECT id, NULL, 'flag_program', 0.55 FROM {{fleet}} WHERE flag IN ('IR', 'KP', 'SY', 'CU'))
    SELECT vessel_id, listing_id, match_type, {r4('round(confidence, 2)', 'confidence')}, CASE WHEN round(confidence, 2) >= 0.9 THEN 'critical' WHEN round(confidence, 2) >= 0.7 THEN 'high' WHEN round(confidence, 2) >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM al""")
def _(fleet, listings):
    return n.screen_vessels(fleet, listings).select("vessel_id", "listing_id", "match_type", "confidence", "severity")


@query("j26_listing_peers", inputs="listings", oracle="SELECT id, (SELECT string_agg(DISTINCT authority, ',' ORDER BY authority) FROM {listings} p WHERE p.name_normalized = l.name_normalized) AS authorities FROM {listings} l")
def _(listings):
    return n.listing_peers(listings).select("id", "authorities")


@query("j07_best_registry_match", inputs="listings companies fleet", oracle=f"""
    WITH q AS (SELECT DISTINCT id AS query_id, {normal('nm')} AS core FROM (SELECT id, name AS nm FROM {{listings}} UNION ALL SELECT id, unnest(aliases) FROM {{listings}})), r AS (SELECT DISTINCT concat('X', CAST(id AS STRING)) AS lei, {normal('nm')} AS rcore FROM (SELECT id, name AS nm FROM {{fleet}} UNION ALL SELECT id, operator FROM {{fleet}})),
    qd AS (SELECT DISTINCT core FROM q), rd AS (SELECT DISTINCT rcore FROM r), p AS (SELECT core, rcore, round({RATIO.format(a='core', b='rcore')}, 3) AS score FROM qd, rd WHERE abs(length(core) - length(rcore)) <= 4 AND {RATIO.format(a='core', b='rcore')} >= 0.8995)
    SELECT query_id, lei, {r4('score')} FROM q JOIN p USING (core) JOIN r USING (rcore) WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lei) = 1""")
def _(listings, companies, fleet):
    queries = listings.select(F.col("id").alias("query_id"), F.concat(F.array("name"), "aliases").alias("names"))
    registry = fleet.select(F.concat(F.lit("X"), F.col("id").cast("string")).alias("lei"), "name", F.array("operator").alias("other_names"))
    return n.best_registry_match(queries, registry)


@query("j25_party_filter", inputs="posts companies", oracle="""
    SELECT p.post_id, c.id AS listing_id FROM {posts} p JOIN {companies} c ON c.id = p.post_id % 100 WHERE contains(upper(p.victim), regexp_replace(replace(c.name, '.', ' '), '( LTD| TRADING S A *| SHIPPING GMBH| GMBH)$', ''))""".replace("( LTD| TRADING S A *| SHIPPING GMBH| GMBH)$", "( LTD| TRADING S A *| GMBH)$"))
def _(posts, companies):
    dockets = posts.select("post_id", (F.col("post_id") % 100).alias("listing_id"), F.col("victim").alias("title"), F.array().cast("array<string>").alias("parties"))
    return n.party_filter(dockets, companies).select("post_id", "listing_id")


DIFF = """o AS (SELECT * FROM {list_old}), w AS (SELECT * FROM {list_new}), tr AS (SELECT authority, coalesce((SELECT count(*) FROM w WHERE w.authority = x.authority), 0) < 0.5 * count(*) FILTER (is_active) AS trunc FROM o x GROUP BY 1),
    d AS (SELECT coalesce(o.authority, w.authority) AS authority, coalesce(o.source_id, w.source_id) AS source_id, o.id AS oid, o.is_active, w.id AS wid, concat_ws(',', CASE WHEN regexp_replace(upper(o.name), '[^A-Z0-9]+', ' ', 'g') <> regexp_replace(upper(w.name), '[^A-Z0-9]+', ' ', 'g') THEN 'name' END,
      CASE WHEN list_sort(o.programs) <> list_sort(w.programs) THEN 'programs' END, CASE WHEN o.imo IS DISTINCT FROM w.imo THEN 'imo' END) AS ch, coalesce(w.name, o.name) AS entity FROM o FULL JOIN w ON o.authority = w.authority AND o.source_id = w.source_id),
    k AS (SELECT d.*, CASE WHEN oid IS NULL THEN 'new' WHEN wid IS NULL AND NOT is_active THEN 'inactive' WHEN wid IS NULL THEN CASE WHEN trunc THEN 'kept' ELSE 'delisted' END WHEN NOT is_active THEN 'relisted' WHEN ch <> '' THEN 'changed' ELSE 'unchanged' END AS kind FROM d LEFT JOIN tr USING (authority))"""


@query("d01_diff_listings", inputs="list_old list_new", oracle=f"WITH {DIFF} SELECT authority, source_id, kind, CASE WHEN kind IN ('changed', 'unchanged') THEN ch ELSE '' END AS changed FROM k")
def _(old, new):
    return s.diff_listings(old, new).select("authority", "source_id", "kind", "changed")


@query("d02_change_log", inputs="list_old list_new", oracle=f"""
    WITH {DIFF} SELECT authority, source_id, entity, CASE kind WHEN 'new' THEN 'new_designation' WHEN 'relisted' THEN 'relisted' WHEN 'delisted' THEN 'delisting' ELSE CASE WHEN ch LIKE '%name%' THEN 'name_change' WHEN ch LIKE '%programs%' THEN 'program_change' ELSE 'identifier_change' END END AS update_type FROM k WHERE kind IN ('new', 'relisted', 'changed', 'delisted')""")
def _(old, new):
    return s.change_log(s.diff_listings(old, new), AS_OF).select("authority", "source_id", "entity", "update_type")


@query("d03_apply_diff", inputs="list_old list_new", oracle=f"""
    WITH {DIFF} SELECT k.authority, k.source_id, k.entity AS name, wid IS NOT NULL OR (is_active AND kind <> 'delisted') AS is_active, kind = 'delisted' AS delisted_now FROM k""")
def _(old, new):
    out = s.apply_diff(old.withColumn("delisting_date", F.lit(None).cast("timestamp")), new, s.diff_listings(old, new), AS_OF)
    return out.select("authority", "source_id", "name", "is_active", F.col("delisting_date").isNotNull().alias("delisted_now"))


@query("d04_union_sources", inputs="list_old list_new", oracle="SELECT authority, source_id, name, is_active FROM {list_old} UNION ALL SELECT authority, source_id, name, NULL FROM {list_new}")
def _(old, new):
    return s.union_sources(old, new).select("authority", "source_id", "name", "is_active")


@query("d05_seed_companies", inputs="listings fleet companies", oracle=f"""
    WITH a AS (SELECT name, id AS entity_id, 'direct' AS match_type, CASE authority WHEN 'OFAC' THEN 0 WHEN 'UN' THEN 1 ELSE 2 END AS pr, id AS tie FROM {{listings}} WHERE is_active AND entity_type = 'company' UNION ALL SELECT vessel_owner, min(id), 'vessel_owner', 10, min(id) FROM {{listings}} WHERE is_active AND vessel_owner IS NOT NULL GROUP BY 1
      UNION ALL SELECT DISTINCT owner, CAST(NULL AS BIGINT), NULL, 20, 0 FROM {{fleet}} WHERE owner IS NOT NULL), b AS (SELECT *, {normal('name')} AS name_normalized FROM a)
    SELECT name_normalized, entity_id, match_type, match_type IS NOT NULL AS listed FROM b QUALIFY row_number() OVER (PARTITION BY name_normalized ORDER BY pr, tie, name) = 1""")
def _(listings, fleet, companies):
    known = companies.select(F.col("lei").alias("name_normalized"))
    return s.seed_companies(listings, fleet, known).select("name_normalized", "entity_id", "match_type", "listed")


@query("d06_dedupe_events", inputs="geo_events", oracle="""
    WITH n AS (SELECT * FROM {geo_events} WHERE ts >= TIMESTAMP '2024-01-16'), e AS (SELECT * FROM {geo_events} WHERE ts < TIMESTAMP '2024-01-16'), a AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.source = n.source AND e.source_id = n.source_id) QUALIFY row_number() OVER (PARTITION BY source, source_id ORDER BY mentions DESC, ts, source_id) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY mentions DESC, ts, source_id, source) = 1) SELECT id FROM b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.url = b.url AND e.ts >= b.ts - INTERVAL 3 DAY)""")
def _(events):
    cut = F.to_timestamp(F.lit("2024-01-16 00:00:00"))
    return s.dedupe_events(events.where(F.col("ts") >= cut), events.where(F.col("ts") < cut)).select("id")


@query("d07_insert_if_absent", inputs="list_old list_new", oracle="SELECT authority, source_id FROM {list_new} w WHERE NOT EXISTS (SELECT 1 FROM {list_old} o WHERE o.authority = w.authority AND o.source_id = w.source_id)")
def _(old, new):
    return s.insert_if_absent(new, old, ["authority", "source_id"]).select("authority", "source_id")


@query("d10_purge", inputs="transfers", oracle=f"SELECT tx_hash FROM {{transfers}} WHERE ts >= {AS_OF_ORDERS_SQL} - INTERVAL 900 DAY OR usd > 90000")
def _(transfers):
    return s.purge(transfers, "ts", AS_OF_ORDERS, 900, F.col("usd") > 90000).select("tx_hash")


@query("d11_merge_by_lei", inputs="companies", oracle=f"""
    SELECT lei, min(id) AS id, bool_or(listed) AS listed, (max((confidence, match_type, entity_id)) FILTER (listed))[2] AS match_type, count(*) AS merged FROM {{companies}} GROUP BY lei""")
def _(companies):
    return s.merge_by_lei(companies).select("lei", "id", "listed", "match_type", "merged")


@query("g06_program_counts", inputs="listings", oracle="SELECT authority, program, count(*) AS n_entities, count(*) FILTER (entity_type = 'vessel') AS n_vessels FROM (SELECT authority, entity_type, unnest(programs) AS program FROM {listings} WHERE is_active) GROUP BY 1, 2")
def _(listings):
    return s.program_counts(listings)


@query("g07_listing_report", inputs="listings list_updates", oracle=f"""
    SELECT authority, 'active_listings' AS metric, count(*) AS value FROM {{listings}} WHERE is_active GROUP BY 1 UNION ALL SELECT authority, 'active_vessels', count(*) FILTER (entity_type = 'vessel') FROM {{listings}} WHERE is_active GROUP BY 1
    UNION ALL SELECT authority, concat('update:', update_type), count(*) FROM {{list_updates}} WHERE ts >= {AS_OF_ORDERS_SQL} - INTERVAL 90 DAY AND ts <= {AS_OF_ORDERS_SQL} GROUP BY 1, 2""")
def _(listings, updates):
    return s.listing_report(listings, updates, AS_OF_ORDERS, 90)


SECRET = "country IN ('PA', 'VG', 'CY')"
SHELL = f"""sh AS (SELECT *, least(1.0, CASE WHEN {SECRET} THEN 0.25 ELSE 0 END + CASE WHEN parent_exception IN ('NO_KNOWN_PERSON', 'NON_PUBLIC') THEN 0.25 WHEN parent_exception = 'NATURAL_PERSONS' THEN 0.1 ELSE 0 END + CASE WHEN registration_status IN ('LAPSED', 'RETIRED') THEN 0.1 ELSE 0 END
    + CASE WHEN entity_status = 'INACTIVE' THEN 0.05 ELSE 0 END + CASE WHEN floor((epoch(TIMESTAMP '2024-01-31') - epoch(creation_date)) / 86400) < 365 THEN 0.15 ELSE 0 END + CASE WHEN {SECRET} AND (name LIKE '%TRADING%' OR name LIKE '%SHIPPING%') THEN 0.1 ELSE 0 END
    + CASE WHEN {SECRET} AND children_count = 0 THEN 0.05 ELSE 0 END + CASE WHEN listed THEN 0.15 ELSE 0 END) AS conf FROM {{companies}})"""


@query("x05_assess_shell", inputs="companies", oracle=f"WITH {SHELL} SELECT id, {r4('round(conf, 2)', 'shell_confidence')}, round(conf, 2) >= 0.5 AS is_shell, coalesce(parent_exception IN ('NO_KNOWN_PERSON', 'NON_PUBLIC'), false) AS opaque FROM sh")
def _(companies):
    return c.assess_shell(companies, AS_OF).select("id", "shell_confidence", "is_shell", "opaque")


@query("x06_company_risk", inputs="companies", oracle=f"""
    WITH {SHELL} SELECT id, {r4("round(least(1.0, 0.1 + CASE WHEN listed THEN CASE match_type WHEN 'direct' THEN 0.9 ELSE 0.8 END ELSE 0 END + 3e-1 * CAST(round(conf, 2) AS DOUBLE) + CASE WHEN country = 'RU' THEN 0.1 ELSE 0 END), 2)", "risk")} FROM sh""")
def _(companies):
    return c.assess_shell(companies, AS_OF).select("id", c.company_risk(F.col("listed"), F.col("match_type"), F.col("shell_confidence"), F.col("country")).alias("risk"))


@query("g16_corporate_summary", inputs="companies", oracle=f"""
    WITH {SHELL}, z AS (SELECT *, round(conf, 2) >= 0.5 AS is_shell, coalesce(parent_exception IN ('NO_KNOWN_PERSON', 'NON_PUBLIC'), false) AS opaque FROM sh) SELECT 'companies' AS metric, '' AS key, count(*) AS value FROM z UNION ALL SELECT 'linked', '', count(*) FILTER (listed) FROM z UNION ALL SELECT 'shells', '', count(*) FILTER (is_shell) FROM z
    UNION ALL SELECT 'opaque', '', count(*) FILTER (opaque) FROM z UNION ALL SELECT 'match_type', match_type, count(*) FROM z WHERE listed GROUP BY 2 UNION ALL SELECT * FROM (SELECT 'country', country, count(*) FROM z WHERE listed GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""")
def _(companies):
    return c.corporate_summary(c.assess_shell(companies, AS_OF))


# a company's first parent, the path along it, and all owners over either kind of edge
OWNED = """eg AS (SELECT DISTINCT child, parent, kind FROM {ownership} JOIN {companies} c ON c.id = parent WHERE child <> parent), up AS (SELECT child, min_by(parent, (kind <> 'direct', parent)) AS parent, min_by(kind, (kind <> 'direct', parent)) AS kind FROM eg GROUP BY 1),
    w AS (SELECT id AS company, id AS at, [id] AS seen, ['subject'] AS kinds FROM {companies} UNION ALL SELECT w.company, up.parent, list_append(seen, up.parent), list_append(kinds, concat(up.kind, '_parent')) FROM w JOIN up ON up.child = w.at WHERE NOT list_contains(seen, up.parent)),
    pt AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY company ORDER BY len(seen) DESC) = 1),
    ow AS (SELECT child AS company, parent AS owner FROM eg UNION SELECT ow.company, eg.parent FROM ow JOIN eg ON eg.child = ow.owner),
    ab AS (SELECT c.id AS company, count(o.id) AS owners, c.listed OR coalesce(bool_or(o.listed), false) AS listed, c.country IN ('PA', 'VG', 'CY') OR coalesce(bool_or(o.country IN ('PA', 'VG', 'CY')), false) AS secret, c.country = 'RU' OR coalesce(bool_or(o.country = 'RU'), false) AS ru
      FROM {companies} c LEFT JOIN ow ON ow.company = c.id AND ow.owner <> c.id LEFT JOIN {companies} o ON o.id = ow.owner GROUP BY c.id, c.listed, c.country)"""


@query("n03_ownership_chains", inputs="companies ownership", oracle=f"""
    WITH RECURSIVE {OWNED} SELECT pt.company, array_to_string(kinds, ',') AS relationships, len(seen) AS chain_length, t.name AS top_name, owners, ab.listed AS involves_sanctioned, secret AS secrecy FROM pt JOIN ab USING (company) JOIN {{companies}} t ON t.id = seen[-1]""")
def _(companies, ownership):
    return graph.ownership_chains(companies, ownership).select("company", F.col("chain_path.relationship").alias("relationships"), "chain_length", "top_name", "owners", "involves_sanctioned", "secrecy")


@query("n03_owners", inputs="companies ownership", oracle="""
    WITH RECURSIVE eg AS (SELECT DISTINCT child, parent FROM {ownership} WHERE child <> parent), ow AS (SELECT child AS company, parent AS owner, 1 AS steps FROM eg UNION SELECT ow.company, eg.parent, steps + 1 FROM ow JOIN eg ON eg.child = ow.owner WHERE steps < 20)
    SELECT company, owner, min(steps) AS steps FROM ow WHERE company <> owner GROUP BY 1, 2""")
def _(companies, ownership):
    return graph.owners(ownership)


@query("x06_ownership_risk", inputs="companies ownership", oracle=f"""
    WITH RECURSIVE {OWNED} SELECT company, {r4("round(least(1.0, 0.2 + 0.05 * (len(seen) - 1) + CASE WHEN ab.listed THEN 0.5 ELSE 0 END + CASE WHEN secret THEN 0.1 ELSE 0 END + CASE WHEN ru THEN 0.1 ELSE 0 END), 2)", "risk")} FROM pt JOIN ab USING (company)""")
def _(companies, ownership):
    chains = graph.ownership_chains(companies, ownership)
    return chains.select("company", c.ownership_risk(F.col("chain_path"), F.col("places"), F.col("involves_sanctioned"), F.lit(False)).alias("risk"))


@query("n04_propagate_exposure", inputs="companies ownership", oracle=f"""
    WITH s AS (SELECT id, confidence AS c, match_type AS t FROM {{companies}}), k AS (SELECT child AS id, round(c * CASE WHEN kind = 'ultimate' THEN 0.75 ELSE 0.9 END, 3) AS nc, CASE WHEN kind = 'ultimate' THEN 'ultimate_parent' ELSE 'parent' END AS nt FROM {{ownership}} JOIN s ON s.id = parent WHERE c IS NOT NULL
      UNION ALL SELECT parent, 0.5, 'child' FROM {{ownership}} JOIN s ON s.id = child WHERE t = 'direct'), b AS (SELECT id, max((nc, nt)) AS m FROM k GROUP BY 1)
    SELECT s.id, {r4("CASE WHEN t = 'direct' OR m IS NULL OR coalesce(c, 0) >= m[1] THEN c ELSE m[1] END", "confidence")}, CASE WHEN t = 'direct' OR m IS NULL OR coalesce(c, 0) >= m[1] THEN t ELSE m[2] END AS match_type FROM s LEFT JOIN b USING (id)""")
def _(companies, ownership):
    return graph.propagate_exposure(companies, ownership)


@query("n06_relations", inputs="companies ownership", oracle="""
    SELECT e.parent AS id, 'parent' AS relation, kind, name FROM {ownership} e JOIN {companies} c ON c.id = e.parent WHERE child = 13 UNION ALL SELECT e.child, 'subsidiary', kind, name FROM {ownership} e JOIN {companies} c ON c.id = e.child WHERE parent = 13""")
def _(companies, ownership):
    return graph.relations(ownership, companies, 13).drop("country")


@query("n01_connected_components", inputs="spend_inputs", oracle="""
    WITH RECURSIVE h AS (SELECT tx_hash, min(address) AS hub FROM {spend_inputs} GROUP BY 1), e AS (SELECT DISTINCT hub AS a, address AS b FROM {spend_inputs} JOIN h USING (tx_hash)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
    SELECT node, min(root) AS component FROM r GROUP BY node""")
def _(inputs):
    hub = inputs.groupBy("tx_hash").agg(F.min("address").alias("src"))
    return graph.connected_components(inputs.join(hub, "tx_hash").select("src", F.col("address").alias("dst")))


@query("n02_cospend_clusters", inputs="spend_inputs", oracle="""
    WITH RECURSIVE s AS (SELECT tx_hash, concat(chain, ':', address) AS w FROM {spend_inputs}), h AS (SELECT tx_hash, min(w) AS hub FROM s GROUP BY 1), e AS (SELECT DISTINCT hub AS a, w AS b FROM s JOIN h USING (tx_hash)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS root FROM u UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.node)
    SELECT split_part(node, ':', 1) AS chain, split_part(node, ':', 2) AS address, substr(sha1(min(root)), 1, 16) AS cluster_id FROM r GROUP BY node""")
def _(inputs):
    return graph.cospend_clusters(inputs)
