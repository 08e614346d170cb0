"""Registered projections: scalar expressions over whole tables and whole texts."""

from pyspark.sql import functions as F

from intel_spark.catalog.registry import query, r4, ts
from intel_spark.functions import chain as c
from intel_spark.functions import news as n
from intel_spark.functions import scoring as s
from intel_spark.functions import text as t
from intel_spark.functions import vessel as v

NORMAL = "trim(regexp_replace(upper(regexp_replace(strip_accents({x}), '[^\\x00-\\x7F]', '', 'g')), '[^A-Z0-9]+', ' ', 'g'))"


def normal(x: str) -> str:
    return NORMAL.format(x=x)


@query("f01_normalize_name", inputs="texts", oracle=f"SELECT doc_id, md5({normal('text')}) AS digest, length({normal('text')}) AS chars FROM {{texts}}")
def _(texts):
    name = t.normalize_name(F.col("text"))
    return texts.select("doc_id", F.md5(name.cast("binary")).alias("digest"), F.length(name).alias("chars"))


DIGIT = "+".join(f"CAST(substr(d, {i + 1}, 1) AS INT) * {7 - i}" for i in range(6))


@query("f02_valid_imo", inputs="imo_texts", oracle=f"""
    WITH x AS (SELECT DISTINCT raw, trim(replace(raw, 'IMO', '')) AS d FROM {{imo_texts}}) SELECT raw, d AS imo FROM x WHERE ({DIGIT}) % 10 = CAST(substr(d, 7, 1) AS INT) AND d <> '1234567' AND NOT d IN ('1111111', '2222222', '3333333', '4444444', '5555555', '6666666', '7777777', '8888888', '9999999')""")
def _(texts):
    return texts.select("raw").distinct().select("raw", v.valid_imo(F.col("raw")).alias("imo")).where(F.col("imo").isNotNull())


@query("f03_extract_imo", inputs="listings", oracle="SELECT id, substr(remarks, strpos(remarks, 'IMO ') + 4, 7) AS imo FROM {listings}")
def _(listings):
    return listings.select("id", v.extract_imo(F.col("remarks")).alias("imo"))


@query("f04_flag_from_mmsi", inputs="positions", oracle="SELECT id, CASE substr(mmsi, 1, 3) WHEN '210' THEN 'CY' ELSE 'XX' END AS flag, CASE lower(trim(flag)) WHEN 'pa' THEN 'PANAMA' WHEN 'lr' THEN 'LIBERIA' END AS country FROM {positions}")
def _(positions):
    return positions.select("id", v.flag_from_mmsi(F.col("mmsi"), v.lookup({"210": "CY", "211": "DE"})).alias("flag"), v.country_to_iso(F.col("flag"), v.lookup({"pa": "PANAMA", "lr": "LIBERIA"})).alias("country"))


@query("f05_clean_ais_name", inputs="positions", oracle="SELECT id, nullif(trim(regexp_replace(replace(concat('@ ', name, '@@-'), '@', ' '), '\\s+', ' ', 'g'), ' -_.'), '') AS cleaned FROM {positions}")
def _(positions):
    return positions.select("id", t.clean_ais_name(F.concat(F.lit("@ "), "name", F.lit("@@-"))).alias("cleaned"))


SHIP = " ".join(f"WHEN {k} THEN '{x}'" for k, x in v.SHIP_TYPE_EXACT.items())
TENS = " ".join(f"WHEN {k} THEN '{x}'" for k, x in v.SHIP_TYPE_TENS.items())
NAV = " ".join(f"WHEN {k} THEN '{x}'" for k, x in v.NAV_STATUS.items())


@query("f06_ship_type_name", inputs="positions", oracle=f"SELECT id, coalesce(CASE id % 100 {SHIP} END, CASE floor(id % 100 / 10) {TENS} END) AS ship_type, CASE id % 17 {NAV} END AS nav_status FROM {{positions}}")
def _(positions):
    return positions.select("id", v.ship_type_name(F.col("id") % 100).alias("ship_type"), v.nav_status_name(F.col("id") % 17).alias("nav_status"))


@query("f07_name_token", inputs="positions", oracle="SELECT id, replace(replace(name, ' II', ' 2'), ' ', '') AS token FROM {positions} WHERE name IS NOT NULL")
def _(positions):
    return positions.where("name IS NOT NULL").select("id", t.name_token(F.col("name")).alias("token"))


CORE = "regexp_replace(" + normal("name") + ", '( LTD| TRADING S A| SHIPPING GMBH)$', '')"


@query("f08_core_name", inputs="companies", oracle=f"SELECT id, CASE WHEN name LIKE '%GMBH' THEN regexp_replace({normal('name')}, ' GMBH$', '') ELSE {CORE} END AS core FROM {{companies}}")
def _(companies):
    return companies.select("id", t.core_name(F.col("name")).alias("core"))


LETTERS = "length(regexp_replace(text, '[^\\pL]', '', 'g'))"


@query("f09_latin_enough", inputs="texts", oracle=f"SELECT doc_id, CASE WHEN {LETTERS} = 0 THEN false ELSE length(regexp_replace({normal('text')}, '[^A-Z]', '', 'g')) / {LETTERS} >= 0.95 END AS latin FROM {{texts}}")
def _(texts):
    return texts.select("doc_id", t.latin_enough(F.col("text"), 0.95).alias("latin"))


TOPICS = "list_filter(regexp_extract_all(lower(text), '[a-z][a-z-][a-z-][a-z-]+'), lambda w: NOT list_contains([" + ", ".join(f"'{w}'" for w in t.HEADLINE_STOPWORDS) + "], w))"
TOKENS = "list_distinct(list_filter(string_split(" + normal("name") + ", ' '), lambda w: length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in t.LISTING_STOPWORDS) + "], w)))"


@query("f10_topic_tokens", inputs="texts", oracle=f"SELECT doc_id, len({TOPICS}) AS words, md5(array_to_string({TOPICS}, ' ')) AS digest FROM {{texts}}")
def _(texts):
    words = t.topic_tokens(F.col("text"))
    return texts.select("doc_id", F.size(words).alias("words"), F.md5(F.array_join(words, " ").cast("binary")).alias("digest"))


@query("f10_listing_tokens", inputs="companies", oracle=f"SELECT id, array_to_string(list_sort({TOKENS}), ',') AS tokens FROM {{companies}}")
def _(companies):
    return companies.select("id", F.array_sort(t.listing_tokens(t.normalize_name(F.col("name")))).alias("tokens"))


@query("f12_severity", inputs="positions", oracle="""
    SELECT id, CASE WHEN speed >= 30 THEN 'critical' WHEN speed >= 20 THEN 'high' WHEN speed >= 10 THEN 'medium' WHEN speed >= 5 THEN 'low' ELSE 'none' END AS severity, CASE WHEN heading / 360 >= 0.9 THEN 'critical' WHEN heading / 360 >= 0.7 THEN 'high' WHEN heading / 360 >= 0.5 THEN 'medium' ELSE 'low' END AS by_confidence FROM {positions}""")
def _(positions):
    return positions.select("id", s.severity_for(F.col("speed"), (5.0, 10.0, 20.0, 30.0)).alias("severity"), s.severity_for_confidence(F.col("heading") / 360).alias("by_confidence"))


@query("f13_f14_noisy_or", inputs="positions", oracle=f"""
    SELECT id, {r4("greatest(0, least(0.99, coalesce(speed, -1) / 30))", "clamped")}, {r4("round(1 - (1 - greatest(0, least(0.99, coalesce(speed / 40, 0)))) * (1 - greatest(0, least(0.99, heading / 360))) * (1 - greatest(0, least(0.99, coalesce(draught / 50, 0)))), 3)", "combined")} FROM {{positions}}""")
def _(positions):
    return positions.select("id", s.clamp(F.coalesce("speed", F.lit(-1.0)) / 30).alias("clamped"), s.noisy_or(F.array(F.col("speed") / 40, F.col("heading") / 360, F.col("draught") / 50)).alias("combined"))


CATEGORY = "CASE " + " ".join(f"WHEN contains(lower({{x}}), '{w}') THEN '{k}'" for w, k in v.TYPE_CATEGORIES.items()) + " END"


@query("f15_f16_types", inputs="fleet", oracle=f"""
    SELECT id, coalesce({CATEGORY.format(x="ship_type")} <> {CATEGORY.format(x="CASE WHEN id % 2 = 0 THEN 'Crude tanker' ELSE 'Bulk carrier' END")}, false) AS conflict, {r4("CASE WHEN id % 7 = 0 THEN 70 WHEN id % 7 = 1 THEN 45 ELSE 30 END", "max_speed")} FROM {{fleet}}""")
def _(fleet):
    listed = F.when(F.col("id") % 2 == 0, "Crude tanker").otherwise("Bulk carrier")
    kind = F.when(F.col("id") % 7 == 0, "High-Speed Craft").when(F.col("id") % 7 == 1, "Passenger ferry").otherwise(F.col("ship_type"))
    return fleet.select("id", v.types_conflict(listed, F.col("ship_type")).alias("conflict"), v.plausible_max_speed(kind).alias("max_speed"))


@query("f17_tankers", inputs="positions facilities", oracle="""
    SELECT p.ship_type, f.id AS facility, count(*) AS fixes, regexp_matches(lower(p.ship_type), 'tanker|crude|oil|chemical|lng|lpg|gas carrier|product') AS tanker, CASE WHEN f.commodity = 'lng' THEN regexp_matches(lower(p.ship_type), 'lng|gas') ELSE regexp_matches(lower(p.ship_type), 'tanker|crude|oil|chemical|lng|lpg|gas carrier|product') END AS fits
    FROM {positions} p JOIN {facilities} f ON f.id = p.vessel_id % 25 GROUP BY p.ship_type, f.id, f.commodity""")
def _(positions, facilities):
    joined = positions.select("ship_type", (F.col("vessel_id") % 25).alias("facility")).join(facilities.select(F.col("id").alias("facility"), "commodity"), "facility")
    return joined.groupBy("ship_type", "facility", "commodity").agg(F.count("*").alias("fixes")).select("ship_type", "facility", "fixes", v.is_tanker(F.col("ship_type")).alias("tanker"), v.matches_commodity(F.col("ship_type"), F.col("commodity")).alias("fits"))


CLASS = "CASE WHEN l IS NULL THEN NULL WHEN l <= 120 THEN {a} WHEN l <= 160 THEN {b} WHEN l <= 190 THEN {c} WHEN l <= 230 THEN {d} WHEN l <= 260 THEN {e} WHEN l <= 290 THEN {f} WHEN l <= 400 THEN {g} ELSE {h} END"
DRAFT = CLASS.format(a=7.0, b=9.5, c=12.5, d=14.0, e=15.0, f=17.0, g=21.0, h=23.0)
DWT = CLASS.format(a=8000, b=30000, c=50000, d=75000, e=110000, f=160000, g=300000, h=400000)
KIND = CLASS.format(a="'small_tanker'", b="'handysize'", c="'medium_range'", d="'panamax_lr1'", e="'aframax_lr2'", f="'suezmax'", g="'vlcc'", h="'ulcc'")


@query("f18_f19_estimate_cargo", inputs="port_calls", oracle=f"""
    WITH x AS (SELECT id, CASE WHEN id % 13 = 0 THEN NULL ELSE 90 + id % 340 END AS l, draught_arr AS da, draught_dep AS dd, CASE id % 5 WHEN 0 THEN 'lng' WHEN 1 THEN 'products' WHEN 2 THEN NULL ELSE 'crude' END AS cm FROM {{port_calls}}),
    y AS (SELECT *, {DRAFT} AS md, {DWT} AS dwt, {KIND} AS kind FROM x), z AS (SELECT *, CASE WHEN cm = 'lng' THEN NULL WHEN abs(dd - da) >= 1 THEN dd > da WHEN md IS NOT NULL THEN dd >= 0.8 * md WHEN dd >= 12 THEN true END AS laden FROM y)
    SELECT id, kind AS size_class, laden, CASE WHEN cm = 'lng' THEN 'lng_no_barrel_estimate' WHEN abs(dd - da) >= 1 THEN 'draught_change' WHEN md IS NOT NULL THEN 'draught_vs_class_max' WHEN dd >= 12 THEN 'deep_draught' ELSE 'unknown' END AS basis,
    {r4("CASE WHEN laden AND dwt IS NOT NULL THEN round(round(dwt * 0.95 * CASE cm WHEN 'products' THEN 8.0 ELSE 7.3 END) * least(1.0, greatest(0.5, dd / md))) END", "barrels")} FROM z""")
def _(calls):
    length = F.when(F.col("id") % 13 != 0, (90 + F.col("id") % 340).cast("double"))
    commodity = F.when(F.col("id") % 5 == 0, "lng").when(F.col("id") % 5 == 1, "products").when(F.col("id") % 5 != 2, "crude")
    return calls.select("id", v.estimate_cargo(length, F.col("draught_arr"), F.col("draught_dep"), commodity).alias("e")).select("id", "e.size_class", "e.laden", "e.basis", "e.barrels")


@query("f20_f21_listed_addresses", inputs="listings", oracle="""
    SELECT id, 'bitcoin' AS chain, concat('bc1qaddressnumber', lpad(CAST(id % 400 AS STRING), 8, '0')) AS address, 'XBT' AS symbol FROM {listings} UNION ALL SELECT id, 'ethereum', concat('0xabcdef', lpad(CAST(id % 700 AS STRING), 34, '0')), 'ETH' FROM {listings}""")
def _(listings):
    return listings.select("id", F.explode(c.listed_addresses(F.col("remarks"))).alias("a")).select("id", "a.chain", "a.address", "a.symbol")


@query("f22_usd_value", inputs="transfers", oracle=f"SELECT tx_hash, {r4('round(CASE WHEN chain = ' + chr(39) + 'bitcoin' + chr(39) + ' THEN usd * 42000 ELSE usd END, 2)', 'value_usd')} FROM {{transfers}}")
def _(transfers):
    return transfers.select("tx_hash", c.usd_value(F.col("usd"), F.when(F.col("chain") == "bitcoin", "BTC").otherwise(F.col("token")), F.when(F.col("chain") == "bitcoin", 42000.0)).alias("value_usd"))


@query("f23_aircraft_remarks", inputs="listings", oracle="SELECT id, concat('EP-', CAST(id AS STRING)) AS tail, regexp_extract(remarks, 'Aircraft Model ([^;]+)', 1) AS model, 'IR' AS country FROM {listings}")
def _(listings):
    parsed = listings.select("id", n.parse_aircraft_remarks(F.col("remarks")).alias("r"))
    return parsed.select("id", "r.tail", "r.model", n.registration_country(F.col("r.tail")).alias("country"))


@query("f24_extract_domains", inputs="listings", oracle="SELECT id, concat('site', CAST(id % 300 AS STRING), '.example.com') AS domains FROM {listings}")
def _(listings):
    return listings.select("id", n.extract_domains(F.col("remarks")).alias("domains"))


COUNTRY_NAMES = {"iran": "IR", "france": "FR", "russia": "RU", "ukraine": "UA", "guinea": "GN", "equatorial guinea": "GQ", "panama": "PA", "mali": "ML", "oman": "OM"}
PATTERNS = sorted({**{k: x for k, x in COUNTRY_NAMES.items() if len(k) > 3}, **n.DEMONYMS}.items(), key=lambda item: -len(item[0]))
# codes in pattern order, first mention kept
DETECT = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '\\b{k}\\b') THEN '{iso}' END" for k, iso in PATTERNS) + "], lambda c: c IS NOT NULL)"


@query("f25_detect_countries", inputs="slugs", oracle=f"WITH d AS (SELECT id, {DETECT} AS cs FROM (SELECT id, lower(slug) AS x FROM {{slugs}})) SELECT id, array_to_string(list_filter(cs, lambda c, i: NOT list_contains(cs[1:i - 1], c)), ',') AS countries FROM d")
def _(slugs):
    return slugs.select("id", n.detect_countries(F.col("slug"), COUNTRY_NAMES).alias("countries"))


SECTORS = "concat_ws(',', " + ", ".join("CASE WHEN " + " OR ".join(f"contains(x, '{w}')" for w in words) + f" THEN '{name}' END" for name, words in n.SECTOR_KEYWORDS.items()) + ")"
KINDS = "CASE " + " ".join(f"WHEN regexp_matches(x, '{pattern}') THEN '{kind}'" for kind, pattern in n.EVENT_PATTERNS) + " ELSE 'political' END"
HITS = " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in n.HIGH_IMPACT_TERMS)


@query("f26_classify_slugs", inputs="slugs", oracle=f"WITH w AS (SELECT id, lower(slug) AS x FROM {{slugs}}) SELECT id, {SECTORS} AS sectors, {KINDS} AS event_type, CASE WHEN {HITS} >= 3 THEN 'critical' WHEN {HITS} >= 2 THEN 'high' WHEN {HITS} = 1 THEN 'medium' ELSE 'low' END AS severity FROM w")
def _(slugs):
    slug = F.col("slug")
    return slugs.select("id", n.detect_sectors(slug).alias("sectors"), n.classify_text(slug).alias("event_type"), n.severity_from_text(slug, F.lit("low")).alias("severity"))


@query("f26_classify_documents", inputs="texts", oracle=f"WITH w AS (SELECT doc_id, lower(text) AS x FROM {{texts}}) SELECT doc_id, {SECTORS} AS sectors, CASE WHEN {HITS} >= 3 THEN 'critical' WHEN {HITS} >= 2 THEN 'high' WHEN {HITS} = 1 THEN 'medium' ELSE 'low' END AS severity FROM w")
def _(texts):
    return texts.select("doc_id", n.detect_sectors(F.col("text")).alias("sectors"), n.severity_from_text(F.col("text"), F.lit("low")).alias("severity"))


@query("f27_impact_notes", inputs="geo_events", oracle=f"""
    SELECT id, CASE WHEN list_contains(sectors, 'energy') THEN '{n.ENERGY_MARKET}' WHEN event_type = 'sanctions' THEN '{n.SANCTIONS_MARKET}' WHEN event_type = 'conflict' AND list_has_any(countries, ['RU', 'UA', 'IR', 'IL', 'YE', 'SA']) THEN '{n.CONFLICT_MARKET}' END AS market,
    CASE WHEN event_type IN ('port_closure', 'maritime_incident') THEN '{n.ROUTE_SUPPLY}' WHEN list_contains(sectors, 'energy') THEN '{n.ENERGY_SUPPLY}' WHEN event_type = 'sanctions' THEN '{n.SANCTIONS_SUPPLY}' END AS supply FROM {{geo_events}}""")
def _(events):
    return events.select("id", n.impact_notes(F.col("event_type"), F.col("sectors"), F.col("countries")).alias("n")).select("id", "n.market", "n.supply")


@query("f28_title_from_url", inputs="coded_events", oracle="SELECT id, CASE CAST(id AS BIGINT) % 8 WHEN 0 THEN 'Tanker seized near hormuz by iranian forces' WHEN 1 THEN 'Missile strike hits oil refinery pipeline' WHEN 2 THEN 'Celebrity couple fights over custody' WHEN 3 THEN 'New sanctions hit russian shipping fleet' WHEN 4 THEN 'Port of odesa closed after attack' WHEN 6 THEN 'Parliament election protest in france' END AS title FROM {coded_events}")
def _(coded):
    return coded.select("id", n.title_from_url(F.col("url")).alias("title"))


@query("f29_decay", inputs="positions", oracle=f"""
    WITH g AS (SELECT id, abs(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 00:00:00')) / 3.6e9 AS h FROM {{positions}}) SELECT id, {r4("CASE WHEN h > 240 THEN 0 ELSE 1 - h / 240 END", "linear")}, {r4("CASE WHEN h > 240 THEN 0 ELSE 1 - 0.5 * (h / 240) END", "half")} FROM g""")
def _(positions):
    at = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    return positions.select("id", s.linear_decay(at, F.col("ts"), 240).alias("linear"), s.half_decay(at, F.col("ts"), 240).alias("half"))


@query("f31_fingerprint", inputs="positions", oracle="SELECT id, substr(sha1(concat(mmsi, '|', strftime(ts, '%Y-%m-%d'))), 1, 40) AS fingerprint FROM {positions}")
def _(positions):
    return positions.select("id", t.fingerprint(F.concat("mmsi", F.lit("|"), F.date_format("ts", "yyyy-MM-dd"))).alias("fingerprint"))


@query("f33_dwell", inputs="port_calls vessels", oracle=f"""
    SELECT c.id, round((epoch_us(departure) - epoch_us(arrival)) / 3.6e9, 2) AS dwell_h, {r4("abs(epoch_us(departure) - epoch_us(arrival)) / 8.64e10", "days")}, CASE WHEN contains(lower(ship_type), 'tanker') THEN CASE WHEN is_sanctioned THEN 'crude/products' ELSE 'petroleum/chemicals' END WHEN contains(lower(ship_type), 'cargo') THEN 'dry bulk/general cargo' END AS cargo
    FROM {{port_calls}} c JOIN {{vessels}} v ON v.id = c.vessel_id""")
def _(calls, vessels):
    joined = calls.join(vessels.select(F.col("id").alias("vessel_id"), "ship_type"), "vessel_id")
    return joined.select("id", v.dwell_hours(F.col("arrival"), F.col("departure")).alias("dwell_h"), v.days_between(F.col("arrival"), F.col("departure")).alias("days"), v.predicted_cargo(F.col("ship_type"), F.col("is_sanctioned")).alias("cargo"))


@query("f35_summary_text", inputs="candles", oracle=f"SELECT asset, exchange, {ts('ts')}, concat(exchange, ': ', asset, ' opened ', printf('%.2f', open), ' and closed ', printf('%.2f', close)) AS summary FROM {{candles}}")
def _(candles):
    return candles.select("asset", "exchange", "ts", F.format_string("%s: %s opened %.2f and closed %.2f", "exchange", "asset", "open", "close").alias("summary"))


@query("f36_name_ratio", inputs="listings fleet", oracle=f"SELECT l.id, {r4('1 - levenshtein(lower(l.name), lower(f.name)) / greatest(length(l.name), length(f.name))', 'ratio')} FROM {{listings}} l JOIN {{fleet}} f ON f.id = l.id")
def _(listings, fleet):
    joined = listings.select("id", "name").join(fleet.select("id", F.col("name").alias("other")), "id")
    return joined.select("id", t.name_ratio(F.lower("name"), F.lower("other")).alias("ratio"))


@query("f36_sequence_ratio", inputs="listings fleet")
def _(listings, fleet):
    joined = listings.select("id", "name").join(fleet.select("id", F.col("name").alias("other")), "id")
    return joined.select("id", t.name_ratio(F.lower("name"), F.lower("other"), "sequence").alias("ratio"))
