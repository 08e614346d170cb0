"""Registered loads: messages and pages derived from the given tables."""

from pyspark.sql import functions as F

from intel_spark.catalog.helpers import AS_OF, rings
from intel_spark.catalog.registry import query, r4, ts
from intel_spark.functions.vessel import lookup
from intel_spark.sources import ais, chain, lists, market, monitors, news, registry, sinks

COUNTRIES = {"panama": "PA", "liberia": "LR", "iran": "IR"}


def json(df, **columns):
    return df.select(F.to_json(F.struct(*[c.alias(k) for k, c in columns.items()])).alias("value"))


@query("l01_load_candles", inputs="candles", oracle=f"SELECT asset, exchange, {ts('ts')}, {r4('close')}, {r4('volume_usd')} FROM {{candles}}")
def _(candles):
    rows = candles.withColumn("ts_ms", F.unix_millis("ts"))
    old = market.candle_rows(rows.withColumn("close", F.lit(1.0)).withColumn("ingest", F.lit(1)))
    return market.load_candles(rows.withColumn("ingest", F.lit(2)), old).select("asset", "exchange", "ts", "close", "volume_usd")


@query("l02_load_commodities", inputs="candles", oracle=f"SELECT CASE asset WHEN 'click' THEN 'GOLD' WHEN 'view' THEN 'BRENT' ELSE upper(asset) END AS asset, {ts('ts')}, {r4('max(close)', 'close')} FROM {{candles}} GROUP BY asset, ts")
def _(candles):
    one = candles.groupBy("asset", "ts").agg(*[F.max(c).alias(c) for c in ("open", "high", "low", "close", "volume")])
    ticker = F.when(F.col("asset") == "click", "GC=F").when(F.col("asset") == "view", "BZ=F").otherwise(F.concat("asset", F.lit("=F")))
    rows = one.select(ticker.alias("ticker"), F.lit("1h").alias("timeframe"), F.unix_millis("ts").alias("ts_ms"), "open", "high", "low", "close", "volume", F.lit(1).alias("ingest"))
    return market.load_commodities(rows).select("asset", "ts", "close")


@query("l03_load_liquidations", inputs="liquidations", oracle=f"SELECT event_id, upper(asset) AS asset, side, {r4('price')}, {r4('price * (event_id % 5 + 1)', 'usd')} FROM {{liquidations}} WHERE asset <> 'view'")
def _(orders):
    q = (F.col("event_id") % 5 + 1).cast("double")
    o = F.struct(F.concat(F.upper("asset"), F.lit("USDT")).alias("s"), F.upper("side").alias("S"), F.col("price").cast("double").alias("p"), F.when(F.col("event_id") % 2 == 0, F.col("price")).otherwise(0).cast("double").alias("ap"), q.alias("q"), F.lit(0.0).alias("z"), F.col("event_id").alias("T"))
    out = market.load_liquidations(json(orders, o=o), ["ERROR", "CLICK", "SIGNUP", "PURCHASE"])
    return out.select(F.unix_millis("ts").alias("event_id"), "asset", "side", "price", "usd")


@query("l04_load_listing_csv", inputs="listings", oracle="""
    SELECT source_id, name, CASE entity_type WHEN 'vessel' THEN 'vessel' WHEN 'person' THEN 'person' ELSE 'company' END AS entity_type, array_to_string(programs, ',') AS programs, CASE WHEN id % 2 = 0 THEN concat(aliases[1], ',', aliases[2]) ELSE '' END AS aliases, substr(remarks, strpos(remarks, 'IMO ') + 4, 7) AS imo, CASE vessel_flag WHEN 'PA' THEN 'PA' WHEN 'LR' THEN 'LR' END AS vessel_flag FROM {listings}""")
def _(listings):
    flag = F.when(F.col("vessel_flag") == "PA", "Panama").when(F.col("vessel_flag") == "LR", "Liberia").otherwise("-0-")
    kind = F.when(F.col("entity_type") == "person", "individual").when(F.col("entity_type") == "vessel", "vessel").otherwise("-0-")
    sdn = listings.select(F.col("source_id").alias("ent_num"), "name", kind.alias("sdn_type"), F.array_join("programs", "] [").alias("program"), *[F.lit("-0-").alias(c) for c in ("title", "call_sign", "vess_type", "tonnage", "grt")], flag.alias("vess_flag"), F.lit("-0-").alias("vess_owner"), "remarks")
    alt = listings.where("id % 2 = 0").select(F.col("source_id").alias("ent_num"), F.lit("1").alias("alt_num"), F.lit("aka").alias("alt_type"), F.explode("aliases").alias("alt_name"))
    out = lists.load_listing_csv(sdn, alt, lookup(COUNTRIES))
    return out.select("source_id", "name", "entity_type", "programs", F.reverse(F.array_sort("aliases")).alias("aliases"), "imo", "vessel_flag")


@query("l05_load_listing_eu", inputs="listings", oracle="""
    SELECT source_id, CASE WHEN id % 3 = 0 THEN aliases[1] ELSE name END AS name, CASE WHEN entity_type = 'person' THEN 'person' ELSE 'company' END AS entity_type, array_to_string(list_sort(programs), ',') AS programs, strftime(designation_date, '%Y-%m-%d') AS designation_date, country FROM {listings}""")
def _(listings):
    alias = lambda n, strong, language: F.struct(n.alias("_wholeName"), F.lit(strong).alias("_strong"), language.alias("_nameLanguage"))
    english = F.when(F.col("id") % 3 == 0, "EN").otherwise("FR")
    names = F.array(alias(F.col("name"), "true", F.lit("")), alias(F.col("aliases")[0], "true", english), alias(F.col("aliases")[1], "false", F.lit("EN")))
    rule = F.transform("programs", lambda p: F.struct(p.alias("_programme"), F.date_format("designation_date", "yyyy-MM-dd").alias("_publicationDate")))
    records = listings.select(
        F.col("source_id").alias("_euReferenceNumber"), F.lit("x").alias("_logicalId"), names.alias("nameAlias"), F.struct(F.when(F.col("entity_type") == "person", "person").otherwise("enterprise").alias("_code")).alias("subjectType"),
        F.array(F.struct(F.lit("imo").alias("_identificationTypeCode"), F.col("imo").alias("_number"))).alias("identification"), rule.alias("regulation"), F.array(F.struct(F.col("country").alias("_countryIso2Code"))).alias("citizenship"), F.array(F.struct(F.lit("00").alias("_countryIso2Code"))).alias("address"), F.col("remarks").alias("remark"))
    return lists.load_listing_eu(records).select("source_id", "name", "entity_type", "programs", "designation_date", "country")


@query("l06_load_listing_un", inputs="listings", oracle="SELECT source_id, concat(name, ' ', aliases[2]) AS name, programs[1] AS programs, aliases[1] AS aliases, CASE WHEN id % 2 = 0 THEN 'IR' END AS country FROM {listings}")
def _(listings):
    place = F.when(F.col("id") % 2 == 0, "Iran").otherwise("Atlantis")
    none = F.lit(None).cast("string")
    records = listings.select(
        F.col("source_id").alias("DATAID"), F.lit("R").alias("REFERENCE_NUMBER"), F.col("name").alias("FIRST_NAME"), F.col("aliases")[1].alias("SECOND_NAME"), F.lit(" ").alias("THIRD_NAME"), none.alias("FOURTH_NAME"), F.col("programs")[0].alias("UN_LIST_TYPE"), F.lit("2020-01-01").alias("LISTED_ON"), F.col("remarks").alias("COMMENTS1"),
        F.array(F.struct(F.lit("nowhere").alias("VALUE"))).alias("NATIONALITY"), F.array(F.struct(F.col("aliases")[0].alias("ALIAS_NAME"))).alias("INDIVIDUAL_ALIAS"), F.array(F.struct(place.alias("COUNTRY"))).alias("INDIVIDUAL_ADDRESS"))
    return lists.load_listing_un(records, "INDIVIDUAL", lookup(COUNTRIES)).select("source_id", "name", "programs", "aliases", "country")


@query("l07_load_ais", inputs="positions", oracle=f"""
    WITH m AS (SELECT *, id % 6 = 0 AS st, CASE WHEN id % 6 = 0 THEN id END AS sid FROM {{positions}}), f AS (SELECT *, last_value(sid IGNORE NULLS) OVER (PARTITION BY mmsi ORDER BY date_trunc('second', ts), st ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM m)
    SELECT f.mmsi, {ts('f.ts', 'ts')}, {r4('f.lat', 'lat')}, s.call_sign, s.destination_st AS destination FROM f LEFT JOIN (SELECT id, call_sign, concat('D', CAST(id % 9 AS STRING)) AS destination_st FROM {{positions}}) s ON s.id = f.k WHERE NOT f.st""")
def _(positions):
    static = F.col("id") % 6 == 0
    meta = F.struct(F.col("mmsi").alias("MMSI"), F.coalesce("name", F.lit("")).alias("ShipName"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_utc"))
    report = F.struct(F.col("speed").alias("Sog"), F.col("course").alias("Cog"), F.col("heading").alias("TrueHeading"), F.lit(0).alias("NavigationalStatus"))
    facts = F.struct(F.col("name").alias("Name"), F.col("imo").alias("ImoNumber"), F.col("call_sign").alias("CallSign"), F.lit(80).alias("Type"), F.concat(F.lit("D"), (F.col("id") % 9).cast("string")).alias("Destination"), F.lit(7.5).alias("MaximumStaticDraught"))
    value = F.when(static, F.to_json(F.struct(F.lit("ShipStaticData").alias("MessageType"), meta.alias("MetaData"), F.struct(facts.alias("ShipStaticData")).alias("Message")))).otherwise(F.to_json(F.struct(F.lit("PositionReport").alias("MessageType"), meta.alias("MetaData"), F.struct(report.alias("PositionReport")).alias("Message"))))
    return ais.load_ais(positions.select(value.alias("value"))).select("mmsi", "ts", "lat", "call_sign", "destination")


@query("l07_load_station_feed", inputs="positions", oracle=f"SELECT mmsi, {ts("date_trunc('second', ts)", 'ts')}, {r4('lat')}, {r4('speed')}, name, imo FROM {{positions}}")
def _(positions):
    row = F.struct(F.col("mmsi").alias("MMSI"), F.col("lat").alias("LATITUDE"), F.col("lon").alias("LONGITUDE"), F.unix_seconds("ts").alias("TIME"), F.col("speed").alias("SOG"), F.col("course").alias("COG"), F.col("heading").alias("HEADING"), F.lit(0).alias("NAVSTAT"), F.concat("name", F.lit("  ")).alias("NAME"), F.coalesce("imo", F.lit("0")).alias("IMO"), F.col("call_sign").alias("CALLSIGN"), F.lit(80).alias("TYPE"))
    payload = F.concat(F.lit('[{"ERROR":false,"RECORDS":'), F.size("rows").cast("string"), F.lit("},"), F.to_json("rows"), F.lit("]"))
    payloads = positions.groupBy("vessel_id", F.to_date("ts").alias("day")).agg(F.collect_list(row).alias("rows")).select(payload.alias("value"))
    return ais.load_station_feed(payloads).select("mmsi", "ts", "lat", "speed", "name", "imo")


@query("l07_load_area_feed", inputs="positions", oracle=f"SELECT mmsi, {ts("date_trunc('second', ts)", 'ts')}, {r4('CASE WHEN floor(speed) <> 0 THEN floor(speed) / 10 END', 'speed')}, {r4('CASE WHEN course <> 0 THEN course END', 'course')}, flag FROM {{positions}} WHERE id % 10 <> 3")
def _(positions):
    at = F.when(F.col("id") % 10 == 3, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    row = F.struct(F.col("mmsi").alias("MMSI"), F.col("lat").alias("LAT"), F.col("lon").alias("LON"), at.alias("TIMESTAMP"), F.floor("speed").cast("string").alias("SPEED"), F.col("course").alias("COURSE"), F.col("flag").alias("FLAG"))
    payloads = positions.groupBy("vessel_id", F.to_date("ts").alias("day")).agg(F.collect_list(row).alias("rows")).select(F.to_json("rows").alias("value"))
    return ais.load_area_feed(payloads).select("mmsi", "ts", "speed", "course", "flag")


@query("l07_load_locations", inputs="positions vessels", oracle=f"""
    SELECT p.mmsi, {ts("date_trunc('second', p.ts)", 'ts')}, {r4('CASE WHEN p.course <> 360 THEN p.course END', 'course')}, v.name, {r4('v.length_m', 'length_m')} FROM {{positions}} p LEFT JOIN {{vessels}} v ON v.mmsi = p.mmsi WHERE p.ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 14400 MINUTE""")
def _(positions, vessels):
    features = positions.select("mmsi", "lat", "lon", F.unix_millis("ts").alias("ts_ms"), F.col("speed").alias("sog"), F.col("course").alias("cog"), "heading", F.lit(0).alias("nav_stat"))
    none = F.lit(None).cast("string")
    metadata = vessels.select("mmsi", "name", F.coalesce("imo", F.lit("0")).alias("imo"), none.alias("callSign"), F.lit(80).alias("shipType"), none.alias("destination"), F.lit(75).alias("draught"), (F.col("length_m") - 10).alias("referencePointA"), F.lit(10.0).alias("referencePointB"))
    return ais.load_locations(features, metadata, AS_OF, 14_400).select("mmsi", "ts", "course", "name", "length_m")


@query("l08_normalise_ais", inputs="positions", oracle=f"SELECT id, {r4('CASE WHEN heading * 2 < 511 THEN heading * 2 END', 'heading')}, {r4('CASE WHEN speed * 3 < 102.3 THEN speed * 3 END', 'speed')}, CASE WHEN flag = 'XX' THEN 'CY' ELSE flag END AS flag, name FROM {{positions}}")
def _(positions):
    raw = positions.withColumn("heading", F.col("heading") * 2).withColumn("speed", F.col("speed") * 3).withColumn("flag", F.when(F.col("flag") != "XX", F.col("flag"))).withColumn("name", F.concat("name", F.lit("@@ -")))
    prefixes = positions.select(F.substring("mmsi", 1, 3).alias("prefix")).distinct().withColumn("iso", F.lit("CY"))
    return ais.normalise_ais(raw, prefixes).select("id", "heading", "speed", "flag", "name")


@query("l09_load_coded_events", inputs="coded_events", oracle="SELECT id, root_code, lpad(base_code, 3, '0') AS base_code, mentions, CASE country WHEN 'RU' THEN 'RUX' WHEN 'BR' THEN 'BRX' END AS country, CASE actor1_country WHEN 'US' THEN 'USX' END AS actor1_country FROM {coded_events} WHERE CAST(id AS BIGINT) % 10 <> 0")
def _(coded):
    bad = F.col("id").cast("long") % 10 == 0
    values = {"GlobalEventID": F.col("id"), "Day": F.when(bad, "junk").otherwise(F.date_format("date", "yyyyMMdd")), "EventRootCode": F.regexp_replace("root_code", "^0", ""), "EventBaseCode": F.col("base_code"), "EventCode": F.col("base_code"), "NumMentions": F.col("mentions").cast("string"), "Actor1CountryCode": F.col("actor1_country"), "ActionGeo_CountryCode": F.col("country"), "SOURCEURL": F.col("url")}
    rows = coded.select(*[values.get(c, F.lit("")).alias(c) for c in news.EVENT_COLUMNS])
    places = coded.where(F.col("country").isin("RU", "BR")).select(F.col("country").alias("fips")).distinct().withColumn("iso", F.concat("fips", F.lit("X")))
    actors = coded.where(F.col("actor1_country") == "US").select(F.col("actor1_country").alias("iso3")).distinct().withColumn("iso", F.concat("iso3", F.lit("X")))
    return news.load_coded_events(rows, places, actors).select("id", "root_code", "base_code", "mentions", "country", "actor1_country")


@query("l10_load_articles", inputs="headlines", oracle=f"SELECT item_id, trim(title) AS title, {ts('ts')} FROM {{headlines}} WHERE lang = 'en' AND trim(title) <> ''")
def _(headlines):
    rows = headlines.select("title", F.col("item_id").cast("string").alias("url"), F.date_format("ts", "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.when(F.col("lang") == "en", "English").otherwise("Other").alias("language"), F.lit("d").alias("domain"))
    return news.load_articles(rows).select(F.col("url").cast("long").alias("item_id"), "title", "ts")


@query("l11_load_feed", inputs="headlines", oracle=f"SELECT CAST(item_id AS STRING) AS guid, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, {ts('ts', 'published')} FROM {{headlines}} WHERE trim(title) <> ''")
def _(headlines):
    rows = headlines.select(F.concat(F.lit("<b>"), "title", F.lit("</b>")).alias("title"), F.col("item_id").cast("string").alias("link"), F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss 'GMT'").alias("date"), F.lit("<p>x</p>").alias("summary"), F.lit("").alias("guid"))
    return news.load_feed(rows, "wire").select("guid", "title", "published")


@query("l12_html_links", inputs="web_pages", oracle="""
    WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)href="([^"]+)"[^>]*>(.*?)</a>', 1)) AS href, unnest(regexp_extract_all(html, '(?s)href="([^"]+)"[^>]*>(.*?)</a>', 2)) AS raw FROM {web_pages}) SELECT page_id, href, trim(regexp_replace(regexp_replace(raw, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS label FROM l""")
def _(pages):
    return news.html_links(pages).drop("position")


@query("l13_load_utxo", inputs="utxo_lines", oracle=f"SELECT tx_hash, {r4('sum(round(usd * 100)) / 1e8', 'total_out')}, count(*) AS outputs, count(DISTINCT dst) FILTER (dst <> 'P7') + count(DISTINCT src) AS counterparties FROM {{utxo_lines}} GROUP BY 1")
def _(lines):
    value = F.round(F.col("usd") * 100).cast("long")
    tx = lines.groupBy("tx_hash").agg(F.collect_list(F.struct(F.struct(F.col("src").alias("scriptpubkey_address"), value.alias("value")).alias("prevout"))).alias("vin"), F.collect_list(F.struct(F.col("dst").alias("scriptpubkey_address"), value.alias("value"))).alias("vout"))
    out = chain.load_utxo(json(tx, txid=F.col("tx_hash"), vin=F.col("vin"), vout=F.col("vout")), "P7")
    return out.select("tx_hash", "total_out", F.size("outputs").alias("outputs"), F.size("counterparties").alias("counterparties"))


@query("l14_load_native", inputs="transfers", oracle=f"SELECT tx_hash, {r4('floor(usd) * 4294967296 * 4294967296 / 1e18', 'amount')}, lower(src) AS src FROM {{transfers}} WHERE floor(usd) >= 50000")
def _(transfers):
    # sixteen zero digits after the number make it wider than 64 bits
    wide = F.concat(F.lit("0x"), F.lower(F.hex(F.floor("usd").cast("long"))), F.lit("0" * 16))
    blocks = transfers.groupBy(F.to_date("ts").alias("day")).agg(F.collect_list(F.struct(F.col("tx_hash").alias("hash"), F.col("src").alias("from"), F.col("dst").alias("to"), wide.alias("value"))).alias("transactions"))
    out = chain.load_native(json(blocks, number=F.lit("0x10"), timestamp=F.lit("0x5f5e100"), transactions=F.col("transactions")), 50000 * 2.0**64 / 1e18)
    return out.select("tx_hash", "amount", "src")


@query("l15_load_token_logs", inputs="transfers wallet_labels", oracle=f"SELECT concat(tx_hash, ':', '3') AS tx_hash, concat('0x', lpad(lower(src), 40, '0')) AS src, {r4('floor(usd)', 'amount')} FROM {{transfers}} t WHERE src IN (SELECT address FROM {{wallet_labels}} WHERE wallet_type = 'sanctioned')")
def _(transfers, labels):
    pad = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(c), 64, "0"))
    log = json(transfers, address=F.lit("0xAA"), topics=F.array(F.lit(chain.TRANSFER_TOPIC), pad(F.col("src")), pad(F.col("dst"))), data=F.concat(F.lit("0x"), F.lpad(F.hex(F.floor("usd").cast("long")), 64, "0")), transactionHash=F.col("tx_hash"), logIndex=F.lit("0x3"), blockNumber=F.lit("0x1"))
    contracts = labels.select(F.lit("0xaa").alias("address"), F.lit("USDC").alias("symbol"), F.lit(6).alias("decimals")).distinct()
    watched = labels.where("wallet_type = 'sanctioned' AND address LIKE 'W%'").select(F.concat(F.lit("0x"), F.lpad(F.lower("address"), 40, "0")).alias("address"))
    return chain.load_token_logs(log, contracts, watched).select("tx_hash", "src", F.round(F.col("amount") * 1e6).alias("amount"))


@query("l16_load_tron", inputs="transfers", oracle=f"SELECT tx_hash, CASE WHEN chain = 'bitcoin' THEN 'USDT' ELSE 'TRX' END AS token, {r4('floor(usd)', 'amount')} FROM {{transfers}}")
def _(transfers):
    units = F.floor("usd").cast("string")
    tokens = json(transfers.where("chain = 'bitcoin'"), transaction_id=F.col("tx_hash"), block_ts=F.unix_millis("ts"), from_address=F.col("src"), to_address=F.col("dst"), contract_address=F.lit(chain.TRON_USDT), quant=units, tokenInfo=F.struct(F.lit("X").alias("tokenAbbr"), F.lit(6).alias("tokenDecimal")))
    native = json(transfers.where("chain = 'ethereum'"), hash=F.col("tx_hash"), timestamp=F.unix_millis("ts"), ownerAddress=F.col("src"), toAddress=F.col("dst"), contractType=F.lit(1), contractData=F.struct(units.alias("amount")))
    return chain.load_tron(tokens, native).select("tx_hash", "token", F.round(F.col("amount") * 1e6).alias("amount"))


@query("l16_load_tron_balances", inputs="transfers", oracle=f"SELECT src AS address, chain AS token, {r4('sum(floor(usd))', 'balance')} FROM {{transfers}} GROUP BY 1, 2")
def _(transfers):
    item = F.struct(F.col("chain").alias("tokenAbbr"), F.floor("usd").cast("string").alias("balance"), F.lit(6).alias("tokenDecimal"))
    out = chain.load_tron_balances(json(transfers.groupBy("src").agg(F.collect_list(item).alias("b")), address=F.col("src"), trc20token_balances=F.col("b")))
    return out.select("address", "token", F.round(F.col("balance") * 1e6).alias("balance"))


def lei_messages(companies):
    named = lambda n: F.struct(n.alias("name"))
    entity = F.struct(named(F.col("name")).alias("legalName"), F.array(named(F.lower("name"))).alias("otherNames"), F.struct(F.col("country"), F.lit("City").alias("city"), F.lit("Z1").alias("postalCode"), F.array(F.lit("1 Road")).alias("addressLines")).alias("legalAddress"), F.col("country").alias("jurisdiction"), F.col("entity_status").alias("status"), F.date_format("creation_date", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationDate"))
    attrs = F.struct(F.concat(F.lit("L"), F.col("id").cast("string")).alias("lei"), entity.alias("entity"), F.struct(F.col("registration_status").alias("status")).alias("registration"))
    up = F.when(F.col("id") > 0, F.concat(F.lit("L"), F.floor(F.col("id") / 3).cast("string")))
    gaps = F.when(F.col("parent_exception").isNotNull(), F.array(F.struct(F.lit("direct").alias("kind"), F.lit("c").alias("category"), F.col("parent_exception").alias("reason"))))
    return json(companies, id=F.lit("x"), attributes=attrs, relationships=F.struct(up.alias("directParent")), exceptions=gaps)


@query("l17_load_lei", inputs="companies", oracle=f"SELECT concat('L', CAST(id AS STRING)) AS lei, name, lower(name) AS other_names, country, registration_status, '1 Road, Z1' AS address, {ts('creation_date')} FROM {{companies}}")
def _(companies):
    return registry.load_lei(lei_messages(companies)).select("lei", "name", "other_names", "country", "registration_status", "address", "creation_date")


@query("l17_lei_edges", inputs="companies", oracle="SELECT concat('L', CAST(id AS STRING)) AS child, concat('L', CAST(CAST(floor(id / 3) AS BIGINT) AS STRING)) AS parent, 'direct' AS kind FROM {companies} WHERE id > 0")
def _(companies):
    return registry.lei_edges(lei_messages(companies))


@query("l17_lei_exceptions", inputs="companies", oracle="SELECT concat('L', CAST(id AS STRING)) AS lei, parent_exception AS reason FROM {companies} WHERE parent_exception IS NOT NULL")
def _(companies):
    return registry.lei_exceptions(lei_messages(companies)).select("lei", "reason")


@query("l18_load_edgar", inputs="companies", oracle="SELECT CASE WHEN id = 0 THEN '0000000000' ELSE CAST(id AS STRING) END AS cik, name, concat('1 Road, ', country) AS business_address FROM {companies}")
def _(companies):
    address = F.struct(F.lit("business").alias("_type"), F.lit("1 Road").alias("street1"), F.lit("").alias("street2"), F.lit(None).cast("string").alias("city"), F.col("country").alias("state"), F.lit(None).cast("string").alias("zip"))
    rows = companies.select(F.lpad(F.col("id").cast("string"), 10, "0").alias("cik"), F.concat("name", F.lit("  ")).alias("conformed-name"), F.lit("x").alias("assigned-sic-desc"), F.col("country").alias("state-location"), F.struct(F.array(address).alias("address")).alias("addresses"))
    return registry.load_edgar(rows).select("cik", "name", "business_address")


@query("l19_load_breaches", inputs="posts", oracle=f"""
    SELECT CASE WHEN post_id % 2 = 0 THEN concat('grp:', victim, ':', strftime(ts, '%Y-%m-%d')) ELSE concat('B', CAST(post_id AS STRING)) END AS source_id, victim, CASE WHEN post_id % 2 = 0 THEN country END AS country, {ts('ts', 'date')}, CASE WHEN post_id % 2 = 1 THEN records END AS records FROM {{posts}}""")
def _(posts):
    a = json(posts.where("post_id % 2 = 0"), victim=F.col("victim"), group_name=F.lit("grp"), discovered=F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), domain=F.col("domain"), country=F.lower("country"))
    b = json(posts.where("post_id % 2 = 1"), Name=F.concat(F.lit("B"), F.col("post_id").cast("string")), Title=F.col("victim"), BreachDate=F.date_format("ts", "yyyy-MM-dd"), PwnCount=F.col("records"))
    return monitors.load_breaches(a, b).select("source_id", "victim", "country", "date", "records")


@query("l20_load_legal", inputs="posts headlines", oracle=f"""
    SELECT 'courtlistener' AS source, CAST(post_id AS STRING) AS source_id, {ts('ts')}, CAST(NULL AS DOUBLE) AS penalty_usd FROM {{posts}} UNION ALL SELECT 'ofac_enforcement', concat(strftime(ts, '%m/%d/%Y'), ':', victim), {ts('ts')}, CAST(post_id * 1000 AS DOUBLE) FROM {{posts}}
    UNION ALL SELECT 'doj', CAST(item_id AS STRING), {ts('ts')}, NULL FROM {{headlines}} WHERE contains(lower(title), 'oil') OR contains(lower(title), 'iran') OR contains(lower(title), 'russia') OR contains(lower(title), 'tanker') OR contains(lower(title), 'crypto') OR contains(lower(title), 'sanction') OR contains(lower(title), 'evasion') OR contains(lower(title), 'ofac')""")
def _(posts, headlines):
    dockets = json(posts, docket_id=F.col("post_id").cast("string"), caseName=F.col("victim"), dateFiled=F.date_format("ts", "yyyy-MM-dd"))
    cell = lambda c: F.concat(F.lit("<td>"), c, F.lit("</td>"))
    html = F.concat(F.lit("<table><tr><th>h</th></tr><tr>"), cell(F.date_format("ts", "MM/dd/yyyy")), cell(F.concat(F.lit("<b>"), "victim", F.lit("</b>"))), cell(F.lit("1")), cell(F.format_string("$%,d", F.col("post_id") * 1000)), F.lit("</tr></table>"))
    pages = posts.select(F.col("post_id").alias("page_id"), html.alias("html"))
    feed = headlines.select("title", F.lit("").alias("summary"), F.lit("http://x").alias("link"), F.col("item_id").cast("string").alias("guid"), F.col("ts").alias("published"))
    return monitors.load_legal(dockets, pages, feed).select("source", "source_id", "ts", "penalty_usd")


@query("l21_load_psc", inputs="psc", oracle=f"""
    SELECT CASE WHEN event_type = 'ban' THEN concat('ban:', source_id) WHEN source = 'tokyo_mou' THEN concat('9000000', ':', strftime(event_date, '%Y-%m-%d')) ELSE source_id END AS source_id, event_type, ship_name, CASE WHEN id % 2 = 0 THEN 'PA' END AS flag, {ts('event_date')}, CASE WHEN event_type <> 'ban' AND source = 'tokyo_mou' THEN 2 ELSE -1 END AS faults FROM {{psc}}""")
def _(psc):
    flag = F.when(F.col("id") % 2 == 0, "Panama").otherwise("Nowhere")
    day = F.date_format("event_date", "yyyy-MM-dd")
    ban, tokyo = F.col("event_type") == "ban", F.col("source") == "tokyo_mou"
    named = F.struct(flag.alias("description"))
    detentions = json(psc.where(~ban & ~tokyo), id=F.col("source_id"), imoNumber=F.col("imo"), shipName=F.col("ship_name"), flag=named, detentionDate=day)
    bans = json(psc.where(ban), id=F.col("source_id"), imoNumber=F.col("imo"), shipName=F.col("ship_name"), flag=named, banDate=day)
    cells = [F.lit("1"), F.lit("9000000"), F.col("ship_name"), flag, F.lit("1999"), F.lit("1,000"), F.lit("t"), F.lit("c"), F.lit("r"), F.lit("co"), F.lit("Port, Iran"), day, F.lit("-"), F.lit("fault one<br/>fault <i>two</i>")]
    html = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    pages = psc.where(~ban & tokyo).select(F.col("id").alias("page_id"), html.alias("html"))
    return monitors.load_psc(detentions, bans, pages, lookup(COUNTRIES)).select("source_id", "event_type", "ship_name", "flag", "event_date", F.coalesce(F.size("deficiencies"), F.lit(-1)).alias("faults"))


@query("l22_load_adsb", inputs="sightings", oracle=f"SELECT id, {ts('ts')}, CASE WHEN id % 4 = 0 THEN NULL ELSE CAST(1000 + id AS DOUBLE) END AS altitude_ft, id % 4 = 0 AS on_ground, callsign FROM {{sightings}}")
def _(sightings):
    a = F.struct(F.col("registration").alias("r"), F.col("id").cast("string").alias("hex"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"), F.when(F.col("id") % 4 == 0, "ground").otherwise((1000 + F.col("id")).cast("string")).alias("alt_baro"), F.concat("callsign", F.lit("  ")).alias("flight"), F.lit(5.0).alias("seen"))
    messages = json(sightings, now=F.unix_millis("ts") + 5000, ac=F.array(a))
    return monitors.load_adsb(messages).select(F.col("icao_hex").cast("long").alias("id"), "ts", "altitude_ft", "on_ground", "callsign")


@query("l22_load_states", inputs="sightings", oracle=f"SELECT id, {ts('ts')}, {r4('round(id * 3.28084e0)', 'altitude_ft')}, {r4('round((id % 300) * 1.94384e0, 1)', 'speed')}, callsign FROM {{sightings}}")
def _(sightings):
    none = F.lit(None).cast("string")
    s = F.array(F.col("id").cast("string"), F.concat("callsign", F.lit(" ")), F.lit("IR"), none, F.unix_seconds("ts").cast("string"), F.lit("2"), F.lit("1"), F.col("id").cast("string"), F.lit("false"), (F.col("id") % 300).cast("string"), F.lit("90"))
    return monitors.load_states(json(sightings, time=F.lit(0), states=F.array(s))).select(F.col("icao_hex").cast("long").alias("id"), "ts", "altitude_ft", "speed", "callsign")


@query("l23_domain_footprint", inputs="domains domain_checks", oracle="""
    WITH c AS (SELECT domain, count(*) AS n FROM {domain_checks} GROUP BY 1) SELECT d.domain, registrar, coalesce(n, 0) AS certificate_count, CASE WHEN n IS NULL THEN '' ELSE concat(d.domain, ',www.', d.domain) END AS certificate_names, upper(hosting_country) AS hosting_country FROM {domains} d LEFT JOIN c ON c.domain = d.domain""")
def _(domains, checks):
    certs = checks.select("domain", F.concat(F.lit("*."), "domain", F.lit("\nWWW."), "domain", F.lit("\nother.org")).alias("name_value"))
    rdap = domains.select("domain", "registrar")
    ips = domains.select("domain", F.lit("AS1").alias("asn"), F.lit("org").alias("asn_org"), F.lower("hosting_country").alias("country"))
    return monitors.load_domain_footprint(rdap, certs, ips).select("domain", "registrar", "certificate_count", "certificate_names", "hosting_country")


@query("l25_export_rows", inputs="listings", oracle="SELECT id, array_to_string(programs, ';') AS programs, array_to_string(aliases, ';') AS aliases FROM {listings}")
def _(listings):
    return sinks.export_rows(listings.select("id", "programs", "aliases"))


@query("l26_geojson", inputs="vessels", oracle="SELECT id, 'Point' AS kind, name FROM {vessels}")
def _(vessels):
    out = sinks.to_geojson(vessels, "lon", "lat", ["id", "name"])
    return out.select(F.get_json_object("feature", "$.properties.id").cast("long").alias("id"), F.get_json_object("feature", "$.geometry.type").alias("kind"), F.get_json_object("feature", "$.properties.name").alias("name"))


@query("l26_polygons_geojson", inputs="zones", oracle="SELECT name, unnest(CASE WHEN kind = 'sts_hub' THEN ['sts_hubs'] WHEN kind = 'war_zone' THEN ['other'] ELSE ['eu', 'ofac'] END) AS authority, 'Polygon' AS shape FROM {zones}")
def _(zones):
    named = rings(zones).withColumn("authorities", F.when(F.col("kind") == "war_zone", F.array().cast("array<string>")).otherwise(F.array(F.lit("EU"), F.lit("OFAC"))))
    return sinks.polygons_geojson(named).select("name", "authority", F.get_json_object("feature", "$.geometry.type").alias("shape"))


@query("l27_audit_rows", inputs="breaches", oracle=f"SELECT id, vessel_id, 'breach_detected' AS action, concat(authority, ' ', listed) AS rationale FROM {{breaches}}")
def _(breaches):
    out = sinks.audit_rows(breaches, "breach_detected", F.concat_ws(" ", "authority", "listed"), as_of=AS_OF, vessel="vessel_id")
    return out.select(F.get_json_object("evidence", "$.id").cast("long").alias("id"), "vessel_id", "action", "rationale")
