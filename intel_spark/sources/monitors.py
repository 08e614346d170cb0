"""Breach postings, legal events, port inspections, aircraft and domain footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.functions.text import contains_any
from intel_spark.sources.chain import parsed
from intel_spark.sources.news import strip_tags

RANSOM_JSON = "victim string, post_title string, group_name string, group string, discovered string, attackdate string, published string, domain string, website string, country string, activity string, description string"
CATALOGUE_JSON = "Name string, Title string, Domain string, BreachDate string, Description string, PwnCount long, DataClasses array<string>"
DOCKET_JSON = "docket_id string, cluster_id string, caseName string, caseNameFull string, docket_absolute_url string, absolute_url string, court string, dateFiled string, docketNumber string, suitNature string, cause string, party array<string>"
DETENTION_JSON = "id string, imoNumber string, shipName string, flag struct<description:string>, shipType struct<description:string>, detentionPort struct<name:string,country:struct<description:string>>, detentionDate string"
BAN_JSON = "id string, imoNumber string, shipName string, flag struct<description:string>, shipType struct<description:string>, banDate string, startDate string, date string, ismCompany struct<name:string>"
ADSB_JSON = "now long, ac array<struct<r:string,hex:string,lat:double,lon:double,alt_baro:string,gs:double,track:double,flight:string,seen_pos:double,seen:double>>"
STATES_JSON = "time long, states array<array<string>>"
# Words that make a prosecutor's release relevant, and what kind it is.
PROSECUTION_WORDS = ["sanction", "export control", "ofac", "money launder", "iran", "russia", "north korea", "oil", "tanker", "crypto", "evasion"]
INDICTMENT_WORDS = ["indict", "charged", "arrested", "extradit"]
SETTLEMENT_WORDS = ["settle", "plead", "sentenced", "forfeit", "penalty"]


def _text(c) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def any_date(text: Column) -> Column:
    """Date in any of the feeds' four spellings."""
    return F.coalesce(
        F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.substring(text, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd")), F.try_to_timestamp(F.substring(text, 1, 10), F.lit("MM/dd/yyyy"))
    )


def load_breaches(ransom: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Both posting sources under one schema; nameless rows dropped."""
    a = parsed(ransom, RANSOM_JSON)
    name, when = F.trim(F.coalesce("victim", "post_title", F.lit(""))), F.coalesce(_text("discovered"), _text("attackdate"))
    group = F.coalesce(_text("group_name"), _text("group"))
    posts = a.select(
        F.lit("ransomware_live").alias("source"), F.concat_ws(":", F.coalesce(group, F.lit("?")), name, F.coalesce(F.substring(when, 1, 10), F.lit(""))).alias("source_id"), name.alias("victim"), F.coalesce(_text("domain"), _text("website")).alias("domain"),
        F.nullif(F.substring(F.upper(F.trim("country")), 1, 3), F.lit("")).alias("country"), _text("activity").alias("sector"), group.alias("actor"), any_date(F.coalesce(when, "published")).alias("date"),
    ).where(F.col("victim") != "")
    b = parsed(catalogue, CATALOGUE_JSON).withColumn("key", F.coalesce(_text("Name"), _text("Title"))).where(F.col("key").isNotNull())
    rows = b.select(F.lit("hibp").alias("source"), F.col("key").alias("source_id"), F.coalesce("Title", "key").alias("victim"), _text("Domain").alias("domain"), any_date(F.col("BreachDate")).alias("date"), F.col("PwnCount").alias("records"), F.col("DataClasses").alias("data_classes"))
    return posts.unionByName(rows, allowMissingColumns=True)


def html_rows(pages: DataFrame, cell: str = "td") -> DataFrame:
    """Table rows of whole pages (page_id, html): raw cells and tag-free cells."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("(?s)<tr[^>]*>(.*?)</tr>"), 1)).alias("row_no", "row"))
    raw = F.regexp_extract_all("row", F.lit(f"(?s)<{cell}[^>]*>(.*?)</{cell}>"), 1)
    return rows.select("page_id", "row_no", "row", raw.alias("raw")).withColumn("cells", F.transform("raw", strip_tags))


def load_penalties(pages: DataFrame) -> DataFrame:
    """Penalty table rows that begin with a date."""
    rows = html_rows(pages).where((F.size("cells") >= 4) & F.col("cells")[0].rlike(r"^\d{2}/\d{2}/\d{4}"))
    cell = lambda i: F.col("cells")[i]
    link = F.regexp_extract("row", 'href="([^"]+)"', 1)
    return rows.select(
        F.lit("ofac_enforcement").alias("source"), F.concat_ws(":", cell(0), cell(1)).alias("source_id"), F.concat(F.lit("OFAC enforcement: "), cell(1), F.lit(" ("), cell(0), F.lit(")")).alias("title"), F.nullif(link, F.lit("")).alias("url"), any_date(cell(0)).alias("ts"), F.lit("enforcement").alias("event_type"),
        F.nullif(F.regexp_replace(cell(3), r"[^\d.]", ""), F.lit("")).try_cast("double").alias("penalty_usd"), F.array(cell(1)).alias("parties"),
    )


def load_dockets(messages: DataFrame) -> DataFrame:
    d = parsed(messages, DOCKET_JSON).withColumn("key", F.coalesce("docket_id", "cluster_id")).where(F.col("key").isNotNull())
    return d.select(
        F.lit("courtlistener").alias("source"), F.col("key").alias("source_id"), F.coalesce(_text("caseName"), "caseNameFull", F.lit("")).alias("title"), F.coalesce("docket_absolute_url", "absolute_url").alias("url"), any_date(F.col("dateFiled")).alias("ts"), F.lit("docket").alias("event_type"),
        F.lit(None).cast("double").alias("penalty_usd"), F.coalesce("party", F.array().cast("array<string>")).alias("parties"),
    )


def load_prosecutions(feed: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    kept = feed.where(contains_any(text, keywords or PROSECUTION_WORDS))
    kind = F.when(contains_any(text, INDICTMENT_WORDS), "indictment").when(contains_any(text, SETTLEMENT_WORDS), "settlement").otherwise("press_release")
    return kept.select(F.lit("doj").alias("source"), F.coalesce(_text("guid"), "link").alias("source_id"), "title", F.col("link").alias("url"), F.col("published").alias("ts"), kind.alias("event_type"), F.lit(None).cast("double").alias("penalty_usd"), F.array().cast("array<string>").alias("parties"))


def load_legal(dockets: DataFrame, pages: DataFrame, feed: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """Dockets, penalties and prosecutions in one table."""
    return load_dockets(dockets).unionByName(load_penalties(pages)).unionByName(load_prosecutions(feed, keywords))


def _iso(name: Column, countries: Column) -> Column:
    return F.try_element_at(countries, F.lower(F.trim(name)))


def load_detentions(messages: DataFrame, countries: Column) -> DataFrame:
    d = parsed(messages, DETENTION_JSON)
    return d.select(F.lit("paris_mou").alias("source"), F.coalesce("id", F.concat_ws(":", "imoNumber", "detentionDate")).alias("source_id"), F.lit("detention").alias("event_type"), _text("imoNumber").alias("imo"), F.trim(F.coalesce("shipName", F.lit(""))).alias("ship_name"), _iso(F.col("flag.description"), countries).alias("flag"),
                    _text("shipType.description").alias("ship_type"), _text("detentionPort.name").alias("port"), _iso(F.col("detentionPort.country.description"), countries).alias("port_country"), any_date(F.col("detentionDate")).alias("event_date"))


def load_bans(messages: DataFrame, countries: Column) -> DataFrame:
    d = parsed(messages, BAN_JSON)
    return d.select(F.lit("paris_mou").alias("source"), F.concat(F.lit("ban:"), F.coalesce("id", "imoNumber")).alias("source_id"), F.lit("ban").alias("event_type"), _text("imoNumber").alias("imo"), F.trim(F.coalesce("shipName", F.lit(""))).alias("ship_name"), _iso(F.col("flag.description"), countries).alias("flag"),
                    _text("shipType.description").alias("ship_type"), any_date(F.coalesce("banDate", "startDate", "date")).alias("event_date"), _text("ismCompany.name").alias("company"))


def load_detention_table(pages: DataFrame, countries: Column) -> DataFrame:
    """HTML detention list: rows of thirteen cells or more whose second is an IMO number."""
    rows = html_rows(pages).where(F.size("cells") >= 13).where(F.col("cells")[1].rlike(r"^\d{7}$"))
    cell = lambda i: F.col("cells")[i]
    faults = F.transform(F.split(F.coalesce(F.try_element_at("raw", F.lit(14)), F.lit("")), r"<br\s*/?>|\n"), strip_tags)
    place = cell(10)
    country = F.when(F.contains(place, F.lit(",")), _iso(F.substring_index(place, ",", -1), countries))
    return rows.select(
        F.lit("tokyo_mou").alias("source"), F.concat_ws(":", cell(1), cell(11)).alias("source_id"), F.lit("detention").alias("event_type"), cell(1).alias("imo"), cell(2).alias("ship_name"), _iso(cell(3), countries).alias("flag"), _text(cell(6)).alias("ship_type"), _text(F.substring_index(place, ",", 1)).alias("port"), country.alias("port_country"),
        any_date(cell(11)).alias("event_date"), any_date(cell(12)).alias("release_date"), _text(cell(9)).alias("company"), _text(cell(7)).alias("class_society"), F.nullif(F.regexp_replace(cell(5), r"[^\d.]", ""), F.lit("")).try_cast("double").alias("gross_tonnage"), F.substring(cell(4), 1, 4).try_cast("int").alias("year_built"),
        F.filter(faults, lambda d: d != "").alias("deficiencies"),
    )


def load_psc(detentions: DataFrame, bans: DataFrame, pages: DataFrame, countries: Column) -> DataFrame:
    """Inspections of every source in one table."""
    out = load_detention_table(pages, countries)
    for part in (load_detentions(detentions, countries), load_bans(bans, countries)):
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def load_adsb(messages: DataFrame) -> DataFrame:
    """Aircraft list shape: "ground" altitude means on the ground without one; time is now less the age of the fix."""
    rows = parsed(messages, ADSB_JSON).select("now", F.explode("ac").alias("a"))
    ground = F.coalesce(F.col("a.alt_baro") == "ground", F.lit(False))
    age = F.coalesce(F.nullif("a.seen_pos", F.lit(0.0)), "a.seen", F.lit(0.0))
    return rows.select(
        _text("a.r").alias("registration"), F.lower("a.hex").alias("icao_hex"), F.timestamp_millis((F.col("now") - age * 1000).cast("long")).alias("ts"), F.col("a.lat").alias("lat"), F.col("a.lon").alias("lon"), F.when(~ground, F.col("a.alt_baro").try_cast("double")).alias("altitude_ft"), F.col("a.gs").alias("speed"),
        F.col("a.track").alias("heading"), _text("a.flight").alias("callsign"), ground.alias("on_ground"), F.lit("adsb_lol").alias("source"))


def load_states(messages: DataFrame) -> DataFrame:
    """Positional array shape: metres to feet, metres per second to knots."""
    rows = parsed(messages, STATES_JSON).select("time", F.explode("states").alias("s"))
    item = lambda i: F.col("s")[i]
    number = lambda i: item(i).try_cast("double")
    return rows.select(
        F.lit(None).cast("string").alias("registration"), item(0).alias("icao_hex"), F.timestamp_seconds(F.coalesce(item(4).try_cast("long"), "time")).alias("ts"), number(6).alias("lat"), number(5).alias("lon"), F.round(number(7) * 3.28084).alias("altitude_ft"), F.round(number(9) * 1.94384, 1).alias("speed"), number(10).alias("heading"),
        _text(item(1)).alias("callsign"), F.coalesce(item(8) == "true", F.lit(False)).alias("on_ground"), F.lit("opensky").alias("source"))


def load_domain_footprint(rdap: DataFrame, certificates: DataFrame, ips: DataFrame) -> DataFrame:
    """Per domain: registration, hosting, certificate count and the distinct names below it.

    ``rdap`` (domain, registrar, registered_at, expires_at, nameservers, is_live), ``certificates`` (domain, name_value with one
    name per line), ``ips`` (domain, asn, asn_org, country).
    """
    counts = certificates.groupBy("domain").agg(F.count("*").alias("certificate_count"))
    name = F.regexp_replace(F.lower(F.trim("n")), r"^[*.]+", "")
    names = certificates.select("domain", F.explode(F.split("name_value", "\n")).alias("n")).select("domain", name.alias("n")).where(F.endswith("n", F.col("domain"))).distinct()
    listed = names.groupBy("domain").agg(F.array_sort(F.collect_list("n")).alias("certificate_names"))
    host = ips.groupBy("domain").agg(F.min(F.struct("asn", "asn_org", F.upper("country").alias("hosting_country"))).alias("h"))
    return rdap.join(counts, "domain", "left").join(listed, "domain", "left").join(host, "domain", "left").select(
        *rdap.columns, F.coalesce("certificate_count", F.lit(0)).alias("certificate_count"), F.coalesce("certificate_names", F.array().cast("array<string>")).alias("certificate_names"), "h.asn", "h.asn_org", "h.hosting_country")
