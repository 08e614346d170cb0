"""Coded events, articles, feeds and action pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The event export's columns, in file order.
EVENT_COLUMNS = (
    "GlobalEventID Day MonthYear Year FractionDate Actor1Code Actor1Name Actor1CountryCode Actor1KnownGroupCode Actor1EthnicCode Actor1Religion1Code Actor1Religion2Code Actor1Type1Code Actor1Type2Code Actor1Type3Code "
    "Actor2Code Actor2Name Actor2CountryCode Actor2KnownGroupCode Actor2EthnicCode Actor2Religion1Code Actor2Religion2Code Actor2Type1Code Actor2Type2Code Actor2Type3Code IsRootEvent EventCode EventBaseCode EventRootCode QuadClass "
    "GoldsteinScale NumMentions NumSources NumArticles AvgTone Actor1Geo_Type Actor1Geo_FullName Actor1Geo_CountryCode Actor1Geo_ADM1Code Actor1Geo_ADM2Code Actor1Geo_Lat Actor1Geo_Long Actor1Geo_FeatureID "
    "Actor2Geo_Type Actor2Geo_FullName Actor2Geo_CountryCode Actor2Geo_ADM1Code Actor2Geo_ADM2Code Actor2Geo_Lat Actor2Geo_Long Actor2Geo_FeatureID ActionGeo_Type ActionGeo_FullName ActionGeo_CountryCode ActionGeo_ADM1Code "
    "ActionGeo_ADM2Code ActionGeo_Lat ActionGeo_Long ActionGeo_FeatureID DATEADDED SOURCEURL"
).split()


def read_coded_events(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text without quoting; malformed rows are dropped."""
    return spark.read.schema(", ".join(f"{c} string" for c in EVENT_COLUMNS)).option("sep", "\t").option("quote", "").option("mode", "DROPMALFORMED").csv(path)


def load_coded_events(rows: DataFrame, places: DataFrame, actors: DataFrame) -> DataFrame:
    """Codes padded, places mapped by (fips, iso), actors by (iso3, iso); rows with unreadable numbers drop out."""
    number = lambda c, kind: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("0")).try_cast(kind)
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    typed = rows.select(
        F.col("GlobalEventID").alias("id"), F.try_to_timestamp("Day", F.lit("yyyyMMdd")).alias("date"), F.lpad("EventRootCode", 2, "0").alias("root_code"), F.lpad("EventBaseCode", 3, "0").alias("base_code"), F.when(F.col("EventCode") != "", F.lpad("EventCode", 3, "0")).otherwise("").alias("event_code"),
        number("QuadClass", "int").alias("quad"), number("GoldsteinScale", "double").alias("goldstein"), number("NumMentions", "int").alias("mentions"), number("NumSources", "int").alias("sources"), number("NumArticles", "int").alias("articles"), number("AvgTone", "double").alias("tone"),
        text("Actor1Name").alias("actor1"), F.col("Actor1CountryCode").alias("_a1"), text("Actor2Name").alias("actor2"), F.col("Actor2CountryCode").alias("_a2"), text("ActionGeo_FullName").alias("location"), F.col("ActionGeo_CountryCode").alias("_g"),
        text("ActionGeo_Lat").try_cast("double").alias("lat"), text("ActionGeo_Long").try_cast("double").alias("lon"), F.col("SOURCEURL").alias("url"), F.try_to_timestamp(text("DATEADDED"), F.lit("yyyyMMddHHmmss")).alias("added"),
    )
    good = typed.where(F.col("date").isNotNull() & F.col("quad").isNotNull() & F.col("goldstein").isNotNull() & F.col("mentions").isNotNull() & F.col("sources").isNotNull() & F.col("articles").isNotNull() & F.col("tone").isNotNull())
    a1, a2 = actors.select(F.col("iso3").alias("_a1"), F.col("iso").alias("actor1_country")), actors.select(F.col("iso3").alias("_a2"), F.col("iso").alias("actor2_country"))
    return good.join(a1, "_a1", "left").join(a2, "_a2", "left").join(places.select(F.col("fips").alias("_g"), F.col("iso").alias("country")), "_g", "left").drop("_a1", "_a2", "_g")


def load_articles(rows: DataFrame) -> DataFrame:
    """English articles with a title and a link."""
    seen = F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return rows.where((F.col("language") == "English") & (F.trim("title") != "") & (F.trim("url") != "")).select(F.trim("title").alias("title"), "url", seen.alias("ts"), "domain")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), "<[^>]+>", " "), r"\s+", " "))


def feed_time(text: Column) -> Column:
    """Feed dates with an offset, in either usual spelling, as an instant."""
    mail = F.try_to_timestamp(F.regexp_replace(F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", ""), " (GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(mail, F.try_to_timestamp(F.trim(text)))


def load_feed(items: DataFrame, source: str) -> DataFrame:
    """Feed entries (title, link, date, summary, guid as text) cleaned; untitled ones dropped."""
    out = items.select(strip_tags(F.col("title")).alias("title"), F.trim(F.coalesce("link", F.lit(""))).alias("link"), feed_time(F.col("date")).alias("published"), strip_tags(F.col("summary")).alias("summary"), F.lit(source).alias("source"), "guid")
    return out.withColumn("guid", F.coalesce(F.nullif("guid", F.lit("")), "link")).where(F.col("title") != "")


def read_feed(spark: SparkSession, path: str, source: str, atom: bool = False) -> DataFrame:
    if atom:
        schema = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, summary string, content string, id string"
        raw = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
        alternate = F.try_element_at(F.filter("link", lambda l: l["_rel"] == "alternate"), F.lit(1))["_href"]
        return load_feed(raw.select("title", F.coalesce(alternate, F.try_element_at("link", F.lit(1))["_href"]).alias("link"), F.coalesce("published", "updated").alias("date"), F.coalesce("summary", "content").alias("summary"), F.col("id").alias("guid")), source)
    schema = "title string, link string, pubDate string, description string, guid string"
    raw = spark.read.format("xml").option("rowTag", "item").schema(schema).load(path)
    return load_feed(raw.select("title", "link", F.col("pubDate").alias("date"), F.col("description").alias("summary"), "guid"), source)


def html_links(pages: DataFrame, pattern: str = r'href="([^"]+)"[^>]*>(.*?)</a>') -> DataFrame:
    """Links of whole pages (page_id, html) with their tag-free text."""
    full = F.lit("(?s)" + pattern)
    pairs = F.arrays_zip(F.regexp_extract_all("html", full, 1).alias("href"), F.regexp_extract_all("html", full, 2).alias("label"))
    return pages.select("page_id", F.posexplode(pairs).alias("position", "l")).select("page_id", "position", F.col("l.href").alias("href"), strip_tags(F.col("l.label")).alias("label"))


def load_action_page(pages: DataFrame, base_url: str = "https://ofac.treasury.gov") -> DataFrame:
    """Dated links of an action list."""
    links = html_links(pages, r'href="(/recent-actions/\d{8})"[^>]*>(.*?)</a>').where(F.col("label") != "")
    day = F.substring_index("href", "/", -1)
    return links.select(F.col("label").alias("title"), F.concat(F.lit(base_url), "href").alias("link"), F.try_to_timestamp(day, F.lit("yyyyMMdd")).alias("published"), F.col("label").alias("summary"), F.lit("ofac_recent_actions").alias("source"), F.concat(F.lit("ofac:"), day, F.lit(":"), "label").alias("guid"))
