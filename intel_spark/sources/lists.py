"""Sanctions-list files to the listings schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from intel_spark.functions.text import normalize_name
from intel_spark.functions.vessel import extract_imo

SDN_COLUMNS = ["ent_num", "name", "sdn_type", "program", "title", "call_sign", "vess_type", "tonnage", "grt", "vess_flag", "vess_owner", "remarks"]
ALT_COLUMNS = ["ent_num", "alt_num", "alt_type", "alt_name"]
TYPES = {"vessel": "vessel", "entity": "company", "individual": "person", "aircraft": "aircraft"}
EU_SCHEMA = (
    "_euReferenceNumber string, _logicalId string, nameAlias array<struct<_wholeName:string,_strong:string,_nameLanguage:string>>, subjectType struct<_code:string>, identification array<struct<_identificationTypeCode:string,_number:string>>, "
    "regulation array<struct<_programme:string,_publicationDate:string>>, citizenship array<struct<_countryIso2Code:string>>, address array<struct<_countryIso2Code:string>>, remark string"
)
UN_PERSON_SCHEMA = (
    "DATAID string, REFERENCE_NUMBER string, FIRST_NAME string, SECOND_NAME string, THIRD_NAME string, FOURTH_NAME string, UN_LIST_TYPE string, LISTED_ON string, COMMENTS1 string, NATIONALITY array<struct<VALUE:string>>, "
    "{kind}_ALIAS array<struct<ALIAS_NAME:string>>, {kind}_ADDRESS array<struct<COUNTRY:string>>"
)


def _clean(col: str) -> Column:
    text = F.trim(F.col(col))
    return F.when(~text.isin("", "-0-"), text)


def _iso(name: Column, countries: Column) -> Column:
    return F.try_element_at(countries, F.lower(F.trim(name)))


def country_map(dim: DataFrame) -> DataFrame:
    """One-row lookup map of a (name, iso) dimension, to be joined by its single row."""
    return dim.agg(F.map_from_entries(F.collect_list(F.struct(F.lower("name"), "iso"))).alias("_countries"))


def load_listing_csv(sdn: DataFrame, alt: DataFrame, countries: Column) -> DataFrame:
    """12-column entity rows and 4-column alias rows to listings; ``-0-`` is null; programmes split on "] [" and ";"."""
    rows = sdn.select([_clean(c).alias(c) for c in SDN_COLUMNS]).where(F.col("ent_num").isNotNull() & F.col("name").isNotNull())
    aliases = alt.select([_clean(c).alias(c) for c in ALT_COLUMNS]).where(F.col("alt_name").isNotNull()).groupBy("ent_num").agg(F.array_sort(F.collect_list("alt_name")).alias("aliases"))
    kinds = F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair])
    plain = F.replace(F.replace(F.replace("program", F.lit("] ["), F.lit(";")), F.lit("["), F.lit("")), F.lit("]"), F.lit(""))
    programs = F.filter(F.transform(F.split(plain, ";"), lambda p: F.trim(p)), lambda p: p != "")
    flag = _iso(F.col("vess_flag"), countries)
    empty = F.array().cast("array<string>")
    return rows.join(aliases, "ent_num", "left").select(
        F.lit("OFAC").alias("authority"), F.col("ent_num").alias("source_id"), "name", normalize_name(F.col("name")).alias("name_normalized"), F.coalesce(F.try_element_at(kinds, F.lower(F.coalesce("sdn_type", F.lit("entity")))), F.lit("company")).alias("entity_type"),
        F.coalesce(programs, empty).alias("programs"), F.coalesce("aliases", empty).alias("aliases"), flag.alias("country"), extract_imo(F.col("remarks")).alias("imo"), flag.alias("vessel_flag"), F.col("vess_owner").alias("vessel_owner"), F.col("vess_type").alias("vessel_type"), "call_sign", "remarks",
    )


def read_listing_csv(spark: SparkSession, sdn_path: str, alt_path: str, countries: Column) -> DataFrame:
    read = lambda path, cols: spark.read.schema(", ".join(f"{c} string" for c in cols)).option("multiLine", "false").option("escape", '"').csv(path)
    return load_listing_csv(read(sdn_path, SDN_COLUMNS), read(alt_path, ALT_COLUMNS), countries)


def load_listing_eu(records: DataFrame) -> DataFrame:
    """One name per record: strong aliases ranked English, untagged, other, then most ASCII; else the first alias."""
    names = F.filter("nameAlias", lambda a: F.trim(F.coalesce(a["_wholeName"], F.lit(""))) != "")
    strong = F.filter(names, lambda a: a["_strong"] == "true")

    def ranked(a, i):
        language = F.upper(F.coalesce(a["_nameLanguage"], F.lit("")))
        rank = F.when(language == "EN", 0).when(language == "", 1).otherwise(2)
        ascii_chars = F.length(F.regexp_replace(a["_wholeName"], r"[^\x00-\x7F]", ""))
        return F.struct(rank.alias("rank"), (-ascii_chars).alias("ascii"), i.alias("i"), F.trim(a["_wholeName"]).alias("name"))

    best = F.when(F.size(strong) > 0, F.array_min(F.transform(strong, ranked))["name"]).otherwise(F.trim(F.try_element_at(names, F.lit(1))["_wholeName"]))
    empty = F.array().cast("array<string>")
    programmes = F.array_sort(F.array_distinct(F.array_compact(F.transform("regulation", lambda r: F.nullif(r["_programme"], F.lit(""))))))
    dates = F.array_min(F.transform("regulation", lambda r: F.try_to_date(F.substring(r["_publicationDate"], 1, 10))))
    places = F.concat(F.coalesce(F.transform("citizenship", lambda c: c["_countryIso2Code"]), empty), F.coalesce(F.transform(F.filter("address", lambda a: a["_countryIso2Code"] != "00"), lambda a: a["_countryIso2Code"]), empty))
    kind = F.when(F.col("subjectType._code") == "person", "person").otherwise("company")
    imo = F.try_element_at(F.filter("identification", lambda i: i["_identificationTypeCode"] == "imo"), F.lit(-1))["_number"]
    rows = records.withColumn("name", best).where(F.col("name").isNotNull())
    return rows.select(
        F.lit("EU").alias("authority"), F.coalesce("_euReferenceNumber", "_logicalId").alias("source_id"), "name", normalize_name(F.col("name")).alias("name_normalized"), kind.alias("entity_type"), F.coalesce(programmes, empty).alias("programs"),
        F.filter(F.transform(names, lambda a: F.trim(a["_wholeName"])), lambda n: n != F.col("name")).alias("aliases"), F.try_element_at(F.filter(places, lambda p: p.isNotNull() & (p != "")), F.lit(1)).alias("country"), dates.alias("designation_date"),
        F.nullif(F.trim(imo), F.lit("")).alias("imo"), F.nullif(F.trim("remark"), F.lit("")).alias("remarks"),
    )


def read_listing_eu(spark: SparkSession, path: str) -> DataFrame:
    return load_listing_eu(spark.read.format("xml").option("rowTag", "sanctionEntity").option("ignoreNamespace", "true").schema(EU_SCHEMA).load(path))


def load_listing_un(records: DataFrame, kind: str, countries: Column) -> DataFrame:
    """One branch of the list; ``kind`` is ENTITY or INDIVIDUAL."""
    person = kind == "INDIVIDUAL"
    parts = [F.trim(c) for c in ("FIRST_NAME", "SECOND_NAME", "THIRD_NAME", "FOURTH_NAME")]
    name = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts]) if person else F.trim(F.coalesce("FIRST_NAME", F.lit("")))
    empty = F.array().cast("array<string>")
    places = F.concat(F.coalesce(F.transform("NATIONALITY", lambda n: n["VALUE"]), empty), F.coalesce(F.transform(f"{kind}_ADDRESS", lambda a: a["COUNTRY"]), empty))
    committee = F.nullif(F.trim("UN_LIST_TYPE"), F.lit(""))
    comments = F.trim(F.coalesce("COMMENTS1", F.lit("")))
    rows = records.withColumn("name", name).where(F.col("name") != "")
    return rows.select(
        F.lit("UN").alias("authority"), F.coalesce(F.nullif(F.trim("DATAID"), F.lit("")), F.trim("REFERENCE_NUMBER")).alias("source_id"), "name", normalize_name(F.col("name")).alias("name_normalized"), F.lit("person" if person else "company").alias("entity_type"),
        F.when(committee.isNotNull(), F.array(committee)).otherwise(empty).alias("programs"), F.coalesce(F.filter(F.transform(f"{kind}_ALIAS", lambda a: F.trim(a["ALIAS_NAME"])), lambda a: a != ""), empty).alias("aliases"),
        F.try_element_at(F.array_compact(F.transform(places, lambda p: _iso(p, countries))), F.lit(1)).alias("country"), F.try_to_date(F.substring("LISTED_ON", 1, 10)).alias("designation_date"), (F.lit(None).cast("string") if person else extract_imo(comments)).alias("imo"),
        F.concat(F.coalesce(F.trim("REFERENCE_NUMBER"), F.lit("")), F.lit(": "), comments).alias("remarks"),
    )


def read_listing_un(spark: SparkSession, path: str, countries: Column) -> DataFrame:
    read = lambda kind: spark.read.format("xml").option("rowTag", kind).schema(UN_PERSON_SCHEMA.format(kind=kind)).load(path)
    return load_listing_un(read("ENTITY"), "ENTITY", countries).unionByName(load_listing_un(read("INDIVIDUAL"), "INDIVIDUAL", countries))
