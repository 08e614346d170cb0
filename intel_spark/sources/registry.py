"""Legal-entity registry and company filings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intel_spark.sources.chain import parsed

LEI_JSON = (
    "id string, attributes struct<lei:string,entity:struct<legalName:struct<name:string>,otherNames:array<struct<name:string>>,transliteratedOtherNames:array<struct<name:string>>,legalAddress:struct<country:string,city:string,postalCode:string,addressLines:array<string>>,"
    "headquartersAddress:struct<country:string>,jurisdiction:string,status:string,category:string,legalForm:struct<id:string,other:string>,creationDate:string>,registration:struct<status:string>>, "
    "relationships struct<directParent:string,ultimateParent:string>, exceptions array<struct<kind:string,category:string,reason:string>>"
)
EDGAR_SCHEMA = "cik string, `conformed-name` string, `assigned-sic-desc` string, `state-location` string, addresses struct<address:array<struct<_type:string,street1:string,street2:string,city:string,state:string,zip:string>>>"


def load_lei(messages: DataFrame) -> DataFrame:
    """Registry records (value: JSON text) flattened, names merged."""
    r = parsed(messages, LEI_JSON)
    e = "attributes.entity"
    empty = F.array().cast("array<string>")
    names = lambda c: F.coalesce(F.transform(f"{e}.{c}", lambda n: n["name"]), empty)
    others = F.filter(F.concat(names("otherNames"), names("transliteratedOtherNames")), lambda n: n != "")
    address = F.nullif(F.concat_ws(", ", F.array_join(F.coalesce(f"{e}.legalAddress.addressLines", empty), ", "), f"{e}.legalAddress.postalCode"), F.lit(""))
    return r.select(
        F.coalesce("attributes.lei", "id").alias("lei"), F.coalesce(f"{e}.legalName.name", F.lit("")).alias("name"), others.alias("other_names"), F.col(f"{e}.legalAddress.country").alias("country"), F.col(f"{e}.jurisdiction").alias("jurisdiction"), F.col(f"{e}.status").alias("status"),
        F.col("attributes.registration.status").alias("registration_status"), F.col(f"{e}.category").alias("category"), F.coalesce(f"{e}.legalForm.other", f"{e}.legalForm.id").alias("legal_form"), F.try_to_timestamp(F.col(f"{e}.creationDate")).alias("creation_date"), address.alias("address"), F.col(f"{e}.legalAddress.city").alias("city"),
        F.col(f"{e}.headquartersAddress.country").alias("headquarters_country"),
    )


def lei_edges(messages: DataFrame) -> DataFrame:
    """(child, parent, kind) edges to direct and ultimate parents."""
    r = parsed(messages, LEI_JSON).select(F.coalesce("attributes.lei", "id").alias("child"), "relationships.directParent", "relationships.ultimateParent")
    return r.select("child", F.expr("stack(2, 'direct', directParent, 'ultimate', ultimateParent) AS (kind, parent)")).where("parent IS NOT NULL").select("child", "parent", "kind")


def lei_exceptions(messages: DataFrame) -> DataFrame:
    """Reasons given where a parent is missing."""
    return parsed(messages, LEI_JSON).select(F.coalesce("attributes.lei", "id").alias("lei"), F.explode("exceptions").alias("x")).select("lei", "x.kind", "x.category", "x.reason")


def load_edgar(rows: DataFrame) -> DataFrame:
    """Company records; without a CIK or a name dropped."""
    business = F.try_element_at(F.filter("addresses.address", lambda a: a["_type"] == "business"), F.lit(1))
    parts = F.array_compact(F.array(*[F.nullif(F.trim(business[c]), F.lit("")) for c in ("street1", "street2", "city", "state", "zip")]))
    text = lambda c: F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
    out = rows.select(F.trim("cik").alias("raw"), F.regexp_replace(F.trim("`conformed-name`"), r"\s+", " ").alias("name"), text("assigned-sic-desc").alias("sic"), text("state-location").alias("state"), F.nullif(F.array_join(parts, ", "), F.lit("")).alias("business_address"))
    out = out.where((F.col("raw") != "") & (F.col("name") != ""))
    return out.select(F.coalesce(F.nullif(F.regexp_replace("raw", "^0+", ""), F.lit("")), "raw").alias("cik"), "name", "sic", "state", "business_address")


def read_edgar(spark: SparkSession, path: str) -> DataFrame:
    return load_edgar(spark.read.format("xml").option("rowTag", "company-info").option("ignoreNamespace", "true").schema(EDGAR_SCHEMA).load(path))
