"""Company opacity and risk."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.functions.text import contains_any, normalize_name
from intel_spark.functions.vessel import lookup

# Jurisdictions, name hints and link weights.
SECRECY_JURISDICTIONS = ["VG", "KY", "PA", "MH", "LR", "SC", "BZ", "VU", "WS", "BS", "BM", "JE", "GG", "IM", "LI", "MU", "AI", "TC", "KN", "LC", "VC", "DM", "AG", "NR", "CK", "NU", "GI", "MT", "CY", "HK", "AE", "SG", "LU", "CH"]
SANCTIONS_JURISDICTIONS = ["RU", "IR", "KP", "SY", "BY", "CU", "VE", "MM"]
SHELL_NAME_HINTS = ["TRADING", "HOLDINGS", "HOLDING", "INTERNATIONAL", "GLOBAL", "MANAGEMENT", "SHIPPING", "MARINE", "MARITIME", "LOGISTICS", "GENERAL TRADING", "FZE", "FZCO", "DMCC"]
UNDISCLOSED = ["NO_KNOWN_PERSON", "NON_PUBLIC", "NO_LEI"]
LAPSED = ["LAPSED", "RETIRED", "ANNULLED"]
LINK_BASE = {"direct": 0.9, "parent": 0.75, "ultimate_parent": 0.6, "child": 0.45, "vessel_owner": 0.8, "director": 0.6, "shareholder": 0.6}


def _either(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def assess_shell(companies: DataFrame, as_of: datetime) -> DataFrame:
    """Opacity indicators and their sum; a shell from one half up."""
    secret = _either(F.col("country").isin(SECRECY_JURISDICTIONS))
    undisclosed = _either(F.col("parent_exception").isin(UNDISCLOSED))
    natural = _either(F.col("parent_exception") == "NATURAL_PERSONS")
    lapsed = _either(F.col("registration_status").isin(LAPSED))
    inactive = _either(F.col("entity_status") == "INACTIVE")
    young = _either(F.floor((F.unix_micros(F.lit(as_of)) - F.unix_micros("creation_date")) / 8.64e10) < 365)
    generic = secret & contains_any(normalize_name(F.col("name")), SHELL_NAME_HINTS)
    childless = secret & (F.coalesce("children_count", F.lit(0)) == 0)
    linked = _either(F.col("listed"))
    tests = [
        (secret, 0.25, F.concat(F.lit("secrecy_jurisdiction:"), "country")), (undisclosed, 0.25, F.concat(F.lit("parent_undisclosed:"), "parent_exception")), (natural, 0.1, F.lit("owned_by_natural_persons")),
        (lapsed, 0.1, F.concat(F.lit("lei_"), F.lower("registration_status"))), (inactive, 0.05, F.lit("entity_inactive")), (young, 0.15, F.lit("recently_formed")),
        (generic, 0.1, F.lit("generic_trading_name")), (childless, 0.05, F.lit("no_subsidiaries")), (linked, 0.15, F.lit("sanctions_linked")),
    ]
    score = sum((F.when(test, weight).otherwise(0.0) for test, weight, _ in tests), F.lit(0.0))
    confidence = F.round(F.least(score, F.lit(1.0)), 2)
    indicators = F.array_compact(F.array(*[F.when(test, label) for test, _, label in tests]))
    return companies.select("*", indicators.alias("indicators"), confidence.alias("shell_confidence"), (confidence >= 0.5).alias("is_shell"), undisclosed.alias("opaque"))


def company_risk(linked: Column, match_type: Column, shell_confidence: Column, country: Column) -> Column:
    """How the company is tied to a listed party, its shell score and its jurisdiction."""
    base = F.when(_either(linked), F.coalesce(F.try_element_at(lookup(LINK_BASE), F.coalesce(match_type, F.lit(""))), F.lit(0.5))).otherwise(0.0)
    place = F.when(_either(country.isin(SANCTIONS_JURISDICTIONS)), 0.1).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.1 + base + 0.3 * F.coalesce(shell_confidence.cast("double"), F.lit(0.0)) + place), 2)


def ownership_risk(chain: Column, places: Column, involves_sanctioned: Column, involves_shell: Column) -> Column:
    """Chain length, listed or shell links, and the jurisdictions of the company and all its owners."""
    through = lambda risky: F.when(F.exists(places, lambda c: _either(c.isin(risky))), 0.1).otherwise(0.0)
    score = 0.2 + 0.05 * F.greatest(F.lit(0), F.size(chain) - 1) + F.when(involves_sanctioned, 0.5).otherwise(0.0) + F.when(involves_shell, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), score + through(SECRECY_JURISDICTIONS) + through(SANCTIONS_JURISDICTIONS)), 2)


def corporate_summary(companies: DataFrame) -> DataFrame:
    """Tidy (metric, key, value)."""
    one = companies.groupBy().agg(
        F.count("*").alias("companies"), F.count_if(F.col("listed")).alias("linked"), F.count_if(F.col("is_shell")).alias("shells"), F.count_if(F.col("opaque")).alias("opaque")
    ).unpivot([], ["companies", "linked", "shells", "opaque"], "metric", "value").select("metric", F.lit("").alias("key"), "value")
    types = companies.where(F.col("listed")).groupBy(F.lit("match_type").alias("metric"), F.coalesce("match_type", F.lit("unknown")).alias("key")).agg(F.count("*").alias("value"))
    countries = companies.where(F.col("listed") & F.col("country").isNotNull()).groupBy(F.lit("country").alias("metric"), F.col("country").alias("key")).agg(F.count("*").alias("value")).orderBy(F.col("value").desc(), "key").limit(10)
    return one.unionByName(types).unionByName(countries)
