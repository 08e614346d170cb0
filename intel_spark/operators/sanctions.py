"""List changes, programme tracking, and the table-maintenance steps shared by every domain."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.text import clean_company_name, latin_enough, normalize_name
from intel_spark.operators.corporate import company_risk
from intel_spark.operators.timeline import latest_per_key, top_per_key

def _texts(col: str) -> Column:
    return F.coalesce(F.col(col), F.array().cast("array<string>"))


def diff_listings(old: DataFrame, new: DataFrame, min_fraction: float = 0.5) -> DataFrame:
    """One row per (authority, source_id) with kind new, relisted, changed, unchanged, delisted, kept or inactive.

    A listing missing from an incoming list under ``min_fraction`` of the known active size is kept: the list looks
    truncated. The guard is one row per authority.
    """
    keys = ["authority", "source_id"]
    o = old.select(*keys, F.col("id"), F.col("name").alias("o_name"), _texts("programs").alias("o_programs"), F.col("imo").alias("o_imo"), F.col("is_active").alias("o_active"))
    n = new.select(*keys, F.col("name").alias("n_name"), F.col("entity_type").alias("n_type"), _texts("programs").alias("n_programs"), F.col("imo").alias("n_imo"), F.lit(True).alias("incoming"))
    sizes = new.groupBy("authority").agg(F.countDistinct("source_id").alias("seen")).join(old.groupBy("authority").agg(F.count_if("is_active").alias("active")), "authority", "full_outer")
    truncated = sizes.select("authority", ((F.coalesce("active", F.lit(0)) > 0) & (F.coalesce("seen", F.lit(0)) < F.coalesce("active", F.lit(0)) * min_fraction)).alias("truncated"))
    same = lambda a, b: F.sort_array(F.array_distinct(a)) == F.sort_array(F.array_distinct(b))
    changed = F.array_compact(F.array(
        F.when(normalize_name(F.col("o_name")) != normalize_name(F.col("n_name")), "name"), F.when(~same(F.col("o_programs"), F.col("n_programs")), "programs"),
        F.when(~F.nullif("o_imo", F.lit("")).eqNullSafe(F.nullif("n_imo", F.lit(""))), "imo"),
    ))
    kind = (
        F.when(F.col("o_active").isNull(), "new").when(F.col("incoming").isNull() & ~F.col("o_active"), "inactive")
        .when(F.col("incoming").isNull(), F.when(F.col("truncated"), "kept").otherwise("delisted")).when(~F.col("o_active"), "relisted").when(F.size("changed") > 0, "changed").otherwise("unchanged")
    )
    merged = o.join(n, keys, "full_outer").withColumn("changed", F.when(F.col("incoming") & F.col("o_active"), changed).otherwise(F.array().cast("array<string>")))
    return merged.join(truncated, "authority", "left").withColumn("kind", kind).drop("incoming", "truncated")


def change_log(diff: DataFrame, as_of: datetime) -> DataFrame:
    """Log rows of a diff; an authority without earlier rows gives one initial-import row."""
    known = diff.groupBy("authority").agg(F.max(F.col("o_active").isNotNull()).alias("known"), F.count_if(F.col("kind") == "new").alias("n"))
    first = known.where(~F.col("known")).select(
        "authority", F.lit("initial_import").alias("update_type"), F.lit(None).cast("string").alias("source_id"), F.format_string("%d listings imported", "n").alias("entity"), F.lit(None).cast("string").alias("previous"), F.to_json(F.struct(F.col("n").alias("count"))).alias("new")
    )
    kind = (
        F.when(F.col("kind") == "new", "new_designation").when(F.col("kind") == "relisted", "relisted").when(F.col("kind") == "delisted", "delisting")
        .when(F.array_contains("changed", "name"), "name_change").when(F.array_contains("changed", "programs"), "program_change").otherwise("identifier_change")
    )
    has = lambda field, value: F.when(F.array_contains("changed", field), value)
    before = F.to_json(F.struct(has("name", F.col("o_name")).alias("name"), has("programs", F.col("o_programs")).alias("programs"), has("imo", F.col("o_imo")).alias("imo")))
    after = F.to_json(F.struct(has("name", F.col("n_name")).alias("name"), has("programs", F.col("n_programs")).alias("programs"), has("imo", F.col("n_imo")).alias("imo")))
    listed = F.to_json(F.struct(F.col("n_programs").alias("programs"), F.col("n_imo").alias("imo")))
    rows = diff.where(F.col("kind").isin("new", "relisted", "changed", "delisted")).join(known.where("known").select("authority"), "authority", "left_semi").select(
        "authority", kind.alias("update_type"), "source_id", F.coalesce("n_name", "o_name").alias("entity"),
        F.when(F.col("kind") == "changed", before).when(F.col("kind") == "relisted", '{"status":"delisted"}').when(F.col("kind") == "delisted", '{"status":"active"}').alias("previous"),
        F.when(F.col("kind") == "changed", after).when(F.col("kind") == "delisted", '{"status":"delisted"}').otherwise(listed).alias("new"),
    )
    return rows.unionByName(first).withColumn("ts", F.lit(as_of))


def apply_diff(old: DataFrame, new: DataFrame, diff: DataFrame, as_of: datetime) -> DataFrame:
    """The table after the diff: incoming rows replace or join, delisted ones stay inactive with a date."""
    keys = ["authority", "source_id"]
    incoming = new.join(diff.where(F.col("kind").isin("new", "relisted", "changed", "unchanged")).select(*keys, F.col("id").alias("known_id")), keys)
    columns = [c for c in old.columns if c not in ("id", "is_active", "delisting_date", *keys)]
    fresh = incoming.select(F.col("known_id").alias("id"), *keys, *columns, F.lit(True).alias("is_active"), F.lit(None).cast("timestamp").alias("delisting_date"))
    gone = diff.where(F.col("kind") == "delisted").select(*keys, F.lit(True).alias("gone"))
    rest = old.join(incoming.select(*keys), keys, "left_anti").join(gone, keys, "left")
    rest = rest.select("id", *keys, *columns, (F.col("is_active") & F.col("gone").isNull()).alias("is_active"), F.when(F.col("gone"), F.lit(as_of)).otherwise(F.col("delisting_date")).alias("delisting_date"))
    return fresh.unionByName(rest)


def union_sources(*frames: DataFrame) -> DataFrame:
    """Rows of several sources under one schema; columns a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def program_counts(listings: DataFrame) -> DataFrame:
    """Active entities and vessels per authority and programme; rows without one count as (unspecified)."""
    programs = F.when(F.size(_texts("programs")) > 0, F.array_distinct("programs")).otherwise(F.array(F.lit("(unspecified)")))
    return listings.where("is_active").select("authority", "entity_type", F.explode(programs).alias("program")).groupBy("authority", "program").agg(
        F.count("*").alias("n_entities"), F.count_if(F.col("entity_type") == "vessel").alias("n_vessels")
    )


def listing_report(listings: DataFrame, updates: DataFrame, as_of: datetime, days: int = 7, program: str | None = None) -> DataFrame:
    """Tidy (authority, metric, value): active listings, active vessels, and updates by type in the period."""
    kept = listings.where("is_active")
    if program:
        kept = kept.where(F.exists(_texts("programs"), lambda p: F.contains(F.upper(p), F.lit(program.upper()))))
    active = kept.groupBy("authority").agg(F.count("*").alias("active_listings"), F.count_if(F.col("entity_type") == "vessel").alias("active_vessels"))
    tall = active.unpivot("authority", ["active_listings", "active_vessels"], "metric", "value")
    recent = updates.where((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")) & (F.col("ts") <= F.lit(as_of)))
    return tall.unionByName(recent.groupBy("authority", F.concat(F.lit("update:"), "update_type").alias("metric")).agg(F.count("*").alias("value")))


def seed_companies(listings: DataFrame, vessels: DataFrame, known: DataFrame) -> DataFrame:
    """Companies to track: listed ones (OFAC, then UN, then EU spelling), listed vessel owners, owners seen on AIS."""
    active = listings.where("is_active")
    order = F.when(F.col("authority") == "OFAC", 0).when(F.col("authority") == "UN", 1).when(F.col("authority") == "EU", 2).otherwise(3)
    none = lambda kind: F.lit(None).cast(kind)
    listed = active.where((F.col("entity_type") == "company") & latin_enough(F.col("name"))).select(
        F.col("name"), F.col("country"), F.col("id").alias("entity_id"), F.lit("direct").alias("match_type"), F.lit(1.0).alias("confidence"), F.lit("sanctions_seed").alias("origin"), order.alias("priority"), F.col("id").alias("tie"))
    owners = active.where(F.col("vessel_owner") != "").groupBy(F.col("vessel_owner").alias("name")).agg(F.min("id").alias("entity_id")).select(
        "name", none("string").alias("country"), "entity_id", F.lit("vessel_owner").alias("match_type"), F.lit(0.9).alias("confidence"), F.lit("vessel_owner").alias("origin"), F.lit(10).alias("priority"), F.col("entity_id").alias("tie"))
    seen = vessels.where(F.col("owner") != "").select(F.col("owner").alias("name")).distinct().select(
        "name", none("string").alias("country"), none("long").alias("entity_id"), none("string").alias("match_type"), none("double").alias("confidence"), F.lit("ais_owner").alias("origin"), F.lit(20).alias("priority"), F.lit(0).cast("long").alias("tie"))
    both = listed.unionByName(owners).unionByName(seen).withColumn("name_normalized", normalize_name(F.col("name"))).where(F.col("name_normalized") != "")
    # the best spelling per name is an aggregate, so copies of one name shrink before the shuffle
    best = both.groupBy("name_normalized").agg(F.min(F.struct("priority", "tie", "name", "country", "entity_id", "match_type", "confidence", "origin")).alias("b"))
    picked = best.join(known.select("name_normalized").distinct(), "name_normalized", "left_anti").select("name_normalized", "b.*")
    linked = F.col("match_type").isNotNull()
    return picked.select(clean_company_name(F.col("name")).alias("name"), "name_normalized", "country", "entity_id", "match_type", "confidence", "origin", linked.alias("listed"), company_risk(linked, F.col("match_type"), F.lit(None), F.col("country")).alias("risk_score"))


def insert_if_absent(new: DataFrame, old: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose natural key is not stored yet, the least row of each key."""
    rest = [c for c in new.columns if c not in keys]
    fresh = new.join(old.select(*keys), list(keys), "left_anti")
    if not rest:
        return fresh.distinct()
    return fresh.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in new.columns])


def upsert(new: DataFrame, old: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Newest row per key over stored and incoming rows; an incoming row wins a tie."""
    both = old.withColumn("_side", F.lit(0)).unionByName(new.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, keys, order, ["_side"]).drop("_side")


def dedupe_events(drafts: DataFrame, existing: DataFrame, days: int = 3) -> DataFrame:
    """Drafts not stored yet: one per (source, source_id), then one per URL with most mentions, skipping URLs stored
    within ``days`` before the draft."""
    order = [F.coalesce("mentions", F.lit(0)).desc(), F.col("ts"), F.col("source_id")]
    one = top_per_key(drafts, ["source", "source_id"], order, 1).drop("_rank").join(existing.select("source", "source_id"), ["source", "source_id"], "left_anti")
    with_url = top_per_key(one.where(F.col("url") != ""), ["url"], [*order, F.col("source")], 1).drop("_rank")
    stored = existing.where(F.col("url") != "").groupBy("url").agg(F.max("ts").alias("_stored"))
    fresh = with_url.join(stored, "url", "left").where(F.col("_stored").isNull() | (F.col("_stored") < F.col("ts") - F.expr(f"INTERVAL {days} DAYS"))).drop("_stored")
    return fresh.select(*drafts.columns).unionByName(one.where(F.coalesce("url", F.lit("")) == ""))


def purge(df: DataFrame, ts: str, as_of: datetime, days: int, keep: Column | None = None) -> DataFrame:
    """Rows inside the retention period or matching ``keep``; on a date-partitioned table the filter prunes partitions."""
    recent = F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")
    return df.where(recent if keep is None else recent | F.coalesce(keep, F.lit(False)))


def merge_by_lei(companies: DataFrame) -> DataFrame:
    """Companies sharing an LEI become one; a sanctions link on any of them stays, strongest first."""
    link = F.struct("confidence", "match_type", "entity_id")
    merged = companies.where(F.col("lei").isNotNull()).groupBy("lei").agg(
        F.min("id").alias("id"), F.min_by("name", "id").alias("name"), F.min_by("country", "id").alias("country"), F.bool_or(F.coalesce("listed", F.lit(False))).alias("listed"), F.max(F.when(F.col("listed"), link)).alias("l"), F.count("*").alias("merged"))
    merged = merged.select("id", "name", "lei", "country", "listed", "l.match_type", "l.confidence", "l.entity_id", "merged")
    alone = companies.where(F.col("lei").isNull()).select("id", "name", "lei", "country", F.coalesce("listed", F.lit(False)).alias("listed"), "match_type", "confidence", "entity_id", F.lit(1).cast("long").alias("merged"))
    return merged.unionByName(alone)
