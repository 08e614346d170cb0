"""Name screening joins: exact, fuzzy, company index and registry matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.scoring import severity_for_confidence
from intel_spark.functions.text import core_name, listing_tokens, name_ratio, normalize_name
from intel_spark.functions.vessel import types_conflict
from intel_spark.operators.search import word_join, words_of

# Flags under comprehensive programmes, and match labels.
COMPREHENSIVE_PROGRAMS = {"IR": "IRAN", "KP": "DPRK", "SY": "SYRIA", "CU": "CUBA"}
PARTY_MIN = 0.9  # similarity of owners and operators
MATCH_LABELS = {"imo": "IMO", "mmsi": "MMSI", "name_exact": "name", "name_fuzzy": "name (fuzzy)", "owner": "owner", "operator": "operator", "beneficial_owner": "beneficial owner"}


def listing_names(listings: DataFrame) -> DataFrame:
    """One row per (listing, normalised name or alias)."""
    names = F.array_union(F.array(F.coalesce("name_normalized", normalize_name(F.col("name")))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), normalize_name))
    return listings.select(F.col("id").alias("listing_id"), "entity_type", F.explode(names).alias("listed_name")).where(F.col("listed_name") != "")


HOT_SEGMENT = 2_000  # names that hold one segment and are met by one task


def _segments(name: Column, edits: Column) -> Column:
    """A name cut evenly into one part more than the edits it may take: array of struct(length, part, text)."""
    size, parts = F.length(name), edits + 1
    base = F.floor(size / parts).cast("int")
    plain = parts - size % parts  # parts of the base length; the others are one longer

    def part(j: Column) -> Column:
        start = j * base + F.greatest(F.lit(0), j - plain)
        return F.struct(size.alias("size"), j.alias("part"), F.substring(name, start + 1, base + F.when(j >= plain, 1).otherwise(0)).alias("segment"))

    return F.transform(F.sequence(F.lit(0), edits), part)


def _probes(name: Column, edits, longest: Column, least: int) -> Column:
    """Every piece of a name that can equal a part of a partner at least ``least`` characters longer: struct(size, part, segment).

    A partner of ``size`` characters has ``edits(size)`` + 1 parts. The edits before the part that is met shift it by at
    most as many places, those behind it likewise from the other end, so few places are tried.
    """
    own = F.length(name)
    none = F.array().cast("array<struct<size:int,part:int,segment:string>>")

    def of_size(size: Column) -> Column:
        k = edits(size)
        parts = k + 1
        base = F.floor(size / parts).cast("int")
        plain = parts - size % parts

        def of_part(j: Column) -> Column:
            start, width = j * base + F.greatest(F.lit(0), j - plain), base + F.when(j >= plain, 1).otherwise(0)
            low = F.greatest(F.lit(0), start - j, start + own - size - (k - j))
            high = F.least(own - width, start + j, start + own - size + (k - j))
            cut = F.transform(F.sequence(low, high), lambda p: F.struct(size.alias("size"), j.alias("part"), F.substring(name, p + 1, width).alias("segment")))
            return F.when(low <= high, cut).otherwise(none)

        return F.when(size - own <= k, F.flatten(F.transform(F.sequence(F.lit(0), k), of_part))).otherwise(none)

    sizes = F.when(own + least <= longest, F.sequence(own + least, longest)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.flatten(F.transform(sizes, of_size)))


def _meet(index: DataFrame, probes: DataFrame, keys: list[str]) -> DataFrame:
    """Equi-join on ``keys`` in which a key of many index rows is dealt out over several tasks."""
    hot = index.groupBy(*keys).agg(F.ceil(F.count("*") / HOT_SEGMENT).cast("int").alias("_splits")).where("_splits > 1")
    spread = index.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("_long"), F.coalesce("_splits", F.lit(1)))).drop("_splits")
    asked = probes.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_splits", F.lit(1)).cast("long") - 1))).drop("_splits")
    return spread.join(asked, [*keys, "_salt"])


def similar_names(left: DataFrame, right: DataFrame, left_col: str, right_col: str, min_ratio: float, mode: str = "levenshtein", by: str | None = None) -> DataFrame:
    """Every pair of distinct names whose similarity reaches ``min_ratio``, as (left name, right name, ratio). Exact.

    The longer name of a pair is cut evenly into one part more than the edits it may take. That many edits leave one part
    whole, and it stands in the shorter name at nearly the same place, so the two meet in an equi-join on (length, part,
    text). Parts are six to eight characters for usual names, no frequencies are counted beforehand, no partner is dropped
    and no candidate list is capped. With ``by``, only names of equal value of that column meet, and it is returned too.
    """
    if not 0.6 <= min_ratio <= 1:
        raise ValueError("min_ratio must lie between 0.6 and 1: below it names have more edits than parts")
    spread = 1 - min_ratio
    # block matching counts an unmatched character on each side
    edits = lambda size: F.floor(size * (2 * spread if mode == "sequence" else spread) + 1e-9).cast("int")
    reach = 1 / min_ratio if mode != "sequence" else (1 + spread) / (1 - spread)
    longest = lambda name: F.floor(F.length(name) * reach + 1e-9).cast("int")
    tag = F.col(by) if by else F.lit(0)
    ln = left.select(tag.alias("_by"), F.col(left_col).alias("_name")).where(F.col("_name") != "").distinct()
    rn = right.select(tag.alias("_by"), F.col(right_col).alias("_name")).where(F.col("_name") != "").distinct()
    keys = ["_by", "size", "part", "segment"]

    def met(index: DataFrame, asking: DataFrame, least: int) -> DataFrame:
        name = F.col("_name")
        cut = index.select("_by", name.alias("_long"), F.explode(_segments(name, edits(F.length(name)))).alias("s")).select("_by", "_long", "s.*")
        asked = asking.select("_by", name.alias("_short"), F.explode(_probes(name, edits, longest(name), least)).alias("s")).select("_by", "_short", "s.*")
        return _meet(cut, asked, keys)

    # the longer name is on the right, then on the left
    found = met(rn, ln, 0).select("_by", F.col("_short").alias("a"), F.col("_long").alias("b")).unionByName(met(ln, rn, 1).select("_by", F.col("_long").alias("a"), F.col("_short").alias("b")))
    la, lb = F.length("a"), F.length("b")
    out = ["a", "b", "ratio", *([F.col("_by").alias(by)] if by else [])]
    if mode == "sequence":
        return found.distinct().withColumn("ratio", name_ratio(F.col("a"), F.col("b"), mode)).where(F.col("ratio") >= min_ratio - 1e-12).select(*out)
    # the bounded distance gives up early, so pairs that meet in several parts are thinned out after it
    limit = F.floor(F.greatest(la, lb) * spread + 1e-9).cast("int")
    near = found.withColumn("_limit", limit).withColumn("_distance", F.expr("levenshtein(a, b, _limit)")).where("_distance >= 0")
    return near.select("_by", "a", "b", (1 - F.col("_distance") / F.greatest(la, lb)).alias("ratio")).where(F.col("ratio") >= min_ratio - 1e-12).distinct().select(*out)


def match_identifiers(vessels: DataFrame, listings: DataFrame) -> DataFrame:
    """Vessel against listing by IMO (vessel listings only) and by MMSI."""
    by_imo = vessels.where(F.col("imo").isNotNull()).select(F.col("id").alias("vessel_id"), F.col("imo").alias("matched_value")).join(
        listings.where((F.col("entity_type") == "vessel") & F.col("imo").isNotNull()).select(F.col("id").alias("listing_id"), F.col("imo").alias("matched_value")), "matched_value"
    ).withColumn("match_type", F.lit("imo"))
    by_mmsi = vessels.where(F.col("mmsi").isNotNull()).select(F.col("id").alias("vessel_id"), F.col("mmsi").alias("matched_value")).join(
        listings.where(F.col("mmsi").isNotNull()).select(F.col("id").alias("listing_id"), F.col("mmsi").alias("matched_value")), "matched_value"
    ).withColumn("match_type", F.lit("mmsi"))
    return by_imo.unionByName(by_mmsi).select("vessel_id", "listing_id", "match_type", "matched_value", F.lit(0.95).alias("confidence"), F.lit("direct_match").alias("breach_type"))


BLOCK = 1_024  # rows of one class that travel together


def _alike(rows: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """(*keys, spelled, alike): each key's set of values; keys with equal sets are alike and match the same things."""
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_set(value)).alias("spelled")).withColumn("alike", F.unhex(F.sha2(F.to_json("spelled"), 256)))


def _spellings(members: DataFrame, keys: list[str]) -> DataFrame:
    """The values of every class of alike keys, once: (*keys, alike, and the fields of a value)."""
    return members.select(*keys, "alike", "spelled").dropDuplicates([*keys, "alike"]).select(*keys, "alike", F.explode("spelled").alias("s")).select(*keys, "alike", "s.*")


def _blocks(members: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(*keys, name): a class's members in arrays of about ``BLOCK``."""
    splits = members.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("_splits"))
    dealt = members.join(splits, keys).withColumn("_block", F.pmod(F.xxhash64(value), F.col("_splits")))
    return dealt.groupBy(*keys, "_block").agg(F.collect_list(value).alias(name)).drop("_block")


def _expand(pairs: DataFrame, listed: DataFrame, asked: DataFrame, by_listed: list[str], by_asked: list[str]) -> DataFrame:
    """Pairs of classes as pairs of their members, structs ``v`` of ``asked`` (vs) and ``l`` of ``listed`` (ls).

    The members of two classes meet as arrays and are spread out behind the last shuffle, so the pairs of members, which
    grow with the product of the two, are never shuffled or sorted.
    """
    # a number of its own keeps adaptive execution from joining partitions that are small only until they are spread out
    spark = pairs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    met = pairs.join(listed, by_listed).repartition(parts, *by_asked).join(asked.repartition(parts, *by_asked), by_asked)
    return met.withColumn("v", F.explode("vs")).drop("vs").withColumn("l", F.explode("ls")).drop("ls")


def _sides(names: DataFrame, listings: DataFrame, entity_types: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """Name ids with equal spellings and listings with equal names and aliases, as classes."""
    listed = listing_names(listings)
    if entity_types:
        listed = listed.where(F.col("entity_type").isin(entity_types))
    probe = names.select("name_id", "name", normalize_name(F.col("name")).alias("probe")).where(F.col("probe") != "")
    asked = _alike(probe, ["name_id"], F.struct("name", "probe")).withColumnRenamed("alike", "asked")
    return asked, _alike(listed, ["listing_id"], F.struct("entity_type", "listed_name"))


def _asked_spellings(asked: DataFrame) -> DataFrame:
    return _spellings(asked.withColumnRenamed("asked", "alike"), []).withColumnRenamed("alike", "asked")


def _members_of(pairs: DataFrame, asked: DataFrame, listed: DataFrame) -> DataFrame:
    out = _expand(pairs, _blocks(listed, ["alike"], F.struct("listing_id"), "ls"), _blocks(asked, ["asked"], F.struct("name_id"), "vs"), ["alike"], ["asked"])
    return out.select("*", "v.name_id", "l.listing_id").drop("v", "l", "asked", "alike")


def _same(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """(asked, name, alike, entity_type) of classes that share a normalised name."""
    return _asked_spellings(asked).join(_spellings(listed, []).withColumnRenamed("listed_name", "probe"), "probe").select("asked", "name", "alike", "entity_type").distinct()


def match_exact(names: DataFrame, listings: DataFrame, entity_types: list[str] | None = None) -> DataFrame:
    """Names (name_id, name) equal to a listing's normalised name or alias."""
    asked, listed = _sides(names, listings, entity_types)
    return _members_of(_same(asked, listed), asked, listed).select("name_id", "name", "listing_id", "entity_type")


def _close_listings(probe: DataFrame, listed: DataFrame, min_ratio: float, mode: str, by: str | None = None) -> DataFrame:
    """(probe name, listing_id, entity_type, ratio) of listings close to a probe (``probe``) that share a significant word."""
    close = similar_names(probe, listed, "probe", "listed_name", min_ratio, mode, by)
    # word overlap and the length rule are tested on name pairs, before listings and name ids multiply them
    close = close.where(
        F.arrays_overlap(listing_tokens(F.col("a")), listing_tokens(F.col("b")))
        & (F.abs(F.length("a") - F.length("b")) <= F.greatest(F.lit(4), F.floor(F.length("a") / 3)))
    )
    group = [by] if by else []
    named = listed.withColumnRenamed("listed_name", "b")
    return close.join(named, ["b", *group]).groupBy(*group, "a", "listing_id", "entity_type").agg(F.max("ratio").alias("ratio")).where(F.col("ratio") < 1)


def match_fuzzy(names: DataFrame, listings: DataFrame, entity_types: list[str] | None = None, min_ratio: float = 0.88, top: int | None = 5, mode: str = "levenshtein") -> DataFrame:
    """Names close to, but not equal to, a listed name that shares a significant word; best ``top`` per name, all for None."""
    listed = listing_names(listings)
    if entity_types:
        listed = listed.where(F.col("entity_type").isin(entity_types))
    probe = names.select("name_id", "name", normalize_name(F.col("name")).alias("probe")).where(F.length("probe") >= 4)
    per_listing = _close_listings(probe, listed, min_ratio, mode)
    # the best listings depend on the name alone, so copies of a name are ranked once
    ranked = per_listing.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.col("ratio").desc(), "listing_id")))
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return probe.join(ranked, probe.probe == ranked.a).select("name_id", "name", "listing_id", "entity_type", "ratio", "rank")


def screen_names(names: DataFrame, listings: DataFrame, min_ratio: float = 0.88, entity_types: list[str] | None = None, mode: str = "levenshtein") -> DataFrame:
    """Exact hits at 0.9 and fuzzy hits at 0.6 + 0.3 x similarity; exact wins per (name, listing).

    Everything is decided between classes of equal spellings; their members are spread out at the end.
    """
    asked, listed = _sides(names, listings, entity_types)
    exact = _same(asked, listed)
    spelled = _asked_spellings(asked).where(F.length("probe") >= 4)
    close = _close_listings(spelled, _spellings(listed, []).withColumnRenamed("alike", "listing_id"), min_ratio, mode).withColumnsRenamed({"a": "probe", "listing_id": "alike"})
    fuzzy = spelled.join(close, "probe").select("asked", "name", "alike", "entity_type", "ratio").join(exact.select("asked", "alike"), ["asked", "alike"], "left_anti")
    pairs = exact.select("asked", "name", "alike", F.lit("name_exact").alias("match_type"), F.lit(0.9).alias("confidence"), F.lit(1.0).alias("similarity")).unionByName(
        fuzzy.select("asked", "name", "alike", F.lit("name_fuzzy").alias("match_type"), F.round(0.6 + 0.3 * F.col("ratio"), 2).alias("confidence"), F.round("ratio", 3).alias("similarity"))
    )
    return _members_of(pairs, asked, listed).select("name_id", "name", "listing_id", "match_type", "confidence", "similarity")


def screen_summary(matches: DataFrame) -> DataFrame:
    """Best confidence per screened name and whether it counts as sanctioned."""
    return matches.groupBy("name_id").agg(F.max("confidence").alias("max_confidence"), F.count("*").alias("matches")).withColumn("is_sanctioned", F.col("max_confidence") >= 0.85)


def _is_key(df: DataFrame, col: str) -> bool:
    return df.groupBy(col).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def screen_vessels(vessels: DataFrame, listings: DataFrame, fuzzy_min: float = 0.9, mode: str = "levenshtein") -> DataFrame:
    """Every way a vessel can match a listing, one row per (vessel, listing, match type)."""
    facts = listings.select(
        F.col("id").alias("listing_id"), "authority", F.col("name").alias("listed"), F.col("entity_type").alias("l_type"), F.coalesce("programs", F.array().cast("array<string>")).alias("programs"),
        "vessel_flag", F.col("imo").alias("l_imo"), F.col("vessel_type").alias("l_vtype"), F.col("country").alias("l_country"),
    )
    direct = match_identifiers(vessels, listings).select("vessel_id", "listing_id", "match_type", "matched_value", "confidence", F.lit(None).cast("double").alias("similarity"), "breach_type")
    shown = ["authority", "listed", "l_type", "programs"]
    direct = direct.join(facts.select("listing_id", *shown), "listing_id")

    # Screening reads distinct values, so a name or owner shared by many hulls is matched once, and all name columns of a
    # vessel meet the listings in one pass: hull names the vessels on the lists, owners and operators the parties.
    if not 0 < fuzzy_min <= 1:
        raise ValueError("fuzzy_min must lie between 0 and 1")
    columns = F.array(*[F.struct(F.lit(g).alias("kin"), F.col(c).alias("name")) for c, g in (("name", "vessel"), ("owner", "party"), ("operator", "party"), ("beneficial_owner", "party"))])
    distinct = vessels.select(F.explode(columns).alias("n")).select("n.*").where(F.col("name") != "").distinct()
    kin = F.when(F.col("entity_type") == "vessel", "vessel").when(F.col("entity_type").isin("company", "person"), "party")
    listed_names = listing_names(listings).withColumn("kin", kin).where(F.col("kin").isNotNull())
    probe = distinct.withColumn("probe", normalize_name(F.col("name")))
    # listings with the same names are alike: they are met once and spread out behind the last shuffle
    alike = _alike(listed_names, ["kin", "listing_id"], F.struct("entity_type", "listed_name"))
    spelled = _spellings(alike, ["kin"])
    same = probe.where(F.col("probe") != "").join(spelled.withColumnRenamed("listed_name", "probe"), ["kin", "probe"]).select("kin", "name", "alike").distinct().withColumn("similarity", F.lit(1.0))
    floor = F.when(F.col("kin") == "vessel", F.lit(fuzzy_min)).otherwise(F.lit(PARTY_MIN))
    close = _close_listings(probe.where(F.length("probe") >= 4), spelled.withColumnRenamed("alike", "listing_id"), min(fuzzy_min, PARTY_MIN), mode, "kin").where(F.col("ratio") >= floor - 1e-12)
    fuzzy = probe.join(close.withColumnsRenamed({"a": "probe", "listing_id": "alike"}), ["kin", "probe"]).select("kin", "name", "alike", F.col("ratio").alias("similarity"))
    found = same.unionByName(fuzzy)
    parties = _blocks(alike.join(facts, "listing_id"), ["kin", "alike"], F.struct(*facts.columns), "ls")

    def members_of(kin: str, col: str) -> DataFrame:
        hulls = vessels.where(F.col(col).isNotNull()).select(F.col(col).alias("name"), F.struct(F.col("id").alias("vessel_id"), F.col("flag").alias("v_flag"), F.col("imo").alias("v_imo"), F.col("ship_type").alias("v_type")).alias("v"))
        met = _expand(found.where(F.col("kin") == kin), parties, _blocks(hulls, ["name"], F.col("v"), "vs"), ["kin", "alike"], ["name"])
        return met.select("name", "similarity", "v.*", "l.*")

    named = members_of("vessel", "name").withColumn("v_name", F.col("name"))
    exact = F.col("similarity") == 1
    base = (
        F.when(F.col("vessel_flag") == F.col("v_flag"), F.when(exact, 0.9).otherwise(0.7))
        .when(F.coalesce("vessel_flag", F.lit("")) == "", F.when(exact, 0.8).otherwise(0.5))
        .otherwise(F.when(exact, 0.55).otherwise(0.35))
    )
    cap = (
        F.when(F.col("l_imo") != F.col("v_imo"), 0.3)
        .when(types_conflict(F.col("l_vtype"), F.col("v_type")), 0.35)
        .when(F.col("v_imo").isNull() & (F.length(normalize_name(F.col("v_name"))) <= 6), 0.5)
        .otherwise(1.0)
    )
    by_name = named.select(
        "vessel_id", "listing_id", F.when(exact, "name_exact").otherwise("name_fuzzy").alias("match_type"), F.col("v_name").alias("matched_value"),
        F.round(F.least(base, cap), 2).alias("confidence"), F.round("similarity", 3).alias("similarity"), F.lit("direct_match").alias("breach_type"), *shown,
    )

    def by_party(col: str, kind: str, start: float) -> DataFrame:
        party = members_of("party", col)
        bonus = F.when(F.col("l_country") == F.col("v_flag"), 0.05).otherwise(0.0)
        return party.select(
            "vessel_id", "listing_id", F.lit(kind).alias("match_type"), F.col("name").alias("matched_value"),
            F.round(F.when(F.col("similarity") == 1, start + bonus).otherwise(start - 0.1), 2).alias("confidence"), F.round("similarity", 3).alias("similarity"), F.lit("owner_match").alias("breach_type"), *shown,
        )

    listed = direct.unionByName(by_name)
    for col, kind, start in (("owner", "owner", 0.6), ("operator", "operator", 0.6), ("beneficial_owner", "beneficial_owner", 0.4)):
        listed = listed.unionByName(by_party(col, kind, start))
    if not (_is_key(vessels, "id") and _is_key(listings, "id")):
        # an id of several rows can match in several ways; ids that are keys match once each
        ranked = F.row_number().over(Window.partitionBy("vessel_id", "listing_id", "match_type").orderBy(F.col("confidence").desc()))
        listed = listed.drop(*shown).distinct().withColumn("_r", ranked).where("_r = 1").drop("_r").join(facts.select("listing_id", *shown), "listing_id")
    programs = F.create_map(*[F.lit(x) for pair in COMPREHENSIVE_PROGRAMS.items() for x in pair])
    program = F.try_element_at(programs, F.col("flag"))
    flagged = vessels.where(program.isNotNull()).select(
        F.col("id").alias("vessel_id"), F.lit(None).cast("long").alias("listing_id"), F.lit("flag_program").alias("match_type"), F.col("flag").alias("matched_value"), F.lit(0.55).alias("confidence"),
        F.lit(None).cast("double").alias("similarity"), F.lit("flag_violation").alias("breach_type"), F.lit("OFAC").alias("authority"),
        F.concat(F.lit("Comprehensive programme: "), program).alias("listed"), F.lit("programme").alias("l_type"), F.array(program).alias("programs"),
    )
    labels = F.create_map(*[F.lit(x) for pair in MATCH_LABELS.items() for x in pair])
    detail = F.when(F.col("similarity") < 1, F.format_string(" (similarity %.2f)", "similarity")).otherwise("")
    label = F.when(F.size("programs") > 0, F.array_join(F.slice("programs", 1, 3), ", ")).otherwise(F.col("l_type"))
    text = F.when(
        F.col("match_type") == "flag_program", F.concat(F.lit("Flag state "), F.col("matched_value"), F.lit(" falls under the comprehensive "), F.col("programs")[0], F.lit(" sanctions programme"))
    ).otherwise(F.concat(F.try_element_at(labels, F.col("match_type")), F.lit(" '"), F.col("matched_value"), F.lit("' matches "), F.col("authority"), F.lit(" listing '"), F.col("listed"), F.lit("' ["), label, F.lit("]"), detail))
    return listed.unionByName(flagged).select("*", severity_for_confidence(F.col("confidence")).alias("severity"), text.alias("summary"))


def match_companies(names: DataFrame, companies: DataFrame, min_ratio: float = 0.92, mode: str = "levenshtein") -> DataFrame:
    """Best tracked company per name (name_id, name, country) with strength strong, weak or none."""
    probe = names.select("name_id", "name", F.col("country").alias("n_country"), core_name(F.col("name")).alias("core"))
    known = companies.select(F.col("id").alias("company_id"), F.col("country").alias("c_country"), core_name(F.col("name")).alias("c_core")).where(F.col("c_core") != "")
    long_words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= 4)
    pairs = similar_names(probe.where(F.length("core") >= 5), known, "core", "c_core", min_ratio - 0.0005, mode)
    pairs = pairs.where((F.col("a") == F.col("b")) | F.arrays_overlap(long_words(F.col("a")), long_words(F.col("b")))).withColumn("score", F.round("ratio", 3)).where(F.col("score") >= min_ratio)
    # one winner per distinct core: highest score, then lowest id
    winner = pairs.join(known, pairs.b == known.c_core).groupBy("a").agg(F.max_by(F.struct("company_id", "c_country", "score"), F.struct("score", -F.col("company_id"))).alias("best"))
    joined = probe.join(winner, probe.core == winner.a, "left")
    single = F.size(F.split("core", " ")) == 1
    agrees = F.coalesce(F.col("n_country") == F.col("best.c_country"), F.lit(False))
    strength = F.when(F.col("best").isNull(), "none").when(single & ~agrees, "weak").otherwise("strong")
    return joined.select("name_id", "name", F.col("best.company_id").alias("company_id"), F.col("best.score").alias("score"), strength.alias("strength"))


def best_registry_match(queries: DataFrame, registry: DataFrame, min_ratio: float = 0.9, mode: str = "levenshtein") -> DataFrame:
    """Closest registry record per query (query_id, names array: the listing name and its aliases)."""
    probe = queries.select("query_id", F.explode(F.transform("names", core_name)).alias("core")).where(F.col("core") != "").distinct()
    spelled = registry.select("lei", F.explode(F.array_union(F.array("name"), F.coalesce("other_names", F.array().cast("array<string>")))).alias("n")).select("lei", core_name(F.col("n")).alias("r_core")).where(F.col("r_core") != "").distinct()
    pairs = similar_names(probe, spelled, "core", "r_core", min_ratio - 0.0005, mode).withColumn("score", F.round("ratio", 3)).where(F.col("score") >= min_ratio)
    # reduce each core name to its best record before query ids multiply it
    per_core = pairs.join(spelled, pairs.b == spelled.r_core).groupBy("a").agg(F.min_by(F.struct("lei", "score"), F.struct(-F.col("score"), F.col("lei"))).alias("m"))
    hits = probe.join(per_core, probe.core == per_core.a)
    best = hits.groupBy("query_id").agg(F.min_by("m", F.struct(-F.col("m.score"), F.col("m.lei"))).alias("best"))
    return best.select("query_id", "best.lei", "best.score")


def listing_peers(listings: DataFrame) -> DataFrame:
    """Every listing with the set of authorities that list the same normalised name."""
    shared = listings.groupBy("name_normalized").agg(F.array_sort(F.collect_set("authority")).alias("authorities"))
    return listings.join(shared, "name_normalized").select("id", "authority", "name", "name_normalized", "authorities")


def mentions(texts: DataFrame, names: DataFrame, min_length: int = 8) -> DataFrame:
    """Texts (text_id, text) that contain a name (name_id, name) as whole words.

    Names under ``min_length`` characters count only when they have two words. One automaton over the names walks along
    each text once.
    """
    several = F.contains(F.trim(words_of(F.col("name"))), F.lit(" "))
    wanted = names.where((F.length("name") >= min_length) | several)
    found = word_join(texts, wanted.select(F.struct("name_id", "name").alias("needle_id"), F.col("name").alias("needle")))
    return found.select("text_id", "needle_id.name_id", "needle_id.name")


def party_filter(dockets: DataFrame, listings: DataFrame) -> DataFrame:
    """Dockets found for a listing, kept only if the listing's core name stands in the title or the parties."""
    subject = listings.select(F.col("id").alias("listing_id"), core_name(F.col("name")).alias("core")).where(F.col("core") != "")
    text = F.upper(F.concat_ws(" ", "title", F.array_join("parties", " ")))
    return dockets.join(subject, "listing_id").where(F.contains(text, F.col("core"))).drop("core")
