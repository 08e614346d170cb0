"""Ship identity, type and cargo expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ship-type and navigation-status codes of the AIS standard.
SHIP_TYPE_TENS = {
    2: "Wing in ground", 3: "Fishing", 4: "High-speed craft", 5: "Special craft", 6: "Passenger", 7: "Cargo", 8: "Tanker", 9: "Other",
}
SHIP_TYPE_EXACT = {
    30: "Fishing", 31: "Towing", 32: "Towing (large)", 33: "Dredging", 34: "Diving", 35: "Military", 36: "Sailing", 37: "Pleasure craft",
    50: "Pilot vessel", 51: "Search and rescue", 52: "Tug", 53: "Port tender", 54: "Anti-pollution", 55: "Law enforcement", 58: "Medical transport",
}
NAV_STATUS = {
    0: "underway", 1: "at_anchor", 2: "not_under_command", 3: "restricted_manoeuvrability", 4: "constrained_by_draught", 5: "moored", 6: "aground",
    7: "fishing", 8: "sailing", 11: "towing_astern", 12: "pushing_ahead", 14: "ais_sart", 15: "undefined",
}
# Coarse ship categories by first word found, in this order.
TYPE_CATEGORIES = {
    "tanker": "tanker", "crude": "tanker", "lng": "tanker", "lpg": "tanker", "chemical": "tanker", "product": "tanker",
    "cargo": "cargo", "bulk": "cargo", "container": "cargo", "general": "cargo", "ro-ro": "cargo", "reefer": "cargo",
    "fishing": "fishing", "passenger": "passenger", "ferry": "passenger", "tug": "service", "pilot": "service",
    "sailing": "leisure", "pleasure": "leisure", "yacht": "leisure",
}
# Plausible top speed in knots by declared type.
MAX_SPEED_BY_TYPE = {"high-speed craft": 70.0, "passenger": 45.0, "military": 45.0, "pleasure craft": 60.0, "search and rescue": 50.0, "law enforcement": 50.0}
DEFAULT_MAX_SPEED = 30.0
# Words that mark a tanker, and hull classes as (longest m, class, deadweight t, deepest draught m).
TANKER_WORDS = ["tanker", "crude", "oil", "chemical", "lng", "lpg", "gas carrier", "product"]
SIZE_CLASSES = [
    (120, "small_tanker", 8_000, 7.0), (160, "handysize", 30_000, 9.5), (190, "medium_range", 50_000, 12.5), (230, "panamax_lr1", 75_000, 14.0),
    (260, "aframax_lr2", 110_000, 15.0), (290, "suezmax", 160_000, 17.0), (400, "vlcc", 300_000, 21.0),
]
LARGEST_CLASS = ("ulcc", 400_000, 23.0)
BARRELS_PER_TONNE = {"crude": 7.3, "products": 8.0, "mixed": 7.5, "lpg": 11.0, "lng": 0.0}
# Types and name hints that rule a hull out of a cargo rendezvous.
EXCLUDED_TYPES = ["tug", "pilot", "passenger", "fishing", "search and rescue", "port tender", "sailing", "pleasure", "law enforcement", "military", "dredging", "hsc", "wing in ground", "diving", "towing"]
FISHING_NAME_HINTS = ["F/V", "F\\V", "FV ", "MFV", "FISHING", "TRAWLER"]
MOORED_STATUSES = ["moored", "aground"]


def lookup(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lower_type(ship_type: Column) -> Column:
    return F.lower(F.coalesce(ship_type, F.lit("")))


def valid_imo(value: Column) -> Column:
    """seven digits whose weighted sum ends in the check digit, else null."""
    digits = F.trim(F.regexp_replace(F.upper(F.trim(value.cast("string"))), "^IMO", ""))
    total = sum(F.substring(digits, i + 1, 1).try_cast("int") * (7 - i) for i in range(6))
    good = digits.rlike("^[0-9]{7}$") & ~digits.rlike(r"^(\d)\1{6}$") & (digits != "1234567") & (total % 10 == F.substring(digits, 7, 1).try_cast("int"))
    return F.when(good, digits)


def extract_imo(text: Column) -> Column:
    """the seven digits that follow the word IMO in free text."""
    return F.nullif(F.regexp_extract(text, r"(?i)\bIMO\b[^0-9]{0,40}?(\d{7})\b", 1), F.lit(""))


def flag_from_mmsi(mmsi: Column, prefix_map: Column) -> Column:
    """flag of the first three digits, "XX" when unknown; ``prefix_map`` is a map column."""
    return F.coalesce(F.try_element_at(prefix_map, F.substring(mmsi.cast("string"), 1, 3)), F.lit("XX"))


def country_to_iso(name: Column, country_map: Column) -> Column:
    return F.try_element_at(country_map, F.lower(F.trim(name)))


def ship_type_name(code: Column) -> Column:
    """F06"""
    return F.coalesce(F.try_element_at(lookup(SHIP_TYPE_EXACT), code.cast("int")), F.try_element_at(lookup(SHIP_TYPE_TENS), F.floor(code / 10).cast("int")))


def nav_status_name(code: Column) -> Column:
    return F.try_element_at(lookup(NAV_STATUS), code.cast("int"))


def type_category(ship_type: Column) -> Column:
    lowered = lower_type(ship_type)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(word)), F.lit(category)) for word, category in TYPE_CATEGORIES.items()])


def types_conflict(listed: Column, observed: Column) -> Column:
    """both categories known and different."""
    return F.coalesce(type_category(listed) != type_category(observed), F.lit(False))


def plausible_max_speed(ship_type: Column) -> Column:
    """F16"""
    lowered = lower_type(ship_type)
    return F.coalesce(*[F.when(F.contains(lowered, F.lit(word)), F.lit(limit)) for word, limit in MAX_SPEED_BY_TYPE.items()], F.lit(DEFAULT_MAX_SPEED))


def is_tanker(ship_type: Column) -> Column:
    """F17"""
    return lower_type(ship_type).rlike("|".join(TANKER_WORDS))


def matches_commodity(ship_type: Column, commodity: Column) -> Column:
    gas = lower_type(ship_type).rlike("lng|gas")
    return F.when(F.coalesce(commodity, F.lit("")) == "lng", gas).otherwise(is_tanker(ship_type))


def size_class(length_m: Column) -> Column:
    """struct(name, dwt, max_draught); null without a length."""
    def entry(name, dwt, draught):
        return F.struct(F.lit(name).alias("name"), F.lit(float(dwt)).alias("dwt"), F.lit(draught).alias("max_draught"))

    ladder = F.when(F.coalesce(length_m, F.lit(0.0)) == 0, F.lit(None))
    for longest, name, dwt, draught in SIZE_CLASSES:
        ladder = ladder.when(length_m <= longest, entry(name, dwt, draught))
    return ladder.otherwise(entry(*LARGEST_CLASS))


def estimate_cargo(length_m: Column, draught_arrival: Column, draught_departure: Column, commodity: Column, loading: bool = True) -> Column:
    """struct(laden, barrels, size_class, basis) from the draught change and the hull class."""
    hull = size_class(length_m)
    reference, other = (draught_departure, draught_arrival) if loading else (draught_arrival, draught_departure)
    known = F.coalesce(reference, F.lit(0.0)) != 0
    changed = known & (F.coalesce(other, F.lit(0.0)) != 0) & (F.abs(reference - other) >= 1.0)
    is_lng = F.coalesce(commodity, F.lit("")) == "lng"
    laden = (
        F.when(is_lng, F.lit(None).cast("boolean"))
        .when(changed, reference > other)
        .when(known & hull.isNotNull(), reference >= 0.8 * hull["max_draught"])
        .when(known & (reference >= 12.0), F.lit(True))
    )
    basis = (
        F.when(is_lng, "lng_no_barrel_estimate")
        .when(changed, "draught_change")
        .when(known & hull.isNotNull(), "draught_vs_class_max")
        .when(known & (reference >= 12.0), "deep_draught")
        .otherwise("unknown")
    )
    factor = F.coalesce(F.try_element_at(lookup(BARRELS_PER_TONNE), F.coalesce(commodity, F.lit("crude"))), F.lit(7.3))
    full = F.round(hull["dwt"] * 0.95 * factor)
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.5), reference / hull["max_draught"]))
    barrels = F.when(laden & hull.isNotNull(), F.when(known, F.round(full * share)).otherwise(full))
    return F.struct(laden.alias("laden"), barrels.alias("barrels"), hull["name"].alias("size_class"), basis.alias("basis"))


def predicted_cargo(ship_type: Column, sanctioned_facility: Column) -> Column:
    """F33"""
    lowered = lower_type(ship_type)
    tanker = F.when(F.coalesce(sanctioned_facility, F.lit(False)), F.lit("crude/products")).otherwise("petroleum/chemicals")
    return F.when(F.contains(lowered, F.lit("tanker")), tanker).when(F.contains(lowered, F.lit("cargo")), "dry bulk/general cargo")


def dwell_hours(arrival: Column, departure: Column) -> Column:
    return F.round((F.unix_micros(departure) - F.unix_micros(arrival)) / 3.6e9, 2)


def days_between(a: Column, b: Column) -> Column:
    return F.abs(F.unix_micros(b) - F.unix_micros(a)) / 8.64e10


def typed_hull(ship_type: Column) -> Column:
    return lower_type(ship_type).rlike("tanker|cargo")


def tanker_hull(ship_type: Column) -> Column:
    return F.contains(lower_type(ship_type), F.lit("tanker"))


def rendezvous_plausible(ship_type: Column, name: Column, nav_status: Column) -> Column:
    """Not a service craft, not named like a fishing boat, not moored."""
    upper = F.upper(F.coalesce(name, F.lit("")))
    fishing = F.lit(False)
    for hint in FISHING_NAME_HINTS:
        fishing = fishing | F.startswith(upper, F.lit(hint))
        if len(hint) > 3:
            fishing = fishing | F.contains(upper, F.lit(hint))
    return ~lower_type(ship_type).rlike("|".join(EXCLUDED_TYPES)) & ~fishing & ~F.coalesce(nav_status, F.lit("")).isin(MOORED_STATUSES)
