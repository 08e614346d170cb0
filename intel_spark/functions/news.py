"""Country, sector, event-type and title expressions over news text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from intel_spark.functions.text import contains_any

# Demonyms; country names come from the caller's table.
DEMONYMS = {
    "russian": "RU", "ukrainian": "UA", "iranian": "IR", "north korean": "KP", "chinese": "CN", "american": "US", "british": "GB", "israeli": "IL",
    "syrian": "SY", "turkish": "TR", "saudi": "SA", "emirati": "AE", "indian": "IN", "venezuelan": "VE", "cuban": "CU", "libyan": "LY", "yemeni": "YE",
    "houthi": "YE", "taiwanese": "TW", "german": "DE", "french": "FR", "polish": "PL", "finnish": "FI", "estonian": "EE", "greek": "GR", "egyptian": "EG",
    "sudanese": "SD", "pakistani": "PK", "iraqi": "IQ", "lebanese": "LB", "belarusian": "BY", "georgian": "GE", "kazakh": "KZ", "malaysian": "MY", "panamanian": "PA",
}
# Case-sensitive abbreviations.
ABBREVIATIONS = [(r"\b(US|U\.S\.|USA)\b", "US"), (r"\b(UK|U\.K\.)\b", "GB"), (r"\bEU\b", "EU"), (r"\bUAE\b", "AE"), (r"\bDPRK\b", "KP")]
# Words per sector.
SECTOR_KEYWORDS = {
    "energy": ["oil", "crude", "tanker", "lng", "gas", "pipeline", "refinery", "opec", "petroleum", "fuel", "terminal"],
    "shipping": ["tanker", "vessel", "ship", "port", "strait", "canal", "maritime", "cargo", "container", "shipping", "fleet", "seized", "detained", "boarded"],
    "finance": ["sanction", "bank", "swift", "asset", "freeze", "crypto", "stablecoin", "wallet", "tariff", "export control", "designation", "ofac"],
    "defence": ["missile", "drone", "strike", "airstrike", "troops", "military", "naval", "warship", "attack", "offensive", "ceasefire"],
    "trade": ["tariff", "embargo", "export ban", "quota", "trade", "customs", "import ban"],
}
# Event types by the first pattern found, in this order.
EVENT_PATTERNS = [
    ("sanctions", r"sanction|\bofac\b|designat|asset freeze|blacklist|export control|price cap|\bsdn\b"),
    ("port_closure", r"\b(ports?|strait|canal|terminals?|harbou?rs?)\b.{0,40}\b(closed|closure|closes|shut|suspend|blockad|halted|reopen)|\bblockade\b"),
    ("maritime_incident", r"\b(tankers?|vessels?|ships?|freighters?|boats?)\b.{0,50}\b(seized|detained|boarded|attacked|hijack|struck|sank|sinking|collision|fire|drifting|aground)"
                          r"|\b(seize|detain|board|attack|hijack|intercept)\w*\b.{0,50}\b(tankers?|vessels?|ships?|freighters?)|shadow fleet|dark fleet|\bhormuz\b|red sea|bab el.mandeb"),
    ("infrastructure", r"pipeline|refiner(y|ies)|lng terminal|power plant|substation|oil depot|power grid|nuclear plant|export terminal"),
    ("trade", r"tariff|embargo|export ban|import ban|quota|trade war|customs dut"),
    ("conflict", r"airstrike|missile|drone|offensive|shelling|ceasefire|invasion|clash|explosion|attack|strikes? on|troops|warship"),
    ("political", r"\bcoup\b|martial law|state of emergency|election|parliament|resign|protest|arrest|detained|impeach"),
]
HIGH_IMPACT_TERMS = ["hormuz", "bab el-mandeb", "red sea", "suez", "black sea", "baltic", "pipeline", "refinery", "lng", "tanker", "sanction", "ofac", "nuclear", "missile", "blockade"]
SLUG_STOPWORDS = ["html", "htm", "php", "asp", "aspx", "amp", "index", "article", "articles", "news", "story", "stories", "id", "www"]
# Impact notes.
ENERGY_MARKET = "Energy price sensitivity: watch crude/product spreads and gas benchmarks"
ENERGY_SUPPLY = "Possible disruption to loading/discharge at affected terminals and routes"
ROUTE_SUPPLY = "Shipping route / port disruption - expect rerouting, delays and freight-rate moves"
SANCTIONS_MARKET = "Sanctions action: expect repricing of exposed assets and screening hits on newly designated entities"
SANCTIONS_SUPPLY = "New designations may strand cargoes or vessels tied to listed parties"
CONFLICT_MARKET = "Conflict in an energy-exporting region: risk premium on oil and gas"


def detect_countries(text: Column, names: dict[str, str]) -> Column:
    """ISO codes of the names (over three characters) and demonyms found as whole words, longest name first,
    then case-sensitive abbreviations; each code once.

    A plain substring test decides first, so the word-boundary pattern only runs for names that occur.
    """
    patterns = sorted({**{k: v for k, v in names.items() if len(k) > 3}, **DEMONYMS}.items(), key=lambda item: -len(item[0]))
    lowered = F.lower(text)
    table = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(iso).alias("iso")) for name, iso in patterns])
    whole_word = lambda p: F.contains(lowered, p["name"]) & F.regexp_like(lowered, F.concat(F.lit(r"\b\Q"), p["name"], F.lit(r"\E\b")))
    named = F.transform(F.filter(table, whole_word), lambda p: p["iso"])
    short = F.array_compact(F.array(*[F.when(text.rlike(pattern), F.lit(iso)) for pattern, iso in ABBREVIATIONS]))
    return F.array_distinct(F.concat(named, short))


def detect_sectors(text: Column) -> Column:
    """sectors with any keyword in the text, in table order."""
    lowered = F.lower(text)
    return F.array_compact(F.array(*[F.when(contains_any(lowered, words), F.lit(sector)) for sector, words in SECTOR_KEYWORDS.items()]))


def classify_text_or_null(text: Column) -> Column:
    lowered = F.lower(text)
    return F.coalesce(*[F.when(lowered.rlike(pattern), F.lit(kind)) for kind, pattern in EVENT_PATTERNS])


def classify_text(text: Column) -> Column:
    """first matching event type, "political" when none matches."""
    return F.coalesce(classify_text_or_null(text), F.lit("political"))


def severity_from_text(text: Column, base: Column) -> Column:
    """number of distinct high-impact terms raises the base severity."""
    lowered = F.lower(text)
    hits = sum(F.contains(lowered, F.lit(term)).cast("int") for term in HIGH_IMPACT_TERMS)
    return F.when(hits >= 3, "critical").when(hits >= 2, "high").when((hits == 1) & (base == "low"), "medium").otherwise(base)


def impact_notes(event_type: Column, sectors: Column, countries: Column) -> Column:
    """struct(market, supply)."""
    energy = F.array_contains(sectors, "energy")
    exporters = F.arrays_overlap(countries, F.array(*[F.lit(c) for c in ("RU", "UA", "IR", "IL", "YE", "SA")]))
    market = F.when(energy, ENERGY_MARKET).when(event_type == "sanctions", SANCTIONS_MARKET).when((event_type == "conflict") & exporters, CONFLICT_MARKET)
    supply = F.when(event_type.isin("port_closure", "maritime_incident"), ROUTE_SUPPLY).when(energy, ENERGY_SUPPLY).when(event_type == "sanctions", SANCTIONS_SUPPLY)
    return F.struct(market.alias("market"), supply.alias("supply"))


def title_from_url(url: Column) -> Column:
    """last path segment with four useful words, as a sentence; null without one or with a six-digit run."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", "")
    segments = F.filter(F.slice(F.split(path, "/"), 4, 10_000), lambda s: s != "")
    stop = F.array(*[F.lit(w) for w in SLUG_STOPWORDS])

    def words(segment):
        bare = F.regexp_replace(segment, r"(?i)\.(html?|php|aspx?|amp)$", "")
        return F.filter(F.split(bare, r"[-_+]+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$") & ~F.array_contains(stop, F.lower(w)))

    useful = F.filter(F.transform(segments, words), lambda ws: (F.size(ws) >= 4) & (F.length(F.array_join(ws, "")) > F.size(ws) * 3))
    best = F.array_join(F.try_element_at(useful, F.lit(-1)), " ")
    return F.when((best != "") & ~best.rlike(r"\d{6,}"), F.concat(F.upper(F.substring(best, 1, 1)), F.substring(best, 2, 10_000)))


# Aircraft details inside listing remarks.
AIRCRAFT_REMARKS = {
    "model": r"Aircraft Model ([^;]+)",
    "operator": r"Aircraft Operator ([^;]+)",
    "msn": r"Manufacturer's Serial Number \(MSN\) ([^;]+)",
    "mode_s": r"Aircraft Mode S Transponder Code ([0-9A-Fa-f]{6})",
    "tail": r"Aircraft Tail Number ([A-Z0-9-]+)",
}
# Registration prefixes to country.
REGISTRATION_PREFIXES = {
    "EP": "IR", "EX": "KG", "UP": "KZ", "RA": "RU", "RF": "RU", "P": "KP", "YK": "SY", "YV": "VE", "CU": "CU", "EW": "BY", "UR": "UA", "T7": "SM", "9H": "MT",
    "VP-B": "BM", "VP-C": "KY", "M": "IM", "2": "GG", "N": "US", "G": "GB", "D": "DE", "F": "FR", "TC": "TR", "A6": "AE", "A7": "QA", "HZ": "SA", "4K": "AZ",
    "EK": "AM", "YI": "IQ", "OD": "LB", "SU": "EG", "5A": "LY", "ST": "SD", "B": "CN", "JY": "JO", "UN": "KZ", "4L": "GE", "ER": "MD", "LZ": "BG", "YR": "RO",
}


def parse_aircraft_remarks(remarks: Column) -> Column:
    """struct of model, operator, msn, mode_s, tail."""
    text = F.coalesce(remarks, F.lit(""))
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit("")).alias(key) for key, pattern in AIRCRAFT_REMARKS.items()])


def registration_country(registration: Column) -> Column:
    """hyphenated prefix first, then bare prefixes of two characters, or N and B followed by a digit."""
    upper = F.upper(registration)
    prefixes = F.create_map(*[F.lit(x) for pair in REGISTRATION_PREFIXES.items() for x in pair])
    before_hyphens = [F.substring_index(upper, "-", n) for n in (2, 1)]
    hyphenated = [F.when(F.contains(upper, F.lit("-")) & (F.length(p) < F.length(upper)), F.try_element_at(prefixes, p)) for p in before_hyphens]
    two = F.try_element_at(prefixes, F.substring(upper, 1, 2))
    one = F.when(upper.rlike("^[NB][0-9]"), F.try_element_at(prefixes, F.substring(upper, 1, 1)))
    return F.coalesce(*hyphenated, two, one)


def extract_domains(remarks: Column) -> Column:
    """distinct website domains in order of mention."""
    mentions = F.regexp_extract_all(F.coalesce(remarks, F.lit("")), F.lit(r"(?i)Website\s+([^;,\s]+)"), 1)
    bare = r"(?:https?://)?(?:www\.)?([a-z0-9][a-z0-9-]{0,62}(?:\.[a-z0-9][a-z0-9-]{0,62})+)"
    domains = F.transform(mentions, lambda m: F.regexp_extract(F.rtrim(F.lower(m), F.lit(".")), bare, 1))
    return F.array_distinct(F.filter(domains, lambda d: d != ""))
