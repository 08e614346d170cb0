"""Name and text expressions. Every function takes and returns Columns, so it runs as a projection."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words that carry no identity in a listing name.
LISTING_STOPWORDS = ["THE", "OF", "AND", "CO", "LTD", "LLC", "INC", "SA", "AO", "OOO", "COMPANY", "LIMITED", "SHIPPING", "MV", "MT"]

# Legal forms that are not part of a company's core name.
LEGAL_FORMS = [
    "LTD", "LIMITED", "LLC", "L L C", "INC", "INCORPORATED", "CORP", "CORPORATION", "CO", "COMPANY", "PLC", "GMBH", "AG", "SA", "S A", "SARL", "S A R L",
    "BV", "B V", "NV", "N V", "OOO", "OAO", "PAO", "ZAO", "AO", "JSC", "OJSC", "PJSC", "CJSC", "LLP", "LP", "PTE", "PTY", "SDN", "BHD", "SRL", "S R L", "SPA", "S P A",
    "KFT", "SP Z O O", "OY", "AB", "AS", "A S", "APS", "DAC", "FZE", "FZCO", "FZ LLC", "DMCC", "SE", "KK", "HOLDING", "HOLDINGS", "GROUP", "TRADING",
    "PUBLIC JOINT STOCK COMPANY", "JOINT STOCK COMPANY", "LIMITED LIABILITY COMPANY", "OPEN JOINT STOCK COMPANY", "CLOSED JOINT STOCK COMPANY",
]

# Words too common in headlines to tell one story from another.
HEADLINE_STOPWORDS = (
    "the a an and or of to in on for with by from at as is are was were be been has have had its their his her this that these those it not no will would could should "
    "may might can about over after before into than more most new says said say amid under against between during without within while "
    "russia russian russians ukraine ukrainian ukrainians kiev kyiv moscow west western media state official officials minister ministry president attack attacks "
    "attacked report reports reported news week year years time first last country countries government military forces"
).split()

# Roman numerals folded to digits in ship names.
ROMAN = {"I": "1", "II": "2", "III": "3", "IV": "4", "V": "5", "VI": "6", "VII": "7", "VIII": "8", "IX": "9", "X": "10", "XI": "11", "XII": "12"}


@lru_cache(maxsize=1)
def _folding() -> tuple[str, str, dict[str, str]]:
    """Compatibility folding to ASCII, derived from the Unicode tables: one-to-one pairs and longer expansions."""
    source, target, longer = [], [], {}
    for point in [*range(0x80, 0x2100), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        folded = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            source.append(chr(point))
            target.append(folded)
        elif len(folded) > 1 and (point < 0x2100 or 0xFB00 <= point < 0xFB07):
            longer[chr(point)] = folded
    return "".join(source), "".join(target), longer


def fold_ascii(text: Column) -> Column:
    """Accents removed, other non-ASCII characters dropped."""
    source, target, longer = _folding()
    # characters that fold to several letters are rare: only such texts are taken apart
    several = F.create_map(*[F.lit(x) for pair in longer.items() for x in pair])
    expanded = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(several, c), c)), "")
    text = F.when(text.rlike("[" + "".join(longer) + "]"), expanded).otherwise(text)
    # plain ASCII input, the common case, skips the table
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, source, target), r"[^\x00-\x7F]", "")).otherwise(text)


def normalize_name(name: Column) -> Column:
    """upper-case ASCII letters and digits with single spaces; null becomes empty."""
    upper = F.upper(fold_ascii(F.coalesce(name, F.lit(""))))
    return F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", " "))


def clean_ais_name(name: Column) -> Column:
    """radio padding and stray punctuation removed; empty becomes null."""
    spaced = F.regexp_replace(F.translate(name, "@", " "), r"\s+", " ")
    return F.nullif(F.btrim(spaced, F.lit(" -_.")), F.lit(""))


def name_token(name: Column) -> Column:
    """letters and digits only, roman numerals and "NO. 2" spellings folded."""
    text = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "[^A-Z0-9 ]", " ")
    text = F.regexp_replace(text, r"\bNO ?(\d)", "NO$1")
    numerals = F.create_map(*[F.lit(x) for pair in ROMAN.items() for x in pair])
    words = F.filter(F.split(text, " +"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(numerals, w), w)), "")


def is_name_variant(old: Column, new: Column) -> Column:
    return name_token(old) == name_token(new)


def core_name(name: Column) -> Column:
    """normalised name without legal forms at either end; at least one word stays."""
    forms = "|".join(sorted(LEGAL_FORMS, key=lambda form: (-len(form.split()), form)))
    text = normalize_name(name)
    # The greedy head leaves the shortest form run to strip, so alternation goes from four words down to one;
    # a repeated group strips form after form while the lookaround keeps one word.
    text = F.regexp_replace(text, rf"(?<=[A-Z0-9])(?: (?:{forms}))+$", "")
    return F.regexp_replace(text, rf"^(?:(?:{forms}) )+(?=[A-Z0-9])", "")


def latin_enough(name: Column, minimum: float = 0.6) -> Column:
    """most letters survive ASCII folding."""
    letters = F.length(F.regexp_replace(F.coalesce(name, F.lit("")), r"[^\p{L}]", ""))
    kept = F.length(F.regexp_replace(normalize_name(name), "[^A-Z]", ""))
    return F.when(letters == 0, F.lit(False)).otherwise(kept / letters >= minimum)


def clean_company_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s+", " "))


def listing_tokens(normalized: Column) -> Column:
    """distinct words of three letters or more that are not stopwords."""
    words = F.filter(F.split(normalized, " "), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.array_except(words, F.array(*[F.lit(w) for w in LISTING_STOPWORDS])))


def topic_tokens(title: Column) -> Column:
    """headline words in order, stopwords removed."""
    stop = F.array(*[F.lit(w) for w in HEADLINE_STOPWORDS])
    words = F.regexp_extract_all(F.lower(title), F.lit("([a-z][a-z-]{3,})"))
    return F.filter(words, lambda w: ~F.array_contains(stop, w))


@F.pandas_udf(DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    matcher = SequenceMatcher(autojunk=False)

    def ratio(left, right):
        if left is None or right is None:
            return None
        matcher.set_seqs(left, right)
        return matcher.ratio()

    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def name_ratio(a: Column, b: Column, mode: str = "levenshtein") -> Column:
    """similarity in [0, 1]; "sequence" is the longest-matching-block ratio, computed on Arrow batches."""
    if mode == "sequence":
        return _sequence_ratio(a, b)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def company_similarity(a: Column, b: Column, mode: str = "levenshtein") -> Column:
    """F36 on core names: 0 when either is empty, 1 when equal, else the ratio to three places."""
    left, right = core_name(a), core_name(b)
    return (
        F.when((left == "") | (right == ""), F.lit(0.0)).when(left == right, F.lit(1.0)).otherwise(F.round(name_ratio(left, right, mode), 3))
    )


def fingerprint(text: Column, length: int = 40) -> Column:
    """leading characters of the SHA-1 of the text."""
    return F.substring(F.sha1(text.cast("binary")), 1, length)


def contains_any(text: Column, words) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found
