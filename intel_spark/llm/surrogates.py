"""PII surrogates: detected entities get keyed, type-consistent replacements that keep distinctness and coreference.

Only DataFrame functions run here. One pattern finds e-mail addresses, card numbers, phone numbers, IPv4 addresses, IBANs,
social security numbers, access keys, assigned secrets and titled person names. A replacement is a function of the secret
key, the entity's kind and its value, so every mention of a value is replaced alike, in every document, without a join:

* digits become digits and letters become letters of the same case and script (Latin, Greek, Cyrillic, Hebrew, Arabic,
  Devanagari, kana, Han, Hangul; Latin ones for other scripts), marks stay: the format is kept. A secret of marks alone
  becomes a token; a mask (one mark repeated) is no secret;
* a card number that passes the Luhn check gets one that passes it; an IPv4 address stays valid, and private if it was;
  phone numbers keep their country code; an e-mail's domain depends on the domain alone and keeps its last label;
* person names are made of syllables of their script with an ending of the gender that the title gives; a surname depends
  on the surname alone, so "Mr. John Smith" and "Mr. Smith" share it. Further mentions of these words in the same text, with
  a capital first letter, get the same replacements without a title; names that no title introduces in a text stay.

Collision checks keep distinct values distinct: replacements of all values of the corpus are compared with one another and
with the original values, and losers (all but the least value) move on to the next attempt until none is left. The
values with an attempt above 0 reach their texts by a join that Spark broadcasts only if it knows them to be small.

Values without a free replacement after ``ATTEMPTS`` tries give way in format: an address with a fixed first byte (private,
local, multicast) gets, with all others of that byte, its place in a keyed permutation of them, which may be another's
original but is never its own nor shared; any other value gets a longer replacement, a public address tries on.

Null texts stay null, empty texts empty; repeated rows are replaced alike; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, stored, table

KEY = "surrogate-key-1"  # a deployment passes its own
ATTEMPTS = 40

# fixed values: titles by the gender they give
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Signor", "Г-н", "г-н", "Господин", "господин", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Doña", "Signora", "Г-жа", "г-жа", "Госпожа", "госпожа", "Κυρία", "κυρία")
OTHER = ("Dr", "Prof", "Professor", "Mx")
TITLES = "|".join(sorted(MALE + FEMALE + OTHER, key=len, reverse=True))

# fixed values: name syllables of two letters by script, gendered endings
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe fi ga ge gi jo ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si ta te ti to va ve vi wa we za ze".split(), "n", "a"),
    "cyrillic": ("ба бе би бо ва ве ви го да де ди до жа за зе ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе по ра ре ри ро са се си та те ти то".split(), "н", "а"),
    "greek": ("βα βε γα γι δα δε δι θα θε κα κε κι κο λα λε λι λο μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο σα σε σι τα τε τι το φα φι".split(), "ς", "α"),
}

EMAIL = r"(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}][\p{L}\p{N}._%+'-]*+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = r"(?=[pPsStTaA])(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[\"']?(?!(?<mark>[^\p{L}\p{N}\s])\k<mark>*+(?:[\s\"'<>,;]|$))[^\s\"'<>,;]{6,}"
ACCESS = r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
CARD = r"(?<![\p{N}.-])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{15,16}|3[0-9]{3}[ -][0-9]{6}[ -][0-9]{5})(?![\p{N}])"
SSN = r"(?<![\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}-])"
IP = r"(?<![\p{N}.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\p{N}]|\.[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\+(?=(?:[ .()-]{0,2}[0-9]){8})[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{1,4}){1,7}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|(?<![\p{N}-])[0-9]{3}[-.][0-9]{3}[-.][0-9]{4})(?![\p{N}])"
INITIALS = "".join(sorted({t[0] for t in MALE + FEMALE + OTHER}))
WORD = r"\p{Lu}(?:[\p{L}-]|['’](?!s(?!\p{L})))+"  # an 's stays outside
NAME = r"(?=[" + INITIALS + r"])(?<![\p{L}])(?:" + TITLES + r")\.? " + WORD + "(?: " + WORD + "){0,2}"
PATTERN = "|".join((EMAIL, SECRET, ACCESS, IBAN, IP, CARD, SSN, PHONE, NAME))
#: Every entity holds one of these; texts without them are not searched further.
GATE = r"[@=:]|[0-9](?:[0-9]{2}|\.[0-9])|\+[0-9]|[A-Z]{2}[0-9]{2}|A[KS]IA|[" + INITIALS + r"][\p{L}-]{1,10}+\.?+ \p{Lu}"


def kind_of(value: Column) -> Column:
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(whole(SECRET), F.lit("secret")).when(whole(EMAIL), F.lit("email")).when(whole(ACCESS), F.lit("access_key")).when(whole(IBAN), F.lit("iban"))
        .when(whole(IP), F.lit("ip")).when(whole(CARD), F.lit("card")).when(whole(SSN), F.lit("ssn")).when(whole(PHONE), F.lit("phone")).otherwise(F.lit("name"))
    )


def _stream(key: str, *parts: Column) -> Column:
    """64 hex digits that only the key's holder can derive."""
    inner = F.sha2(F.concat_ws("\u001f", F.lit(key), *parts), 256)
    return F.sha2(F.concat(F.lit(key), inner), 256)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th byte of a stream, from 0, going round."""
    return F.conv(F.substring(stream, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def let(value: Column, then) -> Column:
    """``then`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


#: First bytes that an address keeps, besides 224 and above.
FIXED_BYTES = (0, 10, 127, 172, 192, 169)

#: Runs of letters that stand for each other, first and last code point.
LETTERS = [(0x61, 0x7A), (0x41, 0x5A), (0xE0, 0xF6), (0xC0, 0xD6), (0x3B1, 0x3C9), (0x391, 0x3A1), (0x430, 0x44F), (0x410, 0x42F), (0x5D0, 0x5EA), (0x627, 0x63A), (0x905, 0x939), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)]


def _shifted(letter: Column, by: Column) -> Column:
    """Another character of the same class and script; the shift is never 0 within a run."""
    def of(c: Column) -> Column:
        code = c["code"]
        out = F.when((code >= 48) & (code <= 57), _char(48 + F.pmod(code - 48 + 1 + c["by"] % 9, F.lit(10))))
        for lo, hi in LETTERS:
            size = hi - lo + 1
            out = out.when((code >= lo) & (code <= hi), _char(lo + F.pmod(code - lo + 1 + c["by"] % (size - 1), F.lit(size))))
        return out.when((code >= 128) & letter.rlike(r"[\p{L}\p{M}\p{N}]"), _char(97 + c["by"] % 26)).otherwise(letter)

    return let(F.struct(F.ascii(letter).alias("code"), by.alias("by")), of)


def _same_format(value: Column, stream: Column) -> Column:
    # an empty pattern cuts a string into its characters
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _shifted(c, _byte(stream, i))), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _check_digit(value: Column, draft: Column, stream: Column) -> Column:
    """The last digit of a card: right if the value's was."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    check = F.pmod(10 - _luhn_sum(F.concat(F.regexp_replace(draft, "[^0-9]", ""), F.lit("0"))) % 10, F.lit(10))
    return F.when(_luhn_sum(digits) % 10 == 0, check).otherwise(_byte(stream, F.lit(31)) % 10).cast("string")


def _last_bytes(third: Column, fourth: Column, key: str, tweak: Column) -> Column:
    """Another pair of bytes: the next but ``tweak``'s step in a keyed order of all pairs, so that no two pairs get the same."""
    swap = lambda s, i: F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_byte(_stream(key, F.lit("bytes"), tweak, i.cast("string"), s["r"].cast("string")), F.lit(0))).alias("r"))
    back = lambda s, i: F.struct(s["r"].bitwiseXOR(_byte(_stream(key, F.lit("bytes"), tweak, i.cast("string"), s["l"].cast("string")), F.lit(0))).alias("l"), s["l"].alias("r"))
    rounds = [F.lit(i) for i in range(6)]
    placed = F.aggregate(F.array(*rounds), F.struct(third.alias("l"), fourth.alias("r")), swap)
    step = 1 + _byte(_stream(key, F.lit("step"), tweak), F.lit(0))
    moved = let(placed, lambda s: let(F.pmod(s["l"] * 256 + s["r"] + step, F.lit(65536)), lambda n: F.struct(F.floor(n / 256).cast("int").alias("l"), (n % 256).cast("int").alias("r"))))
    return let(F.aggregate(F.array(*rounds[::-1]), moved, back), lambda s: F.concat_ws(".", s["l"], s["r"]))


def _permuted_ip(value: Column, key: str) -> Column:
    """An address of the same first byte and range from a keyed permutation of these addresses; none stays as it is."""
    part = F.split(value, r"\.")

    def of(p: Column) -> Column:
        a, b = p["a"], p["b"]
        turn = lambda i, n: F.pmod(i + _byte(_stream(key, F.lit("second"), a.cast("string")), F.lit(0)), F.lit(n)).cast("int")
        # the values of a range go round among themselves, so do those outside of it
        without = lambda gap, width: let(turn(F.when(b < gap, b).otherwise(b - width), 256 - width), lambda i: F.when(i < gap, i).otherwise(i + width))
        second = (
            F.when((a == 172) & b.between(16, 31), 16 + turn(b - 16, 16)).when(a == 172, without(16, 16)).when((a == 192) & (b != 168), without(168, 1)).when((a == 169) & (b != 254), without(254, 1))
            .when(a.isin(192, 169), b).otherwise(turn(b, 256))
        )
        return F.concat_ws(".", a, second, _last_bytes(p["c"], p["d"], key, F.concat_ws(".", a, b)))

    return let(F.struct(*[part[i].cast("int").alias(n) for i, n in enumerate("abcd")]), of)


def _ip(value: Column, stream: Column) -> Column:
    part = F.split(value, r"\.")
    first, second = part[0].cast("int"), part[1].cast("int")
    byte = lambda i: _byte(stream, F.lit(i))
    a = F.when(first.isin(*FIXED_BYTES) | (first >= 224), first).otherwise(11 + byte(0) % 89)
    b = F.when((first == 172) & second.between(16, 31), 16 + byte(1) % 16).when(((first == 192) & (second == 168)) | ((first == 169) & (second == 254)), second).otherwise(byte(1))
    return F.concat_ws(".", a, b, byte(2), byte(3))


#: What stays in front of a value: a secret's name, a phone's country code, a card's and a key's first characters.
HEAD = {
    "secret": r"^(?i:password|passwd|pwd|secret|token|api[_-]?key)[ \t]*[=:][ \t]*[\"']?", "phone": r"^(?:\+[0-9]{1,3}(?=[ .(-])|\+1|\+[0-9]{2}|)",
    "card": "^.", "access_key": "^.{4}",
}


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(value.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise(F.lit("latin"))


def _built_name(value: Column, stream: Column, kind: Column, longer: Column) -> Column:
    """A pronounceable word of the value's script: given names end by gender, surnames freely but for a feminine form."""
    def of(script: Column) -> Column:
        by_script = lambda f: F.when(script == "cyrillic", f("cyrillic")).when(script == "greek", f("greek")).otherwise(f("latin"))
        pool, count = by_script(lambda s: F.lit("".join(SYLLABLES[s][0]))), by_script(lambda s: F.lit(len(SYLLABLES[s][0])))
        picked = F.transform(F.sequence(F.lit(0), F.lit(2) + _byte(stream, F.lit(5)) % 2 + longer), lambda i: F.substring(pool, (_byte(stream, i) % count) * 2 + 1, F.lit(2)))
        ending = (
            F.when(kind == "given_m", by_script(lambda s: F.lit(SYLLABLES[s][1]))).when(kind == "given_f", by_script(lambda s: F.lit(SYLLABLES[s][2]))).when(kind == "given", by_script(lambda s: F.lit("i" if s == "latin" else SYLLABLES[s][1])))
            .when((script == "cyrillic") & value.rlike("(ова|ева|ина|ая)$"), F.lit("ова")).when((script == "cyrillic") & value.rlike("(ов|ев|ин|ий)$"), F.lit("ов")).otherwise(F.lit(""))
        )
        word = F.initcap(F.concat(F.array_join(picked, ""), ending))
        return F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(word)).otherwise(word)

    return let(_script(value), of)


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The replacement of a unit; ``attempt`` -1 asks for an address's place in the keyed permutation."""
    longer = F.greatest(attempt - (ATTEMPTS - 1), F.lit(0)) * 4
    folded = kind.isin("email", "given", "given_m", "given_f", "surname")
    seed = _stream(key, kind, F.when(folded, F.lower(value)).otherwise(value), attempt.cast("string"))
    at_domain = F.substring_index(value, "@", -1)
    domain_seed = F.when(kind == "email", _stream(key, F.lit("domain"), F.lower(at_domain)))

    def of(c: Column) -> Column:
        stream, head = c["seed"], c["head"]
        last = F.when(kind == "email", F.concat(F.lit("."), F.substring_index(value, ".", -1))).otherwise(F.lit(""))
        # the middle of a value, in parts that have a stream each: an e-mail's name and its domain
        middle = F.substring(value, F.length(head) + 1, F.length(value) - F.length(head) - F.length(last) - F.when(kind == "card", 1).otherwise(0))
        parts = F.when(kind == "email", F.array(F.substring_index(value, "@", 1), F.substring(at_domain, F.lit(1), F.length(at_domain) - F.length(last)))).otherwise(F.array(middle))
        hexed = (kind == "secret") & (middle.rlike("^[0-9a-f]{1,64}$") | ~middle.rlike(r"[\p{L}\p{M}\p{N}]"))
        token = lambda part: F.substring(F.repeat(stream, F.ceil(F.length(part) / 64).cast("int")), F.lit(1), F.length(part))
        more = F.when(longer > 0, F.substring(F.translate(F.reverse(stream), "abcdef", "012345"), F.lit(1), longer)).otherwise(F.lit(""))
        drawn = F.array_join(F.transform(parts, lambda part, i: F.concat(F.when(hexed, token(part)).otherwise(_same_format(part, F.when(i == 0, stream).otherwise(c["domain"]))), F.when(i == 0, more).otherwise(F.lit("")))), "@")
        draft = F.concat(head, drawn, last)
        return (
            F.when((kind == "ip") & (attempt < 0), _permuted_ip(value, key)).when(kind == "ip", _ip(value, stream)).when(kind.isin("given", "given_m", "given_f", "surname"), _built_name(value, stream, kind, longer))
            .otherwise(F.when(kind == "card", let(draft, lambda d: F.concat(d, _check_digit(value, d, stream)))).otherwise(draft))
        )

    head = F.lit("")
    for name, pattern in HEAD.items():
        head = F.when(kind == name, F.regexp_extract(value, pattern, 0)).otherwise(head)
    return let(F.struct(seed.alias("seed"), domain_seed.alias("domain"), head.alias("head")), of)


def entities(text: Column) -> Column:
    """All entities of a text in order, as they stand."""
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(PATTERN), 0)).otherwise(F.array().cast("array<string>"))


def _name_kinds(mention: Column) -> Column:
    """Units of a titled name: (kind, value, what stands before it)."""
    title = F.regexp_extract(mention, f"^(?:{TITLES})", 0)
    words = F.split(mention, " ")
    last = F.size(words) - 1
    given = F.when(title.isin(*MALE), F.lit("given_m")).when(title.isin(*FEMALE), F.lit("given_f")).otherwise(F.lit("given"))
    return F.transform(words, lambda w, i: F.struct(F.when(i == 0, F.lit("title")).when(i == last, F.lit("surname")).otherwise(given).alias("kind"), w.alias("value")))


def units(mentions: Column) -> Column:
    """Each mention as an array of (kind, value); all but the words of a name are one unit."""
    def of(mention: Column) -> Column:
        kind = kind_of(mention)
        return F.when(kind == "name", _name_kinds(mention)).otherwise(F.array(F.struct(kind.alias("kind"), mention.alias("value"))))

    return F.transform(mentions, of)


def resolved(found: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, value, attempt, surrogate) of the different units (kind, value), no two surrogates of a kind alike.

    Settled units are kept apart; each round tries the next replacement for the others only. From round ``ATTEMPTS`` on,
    replacements grow with the round, so that a free one is found whatever the values.
    """
    def tried(df: DataFrame) -> DataFrame:
        return df.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key))

    known = settled(found.withColumn("same", F.when(F.col("kind").isin("email", "given", "given_m", "given_f", "surname"), F.lower("value")).otherwise(F.col("value"))))
    # spellings of a value that differ in case only are one value
    open_units = known.groupBy("kind", "same").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(0))
    taken = known.select("kind", F.col("same").alias("surrogate_same")).distinct()
    done = None
    tries = 0
    while True:
        trial = tried(open_units).withColumn("surrogate_same", F.lower("surrogate"))
        if done is not None:
            used = done.select("kind", F.lower("surrogate").alias("surrogate_same")).union(taken)
        else:
            used = taken
        first = trial.groupBy("kind", "surrogate_same").agg(F.min("value").alias("winner"))
        judged = trial.join(first, ["kind", "surrogate_same"]).join(used.withColumn("clash", F.lit(True)).distinct(), ["kind", "surrogate_same"], "left")
        judged = settled(judged.select("kind", "same", "value", "attempt", "surrogate", ((F.col("winner") == F.col("value")) & F.col("clash").isNull()).alias("ok")))
        won = judged.where("ok").drop("ok")
        done = won if done is None else done.union(won)
        open_units = judged.where("not ok").select("kind", "same", "value", (F.col("attempt") + 1).alias("attempt"))
        if open_units.isEmpty():
            break
        tries += 1
        if tries == ATTEMPTS:
            # a byte's addresses are permuted together: a place may be what another of them had drawn
            byte = F.coalesce(F.when(F.col("kind") == "ip", F.substring_index("same", ".", 1).try_cast("int")), F.lit(-1))
            full = [r["byte"] for r in open_units.select(byte.alias("byte")).where(F.col("byte").isin(*FIXED_BYTES) | (F.col("byte") >= 224)).distinct().collect()]  # at most 38
            placed = settled(tried(done.drop("surrogate").unionByName(open_units).where(byte.isin(full)).withColumn("attempt", F.lit(-1))))
            done, open_units = settled(done.where(~byte.isin(full)).unionByName(placed)), settled(open_units.where(~byte.isin(full)))
            if open_units.isEmpty():
                break
    spelled = known.select("kind", "same", "value").join(done.select("kind", "same", "attempt"), ["kind", "same"]).select("kind", "value", "attempt")
    return tried(spelled)


def with_surrogates(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with its ``text`` replaced, and a column ``__entities`` with the number of entities found in each text."""
    from_text = F.col("text")
    found = docs.where(from_text.rlike(GATE)).select(F.explode(F.flatten(units(entities(from_text)))).alias("u")).select("u.*").where("kind <> 'title'").distinct()
    every = resolved(found, key)
    moved = stored(every.where("attempt <> 0").select("kind", "value", "attempt"), "surrogate-attempts")
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    keyed = docs.withColumn("__mentions", entities(from_text))
    if moved.isEmpty():
        keyed = keyed.withColumn("__attempts", F.lit(None).cast("map<string,int>"))
    else:
        hit = docs.where(from_text.rlike(GATE)).select(F.md5("text").alias("__text_key"), F.explode(F.flatten(units(entities(from_text)))).alias("u")).select("__text_key", "u.*").distinct()
        hit = hit.join(moved, ["kind", "value"]).groupBy("__text_key").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u001f", "kind", "value"), "attempt"))).alias("__attempts"))
        keyed = keyed.withColumn("__text_key", F.md5("text")).join(stored(hit, "surrogate-texts"), "__text_key", "left").drop("__text_key")
    parts = F.split(from_text, PATTERN, -1)
    swapped = F.transform(units(F.col("__mentions")), lambda us: F.array_join(F.transform(us, lambda u: _unit_text(u, F.col("__attempts"), key)), " "))
    titled = F.filter(F.flatten(units(F.col("__mentions"))), lambda u: u["kind"].isin("given", "given_m", "given_f", "surname"))
    named = F.transform(F.sort_array(F.array_distinct(titled), asc=False), lambda u: F.struct(F.lower(u["value"]).alias("word"), _unit_text(u, F.col("__attempts"), key).alias("text")))
    keyed = keyed.withColumns({"__swapped": swapped, "__names": named})
    further = lambda part: F.when(F.size("__names") > 0, _further(part, F.col("__names"))).otherwise(part)
    rebuilt = F.array_join(F.zip_with(parts, F.concat("__swapped", F.array(F.lit(""))), lambda a, b: F.concat(further(a), b)), "")
    text = F.when(F.size("__mentions") > 0, rebuilt).otherwise(from_text)
    out = keyed.withColumn("__entities", F.size("__mentions")).withColumn("text", text)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], "__entities")


def _further(part: Column, names: Column) -> Column:
    """``part`` with the words of ``names`` (word, text) replaced, spelled as they stand or all in capitals."""
    spelled = F.concat_ws("|", F.sort_array(F.transform(names, lambda n: n["word"]), asc=False))  # of two that begin alike, the longer first
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?-i:(?=\p{Lu}))(?:"), spelled, F.lit(r")(?!\p{L})"))
    put = lambda word: let(F.element_at(F.filter(names, lambda n: n["word"] == F.lower(word)), 1)["text"], lambda t: F.when(F.upper(word) == word, F.upper(t)).when(F.upper(t) == t, F.initcap(t)).otherwise(t))
    rest, words = F.split(part, pattern, -1), F.transform(F.regexp_extract_all(part, pattern, F.lit(0)), put)
    return F.concat(F.array_join(F.zip_with(F.slice(rest, 1, F.size(words)), words, lambda a, b: F.concat(a, b)), ""), F.element_at(rest, -1))


def _unit_text(u: Column, attempts: Column, key: str) -> Column:
    attempt = F.coalesce(F.element_at(attempts, F.concat_ws("\u001f", u["kind"], u["value"])), F.lit(0))
    return F.when(u["kind"] == "title", u["value"]).otherwise(surrogate(u["kind"], u["value"], attempt, key))


def anonymise(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with its texts replaced, and its columns as they were; ``n_chars``, if there, counts the new text."""
    out = with_surrogates(docs, key).drop("__entities")
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op6_pii_surrogates")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs).select("doc_id", F.col("__entities").alias("n_entities"), "text")
