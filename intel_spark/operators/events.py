"""News and coded events: drafting, relevance to other signals, summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intel_spark.functions.news import classify_text, classify_text_or_null, detect_countries, detect_sectors, impact_notes, severity_from_text, title_from_url
from intel_spark.functions.scoring import rank_severity, severity_rank
from intel_spark.functions.text import contains_any
from intel_spark.functions.vessel import lookup
from intel_spark.operators.timeline import asof, drop_bucket, running_sum
from intel_spark.session import checkpoint_ready

# Event codes, wire services and watched countries.
SANCTIONS_CODES = ["163", "172"]
CONFLICT_ROOTS = ["15", "18", "19", "20"]
POLITICAL_ROOTS = ["10", "11", "12", "13", "14", "16", "17"]
PRESS_RELEASES = ["prnewswire", "businesswire", "globenewswire", "newswire", "press-release", "einpresswire", "accesswire"]
WATCHLIST = ["RU", "UA", "BY", "IR", "IQ", "SY", "LB", "IL", "PS", "YE", "SA", "AE", "KP", "KR", "CN", "TW", "VE", "CU", "LY", "SD", "SS", "MM", "TR", "EG", "GE", "AM", "AZ", "KZ", "PK", "AF", "SO", "ER", "NG", "ML", "NE", "BF", "CD", "ET", "IN", "US", "GB", "EU", "FI", "EE", "LV", "LT", "PL", "GR", "CY", "MT", "PA", "LR", "MH", "GA", "CM", "KM", "SL", "HN"]
ROOT_LABELS = {
    "01": "public statement", "02": "appeal", "03": "intent to cooperate", "04": "consultation", "05": "diplomatic cooperation", "06": "material cooperation", "07": "aid", "08": "concession", "09": "investigation", "10": "demand",
    "11": "disapproval", "12": "rejection", "13": "threat", "14": "protest", "15": "force posture", "16": "reduced relations", "17": "coercion", "18": "assault", "19": "armed clash", "20": "mass violence",
}
BASE_LABELS = {
    "163": "sanctions / embargo imposed", "172": "administrative sanctions imposed", "171": "property seized", "173": "arrest or detention", "174": "expulsion", "175": "martial law", "181": "abduction", "182": "physical assault",
    "183": "suicide / car bombing", "184": "torture", "185": "assassination", "186": "attack on civilians", "190": "fighting", "191": "blockade", "192": "occupation", "193": "small arms fight", "194": "artillery / aerial fight",
    "195": "unconventional weapons", "196": "missile strike", "201": "mass expulsion", "202": "mass killings", "203": "ethnic cleansing", "204": "weapons of mass destruction", "141": "demonstration", "145": "riot", "150": "military posture",
    "151": "police alert", "152": "military alert", "153": "mobilisation", "154": "military exercise", "161": "diplomatic relations reduced", "162": "aid cut", "164": "halted negotiations", "130": "threat", "138": "threat of force", "139": "ultimatum",
}
ASSET_SECTORS = {"OIL": "energy", "BRENT": "energy", "NATGAS": "energy", "TTF": "energy", "GOLD": "finance", "SILVER": "finance", "COPPER": "trade", "BTC": "finance", "ETH": "finance"}


def _one_of(col: str, values: list[str]) -> Column:
    return F.coalesce(F.col(col).isin(values), F.lit(False))


def draft_events(coded: DataFrame, names: dict[str, str], watch: list[str] | None = None, min_mentions: int = 8) -> DataFrame:
    """Coded event rows to events: interest and coverage filters, type and severity ladder, headline corroboration.

    Cheap filters on codes and counts run before any text expression.
    """
    watched = WATCHLIST if watch is None else watch
    sanctions, conflict = _one_of("base_code", SANCTIONS_CODES), _one_of("root_code", CONFLICT_ROOTS)
    kept = coded.where((sanctions | conflict | _one_of("root_code", POLITICAL_ROOTS)) & (F.col("mentions") >= min_mentions) & F.col("country").isNotNull())
    kept = kept.where(~contains_any(F.col("url"), PRESS_RELEASES))
    on_watch = _one_of("country", watched) | _one_of("actor1_country", watched) | _one_of("actor2_country", watched)
    kept = kept.withColumn("on_watch", on_watch).where(F.col("on_watch") | sanctions | (F.col("mentions") >= 2 * min_mentions))
    violent = _one_of("root_code", ["18", "19", "20"])
    magnitude = -F.col("goldstein")
    rank = (
        F.when(violent & (F.col("mentions") >= 50), 3).when(violent | (sanctions & (F.col("mentions") >= 30)) | (magnitude >= 9), 2).when(_one_of("root_code", ["15", "17"]) | sanctions | (magnitude >= 5), 1).otherwise(0)
    )
    rank = F.when(F.col("on_watch"), rank).otherwise(F.greatest(F.lit(0), rank - 1))
    rank = F.when((rank >= 2) & (F.col("sources") < 2) & (F.col("mentions") < 20), 1).otherwise(rank)
    kind = F.when(sanctions, "sanctions").when(conflict | _one_of("base_code", ["171", "191", "192"]), "conflict").otherwise("political")
    label = F.coalesce(F.try_element_at(lookup(BASE_LABELS), F.col("base_code")), F.try_element_at(lookup(ROOT_LABELS), F.col("root_code")), F.lit("event"))
    staged = kept.select("*", rank_severity(rank).alias("sev0"), kind.alias("kind0"), label.alias("label"), title_from_url(F.col("url")).alias("slug"))
    staged = staged.withColumn("text_type", classify_text_or_null(F.col("slug")))
    headline = _one_of("text_type", ["maritime_incident", "port_closure", "infrastructure", "trade", "sanctions"])
    doubtful = F.col("slug").isNotNull() & ~headline & F.col("kind0").isin("conflict", "sanctions") & ~_one_of("text_type", ["conflict", "sanctions"])
    staged = staged.withColumn("event_type", F.when(headline, F.col("text_type")).otherwise(F.col("kind0"))).withColumn("corroborated", ~doubtful).where(F.col("corroborated") | (F.col("mentions") >= 2 * min_mentions))
    severity = F.when(~F.col("corroborated"), "low").when(F.col("slug").isNotNull(), severity_from_text(F.col("slug"), F.col("sev0"))).otherwise(F.col("sev0"))
    coded_countries = F.array_distinct(F.array_compact(F.array("country", "actor1_country", "actor2_country")))
    in_title = F.when(F.col("slug").isNotNull(), F.array_remove(detect_countries(F.col("slug"), names), "EU")).otherwise(F.array().cast("array<string>"))
    confidence = F.least(F.lit(0.95), 0.35 + 0.05 * F.least("sources", F.lit(6)) + 0.003 * F.least("mentions", F.lit(100)))
    confidence = F.when(F.col("corroborated"), F.round(confidence, 2)).otherwise(F.round(F.round(confidence * 0.6, 2), 2))
    actor = lambda c: F.initcap(F.lower(F.col(c)))
    place = F.nullif(F.trim(F.regexp_replace(F.coalesce("location", F.lit("")), "[�*]+", "")), F.lit(""))
    plain_title = F.concat(F.coalesce(actor("actor1"), F.lit("Unknown Actor")), F.lit(" - "), "label", F.coalesce(F.concat(F.lit(" - "), actor("actor2")), F.lit("")), F.coalesce(F.concat(F.lit(" ("), place, F.lit(")")), F.lit("")))
    second = F.coalesce(F.when(F.col("actor1_country") != F.col("country"), F.col("actor1_country")), F.when(F.col("actor2_country") != F.col("country"), F.col("actor2_country")))
    out = staged.select(
        "event_type", F.when(F.col("slug").isNotNull(), F.concat("slug", F.lit(" ["), "label", F.lit("]"))).otherwise(plain_title).alias("title"), F.coalesce("added", "date").alias("ts"), F.lit("coded_events").alias("source"), F.col("id").alias("source_id"), "url",
        severity.alias("severity"), confidence.alias("confidence"), "country", second.alias("country_secondary"), place.alias("region"), "lat", "lon", detect_sectors(F.concat_ws(" ", F.coalesce("slug", F.lit("")), "url", "label")).alias("sectors"),
        F.array_sort(F.array_union(coded_countries, in_title)).alias("countries"), "goldstein", "mentions",
    )
    notes = impact_notes(F.col("event_type"), F.col("sectors"), F.col("countries"))
    return out.select("*", notes["market"].alias("market_impact"), notes["supply"].alias("supply_chain_impact"))


def draft_articles(articles: DataFrame, names: dict[str, str], state_media: list[str] | None = None, base_confidence: float = 0.5) -> DataFrame:
    """Articles and feed items (title, url, ts, source, topic) to events; state media stays only when on topic, tagged."""
    title = F.col("title")
    typed = articles.withColumn("_type", classify_text_or_null(title)).withColumn("event_type", F.coalesce("topic", "_type", F.lit("political")))
    state = _one_of("source", state_media or [])
    typed = typed.withColumn("state_media", state)
    drafted = typed.select("*", detect_countries(title, names).alias("countries"), detect_sectors(title).alias("sectors"))
    drafted = drafted.where(~F.col("state_media") | F.col("_type").isNotNull() | (F.size("sectors") > 0))
    base = F.when(F.col("event_type").isin("sanctions", "maritime_incident", "port_closure", "infrastructure"), "medium").otherwise("low")
    notes = impact_notes(F.col("event_type"), F.col("sectors"), F.col("countries"))
    words = F.regexp_extract_all(title, F.lit("([A-Za-z][A-Za-z-]{3,})"))
    return drafted.select(
        "event_type", title.alias("title"), "ts", "source", F.col("url").alias("source_id"), "url", severity_from_text(title, base).alias("severity"), F.lit(base_confidence).alias("confidence"),
        F.try_element_at("countries", F.lit(1)).alias("country"), F.try_element_at("countries", F.lit(2)).alias("country_secondary"), "sectors", "countries",
        F.concat(words, F.when(F.col("state_media"), F.array(F.lit("state_media"))).otherwise(F.array().cast("array<string>"))).alias("keywords"), F.lit(None).cast("int").alias("mentions"), notes["market"].alias("market_impact"), notes["supply"].alias("supply_chain_impact"),
    )


def relevance(event_sectors: Column, event_countries: Column, event_type: Column, kind: Column, sector: Column, countries: Column) -> Column:
    """Shared sector, country, or sanctions / maritime theme, at most 1."""
    tracks = kind.isin("evasion_event", "transshipment")
    by_sector = F.when(F.coalesce(F.array_contains(event_sectors, sector), F.lit(False)), F.when(tracks, 0.3).otherwise(0.45)).otherwise(0.0)
    by_country = F.when(F.coalesce(F.arrays_overlap(event_countries, countries), F.lit(False)), 0.35).otherwise(0.0)
    sanctions = F.when((event_type == "sanctions") & kind.isin("sanctions_breach", "sanctions_update"), 0.4).otherwise(0.0)
    maritime = F.when(event_type.isin("maritime_incident", "port_closure") & kind.isin("evasion_event", "transshipment", "sanctions_breach"), 0.3).otherwise(0.0)
    return F.least(F.lit(1.0), by_sector + by_country + sanctions + maritime)


def event_reaches(events: DataFrame, signals: DataFrame, window_hours: float, min_score: float, top: int) -> DataFrame:
    """(event_id, us, signature, r, shared, reach): the signatures whose signals can be among an event's ``top``, and how far off.

    Relevance depends on what an event is about, not on its time, so it is worked out once per topic and signature. Where
    ``top`` signals of some relevance or more lie in an event's own slice of time, they score at least as much as that
    relevance gives across the slice, and what cannot reach that score is left out: nothing that counts is lost.
    ``events`` are (event_id, us, topic, event_type, sectors, countries), ``signals`` carry signature and us.
    """
    span = int(window_hours * 3_600_000_000)
    fine, wide = max(1, span // 48), max(1, span // 8)
    signatures = signals.groupBy("signature").agg(F.first("kind").alias("kind"), F.first("sector").alias("sector"), F.first("countries").alias("s_countries"))
    topics = events.groupBy("topic").agg(F.first("event_type").alias("event_type"), F.first("sectors").alias("sectors"), F.first("countries").alias("countries"))
    # a topic and a signature meet through something they share
    key = lambda kind, value: F.concat(F.lit(kind + ":"), value)
    none = F.lit(None).cast("string")
    sig_keys = F.concat(F.array(key("sector", F.col("sector")), F.when(F.col("kind").isin("sanctions_breach", "sanctions_update"), "theme:sanctions").otherwise(none), F.when(F.col("kind").isin("evasion_event", "transshipment", "sanctions_breach"), "theme:maritime").otherwise(none)), F.transform("s_countries", lambda c: key("country", c)))
    topic_keys = F.concat(F.transform("sectors", lambda s: key("sector", s)), F.transform("countries", lambda c: key("country", c)), F.array(F.when(F.col("event_type") == "sanctions", "theme:sanctions"), F.when(F.col("event_type").isin("maritime_incident", "port_closure"), "theme:maritime")))
    sk = signatures.select("signature", F.explode(F.array_compact(sig_keys)).alias("key")).distinct()
    tk = topics.select("topic", F.explode(F.array_compact(topic_keys)).alias("key")).distinct()
    met = tk.join(sk, "key").select("topic", "signature").distinct().join(signatures, "signature").join(topics, "topic")
    met = met.withColumn("r", relevance(F.col("sectors"), F.col("countries"), F.col("event_type"), F.col("kind"), F.col("sector"), F.col("s_countries"))).where(0.7 * F.col("r") + 0.3 >= min_score)
    met = met.select("topic", "signature", "r", F.coalesce(F.arrays_overlap("countries", "s_countries"), F.lit(False)).alias("shared")).checkpoint()
    held = lambda width, name: signals.groupBy("signature", F.floor(F.col("us") / width).alias(name)).agg(F.count("*").alias(f"n_{name}"))
    placed = events.select("event_id", "us", "topic", F.floor(F.col("us") / fine).alias("fine"), F.floor(F.col("us") / wide).alias("wide"))
    asked = placed.select("topic", "fine", "wide").distinct().join(met, "topic").join(held(fine, "fine"), ["signature", "fine"], "left").join(held(wide, "wide"), ["signature", "wide"], "left")
    # by wide too: a fine slice may lie across the end of a wide one
    cell = Window.partitionBy("topic", "fine", "wide")
    upto = cell.orderBy(F.col("r").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    asked = asked.withColumns({f"c_{w}": F.sum(F.coalesce(f"n_{w}", F.lit(0))).over(upto) for w in ("fine", "wide")})
    sure = lambda name, width: F.max(F.when(F.col(f"c_{name}") >= top, 0.7 * F.col("r") + 0.3 * (1 - width / span))).over(cell)
    # scores are rounded to thousandths
    need = F.greatest(F.lit(min_score - 0.0006), sure("fine", fine) - 0.0012, sure("wide", wide) - 0.0012)
    asked = asked.withColumn("need", need).where(0.7 * F.col("r") + 0.3 >= F.col("need"))
    reach = F.floor((1 - F.greatest(F.lit(0.0), (F.col("need") - 0.7 * F.col("r")) / 0.3)) * span)
    return placed.join(asked.select("topic", "fine", "wide", "signature", "r", "shared", reach.alias("reach")), ["topic", "fine", "wide"]).select("event_id", "us", "signature", "r", "shared", "reach")


def signal_blocks(signals: DataFrame, top: int) -> DataFrame:
    """(signature, kind, block, ts, back, back_ids, forth, forth_ids): every signature's signals by time in blocks of ``top``.

    ``ts`` is when the block starts. ``back`` are the times of this block and the one before, ``forth`` those of this block
    and the next, so that the ``top`` nearest on each side of a moment in the block are among them. Of signals of one
    moment the smaller ids count as nearer, before and after.
    """
    out = None
    for name, tie in (("back", "down"), ("forth", "up")):
        # ids of one moment in falling order, so that the smaller ones come nearer to what follows
        rows = signals if tie == "up" else signals.withColumn("down", F.dense_rank().over(Window.partitionBy("signature", "us").orderBy(F.col("id").desc())))
        numbered = drop_bucket(running_sum(rows, ["signature"], "ts", F.lit(1), "n", tie=["id" if tie == "up" else "down"]))
        packed = numbered.groupBy("signature", F.floor((F.col("n") - 1) / top).alias("block")).agg(F.first("kind").alias("kind"), F.min("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("n", "us", "id"))).alias("own"))
        packed = packed.select("signature", "block", "kind", "ts", F.col("own.us").alias("us"), F.col("own.id").alias("id"))
        beside = packed.select("signature", (F.col("block") + (1 if tie == "down" else -1)).alias("block"), F.col("us").alias("b_us"), F.col("id").alias("b_id"))
        both = packed.join(beside, ["signature", "block"], "left")
        pair = lambda c: F.concat(F.coalesce(f"b_{c}", F.slice(c, 1, 0)), c) if tie == "down" else F.concat(c, F.coalesce(f"b_{c}", F.slice(c, 1, 0)))  # noqa: E731, B023
        both = both.select("signature", "block", *(["kind", "ts"] if tie == "up" else []), pair("us").alias(name), pair("id").alias(f"{name}_ids"))
        out = both if out is None else out.join(both, ["signature", "block"])
    return out


def correlate_events(events: DataFrame, signals: DataFrame, window_hours: float = 24.0, min_score: float = 0.55, top: int = 40) -> DataFrame:
    """X08 (over J16): the strongest signals around each event, at most ``top``. Exact without pairing events with
    every signal near them.

    A signal's score depends on its signature (kind, sector, countries) and its distance in time. So per event and
    signature only the ``top`` nearest signals can matter, and of them those near enough to pass at all
    (``event_reaches``). They are read off one row of packed times (``signal_blocks``), and travel as arrays.
    ``events`` are (id, ts, event_type, sectors, countries), ``signals`` are (kind, id, ts, sector, countries).
    """
    checkpoint_ready(events.sparkSession)
    tidy = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))
    sig = signals.where("ts is not null").select("kind", "id", "ts", F.unix_micros("ts").alias("us"), "sector", tidy("countries").alias("countries"))
    sig = sig.withColumn("signature", F.to_json(F.struct("kind", "sector", "countries")))
    ev = events.where("ts is not null").select(F.col("id").alias("event_id"), F.unix_micros("ts").alias("us"), "event_type", tidy("sectors").alias("sectors"), tidy("countries").alias("countries"))
    ev = ev.withColumn("topic", F.to_json(F.struct("event_type", "sectors", "countries")))
    asked = event_reaches(ev, sig, window_hours, min_score, top).withColumn("ts", F.timestamp_micros("us"))
    blocks = signal_blocks(sig, top).checkpoint()  # read twice
    at = asof(asked, blocks.select("signature", "ts", "block"), ["signature"], "ts", ["block"], tie="block")
    near = at.select("event_id", "us", "signature", "r", "shared", "reach", F.coalesce("match.block", F.lit(0)).alias("block")).join(blocks.drop("ts"), ["signature", "block"])
    ids = blocks.schema["back_ids"].dataType
    one = lambda df, name: f"{name} {df.schema[name].dataType.simpleString()}"
    rows = near.select("event_id", "us", "kind", "r", "shared", "reach", "back", "back_ids", "forth", "forth_ids")
    close = rows.mapInArrow(nearest(top), f"{one(rows, 'event_id')}, us bigint, kind string, r double, shared boolean, at array<bigint>, ids {ids.simpleString()}")
    spark = events.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    best = close.repartition(parts, "event_id").sortWithinPartitions("event_id").mapInArrow(ranked(top, window_hours, min_score), f"{one(rows, 'event_id')}, us bigint, kind string, id {ids.elementType.simpleString()}, shared boolean, at bigint, score double")
    # minutes as a whole number towards zero
    delta = ((F.col("at") - F.col("us")) / 6e7).cast("long")
    return best.select(
        "event_id", F.col("kind").alias("alert_type"), F.col("id").alias("alert_id"), F.timestamp_micros("at").alias("alert_ts"), "score", delta.alias("delta_min"),
        F.when(F.abs(delta) <= 15, "simultaneous").when(delta > 0, "after").otherwise("before").alias("direction"), F.when(F.col("shared"), "geographic").otherwise("topical").alias("correlation_type"),
    )


PIECE = 2_000  # rows of arrays that are worked on at once


def _codes(values: pa.Array) -> np.ndarray:
    """Numbers in the order of the values; null comes first."""
    if pa.types.is_integer(values.type) and not values.null_count:
        return values.to_numpy()
    plain = values.to_pylist()
    order = {v: i for i, v in enumerate(sorted({v for v in plain if v is not None}))}
    return np.array([-1 if v is None else order[v] for v in plain], dtype="int64")


def _order(group: np.ndarray, key: np.ndarray, bits: int, ties: Callable[[np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """The order by group, then key, which has so many bits, then the columns that ``ties`` gives for the rows that are equal so far.

    Rows come as a few runs that are in order, which a stable sort makes use of; ties are few.
    """
    whole = (group << bits) | key if int(group[-1]).bit_length() + bits < 63 else None
    order = np.argsort(whole, kind="stable") if whole is not None else np.lexsort((key, group))
    g, k = group[order], key[order]
    same = (g[1:] == g[:-1]) & (k[1:] == k[:-1])
    if same.any():
        at = np.flatnonzero(np.append(False, same) | np.append(same, False))
        order[at] = order[at][np.lexsort((*reversed(ties(order[at])), k[at], g[at]))]
    return order


def _first(group: np.ndarray, n: int) -> np.ndarray:
    """Which rows are among the first ``n`` of their group; groups follow each other."""
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.arange(len(group)) - np.repeat(start, np.diff(np.append(start, len(group)))) < n


def _lists(values: pa.Array, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), values)


def nearest(top: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (event_id, us, kind, r, shared, reach, back, back_ids, forth, forth_ids): the ``top`` signals nearest to ``us``
    and within the reach, nearest first; of those equally near, by id, as they rank."""
    def run(batches):
        for batch in (whole.slice(i, PIECE) for whole in batches for i in range(0, whole.num_rows, PIECE)):
            long = lambda name: pc.list_value_length(batch.column(name)).to_numpy().astype("int64")  # noqa: B023, E731
            us, reach, n_back, n_forth = batch.column("us").to_numpy(), batch.column("reach").to_numpy(), long("back"), long("forth")
            times = np.concatenate([batch.column("back").flatten().to_numpy(), batch.column("forth").flatten().to_numpy()])
            ids = pa.concat_arrays([batch.column("back_ids").flatten(), batch.column("forth_ids").flatten()])
            # both sides of a row from the near end on: earlier ones backwards, then later ones
            count = n_back + n_forth
            row = np.repeat(np.arange(batch.num_rows), count)
            j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            earlier = j < n_back[row]
            at = np.where(earlier, np.cumsum(n_back)[row] - 1 - j, n_back.sum() + (np.cumsum(n_forth) - n_forth)[row] + j - n_back[row])
            gap = us[row] - times[at]
            kept = np.where(earlier, gap >= 0, gap < 0) & (np.abs(gap) <= reach[row])
            row, at, gap = row[kept], at[kept], np.abs(gap[kept])
            if len(row):
                order = _order(row, gap, int(gap.max()).bit_length(), lambda i: [_codes(ids.take(pa.array(at[i])))])  # noqa: B023
                order = order[_first(row[order], top)]
                row, at = row[order], at[order]
            count = np.bincount(row, minlength=batch.num_rows)
            yield pa.record_batch([*[batch.column(c) for c in ("event_id", "us", "kind", "r", "shared")], _lists(pa.array(times[at]), count), _lists(ids.take(pa.array(at)), count)], ["event_id", "us", "kind", "r", "shared", "at", "ids"])

    return run


def _thousandths(score: np.ndarray) -> np.ndarray:
    """Whole thousandths, halves away from zero as they are written in decimals."""
    scaled = score * 1000
    out = np.floor(scaled + 0.5).astype("int64")
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6):
        out[i] = int(Decimal(repr(float(score[i]))).scaleb(3).quantize(Decimal(1), ROUND_HALF_UP))
    return out


def ranked(top: int, window_hours: float, min_score: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of (event_id, us, kind, r, shared, at, ids), those of an event together: its ``top`` best signals."""
    def best(rows: pa.RecordBatch) -> pa.RecordBatch:
        event = rows.column("event_id").dictionary_encode().indices.fill_null(-1).to_numpy()
        event = np.cumsum(np.append(0, event[1:] != event[:-1])).astype("int64")
        row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows.column("at")).to_numpy())
        at, ids = rows.column("at").flatten().to_numpy(), rows.column("ids").flatten()
        off = at - rows.column("us").to_numpy()[row]
        t = 1 - np.abs(off / 3.6e9) / window_hours
        score = _thousandths(0.7 * rows.column("r").to_numpy()[row] + 0.3 * t)
        kept = np.flatnonzero((t > 0) & (score / 1000 >= min_score))
        if len(kept):
            gap, shared = np.abs(off[kept]), rows.column("shared").to_numpy(zero_copy_only=False)
            bits = int(gap.max()).bit_length()
            kind = _codes(rows.column("kind"))
            ties = lambda i: [kind[row[kept[i]]], _codes(ids.take(pa.array(kept[i]))), shared[row[kept[i]]], at[kept[i]]]
            order = _order(event[row[kept]], ((1000 - score[kept]) << bits) | gap, bits + 10, ties)
            kept = kept[order]
            kept = kept[_first(event[row[kept]], top)]
        of = lambda name: rows.column(name).take(pa.array(row[kept]))
        return pa.record_batch([of("event_id"), of("us"), of("kind"), ids.take(pa.array(kept)), of("shared"), pa.array(at[kept]), pa.array(score[kept] / 1000)], ["event_id", "us", "kind", "id", "shared", "at", "score"])

    def run(batches):
        held: list[pa.RecordBatch] = []  # the last event may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            ids = batch.column("event_id")
            last = ids[-1].as_py()
            if ids[0].as_py() == last:
                if len(held) > 1 and held[-2].column("event_id")[-1].as_py() != last:
                    yield best(_joined(held[:-1]))
                    held = [batch]
                continue
            codes = ids.dictionary_encode().indices.fill_null(-1).to_numpy()
            cut = int(np.flatnonzero(codes != codes[-1])[-1]) + 1
            yield best(_joined([*held[:-1], batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield best(_joined(held))

    return run


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def mark_correlated(events: DataFrame, links: DataFrame) -> DataFrame:
    """Flags of each event for market, maritime and sanctions links."""
    has = lambda *kinds: F.max(F.col("alert_type").isin(*kinds))
    flags = links.groupBy(F.col("event_id").alias("id")).agg(has("market_alert").alias("with_market"), has("sanctions_breach", "evasion_event", "transshipment").alias("with_maritime"), has("sanctions_update", "sanctions_breach").alias("with_sanctions"))
    return events.join(flags, "id", "left").fillna(False, ["with_market", "with_maritime", "with_sanctions"])


def geo_summary(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Tidy counts by type and severity, and the ten busiest countries."""
    recent = events.where(F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {hours} HOURS"))
    count = lambda metric, col: recent.groupBy(F.lit(metric).alias("metric"), F.col(col).alias("key")).agg(F.count("*").alias("value"))
    countries = count("country", "country").where(F.col("key").isNotNull()).orderBy(F.col("value").desc(), "key").limit(10)
    return count("event_type", "event_type").unionByName(count("severity", "severity")).unionByName(countries)


def country_timeline(events: DataFrame, iso: str, as_of: datetime, days: int = 30) -> DataFrame:
    """Per day: events touching the country, counts by type, worst severity."""
    touching = events.where((F.col("ts") >= F.lit(as_of) - F.expr(f"INTERVAL {days} DAYS")) & ((F.col("country") == iso) | (F.col("country_secondary") == iso) | F.array_contains("countries", iso)))
    by_type = touching.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").alias("n"), F.max(severity_rank(F.col("severity"))).alias("rank"))
    return by_type.groupBy("day").agg(F.sum("n").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("by_type"), rank_severity(F.max("rank")).alias("max_severity"))


def news_source_health(fetches: DataFrame) -> DataFrame:
    """Q32: items fetched so far and the latest status and latency per source."""
    return fetches.groupBy("source").agg(F.sum("items").alias("items_total"), F.max_by("status", "ts").alias("last_status"), F.max_by("latency_ms", "ts").alias("last_latency_ms"), F.max("ts").alias("last_fetch")).orderBy("source")
