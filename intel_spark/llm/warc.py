"""WARC archives: written as Spark text files, read back by boundary-chain verification.

Archives are read in blocks, cut where a line begins with the magic: that separator never overlaps itself, so the cuts are
the same wherever a block begins, whatever line ends a payload holds. A task takes every stretch of bytes that looks like a
record header (the magic, a Content-Length, a record id) as a candidate and emits its offset with that of its successor. Payloads may hold such stretches
too, so a candidate counts only if the chain of successors from the file's start reaches it: each task follows the
chains within its block to the offset where they leave it, pointer jumping over the blocks' entries and exits finds the
entries that are reached from the start, and a walk within each block keeps the records on the chain. Payloads that end
in their block are hashed there; those that run over its end are collected in a second pass over the files, for at most
``SLICE`` records at a time. A file whose chain does not end at its last byte raises an error.

Of pages with equal payloads of ``SHARED`` bytes or more, the one with the least id is written as response, the others
as revisit without payload. Rows of that same id are all responses. A null payload is empty, a null id is written as
``none`` and read as null; urls may be null. Repeated rows give repeated records, an empty table no archive.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intel_spark.llm.base import fresh_path, query, settled, stored, table
from intel_spark.llm.blocks import block_rows, placed_blocks, runs

SHARED = 100
SLICE = 100_000
END = "\r\n\r\n"
MAGIC = b"WARC/1."
CUT = b"\n" + MAGIC
DATE = "2026-01-01T00:00:00Z"
HEADER = re.compile(rb"WARC/1\.[01]\r\n((?:[!-9;-~]+:[^\r\n]*\r\n)*[!-9;-~]+:[^\r\n]*)\Z")
FIELD = re.compile(rb"([!-9;-~]+):[ \t]*([^\r\n]*)")


def write_archives(pages: DataFrame, folder: str) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) into files under ``folder``."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2(F.col("payload").cast("binary"), 256), "size": F.octet_length("payload")})
    keys = rows.where(F.col("size") >= SHARED).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    revisits = keys.join(first.select("digest", "first"), "digest").where(~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = stored(revisits.select(F.col("page_id").alias("again"), F.col("digest").alias("same"), "first").distinct(), "warc-revisits")
    rows = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("again")) & (F.col("digest") == F.col("same")), "left")
    again = F.col("same").isNotNull()
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    line = lambda key, value: F.concat(F.lit(f"\r\n{key}: "), value)
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\x00-\x20\x7f]", "%20")
    block = F.when(again, F.lit("")).otherwise(F.col("payload"))
    record = F.concat(
        F.lit("WARC/1.0"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))), line("WARC-Record-ID", name("page_id")),
        line("WARC-Date", F.lit(DATE)), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(again, F.concat(line("WARC-Refers-To", name("first")), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(block).cast("string")), F.lit(END), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(folder)


def parse_header(value: bytes) -> dict[str, bytes] | None:
    """The fields of a record header, None if ``value`` is none."""
    if not value.startswith(b"WARC/1."):
        return None
    found = HEADER.match(value)
    if not found:
        return None
    fields = {k.decode("ascii").lower(): v.strip() for k, v in FIELD.findall(found[1])}
    return fields if fields.get("content-length", b"").isdigit() and len(fields["content-length"]) < 18 and fields.get("warc-record-id") else None


def page_of(name: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(found[1]) if found else None


SCAN = "file string, block long, at long, next long, leaves long, body long, size long, digest string, type string, page_id long, refers_to long, declared string"


def _scan(batches):
    """Candidates of every block: places relative to its first byte; ``at`` is null in the block's own row (``next``: its length, ``size``: the file's)."""
    def closed(file, block, found, total, length, open_):
        for record in open_:  # payloads that run over the block's end
            record["digest"] = None
        leaves: dict[int, int] = {}
        for record in reversed(found):
            leaves[record["at"]] = record["leaves"] = leaves.get(record["next"], record["next"])
        rows = [{"file": file, "block": block, "at": None, "next": length, "size": total}, *found]
        names = [f.split()[0] for f in SCAN.split(", ")]
        kinds = [pa.string(), *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.record_batch([pa.array([r.get(n) for r in rows], kind) for n, kind in zip(names, kinds)], names)

    state = None
    for file, block, values, begins, total in runs(batches):
        if begins:
            if state:
                yield closed(*state)
            found, open_, length = [], [], 0
            state = [file, block, found, total, 0, open_]
        for i, value in enumerate(values):
            # every value but a file's first follows a cut, whose magic belongs to its header
            missing = b"" if begins and i == 0 and block == 0 else MAGIC
            data = (value.as_py() or b"") + CUT
            view = memoryview(data)
            still = []
            for record in open_:  # this stretch belongs to their payloads
                take = min(record["left"], len(data))
                record["hash"].update(view[:take])
                record["left"] -= take
                if record["left"]:
                    still.append(record)
                else:
                    record["digest"] = record["hash"].hexdigest()
            open_ = still
            head = data.find(END.encode())
            fields = parse_header(missing + data[:head]) if head >= 0 else None
            if fields:
                size, begin = int(fields["content-length"]), head + len(END)
                digest = fields.get("warc-payload-digest", b"")
                record = {
                    "file": file, "block": block, "at": length - len(missing), "body": length + begin, "size": size, "next": length + begin + size + len(END), "hash": hashlib.sha256(view[begin : begin + size]),
                    "left": max(size - (len(data) - begin), 0), "type": fields.get("warc-type", b"").decode("ascii", "replace"), "page_id": page_of(fields["warc-record-id"]), "refers_to": page_of(fields.get("warc-refers-to")),
                    "declared": digest.removeprefix(b"sha256:").decode("ascii", "replace"),
                }
                found.append(record)
                if record["left"]:
                    open_.append(record)
                else:
                    record["digest"] = record["hash"].hexdigest()
            length += len(data)
            state[4], state[5] = length, open_
    if state:
        yield closed(*state)


def _reached_entries(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """(file, entry): the first record of each block on the chain from the file's start.

    Pointers from a candidate to where its chain leaves its block are doubled until no new entry is reached.
    """
    jump = settled(candidates.select("file", F.col("offset").alias("entry"), F.col("exit").alias("to")))
    reached = settled(blocks.select("file").distinct().withColumn("entry", F.lit(0).cast("long")).join(jump.select("file", "entry"), ["file", "entry"], "left_semi"))
    known = reached.count()
    while True:
        landed = reached.join(jump, ["file", "entry"]).select("file", F.col("to").alias("entry")).join(jump.select("file", "entry"), ["file", "entry"], "left_semi")
        reached = settled(reached.union(landed).distinct())
        now = reached.count()
        if now == known:
            return reached
        known = now
        further = jump.select("file", F.col("entry").alias("to"), F.col("to").alias("past"))
        jump = settled(jump.join(further, ["file", "to"], "left").select("file", "entry", F.coalesce("past", "to").alias("to")))


def _on_chain(frame: pd.DataFrame) -> pd.DataFrame:
    """The records of one block on the chain from its entry."""
    following = dict(zip(frame["offset"], frame["after"]))
    at, kept = int(frame["entry"].iloc[0]), []
    while at in following:
        kept.append(at)
        at = following[at]
    return frame[frame["offset"].isin(kept)].drop(columns=["entry", "after"])


RECORD = "file string, block long, offset long, body long, size long, digest string, type string, page_id long, refers_to long, declared string"


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(file, block, offset, body, size, digest, type, page_id, refers_to, declared) of the records on the chains."""
    scanned = settled(block_rows(spark, folder, CUT.decode()).mapInArrow(_scan, SCAN))
    blocks = settled(placed_blocks(scanned.where("at is null").select("file", "block", F.col("next").alias("length"))))
    candidates = scanned.where("at is not null").join(blocks.select("file", "block", "start"), ["file", "block"])
    shifted = {c: (F.col("start") + F.col(d)) for c, d in (("offset", "at"), ("after", "next"), ("exit", "leaves"), ("payload", "body"))}
    candidates = settled(candidates.withColumns(shifted))
    entries = _reached_entries(blocks, candidates)
    entered = candidates.select("file", "block", "offset").join(entries.select("file", F.col("entry").alias("offset")), ["file", "offset"]).select("file", "block", F.col("offset").alias("entry"))
    chained = candidates.select("file", "block", "offset", "after", F.col("payload").alias("body"), "size", "digest", "type", "page_id", "refers_to", "declared").join(entered, ["file", "block"])
    # null ids would become floats in a frame
    chained = chained.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})
    text = RECORD.replace("page_id long", "page_id string").replace("refers_to long", "refers_to string")
    records = chained.groupBy("file", "block").applyInPandas(_on_chain, text).withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})
    records = settled(records)
    ends = records.groupBy("file").agg((F.max(F.col("body") + F.col("size")) + len(END)).alias("end"))
    files = scanned.where("at is null").groupBy("file").agg(F.max("size").alias("bytes"))
    broken = files.join(ends, "file", "left").where(~F.col("bytes").eqNullSafe(F.col("end"))).first()
    if broken:
        raise ValueError(f"the records of {broken['file']} end at {broken['end']}, the file at {broken['bytes']}")
    over = records.where("digest is null")
    hashed = [_collected(spark, folder, blocks, over, lo) for lo in range(0, over.count(), SLICE)]
    if not hashed:
        return records
    found = hashed[0]
    for more in hashed[1:]:
        found = found.union(more)
    return records.join(found, ["file", "offset"], "left").withColumn("digest", F.coalesce("digest", "late")).drop("late")


def _collected(spark: SparkSession, folder: str, blocks: DataFrame, over: DataFrame, lo: int) -> DataFrame:
    """(file, offset, late): digests of payloads that lie in several blocks, for one slice of them."""
    wanted = over.select("file", "offset", "body", "size").orderBy("file", "offset").offset(lo).limit(SLICE)
    spans = wanted.join(blocks.select("file", "block", "start", "length"), "file").where("start < body + size and start + length > body")
    by_block: dict[tuple[str, int], list[tuple[int, int, int]]] = {}
    for r in spans.select("file", "block", "start", "offset", "body", "size").toLocalIterator():  # at most SLICE payloads
        by_block.setdefault((r["file"], r["block"]), []).append((r["start"], r["offset"], r["body"], r["size"]))
    shared = spark.sparkContext.broadcast(by_block)

    def pieces(batches):
        at = 0
        for file, block, values, begins, _ in runs(batches):
            parts = shared.value.get((file, block))
            if begins:
                at = parts[0][0] if parts else 0
            if not parts:
                continue
            out = []
            for value in values:
                data = (value.as_py() or b"") + CUT
                for _, offset, body, size in parts:
                    a, b = max(body, at), min(body + size, at + len(data))
                    if a < b:
                        out.append((file, offset, a, data[a - at : b - at]))
                at += len(data)
            if out:
                yield pa.record_batch([pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64(), pa.binary()))], ["file", "offset", "at", "data"])

    def digest(frame: pd.DataFrame) -> pd.DataFrame:
        own = hashlib.sha256(b"".join(frame.sort_values("at")["data"]))
        return pd.DataFrame({"file": [frame["file"].iloc[0]], "offset": [frame["offset"].iloc[0]], "late": [own.hexdigest()]})

    found = block_rows(spark, folder, CUT.decode()).mapInArrow(pieces, "file string, offset long, at long, data binary")
    return settled(found.groupBy("file", "offset").applyInPandas(digest, "file string, offset long, late string"))


def resolved_records(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); revisits get the size of what they refer to."""
    full = records.where("type = 'response'").select(F.col("page_id").alias("of"), F.col("digest").alias("same"), F.col("size").alias("full")).distinct()
    again = records.where("type = 'revisit'").join(full, F.col("refers_to").eqNullSafe(F.col("of")) & (F.col("declared") == F.col("same")), "left")
    plain = records.where("type = 'response'").select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return plain.unionByName(again.select("page_id", F.col("full").alias("payload_bytes"), F.col("same").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"))


ORACLE = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {SHARED} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""


@query("op9_warc", ORACLE)
def op9(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    folder = fresh_path(spark, "warc")
    write_archives(pages, folder)
    return resolved_records(read_archives(spark, folder))
