"""N-gram Jaccard join with adaptive multi-match prefixes.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold. Let n be a set's size
and a = ceil(t * n) the least overlap a partner needs. In one global order of the shingles, two linked sets that both
take the first n - a + l shingles share at least l of them (the l-prefix). A document's own l is the one that makes
``scan + verify`` cheapest, estimated from the frequencies of its own prefix: a longer prefix is scanned more, but
its partners must share more of it. A pair uses the smaller l of the two.

* The global order is by frequency in a sketch of fixed size over all documents (ties by hash). Any order gives the
  same links; a good one keeps common passages out of the prefixes.
* Equal sets are one class and take part once.
* A shared prefix shingle first links every class to one centre per shingle; classes so connected need no further pairs,
  so a group of n near copies costs n pairs and not n * n. All pairs of prefix partners that are not yet connected are
  then enumerated under the size and position conditions, and those with too few matches in their l-prefixes go. None of
  the conditions can lose a link.
* Candidates are verified on the whole sets.

Nulls and empty texts have no shingles and link with nothing. Equal rows are copies of one class. Rows without an id
take part; their component is the least id among their partners, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, stored, table
from intel_spark.llm.shingles import WORDS, mix, shingle_rows
from intel_spark.operators.graph import checkpointed_components as connected_components

SKETCH_BITS = 22
SKETCH_PARTS = 1024
HOT = 4096  # a shingle estimated to stand in more prefixes is salted
MAX_MATCH = 8
VERIFY_WEIGHT = 2.0  # cost of verifying a candidate, against one posting read
FILTER_BITS = 23
ROWS = 32
_SEED_A, _SEED_B = np.uint64(0x51ED270B9F1F2A31), np.uint64(0x2545F4914F6CDD1D)


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    """96 bits that name a set: sums of two finalised hashes of its members."""
    a = mix(own ^ _SEED_A).sum(dtype=np.uint64).astype(np.int64)
    b = (mix(own ^ _SEED_B).sum(dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(own) else 0
    return int(a), int(b)


def set_keys(k: int = WORDS):
    """Arrow UDF: a text's set size and fingerprint."""
    kind = pa.struct([("n", pa.int32()), ("a", pa.int64()), ("b", pa.int32())])

    @F.arrow_udf("struct<n: int, a: long, b: int>")
    def keys(text: pa.Array) -> pa.Array:
        out = []
        for _, hashes in shingle_rows(text, k):
            own = np.unique(hashes)
            a, b = _fingerprint(own)
            out.append({"n": len(own), "a": a, "b": b})
        return pa.array(out, kind)

    return keys


def _classes_once(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """Each different non-empty set of a task once: (members, fingerprint)."""
    seen = set()
    for batch in batches:
        for _, hashes in shingle_rows(batch.column("text"), k):
            own = np.unique(hashes)
            key = _fingerprint(own)
            if len(own) and key not in seen:
                seen.add(key)
                yield own, *key


def sketch(docs: DataFrame, k: int = WORDS, bits: int = SKETCH_BITS) -> np.ndarray:
    """Counts of all documents' shingles in 2**bits counters, capped at 65535: its size does not depend on the input."""
    size = 1 << bits
    parts = min(SKETCH_PARTS, size)
    width = size // parts

    def count(batches):
        total = np.zeros(size, np.uint32)
        for own, _, _ in _classes_once(batches, k):
            np.add.at(total, (own >> np.uint64(64 - bits)).astype(np.int64), 1)
        rows = np.minimum(total, 65535).astype(np.uint16).reshape(parts, width)
        held = np.flatnonzero(rows.any(axis=1))
        for at in range(0, len(held), 64):
            some = held[at : at + 64]
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([rows[i].tobytes() for i in some], pa.binary())], ["part", "counts"])

    def add(batches):
        sums = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist()):
                got = np.frombuffer(counts, np.uint16).astype(np.uint32)
                sums[part] = np.minimum(sums[part] + got, 65535) if part in sums else got
        for part, total in sums.items():
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([total.astype(np.uint16).tobytes()], pa.binary())], ["part", "counts"])

    kind = "part int, counts binary"
    merged = docs.select("text").mapInArrow(count, kind).repartition(F.col("part")).mapInArrow(add, kind)
    total = np.zeros(size, np.uint16)
    for row in merged.collect():  # the fixed-size table itself
        total[row["part"] * width : (row["part"] + 1) * width] = np.frombuffer(row["counts"], np.uint16)
    return total


def match_count(frequency: np.ndarray, first: int, limit: int) -> int:
    """The l with the least estimated cost; ``frequency`` in prefix order, ``first`` the length of the 1-prefix."""
    read = np.cumsum(np.maximum(frequency[: first + limit - 1].astype(np.int64) - 1, 0))[first - 1 :]
    lengths = np.arange(1, len(read) + 1)
    return int(np.argmin(read * (1 + VERIFY_WEIGHT / lengths))) + 1


def prefixes(docs: DataFrame, counts: np.ndarray, percent: int, k: int = WORDS) -> DataFrame:
    """(token, a, b, n, l, place): the prefix shingles of every class, those of one shingle in one partition in order.

    ``place`` is the position from 0, or -1 - position for shingles estimated to be hot: these are dealt out over several
    partitions. Until they get there, a class's shingles travel in about ``ROWS`` rows.
    """
    bits = int(counts.size).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    groups = parts * -(-ROWS // parts)
    names = ["part", "a", "b", "n", "l", "tokens", "places"]

    def emit(batches):
        held, rows = [], 0

        def batch():
            part, a, b, n, l, ends, tokens, places = (np.concatenate(c) for c in zip(*held))
            offsets = pa.array(np.concatenate([[0], np.cumsum(ends)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (tokens, places)]
            return pa.record_batch([pa.array(part), pa.array(a), pa.array(b), pa.array(n), pa.array(l), *lists], names)

        for own, a, b in _classes_once(batches, k):
            n = len(own)
            need = -(-percent * n // 100)
            first = n - need + 1
            limit = min(MAX_MATCH, need)
            estimate = shared.value[(own >> np.uint64(64 - bits)).astype(np.int64)].astype(np.int64)
            order = np.lexsort((own, estimate))[: first + limit - 1]
            l = match_count(estimate[order], first, limit)
            order = order[: first + l - 1]
            split = (estimate[order] // HOT + 1).astype(np.uint64)
            place = np.arange(len(order), dtype=np.int32)
            place = np.where(split > 1, -1 - place, place)
            salt = np.uint64(a & ((1 << 64) - 1)) % split
            part = (mix(own[order] ^ mix(salt)) % np.uint64(groups)).astype(np.int32)
            sort = np.argsort(part, kind="stable")
            different, begin = np.unique(part[sort], return_index=True)
            size = len(different)
            held.append((different, np.full(size, a, np.int64), np.full(size, b, np.int32), np.full(size, n, np.int32), np.full(size, l, np.int32), np.diff(np.append(begin, len(sort))), own[order][sort].view(np.int64), place[sort].astype(np.int32)))
            rows += size
            if rows >= 20_000:
                yield batch()
                held, rows = [], 0
        if held:
            yield batch()

    packed = docs.select("text").mapInArrow(emit, "part int, a long, b int, n int, l int, tokens array<long>, places array<int>")
    dealt = packed.repartitionById(parts, F.col("part") % parts).select("a", "b", "n", "l", F.explode(F.arrays_zip("tokens", "places")).alias("t"))
    return dealt.select(F.col("t.tokens").alias("token"), "a", "b", "n", "l", F.col("t.places").alias("place")).sortWithinPartitions("token", "n", "a", "b")


def _shared_postings(rows: DataFrame, percent: int) -> DataFrame:
    """(token, a, b, n, pos, l, c): prefix rows that another class can meet, with the shingle's centre, one of its rows.

    Rows come in order, so one look ahead tells whether a shingle has another class; sizes are in order as well, so a row
    without a neighbour of a fitting size has no partner, nor have two rows alone whose pair cannot make a link.
    """
    fields = ["token", "a", "b", "n", "l", "place"]
    out = ["token", "a", "b", "n", "pos", "l", "ca", "cb", "cn", "cpos"]

    def run(batches):
        carry, centre = None, None  # the last row, and the centre of its shingle
        for batch in batches:
            own = {f: batch.column(f).to_numpy() for f in fields}
            if carry is not None:
                own = {f: np.concatenate([carry[f], own[f]]) for f in fields}
            if not len(own["token"]):
                continue
            again = np.zeros(len(own["token"]), bool)
            again[1:] = (own["token"][1:] == own["token"][:-1]) & (own["a"][1:] == own["a"][:-1]) & (own["b"][1:] == own["b"][:-1])
            own = {f: v[~again] for f, v in own.items()}
            done, carry, centre = kept(own, carry is not None, centre, False)
            if len(done):
                yield done
        if carry is not None:
            done, _, _ = kept(carry, True, centre, True)
            if len(done):
                yield done

    def kept(own, carried, centre, last):
        token, n, l = own["token"], own["n"].astype(np.int64), own["l"].astype(np.int64)
        hot = own["place"] < 0
        pos = np.where(hot, -1 - own["place"], own["place"]).astype(np.int64)
        first = np.ones(len(token), bool)
        first[1:] = token[1:] != token[:-1]
        starts = np.flatnonzero(first)
        which = np.cumsum(first) - 1
        # the class with the fewest rarer shingles has most in common with the others; ties by hash
        rarer = (pos << 32) | (own["a"].view(np.uint64) >> np.uint64(32)).astype(np.int64)
        least = np.flatnonzero(rarer == np.minimum.reduceat(rarer, starts)[which])
        least = least[np.unique(which[least], return_index=True)[1]]
        c = [x[least] for x in (own["a"], own["b"], n, pos, rarer)]
        open_run = carried and centre is not None
        if open_run and centre[4] < c[4][0]:  # the first run began in an earlier batch
            for x, value in zip(c, centre):
                x[0] = value
        ends = np.append(starts[1:], len(token))
        length = (ends - starts)[which]
        fits = 100 * n[:-1] >= percent * n[1:]
        same = ~first[1:]
        near = np.zeros(len(token), bool)
        near[1:] |= same & fits
        near[:-1] |= same & fits
        edge = (which == 0) & open_run | (which == which[-1]) & (not last)
        pair = np.flatnonzero((length[:-1] == 2) & same & ~edge[:-1] & ~edge[1:])
        remaining = np.minimum(n[pair] - pos[pair], n[pair + 1] - pos[pair + 1]) + np.minimum(l[pair], l[pair + 1]) - 1
        poor = pair[(100 + percent) * remaining < percent * (n[pair] + n[pair + 1])]
        near[poor] = near[poor + 1] = False
        keep = near | hot | edge
        settled_rows = len(token) if last else len(token) - 1
        if open_run and not last and len(token) > 1 or last:
            keep[0] |= open_run  # its neighbours were seen in an earlier batch
        keep[settled_rows:] = False
        at = np.flatnonzero(keep)
        cols = [token[at], own["a"][at], own["b"][at], own["n"][at], pos[at].astype(np.int32), own["l"][at], *(x[which[at]] for x in c[:4])]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        done = pa.record_batch([pa.array(x).cast(kind) for x, kind in zip(cols, kinds)], out)
        return done, {f: v[-1:] for f, v in own.items()}, [x[-1] for x in c]

    kind = "token long, a long, b int, n int, pos int, l int, ca long, cb int, cn int, cpos int"
    return rows.mapInArrow(run, kind).select("token", "a", "b", "n", "pos", "l", F.struct(F.col("ca").alias("a"), F.col("cb").alias("b"), F.col("cn").alias("n"), F.col("cpos").alias("pos")).alias("c"))


def _sizes_fit(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def _reach(remaining: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether ``remaining`` shared shingles at most can still make a link."""
    return (100 + percent) * remaining >= percent * (n + m)


def _filtered_sets(docs: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """(a, b, members) of the classes whose text key is in ``keys`` (tk); others pass a fixed-size filter at times."""
    bits = FILTER_BITS

    def mark(batches):
        own = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = (mix(batch.column("tk").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.record_batch([pa.array([own.tobytes()], pa.binary())], ["bits"])

    filled = np.zeros(1 << (bits - 3), np.uint8)
    for row in keys.select("tk").coalesce(4).mapInArrow(mark, "bits binary").toLocalIterator():  # at most four filters
        filled |= np.frombuffer(row["bits"], np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(filled)

    def members(batches):
        def passed():
            for batch in batches:
                at = (mix(batch.column("tk").to_numpy().view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)
                yield batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

        for own, a, b in _classes_once(passed(), k):
            yield pa.record_batch([pa.array([a], pa.int64()), pa.array([b], pa.int32()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], ["a", "b", "members"])

    found = docs.where("text is not null").select(F.xxhash64("text").alias("tk"), "text").mapInArrow(members, "a long, b int, members array<long>")
    return found.groupBy("a", "b").agg(F.first("members").alias("members"))


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs (a, b, n, ca, cb, cn) whose whole sets are similar enough."""
    ends = pairs.select("a", "b").union(pairs.select("ca", "cb")).distinct()
    sets = _filtered_sets(docs, ends.join(classes, ["a", "b"]).select("tk"), k)
    left = sets.withColumnRenamed("members", "x")
    right = sets.select(F.col("a").alias("ca"), F.col("b").alias("cb"), F.col("members").alias("y"))
    both = pairs.join(left, ["a", "b"]).join(right, ["ca", "cb"]).withColumn("shared", F.size(F.array_intersect("x", "y")))
    return both.where((100 + percent) * F.col("shared") >= percent * (F.col("n") + F.col("cn"))).select("a", "b", "ca", "cb")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.struct("a", "b").alias("src"), F.struct(F.col("ca").alias("a"), F.col("cb").alias("b")).alias("dst"))


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) once further links join components and single nodes: only what they touch is gone through again."""
    placed = joined.withColumnRenamed("component", "part")
    ends = _edges(links)
    for end in ("src", "dst"):
        ends = ends.join(placed.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("part", end)).drop("part")
    parts = connected_components(ends).withColumnRenamed("node", "part")
    kept = joined.withColumnRenamed("component", "part").join(parts, "part", "left").select("node", F.coalesce("component", "part").alias("component"))
    new = parts.withColumnRenamed("part", "node").join(joined, "node", "left_anti")
    return kept.unionByName(new.select("node", "component"))


def _grouped(docs: DataFrame, percent: int, k: int) -> DataFrame:
    """(doc_id, tk, n, a, b, component, component_id) of each row: text key, set key, and the group with its least id."""
    docs = docs.select("doc_id", "text")
    key = set_keys(k)(F.col("text"))
    rows = settled(docs.select("doc_id", F.xxhash64("text").alias("tk"), key.alias("s")).select("doc_id", "tk", "s.*"))
    classes = settled(rows.where("n > 0").groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.min("tk").alias("tk")))
    counts = sketch(docs, k)
    postings = stored(_shared_postings(prefixes(docs, counts, percent, k), percent), "shared-shingles")

    n, cn = F.col("n"), F.col("cn")
    star = (
        postings.where("a <> c.a or b <> c.b").select("a", "b", "n", F.col("c.a").alias("ca"), F.col("c.b").alias("cb"), F.col("c.n").alias("cn"))
        .where(_sizes_fit(n, cn, percent))
        .select("a", "b", "n", "ca", "cb", "cn").distinct()
    )
    star = settled(star)
    near = settled(_verified(docs, star, classes, percent, k))
    joined = settled(connected_components(_edges(near)))
    rest = settled(_open_pairs(postings, joined, percent).join(star.select("a", "b", "ca", "cb"), ["a", "b", "ca", "cb"], "left_anti"))
    final = _merged(joined, settled(_verified(docs, rest, classes, percent, k))).select("node.a", "node.b", "component")

    labelled = classes.join(final, ["a", "b"], "left").select("a", "b", "least", F.coalesce("component", F.struct("a", "b")).alias("component"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    return rows.join(labelled.join(least, "component").select("a", "b", "component", "component_id"), ["a", "b"], "left")


def jaccard_components(docs: DataFrame, percent: int = 75, k: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text; other columns are not looked at)."""
    least = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _grouped(docs, percent, k).select("doc_id", F.col("n").cast("long").alias("n_shingles"), least.alias("component_id"))


def _level(pos: Column, n: Column, percent: int) -> Column:
    """The least l whose prefix holds a position."""
    return F.greatest(F.lit(1), pos - (n - F.ceil(n * percent / 100)) + 1)


def _open_pairs(postings: DataFrame, joined: DataFrame, percent: int) -> DataFrame:
    """All pairs of prefix partners not yet connected that pass the size, position and match-count conditions.

    Two linked sets share a first shingle in the order, which stands in both 1-prefixes, and what follows it in either set
    must be enough for the overlap: pairs meet on such shingles only. Rows of a shingle's largest component never meet
    each other: only the rows outside it are paired, with all rows. They meet within size classes, so that the join key
    holds the partner's size as well as the shingle.
    """
    label = F.coalesce("component", F.struct("a", "b"))
    rows = postings.where(_level(F.col("pos"), F.col("n"), percent) == 1)
    rows = rows.join(joined.select("node.a", "node.b", "component"), ["a", "b"], "left").select("token", "a", "b", "n", "l", (F.col("n") - F.col("pos")).alias("remaining"), label.alias("label"))
    rows = stored(rows, "labelled-shingles")
    main = rows.groupBy("token", "label").agg(F.count("*").alias("c")).groupBy("token").agg(F.max_by("label", "c").alias("main"), F.count("*").alias("labels")).where("labels > 1")
    rows = rows.join(main.select("token", "main"), "token")

    def size_class(size: Column) -> Column:
        return F.floor(F.log(1.2, size.cast("double"))).cast("int")

    n, remaining = F.col("n"), F.col("remaining")
    widest = F.least(F.floor(n * 100 / percent), F.floor(remaining * (100 + percent) / percent) - n)
    narrowest = F.greatest(F.lit(1), F.ceil(n * percent / 100))
    sizes = F.explode(F.sequence(size_class(narrowest), size_class(widest))).alias("size")
    outside = rows.where("label <> main").where(widest >= narrowest).select("token", sizes, *[F.col(c).alias(f"o_{c}") for c in ("a", "b", "n", "l", "remaining", "label")])
    inside = rows.select("token", size_class(n).alias("size"), "a", "b", "n", "l", "remaining", "label", (F.col("label") != F.col("main")).alias("outside"))
    low = F.struct("o_a", "o_b") < F.struct("a", "b")
    fits = (F.col("label") != F.col("o_label")) & (~F.col("outside") | low) & _sizes_fit(F.col("n"), F.col("o_n"), percent) & _reach(F.least("remaining", "o_remaining"), F.col("n"), F.col("o_n"), percent)
    met = outside.join(inside, ["token", "size"]).where(fits)

    def end(first: bool, name: str) -> Column:
        return F.when(low, F.col(f"o_{name}" if first else name)).otherwise(F.col(name if first else f"o_{name}"))

    m = F.least("l", "o_l").alias("m")
    pairs = met.select(end(True, "a").alias("a"), end(True, "b").alias("b"), end(True, "n").alias("n"), end(False, "a").alias("ca"), end(False, "b").alias("cb"), end(False, "n").alias("cn"), m).distinct()
    return _enough_matches(settled(pairs), postings, percent)


def _enough_matches(pairs: DataFrame, postings: DataFrame, percent: int) -> DataFrame:
    """The pairs whose m-prefixes share at least m shingles, m being the smaller l of the two."""
    names = ["a", "b", "n", "ca", "cb", "cn"]
    own = postings.select("a", "b", "token", _level(F.col("pos"), F.col("n"), percent).alias("level"))
    left = pairs.where("m > 1").join(own, ["a", "b"]).where("level <= m").drop("level")
    other = own.select(F.col("a").alias("ca"), F.col("b").alias("cb"), "token", "level")
    both = left.join(other, ["ca", "cb", "token"]).where("level <= m")
    return pairs.where("m = 1").select(*names).union(both.groupBy(*names, "m").agg(F.count("*").alias("shared")).where("shared >= m").select(*names))


def keep_one_per_group(docs: DataFrame, percent: int = 75, k: int = WORDS) -> DataFrame:
    """One row of every group, that with the least id (ties by text hash); rows without words all stay."""
    grouped = _grouped(docs, percent, k).where("n > 0")
    kept = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "tk")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.tk").alias("__key"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    wordy = F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False))
    keyed = docs.where(wordy).withColumn("__tk", F.xxhash64("text"))
    once = keyed.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__tk") == F.col("__key")), "left_semi").dropDuplicates(["doc_id", "__tk"])
    return once.select(*columns).unionByName(docs.where(~wordy).select(*columns))


ORACLE = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN list_aggregate(w, 'string_agg', ' ') ELSE list_aggregate(w[i:i + 4], 'string_agg', ' ') END AS s
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 75 * (p.n + q.n - count(*))
), reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) m ON m.x = d.doc_id
"""


@query("op5_ngram_jaccard_join", ORACLE)
def op5(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))
