"""Language-model scores by context-tree weighting over the bytes of a corpus.

A byte is decided bit by bit, the highest first; the bits decided so far name one of 255 binary decisions. Each decision
has a context tree of its own over the ``DEPTH`` bytes before. A context of any depth keeps how often its decision fell
each way in the training texts and gives the Krichevsky-Trofimov estimate (ones + 1/2) / (zeros + ones + 1). The weighted
probability of a context is half its own estimate of its training bits plus half the product of the weighted
probabilities of the contexts one byte longer; as in sequential coding, this makes the probability of a next bit a
mixture of the estimates of all depths, the share of a depth being what its estimate gained over the deeper ones. The
counts are frozen after training, so a text's score is a sum over its bytes and its end of a number that the ``DEPTH``
bytes before and the byte itself name.

Texts are cut at white space into pieces and gathered in blocks of about ``BLOCK`` bytes, which are written once. A block
hands on its distinct byte runs and word hashes with their training counts, not its positions; Spark adds them up. The
runs are then dealt out by their last two context bytes, so that a task holds whole subtrees, at most 2**24 runs each;
what the two topmost levels need is at most 2**16 sums. Each run's log-probability and each word's count travel back to
the blocks that hold them, where texts are scored.

Texts are read whole, A-Z in lower case; before a text stand ``DEPTH`` bytes 0xFF, and one byte 0xFF ends it, which no
UTF-8 text holds. Words are told apart by 63-bit hashes. A null text counts as an empty one, which has only its end; a
null id belongs to the training fold; equal rows count and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import fresh_path, query, settled, table
from intel_spark.llm.shingles import buffers, rows_of_words

DEPTH = 4  # context bytes; the layout of run codes below is made for it
BLOCK = 1 << 25  # bytes of texts that share one table of runs and words
PIECE = 1 << 20  # bytes of a text worked on at once, up to the next white space
BATCH = 1 << 17  # runs whose subtrees are weighted at once
FOLDS, HELD = 7, 2
EDGE = 0xFF
END = -1  # the key of the end of a text among the words
_WORD = np.uint64(1 << 63)  # words have this bit, byte runs do not

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEPS = np.arange(8, dtype=np.uint64)
_HASH = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- texts in blocks


def text_blocks(docs: DataFrame) -> DataFrame:
    """(block, row, doc_id, held, size, data): pieces of texts, ``row`` telling rows of ``docs`` apart, ``data`` compressed.

    A piece is its ``DEPTH`` bytes of context, its own bytes, and the end byte if it is a text's last.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD, F.lit(False))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held"), F.col("text").cast("string").alias("text"))

    def run(batches):
        task = TaskContext.get().partitionId() << 40
        pieces, total, row, block = [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = pa.compress(np.concatenate([p[3] for p in pieces]).tobytes(), "zstd", asbytes=True)
            lists = [pa.array([[p[i] for p in pieces]], pa.list_(kind)) for i, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))]
            sizes = pa.array([[len(p[3]) for p in pieces]], pa.list_(pa.int64()))
            return pa.record_batch([pa.array([task + block]), *lists, sizes, pa.array([data], pa.binary())], ["block", "row", "doc_id", "held", "size", "data"])

        for batch in batches:
            data, offsets, valid = buffers(batch.column("text"))
            ids, folds = batch.column("doc_id").to_pylist(), batch.column("held").to_pylist()
            for i in range(len(batch)):
                text = data[offsets[i] : offsets[i + 1]] if valid[i] else data[:0]
                before, at = np.full(DEPTH, EDGE, np.uint8), 0
                while True:
                    end = _cut(text, at)
                    own = [before, _LOWER[text[at:end]]] + ([np.full(1, EDGE, np.uint8)] if end == len(text) else [])
                    pieces.append((task + row, ids[i], folds[i], np.concatenate(own)))
                    total += end - at
                    before, at = pieces[-1][3][-DEPTH:], end
                    if total >= BLOCK:
                        yield flush()
                        pieces, total, block = [], 0, block + 1
                    if at == len(text):
                        break
                row += 1
        if pieces:
            yield flush()

    return source.mapInArrow(run, "block long, row array<long>, doc_id array<long>, held array<boolean>, size array<long>, data binary")


def _cut(text: np.ndarray, at: int) -> int:
    """Where a piece that begins at ``at`` ends: before white space, or with the text."""
    end = min(len(text), at + PIECE)
    while end < len(text):
        space = _SPACE[text[end : end + PIECE]]
        if space.any():
            return end + int(space.argmax())
        end = min(len(text), end + PIECE)
    return end


class Stretch:
    """Pieces of a block worked on together: their bytes, where they begin and end, and which end a text."""

    def __init__(self, data: np.ndarray, sizes: np.ndarray, first: int):
        self.data, self.first = data, first
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.last = (sizes > DEPTH) & (data[self.ends - 1] == EDGE)

    def runs(self) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the byte runs that begin at every place, and which of them lie within a piece."""
        n = len(self.data) - DEPTH
        wide = self.data.astype(np.uint64)
        code = wide[:n].copy()
        for j in range(1, DEPTH + 1):
            code <<= np.uint64(8)
            code |= wide[j : n + j]
        inside = np.ones(n, bool)
        inside[(self.ends[:-1, None] - np.arange(1, DEPTH + 1)).ravel()] = False
        return code, inside

    def words(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first piece, keys of the words, offsets of each piece's words)."""
        text = self.data.copy()
        text[(self.starts[:, None] + np.arange(DEPTH)).ravel()] = 0x20
        text[self.ends[self.last] - 1] = 0x20
        offsets = np.concatenate([[0], self.ends]).astype(np.int32 if len(text) < 1 << 31 else np.int64)
        kind = pa.binary() if offsets.dtype == np.int32 else pa.large_binary()
        column = pa.Array.from_buffers(kind, len(self.ends), [None, pa.py_buffer(offsets), pa.py_buffer(text)])
        for first, hashes, bounds in rows_of_words(column):
            yield first, (hashes | _WORD).view(np.int64), bounds


def stretches(sizes: np.ndarray, data: bytes) -> Iterator[Stretch]:
    """The pieces of a block, about ``PIECE`` bytes at a time."""
    text = np.frombuffer(pa.decompress(data, int(sizes.sum()), "zstd", asbytes=True), np.uint8)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        begin = int(ends[at] - sizes[at])
        stop = max(at + 1, int(np.searchsorted(ends, begin + PIECE, "right")))
        yield Stretch(text[begin : ends[stop - 1]], sizes[at:stop], at)
        at = stop


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    different, at = np.unique(np.concatenate(keys), return_inverse=True)
    return different, np.bincount(at, np.concatenate(counts)).astype(np.int64)


def block_keys(blocks: DataFrame) -> DataFrame:
    """(block, key, n): a block's distinct byte runs (keys from 0) and words (below 0) and their number in its training texts."""
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                sizes, held = (np.asarray(batch.column(c)[i].values) for c in ("size", "held"))
                keys, counts = [], []
                for part in stretches(sizes, batch.column("data")[i].as_py()):
                    own = held[part.first : part.first + len(part.ends)]
                    code, inside = part.runs()
                    marked = (code << np.uint64(1) | np.repeat(own, np.diff(part.ends, prepend=0))[: len(code)].astype(np.uint64))[inside]
                    code, n = np.unique(marked, return_counts=True)
                    keys.append((code >> np.uint64(1)).view(np.int64))
                    counts.append(np.where(code & np.uint64(1), 0, n))
                    for first, words, bounds in part.words():
                        learnt = ~np.repeat(own[first : first + len(bounds) - 1], np.diff(bounds))
                        for some, weight in ((words[learnt], 1), (words[~learnt], 0)):
                            different, n = np.unique(some, return_counts=True)
                            keys.append(different)
                            counts.append(n * weight)
                    keys.append(np.array([END]))
                    counts.append(np.array([int((part.last & ~own).sum())]))
                key, n = _summed(keys, counts)
                yield pa.record_batch([pa.array(np.full(len(key), batch.column("block")[i].as_py(), np.int64)), pa.array(key), pa.array(n)], ["block", "key", "n"])

    return blocks.select("block", "held", "size", "data").mapInArrow(run, "block long, key long, n long")


# ---------------------------------------------------------------- weighted contexts


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after eight steps of the recurrence; x > 0."""
    y = x + 8
    series = (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    return series - np.log(np.prod([x + i for i in range(8)], axis=0))


class Level:
    """The contexts of one depth, each with one decision: counts, weighted probability, and the share of its own estimate."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys, at = np.unique(keys, return_inverse=True)
        self.at = at.ravel()
        self.zeros, self.ones = (np.bincount(self.at, x, len(self.keys)) for x in (zeros, ones))
        own = log_gamma(self.zeros + 0.5) + log_gamma(self.ones + 0.5) - np.log(np.pi) - log_gamma(self.zeros + self.ones + 1)
        self.one = (self.ones + 0.5) / (self.zeros + self.ones + 1)
        if below is None:
            self.log_p, self.share = own, np.ones(len(own))
        else:
            deeper = np.bincount(self.at, below, len(self.keys))
            self.log_p = np.logaddexp(own, deeper) - np.log(2)
            with np.errstate(over="ignore"):
                self.share = 1 / (1 + np.exp(deeper - own))

    def above(self, bits: int) -> "Level":
        """The contexts one byte shorter: the last ``bits`` of the keys, those of the decision among them."""
        return Level(self.keys & np.uint64((1 << bits) - 1), self.zeros, self.ones, self.log_p)

    def mixed(self, at: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The probability of a one, from that of the next deeper context."""
        return self.share[at] * self.one[at] + (1 - self.share[at]) * deeper


def decisions(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys (context, decision) and outcomes of the eight decisions of each byte run."""
    byte = (code & np.uint64(255))[:, None]
    node = (np.uint64(1) << _STEPS) | (byte >> (np.uint64(8) - _STEPS))
    return ((code >> np.uint64(8))[:, None] << np.uint64(8) | node).ravel(), ((byte >> (np.uint64(7) - _STEPS)) & np.uint64(1)).ravel().astype(np.int64)


def lower_levels(code: np.ndarray, n: np.ndarray) -> tuple[Level, Level, np.ndarray]:
    """The two deepest levels of runs that hold their depth-3 contexts whole, and the runs' outcomes."""
    keys, bits = decisions(code)
    weight = np.repeat(n, 8)
    deepest = Level(keys, weight * (1 - bits), weight * bits, None)
    return deepest, deepest.above(32), bits


def batches_of(code: np.ndarray) -> list[np.ndarray]:
    """Indices of the runs, about ``BATCH`` at a time, all runs of a depth-3 context together."""
    context = (code >> np.uint64(8)) & np.uint64(0xFFFFFF)
    order = np.argsort(context, kind="stable")
    borders = np.flatnonzero(np.diff(context[order])) + 1
    wanted = np.searchsorted(borders, np.arange(BATCH, len(code), BATCH))
    cuts = np.unique(borders[wanted[wanted < len(borders)]])
    return np.split(order, cuts) if len(code) else []


def second_level(code: np.ndarray, n: np.ndarray) -> Level:
    """The depth-2 contexts of runs that hold them whole."""
    found = []
    for part in batches_of(code):
        level = lower_levels(code[part], n[part])[1]
        found.append((level.keys & np.uint64(0xFFFFFF), level.zeros, level.ones, level.log_p))
    keys, zeros, ones, log_p = (np.concatenate(x) for x in zip(*found))
    return Level(keys, zeros, ones, log_p)


class Top:
    """Depths 1 and 0, from the sums of depth 2: at most 2**16 and 2**8 decisions."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray):
        self.first = Level(keys, zeros, ones, below)
        self.root = self.first.above(8)


def run_scores(code: np.ndarray, n: np.ndarray, top: Top) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(codes, log10 probabilities of their bytes) of runs that hold their depth-2 contexts whole."""
    second = second_level(code, n)
    for part in batches_of(code):
        deepest, third, bits = lower_levels(code[part], n[part])
        at = deepest.at
        p = third.mixed(third.at[at], deepest.one[at])
        for level, mask in ((second, 0xFFFFFF), (top.first, 0xFFFF), (top.root, 0xFF)):
            p = level.mixed(np.searchsorted(level.keys, deepest.keys & np.uint64(mask))[at], p)
        yield code[part], np.log10(np.where(bits == 1, p, 1 - p)).reshape(-1, 8).sum(axis=1)


def _partition(batches) -> tuple[np.ndarray, np.ndarray]:
    code, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for batch in batches:
        code.append(batch.column("key").to_numpy())
        n.append(batch.column("n").to_numpy())
    return np.concatenate(code).view(np.uint64), np.concatenate(n)


def score_runs(runs: DataFrame) -> DataFrame:
    """(key, value): the log10 probability of every byte run of (key, n)."""
    # a depth-2 context, whose runs go to one task, has no more than 2**24 different ones
    whole = settled(runs.repartition(F.shiftrightunsigned("key", 8).bitwiseAND(0xFFFF)))

    def sums(batches):
        code, n = _partition(batches)
        if len(code):
            second = second_level(code, n)
            first = second.above(16)
            deeper = np.bincount(first.at, second.log_p, len(first.keys))
            yield pa.record_batch([pa.array(first.keys.view(np.int64)), pa.array(first.zeros), pa.array(first.ones), pa.array(deeper)], ["key", "zeros", "ones", "below"])

    found = whole.mapInArrow(sums, "key long, zeros double, ones double, below double").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")]).toPandas()  # 2**16 rows at most
    top = Top(found["key"].to_numpy(np.int64).view(np.uint64), *(found[c].to_numpy(float) for c in ("zeros", "ones", "below")))

    def scored(batches):
        code, n = _partition(batches)
        if len(code):
            for some, value in run_scores(code, n, top):
                yield pa.record_batch([pa.array(some.view(np.int64)), pa.array(value)], ["key", "value"])

    return whole.mapInArrow(scored, "key long, value double")


# ---------------------------------------------------------------- scores of texts


class Lookup:
    """Values by code, for codes that are all known: a table of hash slots, sorted search where codes share one."""

    def __init__(self, codes: np.ndarray, values: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.values = codes[order], values[order]
        self.shift = np.uint64(64 - max(10, int(len(codes) * 4).bit_length()))
        slot = self._slots(self.codes)
        self.table = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.table[slot] = np.arange(len(slot))
        shared = np.bincount(slot, minlength=len(self.table)) > 1
        self.table[shared] = -1

    def _slots(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * _HASH) >> self.shift).astype(np.int64)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        at = self.table[self._slots(codes)]
        rest = np.flatnonzero(at < 0)
        at[rest] = np.searchsorted(self.codes, codes[rest])
        return self.values[at]


def score_blocks(blocks: DataFrame, values: DataFrame) -> DataFrame:
    """(row, doc_id, held, n_tokens, n_known, gain, score) of each piece; ``gain`` sums log10(count + 1) over its tokens."""
    def run(block: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if len(block):
            key, value = known.column("key").to_numpy(), known.column("value").to_numpy()
            runs = Lookup(key[key >= 0].view(np.uint64), value[key >= 0])
            order = np.argsort(key[key < 0])
            words, counts = key[key < 0][order], value[key < 0][order]
            end = counts[-1]  # the end has the largest key below 0
            sizes = np.asarray(block.column("size").combine_chunks()[0].values)
            for part in stretches(sizes, block.column("data")[0].as_py()):
                code, inside = part.runs()
                gain = np.zeros(len(part.data))
                gain[: len(code)][inside] = runs(code[inside])
                score = np.add.reduceat(gain, part.starts)
                tokens, hits, logs = (np.zeros(len(part.ends)) for _ in range(3))
                for first, own, bounds in part.words():
                    count = counts[np.searchsorted(words, own)]
                    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                    rows = slice(first, first + len(bounds) - 1)
                    tokens[rows] += np.diff(bounds)
                    hits[rows] += np.bincount(piece, count > 0, len(bounds) - 1)
                    logs[rows] += np.bincount(piece, np.log10(count + 1), len(bounds) - 1)
                tokens += part.last
                hits += part.last & (end > 0)
                logs += part.last * np.log10(end + 1)
                out.append([tokens.astype(np.int64), hits.astype(np.int64), logs, score])
        lists = [block.column(c).combine_chunks()[0].values if len(block) else pa.array([], kind) for c, kind in (("row", pa.int64()), ("doc_id", pa.int64()), ("held", pa.bool_()))]
        numbers = [pa.array(np.concatenate(x)) for x in zip(*out)] if out else [pa.array([], pa.int64())] * 2 + [pa.array([], pa.float64())] * 2
        return pa.table(lists + numbers, ["row", "doc_id", "held", "n_tokens", "n_known", "gain", "score"])

    schema = "row long, doc_id long, held boolean, n_tokens long, n_known long, gain double, score double"
    return blocks.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(run, schema)


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``."""
    spark = docs.sparkSession

    def written(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    blocks = written(text_blocks(docs), "lm-texts")
    keys = written(block_keys(blocks), "lm-keys")
    totals = settled(keys.groupBy("key").agg(F.sum("n").alias("n")))
    learnt = totals.where("key < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("n") > 0, 1)).alias("words")).first()
    values = score_runs(totals.where("key >= 0")).unionByName(totals.where("key < 0").select("key", F.col("n").cast("double").alias("value")))
    pieces = score_blocks(blocks, keys.select("block", "key").join(values, "key").select("block", "key", "value"))
    rows = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "gain", "score")])
    unit = F.log10(F.lit(float(learnt["tokens"] + learnt["words"] + 1)))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(learnt["tokens"])).cast("long").alias("train_tokens"), (F.col("gain") - F.col("n_tokens") * unit).alias("base_score"), "score")


@query("op13_context_tree_weighting")
def op13(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
