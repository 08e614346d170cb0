"""Centroid clustering, context-tree scores and the conversation trie against brute force."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from intel_spark.llm import centroids as C
from intel_spark.llm import contexttree as T
from intel_spark.llm import prefixtrie as P


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((distance(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(x) for x in zip(*members[j])] if j in members else c for j, c in enumerate(centres)]
    out = [(i, *nearest(v)[::-1]) for i, v in kept]
    total, own = sum(d for _, _, d in out), Counter()
    for _, j, d in out:
        own[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return Counter((i, j, d, own[j], total, digest[j]) for i, j, d in out)


@pytest.mark.parametrize("pack", [7, 8192])
def test_clusters_match_plain_rounds(spark, monkeypatch, pack):
    monkeypatch.setattr(C, "PACK", pack)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(150)]
    rows += [(200, [0.5] * 6)] * 60 + [(None, [0.25] * 6), (None, [0.25] * 6), (7, [0.1] * 6), (8, [0.5] * 6)]  # repeated rows, null and repeated ids
    bad = [(300, None), (301, [0.1] * 5), (302, [None] + [0.1] * 5), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (305, [])]
    frame = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumns({"cluster": F.lit("clash"), "vector": F.lit(1), "mark": F.lit(2)})
    held = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    got = Counter(tuple(r) for r in C.cluster_vectors(frame, k=9, rounds=4, dims=6).collect())
    assert got == brute_clusters(held, 9, 4, 6)
    few = C.cluster_vectors(frame.where("vec_id < 3"), k=9, rounds=4, dims=6)
    assert Counter(tuple(r) for r in few.collect()) == brute_clusters([r for r in held if r[0] is not None and r[0] < 3], 9, 4, 6)
    assert C.cluster_vectors(frame.limit(0), k=9, rounds=2, dims=6).count() == 0


def test_blocks_of_dimensions_lose_nothing():
    rng = np.random.default_rng(5)
    rows = np.vstack([np.repeat(rng.integers(-300, 300, (4, 8)), 20, axis=0), rng.integers(-3, 3, (30, 8))])
    blocks = C.encode(rows)
    assert np.array_equal(np.hstack([entries[codes] for _, entries, codes in blocks]), rows)
    assert len(C.encode(rows[:80])) == 1  # four different rows: one block of four subvectors


class BruteTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts):
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            for context, node, bit in self.events(text):
                for d in range(T.DEPTH + 1):
                    self.counts[context[T.DEPTH - d :], node][bit] += 1
                    if d:
                        self.children[context[T.DEPTH - d + 1 :], node].add(context[T.DEPTH - d :])
        self.known = {}

    @staticmethod
    def events(text):
        data = b"\xff" * T.DEPTH + text + b"\xff"
        for i in range(T.DEPTH, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield data[i - T.DEPTH : i], node, bit
                node = node * 2 + bit

    @staticmethod
    def own(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def weighted(self, context, node):
        key = (context, node)
        if key not in self.known:
            own = self.own(*self.counts[key])
            if len(context) < T.DEPTH:
                deeper = sum(self.weighted(c, node) for c in self.children[key])
                top = max(own, deeper)
                own = top + math.log((math.exp(own - top) + math.exp(deeper - top)) / 2)
            self.known[key] = own
        return self.known[key]

    def score(self, text):
        total = 0.0
        for context, node, bit in self.events(text):
            # the ratio of the weighted probabilities with and without the bit, level by level
            p = None
            for d in range(T.DEPTH, -1, -1):
                key = (context[T.DEPTH - d :], node)
                a, b = self.counts[key]
                own = ((b if bit else a) + 0.5) / (a + b + 1)
                if p is None:
                    p = own
                else:
                    gained = self.own(a, b) - sum(self.weighted(c, node) for c in self.children[key])
                    share = 1 / (1 + math.exp(min(700.0, -gained)))
                    p = share * own + (1 - share) * p
            total += math.log10(p)
        return total


def lower(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def brute_scores(rows):
    import re

    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    words = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", lower(t)) + [None]
    tree = BruteTree([lower(t) for i, t in rows if not held(i)])
    counts = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, different = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        own = words(t)
        base = sum(math.log10((counts[w] + 1) / (total + different + 1)) for w in own)
        out.append((i, held(i), len(own), sum(counts[w] > 0 for w in own), total, base, tree.score(lower(t))))
    return out


def same_scores(got, want):
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0], r[2], round(r[6], 6)))
    assert len(got) == len(want)
    for a, b in zip(order(got), order(want)):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sizes", [None, (300, 900, 40)])
def test_scores_match_recursive_weighting(spark, monkeypatch, sizes):
    if sizes:  # texts cut into many pieces, blocks and batches
        for name, value in zip(("PIECE", "BLOCK", "BATCH"), sizes):
            monkeypatch.setattr(T, name, value)
    rng = np.random.default_rng(6)
    lexicon = ["the", "The", "tree", "three", "éclair", "ümlaut", "x1", "ÀB", "中文字"]
    rows = [(i, " ".join(rng.choice(lexicon, int(rng.integers(0, 30))))) for i in range(60)]
    rows += [(100, "same line\n" * 200), (101, None), (102, ""), (102, ""), (None, "no id"), (None, None), (103, "u" * 1500), (104, " \t\n "), (105, "a b " * 400)] + [(7, "again and again")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"held": F.lit("clash"), "row": F.lit(1), "key": F.lit(2), "n": F.lit(3), "block": F.lit(4)})
    same_scores([tuple(r) for r in T.score_texts(frame.repartition(3)).collect()], brute_scores(rows))
    assert T.score_texts(frame.limit(0)).count() == 0


def test_scores_without_training_texts(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    frame = spark.createDataFrame([(held, "ab")], "doc_id long, text string")
    r = T.score_texts(frame).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) == (2, 0, 0, 0.0) and r["score"] == pytest.approx(24 * math.log10(0.5))


def brute_trie(rows):
    """Nodes by prefix, each found from the rebuilt conversations themselves."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0), role, mark, text))
    own = {c: [(r, t) for _, r, _, t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + ts[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children, out = defaultdict(list), Counter()
    for path in members:
        if path:
            children[path[:-1]].append(path)

    def below(path):
        leaves, saved = int(not children[path]), (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
        for child in children[path]:
            more = below(child)
            leaves, saved = leaves + more[0], saved + more[1]
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out[min(members[path]), len(path), min(members[path[:-1]]) if path else None, len(members[path]), len(children[path]), leaves, saved, digest] += 1
        return leaves, saved

    if built:
        below(())
    return out


def talk(rng, n):
    """Conversations that share first turns, some whole, and ties, nulls and repeated rows."""
    words = ["hi", "Hi", "", "how", "ünï", "x" * 50]
    rows = []
    for conv in range(n):
        for turn in range(int(rng.integers(0, 12))):
            rows.append((conv, turn, ["user", "assistant"][turn % 2], words[int(rng.integers(0, 2 if turn < 4 else 6))]))
    rows += [(c, t, "user", "the same") for c in range(n, n + 60) for t in range(10)]
    rows += [(n + 100, None, None, None), (n + 100, None, "a", "b"), (n + 100, 1, "u", "tie"), (n + 100, 1, "u", "tie"), (n + 100, 1, "a", "tie"), (None, 1, "u", "lost"), (n + 101, 3, "u", None)]
    return rows + [(n + 107, i, "user", f"long {i}") for i in range(600)]


@pytest.mark.parametrize("shard", [1 << 20, 25])
def test_trie_matches_prefix_counts(spark, monkeypatch, shard):
    monkeypatch.setattr(P, "SHARD", shard)
    rows = talk(np.random.default_rng(9), 90)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.lit("clash"), "n": F.lit(1), "depth": F.lit(2), "shard": F.lit(3)})
    got = Counter(tuple(r[c] for c in P.COLUMNS) for r in P.conversation_trie(frame.repartition(3)).collect())
    assert got == brute_trie(rows)
    assert P.conversation_trie(frame.limit(0)).count() == 0


def test_closing_parentheses():
    rng = np.random.default_rng(10)
    for _ in range(20):
        text, depth = [], 0
        for _ in range(int(rng.integers(1, 3000))):
            up = depth <= 1 or rng.random() < 0.5
            text.append(up)
            depth += 1 if up else -1
        text += [False] * depth
        if not text[0]:
            continue
        opens, closes, run = [], [], None
        for is_open in text[: len(text) - depth]:
            if is_open and run != "open":
                closes.append(0 if run is None else count)
                count, run = 0, "open"
            elif not is_open and run != "close":
                opens.append(count)
                count, run = 0, "close"
            elif run is None:
                count = 0
            count = count + 1
        if run == "close":
            continue
        opens.append(count)
        p = P.Parentheses(np.array(closes), np.array(opens))
        stack, want = [], {}
        for i, is_open in enumerate(p.open.tolist()):
            if is_open:
                stack.append(i)
            else:
                want[stack.pop()] = i
        assert not stack and p.findclose().tolist() == [want[i] for i in p.at.tolist()]
