"""Toxicity: Levenshtein automata intersected with a lexicon trie, with context-window scores.

A lexicon of abusive terms is learned from labelled documents. Every word of a text runs through the intersection of the
lexicon's trie with the Levenshtein automaton of the term: a state is a set of (trie node, edits so far), made
deterministic as words reach it, so a word costs one table look-up a letter and ordinary words die after a few letters.
Terms of up to 3 letters match exactly, up to 7 letters with one edit, longer ones with two. Spellings with digits or marks
among their letters, or a digit at an end, run through it as a whole too.

A match counts with the weight learned for its term and distance, and the words around it decide what for: in quotation
marks, or after a word of speech or mention, it is a quotation and counts little; otherwise, and more so beside a second
person, it is abuse. A logistic model over the sums of both kinds gives the score.

Labels are taken from at most ``SAMPLE`` labelled rows whose ``crc32(doc_id) mod 5`` is not 0, chosen by hash; everything
else covers all rows. Texts that are null or empty score as texts without a match. Repeated rows score alike. Rows with a
null label are not learned from; without any usable label the score is 0 everywhere.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from intel_spark.llm.base import query, settled, table

SAMPLE = 20_000  # labelled rows to learn from
TERMS = 2_000  # most terms in a lexicon
SUPPORT = 8  # different contexts of toxic rows that a term needs
WINDOW = 6  # words on either side of a match
QUOTED = 0.25  # share of its weight that a match in quotation keeps
ADDRESSED = 1.5  # factor of a match beside a second person
STATES = 100_000  # automaton states kept in a task before it starts afresh
SEEN = 150_000  # words remembered as no match in a task

# fixed values: words of speech and mention, and second persons, in the languages of the corpus
MENTION = frozenset("said says wrote writes called calling quoted quote word term phrase insult slur dit écrit mot terme insulte sagte schrieb wort begriff beleidigung nannte dijo escribió palabra término insulto".split())
SECOND = frozenset("you your yours yourself u ur tu toi ton ta tes vous votre vos du dich dir dein deine sie ihr euch usted ustedes ti tú vosotros".split())
OPENING, CLOSING = "\"“„«‘‹", "\"”“»’›"

WORD = re.compile(r"[^\W\d_]+")
# letters with digits or marks among them, or a digit at an end, as spellings that hide a word have them
MIXED = re.compile(r"\d?[^\W\d_]+(?:[\d_*@$!#.'’+-]{1,2}[^\W\d_]+)*\d?")


def fold(text: str) -> str:
    return unicodedata.normalize("NFC", text).lower()


def edits_for(term: str) -> int:
    return 0 if len(term) <= 3 else 1 if len(term) <= 7 else 2


class Automaton:
    """Words within each term's edit distance, as a lazily determinised intersection of trie and Levenshtein automata."""

    DEAD = -1

    def __init__(self, terms):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.most = [0]  # most edits of any term below a node
        for term in sorted(terms):
            node, edits = 0, edits_for(term)
            self.most[0] = max(self.most[0], edits)
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(0)
                node = self.children[node][letter]
                self.most[node] = max(self.most[node], edits)
            self.term[node] = term
        self._restart()

    def _restart(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.sets: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple[str, int] | None] = []
        self.start = self._state(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """Letters of a term may be left out."""
        todo = list(nodes)
        while todo:
            node = todo.pop()
            edits = nodes[node] + 1
            for child in self.children[node].values():
                if edits <= self.most[child] and edits < nodes.get(child, 99):
                    nodes[child] = edits
                    todo.append(child)
        return nodes

    def _state(self, nodes: dict[int, int]) -> int:
        if not nodes:
            return self.DEAD
        key = tuple(sorted(nodes.items()))
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(nodes)
            self.steps.append({})
            ends = [(edits, self.term[n]) for n, edits in nodes.items() if self.term[n] is not None and edits <= edits_for(self.term[n])]
            self.accepts.append((min(ends)[1], min(ends)[0]) if ends else None)
        return self.ids[key]

    def _step(self, state: int, letter: str) -> int:
        after: dict[int, int] = {}
        for node, edits in self.sets[state].items():
            if edits + 1 <= self.most[node] and edits + 1 < after.get(node, 99):  # a letter too many
                after[node] = edits + 1
            for own, child in self.children[node].items():
                cost = edits + (own != letter)
                if cost <= self.most[child] and cost < after.get(child, 99):
                    after[child] = cost
        reached = self._state(self._closed(after))
        self.steps[state][letter] = reached
        return reached

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance (ties to the first term), None if no term is near enough."""
        if len(self.sets) > STATES:
            self._restart()
        state = self.start
        for letter in word:
            following = self.steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                return None
        return self.accepts[state]


class Finder:
    """Matches of a lexicon in texts, remembering the words met before."""

    def __init__(self, terms):
        self.automaton = Automaton(terms)
        self.longest = max(map(len, terms), default=0) + 2
        self.near: dict[str, tuple[str, int]] = {}
        self.other: set[str] = set()

    def near_words(self, own: set[str]) -> set[str]:
        """Those of some different words that match a term."""
        found = own & self.near.keys()
        for word in own - self.other - found:
            hit = self.automaton.match(word)
            if hit is None:
                if len(self.other) < SEEN:
                    self.other.add(word)
            else:
                self.near[word] = hit
                found.add(word)
        return found

    def words(self, text: str) -> tuple[list[str], set[str], set[str]]:
        """All words, the different ones that match a term, and the spellings with digits or marks that do."""
        words = WORD.findall(text)
        mixed = {w for w in MIXED.findall(text) if not w.isalpha() and len(w) <= self.longest}
        return words, self.near_words(set(words)), self.near_words(mixed)

    def matches(self, text: str | None):
        """(word, term, distance, left words, right words, quoted, addressed) of every match, and the number of words."""
        if not text:
            return [], 0
        text = fold(text)
        words, found, mixed = self.words(text)
        if not found and not mixed:
            return [], len(words)
        out = []
        spans = [m.span() for m in WORD.finditer(text)]
        hits = [(i, i + 1, word) for i, word in enumerate(words) if word in found]
        if mixed:
            starts = [a for a, _ in spans]
            for m in MIXED.finditer(text):
                if m[0] in mixed:  # its words are parts of it, unless one of them is a match of its own
                    i, j = bisect_left(starts, m.start()), bisect_left(starts, m.end())
                    if not found.intersection(words[i:j]):
                        hits.append((i, j, m[0]))
            hits.sort()
        for i, j, word in hits:
            left, right = words[max(0, i - WINDOW) : i], words[j : j + WINDOW]
            begin = spans[max(0, i - WINDOW)][0]
            end = spans[min(len(spans) - 1, j - 1 + WINDOW)][1]
            before, after = text[begin : spans[i][0]], text[spans[j - 1][1] : end]
            opened = max((before.rfind(c) for c in OPENING), default=-1)
            inside = opened >= 0 and not any(c in before[opened + 1 :] for c in CLOSING) and any(c in after for c in CLOSING)
            quoted = inside or bool(MENTION.intersection(left))
            out.append((word, *self.near[word], left, right, quoted, bool(SECOND.intersection(left + right))))
        return out, len(words)


class Exact(Finder):
    """Matches without edits."""

    def __init__(self, terms):
        self.near = {t: (t, 0) for t in terms}

    def words(self, text: str) -> tuple[list[str], set[str], set[str]]:
        words = WORD.findall(text)
        return words, set(words) & self.near.keys(), set()


FEATURES = 4


class Model:
    """Weights of the terms by distance, surfaces that are ordinary words, and the logistic coefficients."""

    def __init__(self, weights: dict[str, list[float]], ordinary: set[str], coefficients=None):
        self.weights, self.ordinary, self.coefficients = weights, ordinary, coefficients
        self.finder = None

    def __getstate__(self):
        return {**self.__dict__, "finder": None}

    def features(self, text: str | None) -> list[float]:
        """Abuse and quotation evidence, the strongest match, and the share of words that match."""
        if self.finder is None:
            self.finder = Finder(self.weights)
        abuse = quotation = strongest = hits = 0.0
        matches, n = self.finder.matches(text)
        for word, term, distance, _, _, quoted, addressed in matches:
            if distance and word in self.ordinary:
                continue
            weight = self.weights[term][distance]
            if weight <= 0:
                continue
            hits += 1
            if quoted:
                quotation += weight
                weight *= QUOTED
            elif addressed:
                weight *= ADDRESSED
            abuse += weight
            strongest = max(strongest, weight)
        return [math.log1p(abuse), math.log1p(quotation), strongest, math.sqrt(hits / n) if n else 0.0]

    def scores(self, texts) -> np.ndarray:
        if self.coefficients is None:
            return np.zeros(len(texts))
        x = np.array([self.features(t) for t in texts], float).reshape(len(texts), FEATURES)
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients[1:] + self.coefficients[0], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the intercept is free and evidence of abuse cannot lower a score."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.full(len(w), ridge * max(1, len(y)) / 100)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + penalty * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fold_of(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most ``sample`` labelled rows of the learning folds."""
    chosen = labels.where("toxic in (0, 1) and doc_id is not null").where(fold_of() != 0).select("doc_id", "toxic").dropDuplicates(["doc_id"])
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # at most SAMPLE rows of two numbers
    return settled(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").select("text", F.col("toxic").cast("int").alias("toxic")))


def _candidate_terms(sample: DataFrame) -> list[str]:
    """Words that stand in toxic rows far more often than in the others."""
    def count(frames):
        toxic: dict[str, int] = {}
        clean: dict[str, int] = {}
        for frame in frames:
            for text, label in zip(frame["text"], frame["toxic"]):
                into = toxic if label else clean
                for word in set(WORD.findall(fold(text))):
                    into[word] = into.get(word, 0) + 1
        words = sorted(toxic)  # a term stands in toxic rows; rows of clean words alone are not needed
        others = [w for w in clean if w not in toxic]
        yield pd.DataFrame({"word": words + others, "toxic": [toxic[w] for w in words] + [0] * len(others), "clean": [clean.get(w, 0) for w in words] + [clean[w] for w in others]})

    totals = sample.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    if not totals["toxic"] or totals["toxic"] == totals["n"]:
        return []
    odds = float(totals["toxic"]) / (totals["n"] - totals["toxic"])
    counts = sample.mapInPandas(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    lift = (F.col("toxic") + 0.5) / (F.col("clean") + 0.5) / odds
    picked = counts.where((F.col("toxic") >= SUPPORT // 2) & (F.length("word") >= 3)).withColumn("lift", lift).where("lift >= 8")
    return [r["word"] for r in picked.orderBy(F.desc("toxic"), "word").limit(2 * TERMS).collect()]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    rows = labelled_sample(docs, labels, sample)
    candidates = _candidate_terms(rows)
    if not candidates:
        return Model({}, set())

    def contexts(terms, edits):
        """Matches per word with the words around them; copies of a text repeat its contexts, so each counts once a label."""
        def seen(frames):
            finder = Finder(terms) if edits else Exact(terms)
            for frame in frames:
                out = []
                for text, label in zip(frame["text"], frame["toxic"]):
                    for word, term, distance, left, right, _, _ in finder.matches(text)[0]:
                        out.append((word, term, distance, " ".join(left[-2:] + ["|"] + right[:2]), int(label)))
                yield pd.DataFrame(out, columns=["word", "term", "distance", "context", "toxic"])

        met = rows.mapInPandas(seen, "word string, term string, distance int, context string, toxic int").distinct()
        return met.groupBy("word", "term", "distance").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).toPandas()  # words of the sample near a term

    total = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n")).first()
    prior = math.log(total["toxic"] / (total["n"] - total["toxic"]))

    def weight(toxic: float, clean: float) -> float:
        return max(0.0, math.log((toxic + 0.5) / (clean + 0.5)) - prior)

    exact = contexts(candidates, False)
    chosen = {}
    for word, toxic, clean in zip(exact["word"], exact["toxic"], exact["clean"]):
        if toxic >= SUPPORT and weight(toxic, clean) >= 3:
            chosen[word] = weight(toxic, clean)
    chosen = dict(sorted(chosen.items(), key=lambda e: (-e[1], e[0]))[:TERMS])
    if not chosen:
        return Model({}, set())
    near = contexts(list(chosen), True)
    near = near[near["distance"] > 0]
    ordinary = set(near.loc[near["clean"] > 0, "word"])
    weights = {}
    for term, full in chosen.items():
        weights[term] = [full]
        for distance in range(1, edits_for(term) + 1):
            some = near[(near["term"] == term) & (near["distance"] == distance)]
            # surfaces count once each: whether a misspelling met for the first time is abuse
            weights[term].append(min(weight((some["toxic"] > some["clean"]).sum() + 0.5, (some["clean"] > 0).sum()), full * 0.75**distance))
    model = Model(weights, ordinary)

    def measured(frames):
        for frame in frames:
            x = np.array([model.features(t) for t in frame["text"]], float).reshape(len(frame), FEATURES)
            yield pd.DataFrame({"x": list(x.tolist()), "toxic": frame["toxic"]})

    fitted = rows.mapInPandas(measured, "x array<double>, toxic int").toPandas()  # at most SAMPLE rows
    model.coefficients = fit_logistic(np.array(fitted["x"].tolist()), fitted["toxic"].to_numpy(float))
    return model


def toxicity_score(spark, model: Model):
    """Pandas UDF: the score of a text, from 0 to 1."""
    shared = spark.sparkContext.broadcast(model)  # at most TERMS terms and the sample's near words

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(texts))

    return score


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; only text and the learning folds' labels are looked at."""
    score = toxicity_score(docs.sparkSession, learn(docs, labels, sample))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select("doc_id", F.coalesce(fold_of() == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that score below one half, with their columns as they were."""
    score = toxicity_score(docs.sparkSession, learn(docs, labels, sample))
    kept = docs.withColumn("__score", score(F.col("text"))).where("__score < 0.5")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op3_toxicity")
def op3(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
