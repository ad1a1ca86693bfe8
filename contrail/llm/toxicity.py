"""Toxicity scores from a learned lexicon, matched with spelling errors.

Learning (labelled rows outside the held-out part, at most ``TRAIN_ROWS`` of
them, the ones with the smallest hashed ids):

1. Lexicon: words and word beginnings that occur in toxic texts and hardly in
   others. A beginning is lengthened while its occurrences stay the same, so
   both fixed words and stems with many endings are found.
2. Weights of a logistic regression over the hit features below.

Scoring (every row): one automaton holds the product of the lexicon trie with
the Levenshtein automata of its terms (terms of ``FUZZY_LENGTH`` letters or
more may differ in one letter). It is determinised as words are read, so a
word costs one table step per letter. Around each hit a window of words tells
quotation (quotation marks on both sides, or words of reporting) from abuse
(words addressing a person, further hits); the counts of the kinds and the
densest window are the features.

Defined results: null and empty texts have no hits and get the score of the
bias alone; without labelled rows, or with one class only, every score is the
share of toxic rows (0 without rows); several labels of a document all count;
every row gives one row, repeats and null doc_ids (never held out) included;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.language_id import held_out
from contrail.llm.shared import Scratch, concat_batches, doc_columns, tidy

TRAIN_ROWS = 20_000     # labelled rows the classifier is fitted on, at most
MIN_TEXTS = 8           # toxic texts that a lexicon term occurs in, at least,
MIN_SHARE = 0.01        # and their share of all toxic texts
PRECISION = 0.95        # share of toxic texts among a term's texts
LEXICON = 2_000         # terms kept, the most frequent first
SHORTEST, LONGEST = 4, 16  # letters of a term
FUZZY_LENGTH = 5        # from this length on one error is allowed
WINDOW = 6              # words on each side of a hit
THRESHOLD = 0.7
_MEMO = 200_000         # words a worker remembers

# Words of reporting, and words that address a person.
REPORTING = ("said", "says", "wrote", "called", "quote", "quoted", "sagte", "schrieb", "dit",
             "écrit", "dijo", "escribió")
ADDRESSING = ("you", "your", "du", "dich", "tu", "toi", "vous", "usted", "eres")

_WORD = re.compile(r"\w+")
_QUOTES = frozenset("\"“”«»„‟‘’")
FEATURES = 6


# ---- the automaton -----------------------------------------------------------

class LexiconAutomaton:
    """Lexicon trie x Levenshtein automata, determinised lazily.

    A state is a set of (trie node, errors); reading a letter matches it,
    substitutes it, or takes it as inserted, and letters of the term may be
    missing. ``match`` gives the fewest errors with which a term (a stem: with
    any ending) matches the word, or None.
    """

    def __init__(self, terms: dict[str, bool]):
        """terms: term -> whether any ending may follow."""
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[bool | None] = [None]   # None: no term ends here
        self.fuzzy: list[bool] = [False]        # a term below allows an error
        for term, stem in terms.items():
            node = 0
            for c in term:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.fuzzy.append(False)
                node = nxt
                self.fuzzy[node] |= len(term) >= FUZZY_LENGTH
            self.ends[node] = bool(stem or self.ends[node])
            self.fuzzy[0] |= len(term) >= FUZZY_LENGTH
        self.depth = [0] * len(self.children)
        for node, below in enumerate(self.children):
            for nxt in below.values():
                self.depth[nxt] = self.depth[node] + 1
        self._states: dict[frozenset, int] = {}
        self._sets: list[frozenset] = []
        self._step: list[dict[str, int]] = []
        self._stem: list[int | None] = []   # fewest errors of a stem that ends in the state
        self._whole: list[int | None] = []  # the same for any term
        self._start = self._state(frozenset(self._closed({(0, 0)})))

    def _closed(self, items: set) -> set:
        """With one letter of the term missing."""
        out = set(items)
        for node, errors in items:
            if errors == 0:
                out |= {(n, 1) for n in self.children[node].values() if self.fuzzy[n]}
        return {(n, e) for n, e in out if e == 0 or (n, 0) not in out}

    def _state(self, items: frozenset) -> int:
        at = self._states.get(items)
        if at is None:
            at = self._states[items] = len(self._sets)
            self._sets.append(items)
            self._step.append({})
            ends = [(e, self.ends[n]) for n, e in items
                    if self.ends[n] is not None and (e == 0 or self.depth[n] >= FUZZY_LENGTH)]
            self._stem.append(min((e for e, stem in ends if stem), default=None))
            self._whole.append(min((e for e, _ in ends), default=None))
        return at

    def _read(self, state: int, c: str) -> int:
        items: set = set()
        for node, errors in self._sets[state]:
            below = self.children[node]
            if c in below:
                items.add((below[c], errors))
            if errors == 0 and self.fuzzy[node]:
                items.add((node, 1))
                items |= {(n, 1) for n in below.values() if self.fuzzy[n]}
        at = self._step[state][c] = self._state(frozenset(self._closed(items)))
        return at

    def match(self, word: str) -> int | None:
        state, best = self._start, None
        for c in word:
            state = self._step[state].get(c, -1) if c in self._step[state] else self._read(state, c)
            if not self._sets[state]:
                return best
            found = self._stem[state]
            if found is not None and (best is None or found < best):
                best = found
                if best == 0:
                    return 0
        found = self._whole[state]
        return found if best is None or found is not None and found < best else best


# ---- features ----------------------------------------------------------------

class HitFeatures:
    """Feature rows of texts."""

    def __init__(self, terms: dict[str, bool]):
        self.automaton = LexiconAutomaton(terms)
        self.memo: dict[str, int | None] = {}

    def __call__(self, text: str | None) -> list[float]:
        if not text:
            return [0.0] * FEATURES
        low = text.lower()
        words = _WORD.findall(low)
        memo = self.memo
        fresh = set(words).difference(memo)
        if fresh:
            if len(memo) > _MEMO:
                memo.clear()
                fresh = set(words)
            for w in fresh:
                memo[w] = self.automaton.match(w)
        found = list(map(memo.__getitem__, words))
        hits = [i for i, e in enumerate(found) if e is not None]
        if not hits:
            return [0.0] * FEATURES
        return self._describe(low, words, found, hits)

    @staticmethod
    def _describe(low, words, found, hits) -> list[float]:
        at = [m.span() for m in _WORD.finditer(low)] if _QUOTES.intersection(low) else None
        exact = fuzzy = quoted = personal = 0
        densest = 0
        hit_at = np.array(hits)
        for i in hits:
            first, last = max(0, i - WINDOW), min(len(words) - 1, i + WINDOW)
            window = words[first:last + 1]
            marks = False
            if at is not None:
                before = low[at[first][0]:at[i][0]]
                after = low[at[i][1]:at[last][1] + 1]
                marks = bool(_QUOTES.intersection(before)) and bool(_QUOTES.intersection(after))
            aimed = any(w in window for w in ADDRESSING)
            if (marks or any(w in window for w in REPORTING)) and not aimed:
                quoted += 1
                continue
            personal += aimed
            exact += found[i] == 0
            fuzzy += found[i] == 1
            densest = max(densest, int(((hit_at >= first) & (hit_at <= last)).sum()))
        return [float(exact > 0), math.log1p(exact), float(fuzzy > 0 and exact == 0),
                math.log1p(quoted), math.log1p(personal), math.log1p(densest)]


# ---- learning ------------------------------------------------------------------

def _count_terms(batches):
    """Toxic and other texts that contain each word or word beginning."""
    schema = pa.schema([("term", pa.string()), ("bad", pa.int64()), ("good", pa.int64())])
    counts = (Counter(), Counter())

    def rows():
        terms = list(counts[0].keys() | counts[1].keys())
        for i in range(0, len(terms), 65536):
            part = terms[i:i + 65536]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), pa.array([counts[1][t] for t in part], pa.int64()),
                 pa.array([counts[0][t] for t in part], pa.int64())], schema=schema)

    for b in batches:
        for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            terms = set()
            for w in set(_WORD.findall(text.lower())):
                if w.isalpha():
                    terms.update(w[:n] for n in range(SHORTEST, min(len(w), LONGEST) + 1))
            counts[toxic].update(terms)
        if len(counts[0]) + len(counts[1]) > 200_000:
            yield from rows()
            counts = (Counter(), Counter())
    yield from rows()


def choose_terms(counts: list[tuple[str, int, int]]) -> dict[str, bool]:
    """Lexicon from (term, toxic texts, other texts) of all beginnings that
    pass the support and precision tests: term -> is a stem."""
    support = {t: bad for t, bad, _ in counts}
    longer: dict[str, list[int]] = {}
    for t, bad, _ in counts:
        longer.setdefault(t[:-1], []).append(bad)
    chosen: dict[str, bool] = {}
    for t in sorted(support, key=lambda t: (len(t), t)):
        # the last one whose occurrences do not nearly all go on alike
        if max(longer.get(t, [0])) >= 0.9 * support[t]:
            continue
        if not any(t[:n] in chosen for n in range(SHORTEST, len(t))):
            chosen[t] = t in longer
    top = sorted(chosen, key=lambda t: (-support[t], t))[:LEXICON]
    return {t: chosen[t] for t in sorted(top)}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression with a bias, by Newton steps; weights are not
    negative except the quoted one, so more hits never lower a score."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    free = [i for i in range(FEATURES) if i != 3]
    active = np.ones(FEATURES + 1, bool)
    while True:
        w = np.zeros(FEATURES + 1)
        cols = np.flatnonzero(active)
        z = a[:, cols]
        penalty = np.diag([ridge if c < FEATURES else 1e-6 for c in cols])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w[cols], -30, 30)))
            grad = z.T @ (p - y) + penalty @ w[cols]
            hess = (z * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ z + penalty
            step = np.linalg.solve(hess, grad)
            w[cols] -= step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
            if np.abs(step).max() < 1e-8:
                break
        bad = [i for i in free if active[i] and w[i] < 0]
        if not bad:
            return w
        active[bad] = False


class Model:
    """Lexicon and weights; or a constant score."""

    def __init__(self, terms: dict[str, bool], weights: np.ndarray | None, constant: float = 0.0):
        self.terms, self.weights, self.constant = terms, weights, constant

    def scorer(self):
        if self.weights is None:
            return lambda text: self.constant
        features, w = HitFeatures(self.terms), self.weights

        def score(text):
            z = float(np.dot(features(text), w[:-1]) + w[-1])
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
        return score


def _features(terms: dict[str, bool]):
    def task(batches):
        features = HitFeatures(terms)
        for b in batches:
            rows = [features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])
    return task


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold: int = 1,
          folds: int = 3, rows: int = TRAIN_ROWS) -> Model:
    """Model from the labelled rows that are not held out."""
    known = (doc_columns(labels, "doc_id", "toxic")
             .where("doc_id IS NOT NULL AND toxic IN (0, 1)")
             .where(~held_out(fold, folds))
             .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
             .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows))
    scratch = Scratch(spark, "toxicity")
    known = scratch.save(known, "labels")  # at most ``rows`` short rows
    texts = (doc_columns(docs, "doc_id", "text").where("text IS NOT NULL")
             .join(F.broadcast(known), "doc_id").select("text", "toxic"))
    # equal texts count once, so copies do not make their words terms
    train = scratch.save(texts.dropDuplicates(["text", "toxic"]).repartition(
        spark.sparkContext.defaultParallelism), "train")
    share = train.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("m"),
                      F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    least = max(MIN_TEXTS, MIN_SHARE * share.bad)
    if share.n == 0 or share.m in (0.0, 1.0):
        return Model({}, None, float(share.m))
    terms = (train.mapInArrow(tidy(_count_terms), "term string, bad long, good long")
             .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .where((F.col("bad") >= least)
                    & (F.col("bad") >= PRECISION * (F.col("bad") + F.col("good"))))
             .orderBy(F.desc("bad"), "term").limit(50 * LEXICON))
    lexicon = choose_terms([(r.term, r.bad, r.good) for r in terms.collect()])
    # at most ``rows`` rows of FEATURES numbers
    table = train.mapInArrow(tidy(_features(lexicon)), "x array<double>, toxic int").toPandas()
    x = np.array(table["x"].tolist(), np.float64).reshape(len(table), FEATURES)
    scratch.drop("train", "labels")
    return Model(lexicon, fit_weights(x, table["toxic"].to_numpy(np.float64)))


# ---- scoring -------------------------------------------------------------------

_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                  ("predicted", pa.int32())])


def _score(model: Model):
    def rows(batches):
        score = model.scorer()
        for b in batches:
            s = [score(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()),
                 pa.array([int(x >= THRESHOLD) for x in s], pa.int32())], schema=_OUT)
    return lambda batches: concat_batches(rows(batches), _OUT, 4096)


def score_toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, fold: int = 1,
                   folds: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = learn(spark, docs, labels, fold, folds)
    base = doc_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out(fold, folds).alias("held_out"), "text")
    return base.mapInArrow(tidy(_score(model)), "doc_id long, held_out boolean, score double, predicted int")


def _keep(model: Model, column: int):
    def task(batches):
        score = model.scorer()
        for b in batches:
            yield b.filter(pa.array([score(t) < THRESHOLD for t in b.column(column).to_pylist()],
                                    pa.bool_()))
    return task


def drop_toxic(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score stays below the threshold."""
    model = learn(spark, docs, labels)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(tidy(_keep(model, docs.columns.index("text"))), plain.schema).toDF(*docs.columns)
