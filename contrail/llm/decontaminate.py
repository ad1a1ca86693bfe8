"""Benchmark decontamination: n-gram seeds, then Smith-Waterman.

1. Every n-gram of words of the test items is a seed, however often it occurs:
   whether a document is found does not depend on the other documents.
2. Seeds join training passages to items: around each seed found in a text a
   window as long as the item and some words more is taken; overlapping
   windows of an item become one.
3. A window whose words in common with the item cannot reach the threshold is
   skipped (the words in common bound the alignment score); the others are
   aligned with Smith-Waterman over words. The score is the alignment's part
   of a full match: 1 for a verbatim copy, lower for edited ones. It has to
   reach ``THRESHOLD`` and the score of ``LEAST_MATCHED`` words, or of the
   whole item if that is shorter: short items are found as they stand only.

The items are taken in blocks of ``BLOCK_ITEMS`` (what a task holds is
bounded; a larger benchmark takes more passes); texts are never shuffled.

Defined results: null and empty texts match nothing; items with null id or
null text, or with fewer than ``LEAST_WORDS`` words, are not searched; each
row of documents gives its own rows, null doc_ids and repeats included;
repeated items give one row per item row; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.shared import Scratch, concat_batches, doc_columns, tidy
from contrail.llm.words import gram_hashes, word_hashes

SEED_WORDS = 3
LEAST_WORDS = SEED_WORDS
LEAST_MATCHED = 8
BLOCK_ITEMS = 20_000
THRESHOLD = 0.5
MATCH, MISMATCH, GAP = 2, -1, 1
_BITS = 20  # of the table that rejects most n-grams before the exact look-up

_WORD = re.compile(r"\w+")


def text_words(text: str) -> np.ndarray:
    return word_hashes(_WORD.findall(text.lower()))


# ---- alignment -----------------------------------------------------------------

def _rows(item: np.ndarray, window: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the local alignment matrix, one per item word."""
    step = np.arange(len(window) + 1) * GAP
    above = np.zeros(len(window) + 1, np.int64)
    for w in item:
        row = np.zeros(len(window) + 1, np.int64)
        row[1:] = np.maximum(above[:-1] + np.where(window == w, MATCH, MISMATCH), above[1:] - GAP)
        np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + step) - step  # gaps along the window
        above = row
        yield row


def least_score(n: int) -> float:
    """Alignment score that an item of n words has to reach."""
    return MATCH * max(THRESHOLD * n, min(n, LEAST_MATCHED))


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """(score, start, end) of the best local alignment, in window words."""
    best, end = 0, 0
    at = 0
    for i, row in enumerate(_rows(item, window)):
        j = int(row.argmax())
        if row[j] > best:
            best, end, at = int(row[j]), j, i + 1
    if not best:
        return 0, 0, 0
    # the same alignment backwards from its end finds its start
    back = 0
    for row in _rows(item[:at][::-1], window[:end][::-1]):
        hit = np.flatnonzero(row == best)
        if len(hit):
            back = int(hit[0])
            break
    return best, end - back, end


# ---- seeds -----------------------------------------------------------------------

class Items:
    """One block of test items and the n-grams to look for."""

    def __init__(self, ids: list, texts: list[str]):
        words = [text_words(t) for t in texts]
        use = [i for i, w in enumerate(words) if len(w) >= LEAST_WORDS]
        self.ids = [ids[i] for i in use]
        self.words = [words[i] for i in use]
        owner, place, gram = [], [], []
        for i, w in enumerate(self.words):
            g = gram_hashes(w, SEED_WORDS)
            gram.append(g)
            owner.append(np.full(len(g), i))
            place.append(np.arange(len(g)))
        cat = lambda x, kind: np.concatenate(x) if x else np.empty(0, kind)
        gram, owner, place = cat(gram, np.uint64), cat(owner, np.int64), cat(place, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.owner, self.place = gram[order], owner[order], place[order]
        self.table = np.zeros(1 << _BITS, bool)
        self.table[(self.gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position in the text, index of the first equal n-gram here)."""
        g = gram_hashes(words, SEED_WORDS)
        at = np.flatnonzero(self.table[(g >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.gram):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.searchsorted(self.gram, g[at])
        first = np.minimum(first, len(self.gram) - 1)
        same = self.gram[first] == g[at]
        return at[same], first[same]

    def search(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item index, score, start, end in words) of the best alignment of
        each item that reaches the threshold."""
        words = text_words(text)
        at, first = self.hits(words)
        windows: dict[int, list[tuple[int, int]]] = {}
        for pos, k in zip(at.tolist(), first.tolist()):
            g = self.gram[k]
            while k < len(self.gram) and self.gram[k] == g:
                i = int(self.owner[k])
                size, place = len(self.words[i]), int(self.place[k])
                room = max(8, size // 4)
                windows.setdefault(i, []).append(
                    (max(0, pos - place - room), min(len(words), pos - place + size + room)))
                k += 1
        out = []
        for i, spans in windows.items():
            item = self.words[i]
            full, least = MATCH * len(item), least_score(len(item))
            best = (0, 0, 0)
            for start, stop in _merged(spans):
                window = words[start:stop]
                if MATCH * int(np.isin(item, window).sum()) < least:
                    continue
                score, a, z = align(item, window)
                if score > best[0]:
                    best = (score, start + a, start + z)
            if best[0] >= least:
                out.append((i, best[0] / full, *best[1:]))
        return out


def _merged(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    spans.sort()
    start, stop = spans[0]
    for a, z in spans[1:]:
        if a <= stop:
            stop = max(stop, z)
        else:
            yield start, stop
            start, stop = a, z
    yield start, stop


def _blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark's items, block by block."""
    rows = (doc_columns(benchmark, "item_id", "text")
            .where("item_id IS NOT NULL AND text IS NOT NULL")
            .select(F.col("item_id").cast("long").alias("item_id"), "text"))
    blocks = max(1, math.ceil(rows.count() / BLOCK_ITEMS))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).orderBy("item_id", "text")
        part = part.collect()
        yield Items([r.item_id for r in part], [r.text for r in part])


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()),
                  ("start", pa.int64()), ("end", pa.int64())])


def _find(items: Items):
    def rows(batches):
        for b in batches:
            out = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = items.search(text) if text else []
                if found:
                    at = [m.span() for m in _WORD.finditer(text.lower())]
                    out += [(doc_id, items.ids[i], s, at[a][0], at[z - 1][1]) for i, s, a, z in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], f.type) for k, f in enumerate(_OUT)], schema=_OUT)
    return lambda batches: concat_batches(rows(batches), _OUT, 4096)


def find_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, start, end): each document and test item that
    align, with the place of the best alignment in the lower-cased text's code
    points (end exclusive)."""
    Scratch(spark, "leaks")
    base = doc_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for items in _blocks(benchmark):
        part = base.mapInArrow(tidy(_find(items)), "doc_id long, item_id long, score double, start long, end long")
        found = part if found is None else found.union(part)
    return found


def _clean(items: Items, column: int):
    def task(batches):
        for b in batches:
            yield b.filter(pa.array([not (t and items.search(t)) for t in b.column(column).to_pylist()],
                                    pa.bool_()))
    return task


def drop_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that align with no test item."""
    Scratch(spark, "leaks")
    at = docs.columns.index("text")
    kept = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = kept.schema
    for items in _blocks(benchmark):
        kept = kept.mapInArrow(tidy(_clean(items, at)), schema)
    return kept.toDF(*docs.columns)
