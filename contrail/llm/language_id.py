"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 / -1 components, drawn from a seed and
its code point. A letter trigram is the product (binding) of its letters'
vectors, permuted by their place (rotated by two, one and no steps). A text is
the sum (bundle) of its trigrams' vectors, a language the sum over its
training texts; the text's language is the prototype with the largest cosine.

Letters are lower-cased; every run of other characters is one blank, which
has a vector too, so word starts and ends count. Bundles are linear in the
trigram counts: prototypes come from counts that Spark sums over the whole
training part, and a batch's text vectors are one product of its count matrix
with its trigram vectors.

Defined results: null text and text without a letter give ``und`` and score 0;
without any training text everything is ``und``; ties go to the first
language by name; every row gives one row, null doc_ids (held out or not by
crc32 of null: not held out) and repeats included; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.shared import Scratch, doc_columns, mix

DIMENSIONS = 1024
UNKNOWN = "und"
_BLANK = 32
_TEXTS = 256         # texts whose counts form one matrix
_CELLS = 6_000_000   # most cells of a count matrix; larger sets of texts are cut


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Code point -> lower-case letter, or a blank for everything else."""
    table = np.full(0x110000, _BLANK, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def letter_vector(cp: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The +1 / -1 vector of a letter: bits of a mixed counter."""
    words = -(-dimensions // 64)
    seed = np.arange(words, dtype=np.uint64) + np.uint64((cp + 1) << 20)
    bits = np.unpackbits(mix(seed * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8))
    return bits[:dimensions].astype(np.int8) * 2 - 1


class Trigrams:
    """Vectors and counts of letter trigrams, by code points."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.table = letter_table()
        self.dimensions = dimensions
        self._letters: dict[int, np.ndarray] = {}

    def letter(self, cp: int) -> np.ndarray:
        """A letter's vector rotated by 0, 1 and 2 steps."""
        v = self._letters.get(cp)
        if v is None:
            if len(self._letters) > 4096:
                self._letters.clear()
            base = letter_vector(cp, self.dimensions)
            v = self._letters[cp] = np.stack([np.roll(base, i) for i in range(3)])
        return v

    def vectors(self, keys: np.ndarray) -> np.ndarray:
        """Bound vectors (float32 rows) of packed trigrams."""
        parts = [keys >> shift & 0x1FFFFF for shift in (42, 21, 0)]
        alphabet, place = np.unique(np.concatenate(parts), return_inverse=True)
        if not len(alphabet):
            return np.empty((0, self.dimensions), np.float32)
        table = np.stack([self.letter(cp) for cp in alphabet.tolist()])
        a, b, c = np.split(place, 3)
        return (table[a, 2] * table[b, 1] * table[c, 0]).astype(np.float32)

    def codes(self, text: str) -> np.ndarray:
        """Letters with single blanks between and around the words."""
        x = self.table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        blank = x == _BLANK
        x = x[~(blank & np.concatenate(([True], blank[:-1])))]
        x = x[:-1] if len(x) and x[-1] == _BLANK else x
        return np.concatenate(([_BLANK], x, [_BLANK])).astype(np.int64) if len(x) else x.astype(np.int64)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text index, packed trigram, count) of the texts' trigrams."""
        index, keys = [], []
        for i, text in enumerate(texts):
            x = self.codes(text)
            if len(x) < 3:
                continue
            k = x[:-2] << 42 | x[1:-1] << 21 | x[2:]
            index.append(np.full(len(k), i, np.int64))
            keys.append(k)
        if not keys:
            empty = np.empty(0, np.int64)
            return empty, empty, empty
        index_, keys_ = np.concatenate(index), np.concatenate(keys)
        grams, place = self._unique(keys_)
        cells = index_ * len(grams) + place
        if len(texts) * len(grams) <= _CELLS:
            n = np.bincount(cells, minlength=len(texts) * len(grams))
            cell = np.flatnonzero(n)
            n = n[cell]
        else:
            cell, n = np.unique(cells, return_counts=True)
        return cell // len(grams), grams[cell % len(grams)], n

    def _unique(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct trigrams and each key's place among them; over a
        small alphabet through a table instead of sorting."""
        seen = np.zeros(0x110000, bool)
        for shift in (42, 21, 0):
            seen[keys >> shift & 0x1FFFFF] = True
        alphabet = np.flatnonzero(seen)
        n = len(alphabet)
        if n ** 3 > 4_000_000:
            return np.unique(keys, return_inverse=True)
        rank = np.zeros(0x110000, np.int64)
        rank[alphabet] = np.arange(n)
        dense = (rank[keys >> 42] * n + rank[keys >> 21 & 0x1FFFFF]) * n + rank[keys & 0x1FFFFF]
        present = np.flatnonzero(np.bincount(dense, minlength=n ** 3))
        place = np.zeros(n ** 3, np.int64)
        place[present] = np.arange(len(present))
        grams = (alphabet[present // (n * n)] << 42 | alphabet[present // n % n] << 21
                 | alphabet[present % n])
        return grams, place[dense]


_COUNTS = "lang string, gram long, n long"


def _count(batches):
    grams = Trigrams(1)
    total: dict[str, dict[int, int]] = {}
    size = 0

    def rows():
        for lang, counts in total.items():
            keys = np.fromiter(counts.keys(), np.int64, len(counts))
            n = np.fromiter(counts.values(), np.int64, len(counts))
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(n)],
                names=["lang", "gram", "n"])

    for b in batches:
        langs = b.column(1).to_pylist()
        texts = b.column(0).to_pylist()
        for lang in sorted(set(langs)):
            mine = [t for t, x in zip(texts, langs) if x == lang]
            for i in range(0, len(mine), _TEXTS):
                _, keys, n = grams.counts(mine[i:i + _TEXTS])
                uniq, place = np.unique(keys, return_inverse=True)
                sums = np.bincount(place, n, len(uniq)).astype(np.int64)
                counts = total.setdefault(lang, {})
                for g, c in zip(uniq.tolist(), sums.tolist()):
                    counts[g] = counts.get(g, 0) + c
        size = sum(map(len, total.values()))
        if size > 500_000:  # hand over and start anew: bounded memory
            yield from rows()
            total = {}
    yield from rows()


def _bundle(dimensions: int):
    """Partial prototype components of each language from summed counts."""
    def task(batches):
        grams = Trigrams(dimensions)
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            keys = b.column(1).to_numpy(zero_copy_only=False)
            n = b.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
            vectors = grams.vectors(keys)
            for lang in set(langs.tolist()):
                mine = langs == lang
                total[lang] = total.get(lang, 0) + n[mine] @ vectors[mine]
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang], pa.string()), pa.array([v.tolist()], pa.list_(pa.float64()))],
                names=["lang", "v"])
    return task


def prototypes(train: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, v): one prototype per language, from ``text`` and ``lang``."""
    texts = (doc_columns(train, "text", "lang")
             .where("text IS NOT NULL AND lang IS NOT NULL")
             .select("text", F.col("lang").cast("string").alias("lang")))
    counts = texts.mapInArrow(_count, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    parts = counts.mapInArrow(_bundle(dimensions), "lang string, v array<double>")
    cells = parts.select("lang", F.posexplode("v").alias("i", "x"))
    sums = cells.groupBy("lang", "i").agg(F.sum("x").alias("x"))
    return (sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s"))
            .select("lang", F.col("s.x").alias("v")))


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()),
                  ("score", pa.float64())])


def _predict(names: list[str], unit: np.ndarray):
    """names: languages in order; unit: their normalised prototypes."""
    def task(batches):
        grams = Trigrams(unit.shape[1] if len(names) else 1)
        for b in batches:
            texts = [t or "" for t in b.column(2).to_pylist()]
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for first in range(0, len(texts) if names else 0, _TEXTS):
                part = texts[first:first + _TEXTS]
                index, keys, n = grams.counts(part)
                if not len(keys):
                    continue
                uniq, place = np.unique(keys, return_inverse=True)
                bundle = np.zeros((len(part), unit.shape[1]), np.float64)
                width = max(1, _CELLS // (len(part) + unit.shape[1]))
                for at in range(0, len(uniq), width):
                    inside = (place >= at) & (place < at + width)
                    size = min(width, len(uniq) - at)
                    matrix = np.zeros((len(part), size), np.float32)
                    matrix[index[inside], place[inside] - at] = n[inside]
                    bundle += matrix @ grams.vectors(uniq[at:at + size])
                norm = np.linalg.norm(bundle, axis=1)
                cosine = bundle @ unit.T / np.maximum(norm, 1e-30)[:, None]
                best = cosine.argmax(1)
                for i in np.unique(index).tolist():
                    langs[first + i] = names[best[i]]
                    scores[first + i] = min(1.0, max(0.0, float(cosine[i, best[i]])))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores)], schema=_OUT)
    return task


def held_out(remainder: int, parts: int) -> F.Column:
    """crc32(doc_id as text) mod parts = remainder (false for a null id)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == remainder, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, fold: int = 2, folds: int = 4,
             dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): prototypes are learned from the
    rows that are not held out, every row is predicted from its text alone."""
    scratch = Scratch(spark, "language")
    base = doc_columns(docs, "doc_id", "text", "lang").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", "lang",
        held_out(fold, folds).alias("held_out"))
    table = scratch.save(prototypes(base.where(~F.col("held_out")), dimensions), "prototypes")
    # one row of ``dimensions`` numbers per language name
    model = sorted((r.lang, r.v) for r in table.collect() if any(r.v))
    names = [lang for lang, _ in model]
    matrix = np.array([v for _, v in model], np.float64).reshape(len(model), dimensions if model else 0)
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-30)
    return base.select("doc_id", "held_out", "text").mapInArrow(
        _predict(names, unit), "doc_id long, held_out boolean, lang_pred string, score double")
