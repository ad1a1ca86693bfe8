"""Toxicity and language identification: brute force and held-out accuracy."""
import random
import zlib

import numpy as np

from contrail.llm import language_id, toxicity
from contrail.llm.queries import QUERIES
from tests.conftest import SF_MID


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = {"idiot": False, "scum": False, "abcab": True, "abc": True, "worthless": False, "abcde": False}
    automaton = toxicity.LexiconAutomaton(terms)
    words = list(terms) + ["".join(rng.choices("abcdeiots", k=rng.randrange(1, 9))) for _ in range(1500)]
    for t in list(terms):
        for _ in range(80):
            w = list(t)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w) + 1)
                w[at:at + rng.randrange(2)] = rng.choices("abcdeiotsx", k=rng.randrange(2))
            words.append("".join(w) + rng.choice(["", "", "er"]))
    for w in words:
        found = []
        for t, stem in terms.items():
            most = 1 if len(t) >= toxicity.FUZZY_LENGTH else 0
            ds = [_distance(w[:n], t) for n in range(len(w) + 1)] if stem else [_distance(w, t)]
            if min(ds) <= most:
                found.append(min(ds))
        assert automaton.match(w) == min(found, default=None), w


def test_context_tells_quotation_from_abuse():
    features = toxicity.HitFeatures({"idiot": False})
    abuse = features("you are an idiot and you know it")
    quoted = features('the word "idiot" has four vowels')
    assert abuse[0] == 1 and abuse[4] > 0 and abuse[3] == 0
    assert quoted[0] == 0 and quoted[3] > 0
    assert features("an idi0t here")[2] == 1
    assert features("") == features(None) == [0.0] * toxicity.FEATURES


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in QUERIES["op4_toxicity"](spark, SF_MID).collect()}
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").count()
    assert len(rows) == docs
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [(labels[d], r) for d, r in rows.items() if r.held_out and d in labels]
    assert sum(r.predicted for y, r in held if y == 0) == 0
    assert sum(r.predicted for y, r in held if y == 1) >= 0.5 * sum(y for y, _ in held)


def test_toxicity_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, f"you idiot {i}", "x") for i in range(40)] + [(i, f"the cat {i}", "x") for i in range(40, 80)]
        + [(80, None, "x"), (81, "", "x"), (None, "idiot", "x"), (0, "you idiot 0", "x")],
        "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, 1, int(i < 40)) for i in range(80)] + [(None, 1, 1), (3, 1, None)],
                                   "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(spark, docs, labels).collect()
    assert len(got) == 84
    by = {r.doc_id: r for r in got}
    assert by[0].predicted == 1 and by[50].predicted == 0 and by[80].score == by[81].score < 0.7
    assert by[None].predicted == 1 and not by[None].held_out
    kept = toxicity.drop_toxic(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == 42
    none = toxicity.score_toxicity(spark, docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    one = toxicity.score_toxicity(spark, docs, labels.where("toxic = 1")).collect()
    assert {r.score for r in one} == {1.0}
    assert toxicity.score_toxicity(spark, docs.limit(0), labels).collect() == []


def test_language_held_out(spark):
    got = QUERIES["op10_language"](spark, SF_MID).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    assert len(got) == len(docs)
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 for r in got)
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in held)
    assert right >= 0.97 * len(held)


def test_language_equals_plain_bundles(spark):
    dimensions = 256
    texts = [(0, "the cat sat on the mat", "en"), (1, "der hund und die katze", "de"),
             (3, "Le chat, le chien!", "fr"), (4, "THE dog", "en"), (5, "und der", "de"), (8, "chien le", "fr")]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(spark, docs, 2, 4, dimensions).collect()}

    def bundle(text):
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        letters = " " + " ".join(letters.split()) + " "
        v = [language_id.letter_vector(ord(c), dimensions).astype(float) for c in letters]
        return sum((np.roll(a, 2) * np.roll(b, 1) * c for a, b, c in zip(v, v[1:], v[2:])), np.zeros(dimensions))

    names = ["de", "en", "fr"]
    train = {n: sum((bundle(t) for d, t, x in texts if x == n and zlib.crc32(str(d).encode()) % 4 != 2),
                    np.zeros(dimensions)) for n in names}
    for d, text, _ in texts:
        v = bundle(text)
        cosine = [v @ train[n] / np.linalg.norm(v) / max(np.linalg.norm(train[n]), 1e-30) for n in names]
        assert got[d].lang_pred == names[int(np.argmax(cosine))]
        assert abs(got[d].score - max(0, max(cosine))) < 1e-6


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(
        [(i, "the cat and the dog " * 3, "en") for i in range(12)] + [(20, None, "en"), (21, " 12 !", "en"),
         (None, "the cat", None), (22, "日本語" * 2000, "en"), (1, "x" * 300_000, None)],
        "doc_id long, text string, lang string")
    got = language_id.identify(spark, docs).collect()
    by = {(r.doc_id, r.lang_pred, r.score > 0) for r in got}
    assert len(got) == 17
    assert {(20, "und", False), (21, "und", False), (None, "en", True)} <= by
    assert language_id.identify(spark, docs.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id.identify(spark, docs.selectExpr(
        "doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
