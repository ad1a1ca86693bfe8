"""Spot signatures against sets of chains built word by word."""
import hashlib
import random
import re

from contrail.llm.spot_signatures import (ANCHORS, _previous, edited_copies, fingerprint_report, fingerprints,
                                          near_pairs)
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string"


def spots(text, chain=2):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    at = [i for i, w in enumerate(words) if w not in ANCHORS]
    out = set()
    for i, w in enumerate(words):
        rest = [words[j] for j in at if j > i]
        if w in ANCHORS and rest:
            out.add((w, *rest[:chain]))
    return out or ({(text,) if not words else tuple(words)} if text else set())


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[:len(t) - half] + following[:half]
        own = spots(t)
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), len(own),
                    alike(own, spots(edited)), alike(own, spots(following))))
    return sorted(out, key=str)


def report(spark, rows, df=None, **kw):
    df = spark.createDataFrame(rows, SCHEMA) if df is None else df
    got = fingerprint_report(spark, df, **kw).collect()
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, len(r.fingerprint.split()), r.near_edited,
                    r.near_next) for r in got), key=str)


def prose(n, seed):
    rng = random.Random(seed)
    words = ["the", "of", "and", "der", "la", "Sea,", "old", "ship.", "été", "sails", "north", "x9", "harbour"]
    return [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(n)]


def test_equals_sets_built_word_by_word(spark):
    ids = random.Random(1).sample(range(-500, 100_000), 150)
    rows = list(zip(ids, prose(150, 2)))
    want = brute(rows)
    for rows_per_bucket, fan_out in ((1024, 1024), (7, 3), (1, 2)):
        assert report(spark, rows, rows_per_bucket=rows_per_bucket, fan_out=fan_out) == want


def test_given_documents(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [tuple(r) for r in df.collect()]
    assert report(spark, rows, rows_per_bucket=20) == brute(rows)


def test_odd_rows(spark):
    rows = [(5, None), (5, None), (9, ""), (9, "of the"), (9, "of the sea"), (None, "!!"), (None, "??"), (7, "~the~ a~b"),
            (8, "the " * 20000 + "end"), (3, "\x00the sea\x00 of"), (2, "ß the STRASSE"), (2**62, "tail"), (-5, "x")]
    df = spark.createDataFrame([(*r, 1, "b", 3) for r in rows], SCHEMA + ", at int, sigs string, copy int")
    assert report(spark, rows, df) == brute(rows)
    assert report(spark, None, df.limit(0)) == []
    assert report(spark, [(4, "the lone one")]) == brute([(4, "the lone one")])


def test_equal_texts_have_equal_fingerprints(spark):
    texts = prose(20, 3) * 2
    got = {}
    for r in fingerprint_report(spark, spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect():
        got.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in got.values())


def test_next_numbers(spark):
    numbers = sorted(random.Random(4).sample(range(5000), 300))
    df = spark.createDataFrame([(b,) for b in numbers], "b long")
    want = dict(zip(numbers, numbers[1:] + numbers[:1]))
    assert {r.b: r.prev for r in _previous(df, 4).collect()} == want


def test_links_equal_all_pairs(spark):
    rng = random.Random(5)
    base = [" ".join(rng.choices(["the", "of", "and", *map(str, range(90))], k=80)) for _ in range(12)]
    texts = []
    for t in base:
        for _ in range(5):
            words = t.split()
            for _ in range(rng.randint(0, 8)):
                words[rng.randrange(len(words))] = str(rng.randrange(90))
            texts.append(" ".join(words))
    rows = list(enumerate(texts + texts[:9] + ["", None, "!!"]))
    df = spark.createDataFrame(rows, SCHEMA)
    classes, links = near_pairs(spark, df, 60, 100)
    sets = {i: frozenset(spots(t or "")) for i, t in rows}
    first = {}
    for i, s in sorted(sets.items()):
        if s:
            first.setdefault(s, i)
    assert {r.doc_id: r.class_id for r in classes.collect()} == {i: first[s] for i, s in sets.items() if s}
    want = {(a, b) for x, a in first.items() for y, b in first.items()
            if a < b and 100 * len(x & y) >= 60 * len(x | y)}
    got = links.collect()
    assert {(r.a, r.b) for r in got} == want and len(got) == len(want) > 10
    assert all(abs(r.likeness - alike(sets[r.a], sets[r.b])) < 1e-12 for r in got)


def test_fingerprints_and_edited_texts_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "the old sea"), (2, "of ships")], SCHEMA)
    assert [(r.doc_id, r.n_chars, len(r.signatures)) for r in fingerprints(df).orderBy("doc_id").collect()] \
        == [(1, 11, 1), (2, 8, 1)]
    assert sorted((r.doc_id, r.edited) for r in edited_copies(spark, df).collect()) \
        == [(1, "the olof sh"), (2, "of sthe ")]
