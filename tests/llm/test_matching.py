"""Benchmark leaks, repeated passages and SentencePiece against plain versions."""
import random
import struct

import numpy as np
import sentencepiece
from public_tokenizers import path

from contrail.llm import decontaminate, passages, piece_codec
from contrail.llm.queries import QUERIES
from tests.conftest import SF_SMALL

PIECES = path("piece_bpe_32k.model")


# ---- decontamination -------------------------------------------------------------

def smith_waterman(item, window):
    best, h = (0, 0, 0), [[(0, 0)] * (len(window) + 1)]
    for x in item:
        row = [(0, 0)]
        for j, y in enumerate(window, 1):
            d = h[-1][j - 1][0] + (2 if x == y else -1)
            row.append((max(0, d, h[-1][j][0] - 1, row[-1][0] - 1), 0))
            best = max(best, (row[-1][0], 0, 0))
        h.append(row)
    return best[0]


def test_alignment_equals_the_plain_matrix():
    rng = random.Random(4)
    for _ in range(150):
        item = rng.choices(range(6), k=rng.randrange(1, 12))
        window = rng.choices(range(6), k=rng.randrange(1, 25))
        score, a, z = decontaminate.align(np.array(item), np.array(window))
        assert score == smith_waterman(item, window)
        if score:
            assert smith_waterman(item, window[a:z]) == score


def _items(rng, n=30):
    vocabulary = [f"w{i}" for i in range(4000)]
    return [" ".join(rng.choices(vocabulary, k=rng.randrange(20, 50))) for _ in range(n)], vocabulary


def test_leaks_verbatim_edited_and_clean(spark):
    rng = random.Random(6)
    items, vocabulary = _items(rng)
    docs, want = [], set()
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randrange(0, 300))
        if d % 3 == 0:
            i = rng.randrange(len(items))
            copy = items[i].upper().split()
            for _ in range(len(copy) // 10 if d % 2 else 0):  # one word in ten replaced
                copy[rng.randrange(len(copy))] = "edit"
            at = rng.randrange(len(words) + 1)
            words[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.find_leaks(spark, df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    texts = dict(docs)
    for r in got:
        if r.score == 1:
            assert texts[r.doc_id][r.start:r.end].lower() == items[r.item_id]
    assert {r.doc_id for r in decontaminate.drop_leaks(spark, df, bench).collect()} \
        == set(range(120)) - {d for d, _ in want}


def test_leak_query_finds_every_verbatim_item(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()
    got = {(r.doc_id, r.item_id) for r in QUERIES["op7_decontaminate"](spark, SF_SMALL).collect()}
    verbatim = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    assert verbatim and verbatim <= got
    assert len(got - verbatim) <= 2


def test_leaks_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a b c d e f g", 0), (3, "a b c d e f g", 0),
                                  (3, "a b c d e f g", 0)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(1, "A b, c d e f g."), (2, None), (None, "a b c d e"), (4, "a b")],
                                  "item_id long, text string")
    got = sorted(map(tuple, decontaminate.find_leaks(spark, docs, bench).collect()), key=str)
    assert got == [(3, 1, 1.0, 0, 13), (3, 1, 1.0, 0, 13), (None, 1, 1.0, 0, 13)]
    assert decontaminate.find_leaks(spark, docs.limit(0), bench).collect() == []
    assert decontaminate.find_leaks(spark, docs, bench.limit(0)).collect() == []
    assert decontaminate.drop_leaks(spark, docs, bench.limit(0)).count() == 5


def test_heavy_edits_beside_verbatim_copies(spark):
    rng = random.Random(12)
    items, vocabulary = _items(rng, 12)
    docs, want = [], set()
    for i, item in enumerate(items):
        words = item.split()
        n = len(words)
        for cuts in ([], range(2, n, 5), range(0, n - 6, 3)):  # verbatim, 1 in 5, nearly 1 in 3 replaced
            copy = list(words)
            for at in cuts:
                copy[at] = f"edit{at}"
            window = decontaminate.text_words(" ".join(copy))
            score = decontaminate.align(decontaminate.text_words(item), window)[0]
            assert score >= decontaminate.THRESHOLD * decontaminate.MATCH * n
            want.add((len(docs), i))
            docs.append((len(docs), " ".join([*rng.choices(vocabulary, k=50), *copy, *rng.choices(vocabulary, k=50)])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, df, bench).collect()} == want
    assert decontaminate.drop_leaks(spark, df, bench).count() == 0


def test_short_items_match_as_they_stand(spark):
    bench = spark.createDataFrame([(1, "which of the planets rings"), (2, "name the gas"),
                                   (3, "one two three four"), (4, "a b c d e f g h i j")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "he asked which of the two it was"), (2, "Which of the planets, rings?"),
                                  (3, "now Name the gas!"), (4, "name a gas"), (5, "one two three five four"),
                                  (6, "so: one, two, three, four."), (7, "a b c d e x y z"),
                                  (8, "x a b c d e f g h y")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark, docs, bench).collect()}
    assert got == {(2, 1), (3, 2), (6, 3), (8, 4)}
    assert {r.doc_id for r in decontaminate.drop_leaks(spark, docs, bench).collect()} == {1, 4, 5, 7}


# ---- passages ----------------------------------------------------------------------

def test_fenwick_chain_equals_quadratic_chaining():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randrange(1, 25)
        pa, pb = rng.choices(range(60), k=n), rng.choices(range(60), k=n)
        matches = sorted(set(zip(pa, pb)))
        got = passages.chains(pa, pb)
        assert sorted(m for c in got for m in c) == matches  # every match once
        for chain in got:
            assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(chain, chain[1:]))
    line = [(10 * i, 10 * i + 3) for i in range(12)]
    assert passages.chains([x for x, _ in line], [y for _, y in line])[0] == line


def _passage_corpus(rng):
    vocabulary = [f"v{i}" for i in range(5000)]
    new = lambda n: rng.choices(vocabulary, k=n)
    shared = new(70)
    docs = [new(rng.randrange(60, 200)) for _ in range(40)]
    for d in (3, 9, 22, 31):
        docs[d][20:20] = shared
    edited = list(shared)
    for at in (15, 40):
        edited[at] = "other"
    del edited[55]
    docs[12][30:30] = edited
    docs.append(list(docs[5]))             # an exact copy
    docs.append(docs[7][:30] + new(100))   # too short a repeat
    return [(i, " ".join(w)) for i, w in enumerate(docs)], shared


def test_passages_found_and_clean_texts_left_alone(spark):
    rows, shared = _passage_corpus(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = passages.repeated_passages(spark, df).collect()
    assert {r.doc_id for r in got} == {3, 9, 12, 22, 31, 5, 40}
    texts = {d: t.split() for d, t in rows}
    for r in got:
        mine = texts[r.doc_id][r.start_word:r.end_word]
        other = texts[r.other_id][r.other_start:r.other_end]
        if {r.doc_id, r.other_id} <= {3, 9, 22, 31}:
            assert mine == other and len(mine) >= 70 and r.equal_words == len(mine)
        elif 12 in (r.doc_id, r.other_id):
            assert 60 <= len(mine) <= 75 and 60 <= len(other) <= 75
    assert {(r.doc_id, r.other_id) for r in got if r.doc_id in (5, 40)} == {(5, 40), (40, 5)}


def test_hot_passage_in_every_text(spark, monkeypatch):
    rng = random.Random(2)
    line = rng.choices([f"h{i}" for i in range(500)], k=60)
    rows = [(i, " ".join([*rng.choices([f"v{i}" for i in range(9000)], k=30), *line])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = passages.repeated_passages(spark, df).collect()
    assert {r.doc_id for r in got} == set(range(300))
    assert len(got) <= 300 * 2 * 6  # links grow with the texts, not with their pairs


def test_passages_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(80))
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, text, 0), (None, text, 0), (4, text.upper(), 0),
                                (4, text.upper(), 0), (5, "short", 0), (6, "short", 0)],
                               "doc_id long, text string, cls int")
    got = sorted(map(tuple, passages.repeated_passages(spark, df).collect()))
    assert got == [(3, 0, 80, 4, 0, 80, 80), (4, 0, 80, 3, 0, 80, 80)]
    assert passages.repeated_passages(spark, df.limit(0)).collect() == []


def test_passage_query_finds_copied_spans(spark):
    """Documents that share an exact run of 60 words are all reported."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()
    found = {r.doc_id for r in QUERIES["op9_passages"](spark, SF_SMALL).collect()}
    holders: dict = {}
    for d in docs:
        w = d.text.encode().lower().split()
        for i in range(len(w) - 59):
            holders.setdefault(tuple(w[i:i + 60]), set()).add(d.doc_id)
    want = {d for h in holders.values() if len(h) > 1 for d in h}
    assert want <= found


# ---- SentencePiece -----------------------------------------------------------------

ODD = ["", " ", "  a  b ", "\n\n x\n y \n", "日本語 テキスト", "a▁b ▁ c", "<s> </s> <unk> <0x41>", "\t é ́",
       "\U0001f600 " * 3, "x" * 3000, "new\r\nline", "I'm 100% sure. ok", " \n", "a\n \nb"]


def test_parity_and_round_trip():
    codec = piece_codec.Codec(open(PIECES, "rb").read(), threads=1)
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode([None, *ODD])]
    assert ids == [[], *reference.encode(ODD)]
    assert codec.decode(ids) == reference.decode(ids)
    assert codec.decode(ids) == ["", *[t.replace("▁", " ") for t in ODD]]  # the marker reads as a blank


def _field(number, kind, payload):
    key = bytes([number << 3 | kind]) if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4])
    return key + payload


def _unigram_model():
    """A small hand-made unigram model file."""
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(p, s, 1) for p, s in [("▁", -2.0), ("▁the", -1.5), ("▁cat", -2.5), ("c", -4.0), ("a", -4.1),
                                      ("t", -4.2), ("at", -3.5), ("▁c", -3.9), ("he", -3.0), ("h", -4.5), ("e", -4.6)]]
    pieces += [(f"<0x{i:02X}>", -9.0, 6) for i in range(256)]
    out = b""
    for p, s, kind in pieces:
        raw = p.encode()
        body = b"\x0a" + bytes([len(raw)]) + raw + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([kind])
        out += b"\x0a" + bytes([len(body)]) + body
    trainer = b"\x18\x01" + _field(35, 0, b"\x01")
    normal = b"\x0a\x08identity" + b"\x18\x01\x20\x01\x28\x01"
    return out + b"\x12" + bytes([len(trainer)]) + trainer + b"\x1a" + bytes([len(normal)]) + normal


def test_unigram_scores_and_clean_up():
    data = _unigram_model()
    model = piece_codec.PieceModel(data)
    assert model.kind == piece_codec.UNIGRAM and model.byte_fallback and model.trim and not model.stretches
    codec = piece_codec.Codec(data, threads=1)
    reference = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = ["the cat", "  the   cat ", "that hat", "cat日", "a é"]
    ids = [np.frombuffer(x, "<u4").tolist() for x in codec.encode(texts)]
    assert ids == reference.encode(texts)
    assert codec.decode(ids) == [reference.decode(x) for x in ids]


def test_piece_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    reference = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = QUERIES["op8_pieces"](spark, SF_SMALL).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.parity and r.round_trip and r.n_tokens == len(reference.encode(docs[r.doc_id]))


def test_pieces_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (None, "a b", "x"), (2, "", "x"), (2, "a b", "x")],
                               "doc_id long, text string, model string")
    coded = piece_codec.encode(spark, df, PIECES)
    assert coded.columns == ["doc_id", "text", "model", "ids"]
    back = piece_codec.decode(spark, coded, PIECES).collect()
    assert [r.decoded for r in back] == [r.text or "" for r in back]
    assert piece_codec.encode(spark, df.limit(0), PIECES).collect() == []


def test_two_passages_in_one_pair(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(5000)]
    new = lambda n: rng.choices(vocabulary, k=n)
    rows, want = [], {}
    for size, gap, more in ((60, 40, 0), (60, 80, 0), (60, 120, 70), (300, 800, 0)):
        one, two, d = new(size), new(size), len(rows)
        for side in range(2):
            head = new(30 + 10 * side)
            rows.append((d + side, " ".join([*head, *one, *new(gap + more * side), *two, *new(25)])))
            want[d + side] = [(len(head), size), (len(head) + size + gap + more * side, size)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, passages.repeated_passages(spark, df).collect()))
    assert {g[0] for g in got} == set(want)
    for d, spans in want.items():
        mine = [g for g in got if g[0] == d]
        assert [(g[1], g[2] - g[1]) for g in mine] == spans and all(g[6] == g[2] - g[1] for g in mine)


def test_segments_are_all_stretches_of_the_identity():
    rng = random.Random(9)
    for _ in range(150):
        same, px, py = [], [0], [0]
        while len(same) < 330:
            rate = rng.choice((0.3, 0.75, 0.85, 1.0))
            for _ in range(rng.randrange(5, 90)):
                kind = rng.random()
                same.append(kind >= 0.03 and rng.random() < rate)
                px.append(px[-1] + (kind >= 0.015))
                py.append(py[-1] + (not 0.015 <= kind < 0.03))
        px, py, same = np.array(px), np.array(py), np.array(same)
        got = passages.segments(px, py, same)
        sums = np.concatenate(([0], np.cumsum(same)))
        passes = lambda s, e: (
            same[s] and same[e - 1] and min(px[e] - px[s], py[e] - py[s]) >= passages.MIN_WORDS
            and 5 * (sums[e] - sums[s]) >= 4 * max(px[e] - px[s], py[e] - py[s]))
        assert all(passes(s, e) for s, e in got)
        left = [0, *[x for g in got for x in g], len(same)]
        for a, z in zip(left[::2], left[1::2]):  # no passage is left beside them
            assert not any(passes(s, e) for s in range(a, z) for e in range(s + passages.MIN_WORDS, z + 1))


def test_every_shared_run_is_in_one_class(spark):
    """Against brute force: texts that share halves of a passage with others."""
    rng = random.Random(10)
    vocabulary = [f"v{i}" for i in range(5000)]
    new = lambda n: rng.choices(vocabulary, k=n)
    shared = [new(60) for _ in range(6)]
    texts = [[*new(40), *s, *new(40)] for s in shared for _ in range(2)]
    texts[0] += [*new(30), *shared[0]]  # twice in one text
    for s in shared:
        for _ in range(12):
            texts += [[*new(40), *s[:30], *new(40)], [*new(40), *s[30:], *new(40)]]
    line = new(50)
    texts += [[*new(30), *line, *new(30)] for _ in range(9)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    found = passages.repeated_passages(spark, df).collect()
    holders: dict = {}
    for d, w in enumerate(texts):
        for p in range(len(w) - 49):
            holders.setdefault(tuple(w[p:p + 50]), set()).add((d, p))
    holders = {g: h for g, h in holders.items() if len({d for d, _ in h}) > 1}
    assert {r.doc_id for r in found} == {d for h in holders.values() for d, _ in h}
    got = passages.passage_classes(spark, df).collect()
    assert sorted(map(tuple, found)) == sorted(tuple(r)[:7] for r in got)
    for h in holders.values():
        of = [{r.class_id for r in got if r.doc_id == d and r.start_word <= p and r.end_word >= p + 50} for d, p in h]
        assert set.intersection(*of)
    assert len({r.class_id for r in got}) == 7


def test_stretches_are_verified_like_whole_texts():
    data = open(PIECES, "rb").read()
    codec = piece_codec.Codec(data, threads=1)
    verify = piece_codec.Verifier(codec, data)
    from sentencepiece import SentencePieceProcessor
    library = SentencePieceProcessor(model_proto=data)
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "the ", " ", "  ", "\n", "\n\n", "é", "汉", "\u2581", "word", "\t", "\x00", "'s "],
                                 k=rng.randint(0, 40))) for _ in range(400)] + ["", " ", "\n", "x" * 3000]
    coded, parity, same = verify(texts)
    assert coded == codec.encode(texts)
    ids = [np.frombuffer(c, "<u4").tolist() for c in coded]
    assert parity == [x == y for x, y in zip(ids, library.encode(texts))]
    assert same == [x == t for x, t in zip(codec.decode(ids), texts)] and not all(same)
    row = piece_codec._in_a_row(sorted({p for t in texts for p in piece_codec._STRETCH.findall(" " + t)}))
    assert piece_codec._STRETCH.findall("".join(row)) == row
    # other ids than the library's are found, and only where they are
    other = piece_codec.Verifier(codec, data)
    plain = other._plain
    other._plain = lambda ps: [c if p != " word" else b"\0\0\0\0" + c for p, c in zip(ps, plain(ps))]
    assert other(["a word here", "no other", "word", "sword"])[1] == [False, True, False, True]
