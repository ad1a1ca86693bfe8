"""Directly addressable token files: round trips and the query's contract."""
import zlib

import numpy as np
from public_tokenizers import path
from tokenizers import Tokenizer

from contrail.llm.queries import QUERIES
from contrail.llm.shared import Scratch
from contrail.llm.token_store import TokenSegment, read_documents, segment_bytes, token_store, write_store
from tests.conftest import SF_SMALL


def test_segment_round_trip_and_random_access():
    rng = np.random.default_rng(5)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = (2 ** (rng.random(n) * 31)).astype(np.uint32)
        cuts = np.sort(rng.integers(0, n + 1, 4))
        starts = np.concatenate(([0], cuts, [n]))
        seg = TokenSegment(segment_bytes([3, None, 5, 6, 7], starts, ids))
        assert (seg.tokens(0, n) == ids).all()
        for i in rng.integers(0, max(n, 1), 200 if n else 0):
            assert seg.token(int(i)) == ids[i]
        for k in range(5):
            assert (seg.document(k) == ids[starts[k]:starts[k + 1]]).all()
        assert seg.doc_valid.tolist() == [True, False, True, True, True]


def _expected(rows):
    model, start, out = Tokenizer.from_file(path("word_bpe_49k.json")), 0, []
    for doc_id, text in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_whole_text_encoding(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(map(tuple, QUERIES["op1_token_store"](spark, SF_SMALL).collect()))
    assert got == _expected([(r.doc_id, r.text) for r in docs])


def test_odd_texts(spark):
    texts = [None, "", " \t ", "don't STOP's now", "<|endoftext|> <|STARTOFTEXT|>x", "é ́a",
             "ΣΑΣ İx", "\x1c\x85 z", "日本語 12.5%", "a" * 5000, "don't " * 3000]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "x") for i, t in reversed(rows)], "doc_id long, text string, path string")
    got = sorted(map(tuple, token_store(spark, docs, path("word_bpe_49k.json"), 2).collect()))
    assert got == _expected(rows)


def test_empty_table_nulls_and_repeats(spark):
    tokenizer = path("word_bpe_49k.json")
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_store(spark, empty, tokenizer, 2).collect() == []
    docs = spark.createDataFrame([(7, "b"), (None, "a"), (7, "b"), (7, "a")], "doc_id long, text string")
    got = sorted(map(tuple, token_store(spark, docs, tokenizer, 2).collect()), key=lambda r: r[1])
    assert got == _expected([(None, "a"), (7, "a"), (7, "b"), (7, "b")])


def test_manifest_orders_segments(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    folder = Scratch(spark, "test").path("store")
    manifest = write_store(spark, docs, folder, path("word_bpe_49k.json"), 2).orderBy("first").collect()
    assert [m.first for m in manifest] == np.concatenate(
        ([0], np.cumsum([m.n_tokens for m in manifest])[:-1])).tolist()
    assert read_documents(spark, folder).count() == docs.count()
