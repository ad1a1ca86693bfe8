"""The pipeline against its stages done plainly, one document after another."""
import sentencepiece
from public_tokenizers import path

import corpus_pipeline
from contrail.llm import decontaminate, pii, toxicity
from contrail.llm.queries import read_table
from contrail.llm.spans import ordered
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.test_ngram_join import brute
from tests.llm.test_spans import base_pii


def test_pipeline_equals_plain_stages(spark):
    docs = {r.doc_id: r.text for r in read_table(spark, SF_MID, "documents").collect()}
    score = toxicity.learn(spark, read_table(spark, SF_MID, "documents"),
                           read_table(spark, SF_MID, "labels")).scorer()
    kept = {d: t for d, t in docs.items() if score(t) < toxicity.THRESHOLD}
    assert 0 < len(kept) < len(docs)
    kept = {d: kept[d] for d, _, component in brute(sorted(kept.items()), 5, 80, 100) if d == component}
    items = [decontaminate.text_words(r.text) for r in read_table(spark, SF_MID, "benchmark").collect()]

    def leaks(text):
        words = decontaminate.text_words(text)
        return any(decontaminate.align(i, words)[0] >= decontaminate.THRESHOLD * decontaminate.MATCH * len(i)
                   for i in items)

    clean = {d: t for d, t in kept.items() if not leaks(t)}
    assert 0 < len(clean) < len(kept) < len(docs)
    find = pii.make_finder()
    masked = {}
    for d, t in clean.items():
        spans = base_pii(t) + [s for s in find(t) if s[0] not in pii.BASE]
        masked[d] = pii.mask_text(t, ordered(spans, pii.KINDS))
    assert any(masked[d] != clean[d] for d in clean)
    reference = sentencepiece.SentencePieceProcessor(model_file=path("piece_bpe_32k.model"))
    got = {r.doc_id: (r.text, list(r.ids)) for r in corpus_pipeline.run(spark, SF_MID).collect()}
    assert got == {d: (t, reference.encode(t)) for d, t in masked.items()}


def test_stages_keep_the_columns(spark):
    docs = read_table(spark, SF_SMALL, "documents").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_SMALL).columns == docs.columns, name


def test_stages_on_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, None, "s", 0), (None, "a b c d e f", "en", "s", 11), (2, "", "en", None, 0),
         (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13),
         (4, "mail me@example.org", "en", "s", 19)],
        "doc_id long, text string, lang string, source string, n_chars int")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_SMALL)
        docs.collect()
        assert stage(spark, docs.limit(0), SF_SMALL).count() == 0 if name != "encode" else True
    got = sorted(map(tuple, docs.select("doc_id", "text").collect()), key=str)
    assert got == sorted([(1, None), (None, "a b c d e f"), (2, ""), (3, "a b c d e f g"),
                          (4, "mail <email>")], key=str)
