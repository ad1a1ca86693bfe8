"""A training-data pipeline over ``documents``.

Five stages, each written as Parquet and read again as the next one's input:
documents scored as toxic go; of each group of near copies (five-word
shingles, similarity 0.8) the document with the smallest id stays; documents
that hold a benchmark item go; personal data is masked; the texts are encoded.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contrail.llm import decontaminate, ngram_join, pii, piece_codec, toxicity
from contrail.llm.queries import PIECE_TOKENIZER, read_table
from contrail.llm.shared import Scratch


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(spark, docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.drop_near_copies(spark, docs, k=5, num=80, den=100)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(spark, docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.mask_pii(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    from public_tokenizers import path
    return piece_codec.encode(spark, docs, path(PIECE_TOKENIZER)).select("doc_id", "text", "ids")


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks),
          ("personal_data", personal_data), ("encode", encode)]

# The lexicon, the alignment and the encoder have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, text, ids."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
