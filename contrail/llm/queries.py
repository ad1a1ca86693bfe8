"""Queries opN_<name>: each operator with production parameters over its
whole table, and DuckDB twins where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.block_codes import codes_sql
from contrail.llm.hard_negatives import HARD_NEGATIVES_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORD_TOKENIZER = "word_bpe_49k.json"
PIECE_TOKENIZER = "piece_bpe_32k.model"
END_ID = 2
RELAXED = 1.5  # factor on the pruning bounds of the vantage-point trees


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op1_token_store")
def op1(spark, sf):
    from contrail.llm.token_store import token_store
    from public_tokenizers import path
    return token_store(spark, read_table(spark, sf, "documents"), path(WORD_TOKENIZER), END_ID)


@register("op2_vantage")
def op2(spark, sf):
    from contrail.llm.vantage import nearest
    return nearest(spark, read_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, k=10,
                   factor=RELAXED)


@register("op3_pii")
def op3(spark, sf):
    from contrail.llm.pii import find_pii
    return find_pii(spark, read_table(spark, sf, "documents"))


@register("op4_toxicity")
def op4(spark, sf):
    from contrail.llm.toxicity import score_toxicity
    return score_toxicity(spark, read_table(spark, sf, "documents"), read_table(spark, sf, "labels"))


_JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([array_to_string(ws[i:i + 3], ' ') FOR i IN range(1, len(ws) - 2)]) END) AS g
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g)
      WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b
      WHERE 100 * c >= 85 * (u.n + v.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS d, doc_id AS root FROM documents
      UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.d)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT d AS doc_id, min(root) AS component_id FROM r GROUP BY d) c USING (doc_id)"""


@register("op5_ngram_join", _JACCARD_SQL)
def op5(spark, sf):
    from contrail.llm.ngram_join import jaccard_components
    return jaccard_components(spark, read_table(spark, sf, "documents"), k=4, num=85, den=100)


@register("op6_secret_scan")
def op6(spark, sf):
    from contrail.llm.secret_scan import find_secrets
    return find_secrets(spark, read_table(spark, sf, "documents"))


@register("op7_decontaminate")
def op7(spark, sf):
    from contrail.llm.decontaminate import find_leaks
    return find_leaks(spark, read_table(spark, sf, "documents"), read_table(spark, sf, "benchmark"))


@register("op8_pieces")
def op8(spark, sf):
    from contrail.llm.piece_codec import digest
    from public_tokenizers import path
    return digest(spark, read_table(spark, sf, "documents"), path(PIECE_TOKENIZER), verify=True)


@register("op9_passages")
def op9(spark, sf):
    from contrail.llm.passages import passage_classes
    return passage_classes(spark, read_table(spark, sf, "documents"))


@register("op10_language")
def op10(spark, sf):
    from contrail.llm.language_id import identify
    return identify(spark, read_table(spark, sf, "documents"))


@register("op12_hilbert_codes", codes_sql())
def op12(spark, sf):
    from contrail.llm.block_codes import compressed
    return compressed(spark, read_table(spark, sf, "embeddings"))


@register("op11_hard_negatives", HARD_NEGATIVES_SQL)
def op11(spark, sf):
    from contrail.llm.hard_negatives import hard_negatives
    relabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark, read_table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0,
                          relabelled)


@register("op13_spot_signatures")
def op13(spark, sf):
    from contrail.llm.spot_signatures import fingerprint_report
    return fingerprint_report(spark, read_table(spark, sf, "documents"))
