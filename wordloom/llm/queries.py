"""The operators as queries over the given tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import fold, table


def op10_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       first_value(doc_id) OVER w = doc_id AS kept,
       text_sha256
FROM d
WINDOW w AS (PARTITION BY text_sha256 ORDER BY len DESC, doc_id)
"""


def op1_jaccard_join(spark, sf_dir):
    from .jaccard_join import similar_groups

    return similar_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op2_lm_score(spark, sf_dir):
    from .lm_score import scores

    return scores(table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1)


def op3_language_id(spark, sf_dir):
    from .language_id import predicted, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold(F.col("doc_id"), 4) != 2).select("doc_id", "text", "lang"))
    out = predicted(docs, model)
    return out.withColumn("held_out", fold(F.col("doc_id"), 4) == 2)


def op4_chat_format(spark, sf_dir):
    from .quotes import threaded

    return threaded(table(spark, sf_dir, "conversations"))


def op5_toxicity(spark, sf_dir):
    from .toxicity import scored, train

    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 5) != 0))
    return scored(docs, model).withColumn("held_out", fold(F.col("doc_id"), 5) == 0)


def op6_repeats(spark, sf_dir):
    from .repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    from .mixing import mixture

    return mixture(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark, sf_dir):
    from .embedding_dedup import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_bpe(spark, sf_dir, vocabulary="byte_bpe_50k.tiktoken"):
    import public_tokenizers

    from .bpe import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path(vocabulary), public_tokenizers.PATTERN)


def queries() -> dict:
    found = [op1_jaccard_join, op2_lm_score, op3_language_id, op4_chat_format, op5_toxicity, op6_repeats, op7_mixing, op8_embedding_dedup, op9_bpe, op10_exact_dedup]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict:
    return {"op10_exact_dedup": OP10_SQL}
