"""The registered queries of this subpackage, each over its whole table, with SQL where SQL can say the same."""

from __future__ import annotations

import secrets as secrets_of_python
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, ann, bpe, chat, divergence, embed_dedup, langid, licenses, oracles, packing, pii, quality, secrets, simhash
from .common import table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def surrogate_key(spark: SparkSession) -> str:
    """spark.vortiq.surrogate.key; where it is unset, one drawn at random that lasts as long as the session."""
    name = "spark.vortiq.surrogate.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets_of_python.token_hex(32))
    return spark.conf.get(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_multi_50k.tiktoken"), _pattern())


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more whose texts hold what looks like turn marks."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.format_conversations(rows.unionByName(more))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"), surrogate_key(spark))


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _pattern())


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _pattern(), _tokenizer("piece_bpe_32k.model"))


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": pipeline, "op1_bpe": op1_bpe, "op2_simhash": op2_simhash, "op3_chat": op3_chat, "op4_quality": op4_quality, "op5_pii": op5_pii, "op6_embeddings": op6_embeddings, "op7_neighbours": op7_neighbours, "op8_secrets": op8_secrets, "op9_language": op9_language, "op10_packing": op10_packing, "op11_align": op11_align, "op12_licenses": op12_licenses, "op13_divergence": op13_divergence}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
