"""From raw documents to packed training sequences, in five stages; each works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vortiq.llm import langid, packing, pii, quality, simhash
from vortiq.llm.common import fresh, materialize, table
from vortiq.llm.queries import surrogate_key


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language stay; those without a letter go. The columns of documents stay as they are."""
    columns, own = tuple(docs.columns), fresh(docs.columns)
    return langid.label(docs, langid.train(docs), columns, own).where(F.col(f"{own}lang_pred") != "und").select(*columns)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more stay; the field is fitted to the labels of documents that came this far."""
    columns, own = tuple(docs.columns), fresh(docs.columns)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, columns, own).where(F.col(f"{own}score") >= 0.5).select(*columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies one document stays, that of smallest doc_id; null ids come last."""
    return simhash.one_each(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced; n_chars follows the text."""
    own = fresh(docs.columns)
    done = pii.replace(docs, surrogate_key(spark), f"{own}n_pii")
    return done.select(*[F.when(F.col(f"{own}n_pii") > 0, F.char_length("text")).otherwise(F.col(c)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("quality", good), ("near_duplicates", distinct), ("pii", private), ("packing", packed)]
#: Models, components and a linear program are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
