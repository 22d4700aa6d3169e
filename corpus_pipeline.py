"""The corpus pipeline: language ID, near-dedup, decontamination, PII, packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from folioloom.llm import decontamination, language, near_dedup, packing, pii
from folioloom.llm.common import Shelf, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the model knows; it learns from the stage's own labelled input."""
    return language.keep_known(docs, language.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs, 5, 80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't contaminated by the benchmark."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with private spans replaced in their texts."""
    return pii.redact(docs, pii.train(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of power-of-two lengths, ids included."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), 2048, 1)


STAGES = [
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("private_data", without_private_data),
    ("packing", packed),
]

#: A trained model decides in two stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    shelf = Shelf(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = shelf.put(docs)
    return docs
