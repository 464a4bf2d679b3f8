"""A training-data pipeline over ``documents``: each stage is one of the text operators, written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasespark.llm import bpe, decontaminate, langid, pii, simhash
from phasespark.llm.common import in_fold, materialise, side, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those that the classifier rejects go."""
    docs = docs.select(*COLUMNS)
    model = langid.learn(docs.filter(~in_fold(F.col("doc_id"), 4, 2)))
    return langid.identify(docs, model).filter(~F.col("language.rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id."""
    return simhash.deduplicate(docs.select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    docs = docs.select(*COLUMNS)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_found")).distinct()
    return docs.join(side(materialise(found, "found")), F.col("doc_id").eqNullSafe(F.col("_found")), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows the text."""
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids and the text decoded from them."""
    found = bpe.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"))
    return found.select("doc_id", "lang", "source", "text", F.size("bpe.ids").cast("long").alias("n_tokens"), "bpe.ids", "bpe.decoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("bpe", tokens),
]
#: Compression and bit votes have no counterpart in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
