"""From documents to training tokens: five stages, each on all that the one before kept.

Every stage takes any table with doc_id and text; all but the last return its
columns as they are, also those whose names an operator uses inside, and only
``text`` and ``n_chars`` change. An empty table stays empty. What a stage does with
null, empty and very long texts, repeated rows and null ids, its docstring says.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hashloom.llm import bpe_codec, decontam, langid, ngram_join, secret_scan
from hashloom.llm.shared import stored

#: A document whose language is less certain goes.
LEAST_SCORE = 0.5
#: Goes before the names of columns that are there within a stage only.
_OWN = "language_id stage: "


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language; those without a letter (null and empty texts too), or of no certain language, go.

    Row by row: repeated rows share their fate, ids do not matter. With no known language to learn from every document goes.
    """
    found = langid.identify(docs, keep=True, prefix=_OWN)
    return found.where((F.col(f"{_OWN}lang_pred") != "und") & (F.col(f"{_OWN}score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least doc_id.

    Null and empty texts are one class of equal texts; of repeated rows one stays; a row with a null doc_id stays only where no row of its class has one.
    """
    return ngram_join.one_per_class(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of benchmark items; those that are mostly such passages go. Texts without words, null ones too, stay as they are; row by row."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked, in whole texts of any length; a null text stays null; row by row."""
    return secret_scan.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and digests of the ids and of the text decoded from them; a null text counts as empty; row by row."""
    return bpe_codec.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: SQL can express neither the language model nor the BPE merges; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage keeps is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
