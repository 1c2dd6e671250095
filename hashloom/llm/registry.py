"""Queries of the training-data operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hashloom.llm import bpe_codec_query, decontam_query, langid_query, ngram_join_query, quality_query, secret_scan_query, suffix_dedup_query, syncmers_query, token_counts_query, toxicity_query

_MODULES = (decontam_query, syncmers_query, bpe_codec_query, toxicity_query, token_counts_query, secret_scan_query, suffix_dedup_query, langid_query, quality_query, ngram_join_query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in _MODULES if getattr(m, "ORACLE_SQL", None)}
