"""The subpackage's queries by name, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tideway.llm import decontaminate, jaccard_join, language_id, pieces, quality, sharding, substring_dedup, token_counts, token_store, warc
from tideway.llm.oracles import ORACLE_SQL as ORACLE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_ring_sharding": sharding.op2_ring_sharding,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_sentencepiece": pieces.op4_sentencepiece,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_language_id": language_id.op8_language_id,
    "op9_warc": warc.op9_warc,
    "op10_token_store": token_store.op10_token_store,
}
