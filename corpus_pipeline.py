"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark passages, token ids.

Every stage takes null ids and texts, repeated rows, empty tables and other columns: null or wordless text fails the
quality rules, is like nothing, loses nothing and has no tokens; rows with a null id are nobody's copy; columns besides
doc_id, text and n_chars pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideway.llm.common import joined_small, table, tokenizer_path, written
from tideway.llm.decontaminate import contaminated
from tideway.llm.jaccard_join import jaccard_components
from tideway.llm.pieces import encode_pieces
from tideway.llm.quality import good_rows
from tideway.llm.substring_dedup import without_repeats

#: Ids that may be broadcast to drop rows by; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id isn't in ``ids``; rows with a null doc_id stay."""
    ids = written(ids.select("doc_id").distinct(), "ids")
    return joined_small(docs, ids, "doc_id", "left_anti", ids.count(), BROADCAST_IDS).select(*docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return good_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id; rows with the same id are one document."""
    return without_ids(docs, jaccard_components(docs).filter("component_id <> doc_id"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has; n_chars, if it is there, follows the text."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    return without_ids(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that they decode to."""
    return encode_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("SentencePiece encoding", token_ids),
]

#: Expectation-maximisation, similarity components and SentencePiece have no SQL; tests/llm checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
