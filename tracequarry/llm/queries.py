"""Queries of problems 5 to 10."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracequarry.llm import contamination, conversations, packing, personal, quality, shared_spans
from tracequarry.llm.sql import SQL as SQL
from tracequarry.session import table

_TEXTS = ["input_value", "output_value"]
_SAME = ["trace_id", "span_id"]


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return conversations.conversations(table(spark, d, "claude_session_minimal")).select("session_id", "turn_no", "uuid")


def p5_corrected(spark: SparkSession, d: str) -> DataFrame:
    """With clock offsets of up to five minutes between the senders corrected."""
    return conversations.conversations(table(spark, d, "claude_session_minimal"), max_offset_us=300_000_000)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return personal.personal_kinds(table(spark, d, "claude_session_with_metadata"), table(spark, d, "identity_map"))


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal.redacted(table(spark, d, "claude_session_with_metadata"), table(spark, d, "identity_map"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_pairs(table(spark, d, "spans"), texts=_TEXTS, same=_SAME)


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every span with its class of spans that share the same stretches, and the number of spans it is linked to."""
    return shared_spans.shared_classes(table(spark, d, "spans"), texts=_TEXTS, same=_SAME)


def p7_share(spark: SparkSession, d: str) -> DataFrame:
    return shared_spans.shared_share(table(spark, d, "spans"), texts=_TEXTS, same=_SAME)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """What is split into containers, as far as the public vocabularies agree that it is larger than one."""
    return packing.split_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents"))


def p10_accuracies(spark: SparkSession, d: str) -> DataFrame:
    """How accurate each vote of the labelling functions was found to be."""
    return quality.vote_accuracies(table(spark, d, "documents"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_types(table(spark, d, "documents")).filter("prose_share < 0.5").select("doc_id")


QUERIES = {f.__name__: f for f in (p5_found, p5_corrected, p6_found, p6_redacted, p7_found, p7_classes, p7_share, p8_found, p8_containers, p9_found, p10_stats, p10_accuracies, p10_found)}
