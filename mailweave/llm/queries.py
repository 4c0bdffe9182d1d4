"""Queries of the operators for training data, on the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm import components, encoding, leakage, mixture, names, neardup, newtext, pii, spans
from mailweave.sources.tables import load


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(load(spark, d, "email_structure"), load(spark, d, "contacts"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redacted(load(spark, d, "email_structure"), load(spark, d, "contacts"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.similar_mail(load(spark, d, "email_structure"))


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.grouped_mail(load(spark, d, "email_structure"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return components.reply_groups(load(spark, d, "email_structure"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.found(load(spark, d, "email_structure"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_entries(load(spark, d, "email_structure"), load(spark, d, "contacts"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return newtext.found(load(spark, d, "email_structure"), load(spark, d, "ingest"), load(spark, d, "mailboxes"))


def p7_new_text(spark: SparkSession, d: str) -> DataFrame:
    return newtext.new_texts(load(spark, d, "email_structure"), load(spark, d, "ingest"), load(spark, d, "mailboxes"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(load(spark, d, "documents"), load(spark, d, "source_targets"))[1]


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    written = mixture.mixture(load(spark, d, "documents"), load(spark, d, "source_targets"))[0]
    return written.select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.span_pairs(load(spark, d, "documents"))


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared(load(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_redacted, p3_found, p3_groups, p4_found, p5_found, p6_found, p7_found, p7_new_text, p8_found, p9_mixture, p9_shares, p10_found, p10_shared)
}
