"""The queries of the problems on texts (8-10); each runs over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronostrata.llm import bpe, forms, leaks
from chronostrata.session import load


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", bpe.token_ids(spark, F.col("text")).alias("ids"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.same_looking_pairs(load(spark, d, "documents"), "doc_id", "text")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaks in which one word was inserted, deleted or substituted."""
    return leaks.leaks(load(spark, d, "documents"), load(spark, d, "eval_items"), "doc_id", "text", "item_id", "text", max_edits=1)


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    return forms.same_looking_classes(load(spark, d, "documents"), "doc_id", "text")


QUERIES = {"p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p9_edited": p9_edited, "p10_classes": p10_classes}
#: None of these can be put in SQL; tests compare them with the public tokenizer and with brute force.
SQL: dict[str, str] = {}
