"""Queries of the training-data problems for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mossgrid.llm import articles, characters, encoding, leakage, residue, sentences, tokenize
from mossgrid.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return characters.inconsistent_fields(table(spark, d, "products"))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    return characters.consistent_form(table(spark, d, "products"))


def p3_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_fields(table(spark, d, "products"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_residue(spark, d).select("product_id", "field_name")


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled_fields(table(spark, d, "products"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_restored(spark, d).select("product_id", "field_name").distinct()


def p6_articles(spark: SparkSession, d: str) -> DataFrame:
    return articles.article_classes(table(spark, d, "products"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return articles.article_pairs(table(spark, d, "products"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.corpus_ids(table(spark, d, "documents"))


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents")).distinct()


QUERIES = {"p1_found": p1_found, "p1_consistent": p1_consistent, "p3_found": p3_found, "p3_residue": p3_residue, "p4_found": p4_found, "p4_restored": p4_restored, "p6_found": p6_found, "p6_articles": p6_articles, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found}
SQL: dict[str, str] = {}
