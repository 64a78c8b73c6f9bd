"""Queries over the standard tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import ann, bpe, brown, html_extract, jaccard, langid, line_rules, mixing, ordinal, url_filter
from larkspur.llm.oracles import ORACLE_SQL


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.taken(mixing.mix(docs))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.digest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op3_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.digest(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordinal.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.digest(table(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary_path())


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_pages(table(spark, sf_dir, "pages"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_ann": op2_ann,
    "op3_brown": op3_brown,
    "op4_quality": op4_quality,
    "op5_line_rules": op5_line_rules,
    "op6_bpe": op6_bpe,
    "op7_langid": op7_langid,
    "op8_url_filter": op8_url_filter,
    "op9_html_extract": op9_html_extract,
    "op10_jaccard": op10_jaccard,
}

