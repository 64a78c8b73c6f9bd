"""A training corpus from raw documents: language, quality, near copies, source mix, tokens.

Each stage works on all that its predecessor kept and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, jaccard, langid, mixing, ordinal
from larkspur.llm.names import col, fresh
from larkspur.llm.registry import table, vocabulary_path
from larkspur.llm.storage import stage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7. Texts without a language go; the others carry the predicted one.

    Null texts and texts without a letter have none. Repeated rows stay as they are, columns of any name pass through.
    """
    machine = langid.learn(docs.where(~langid.held_out("doc_id", 3, 1)).select("doc_id", "text", "lang"))
    lang, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = langid.identify(docs, machine, lang, score).where(F.col(lang) != "und")
    return found.select([F.col(lang).alias("lang") if c == "lang" else col(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4. Documents that are unlikely to have the best grade go, and those without words.

    Repeated rows stay as they are, columns of any name pass through; without any label all documents with words stay.
    """
    model = ordinal.learn(docs.select("doc_id", "text"), ordinal.grades_of_labels(table(spark, sf_dir, "labels")))
    names = tuple(fresh(x, docs.columns) for x in ("expected_grade", "p_best", "kept"))
    return ordinal.score(docs, model, names=names).where(F.col(names[2])).select(*map(col, docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10, with five words and a similarity of 0.8. One document of each group stays, that of the smallest id.

    Rows without an id stay; of rows that repeat an id and its text one does.
    """
    return jaccard.deduplicate(docs, width=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1. A document appears once for each epoch that takes words of it, with those words.

    Documents without words go; a null source is a source of its own; columns of any name pass through.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6. Number of token ids and digests of ids and decoded text of each row; null texts count as empty."""
    return bpe.digests(docs, vocabulary_path())


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("mixture", mixture), ("tokens", tokens)]

#: SQL can express neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over all documents; empty tables give an empty one."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
