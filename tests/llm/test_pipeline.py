"""The corpus pipeline and the registered operator queries on the smallest tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm.registry import QUERIES

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, [docs.count()]
    for k, (name, run) in enumerate(corpus_pipeline.STAGES):
        run(spark, docs, DIR).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        seen.append(docs.count())
        assert k == 4 or docs.columns == columns
    assert seen[1] >= 0.95 * seen[0] and 0 < seen[2] < seen[1] and 0 < seen[3] <= seen[2] and seen[5] == seen[4] >= seen[3]


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, run in corpus_pipeline.STAGES:
        docs = run(spark, docs, DIR)
        assert docs.count() == 0


def test_columns_of_any_name_pass_through(spark, tmp_path):
    """Nulls, an empty text, a long one, repeated rows and ids, and columns named like those that operators make."""
    names = ["n", "score", "kept", "a.b", "ticket", "row", "parts", "size", "h", "guess", "rate", "expected_grade", "p_best", "lang_pred", "quality", "drop_id", "_size"]
    docs = spark.read.parquet(f"{DIR}/documents.parquet").where("doc_id < 60")
    words = docs.where("text is not null").select(F.array_join(F.collect_list("text"), " ")).first()[0]
    odd = [(1000, None, "en", "x", 0), (1001, "", "en", None, 0), (1002, " ".join([words] * 20), None, "x", 1), (None, words[:3000], "en", "x", 1), (None, None, None, None, None), (1, words[3000:6000], "de", "y", 1)]
    docs = docs.unionByName(docs.where("doc_id < 3")).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long"))
    docs = docs.withColumns({c: F.col("doc_id") * (7 + i) for i, c in enumerate(names)})
    columns = docs.columns
    for name, run in corpus_pipeline.STAGES[:-1]:
        run(spark, docs, DIR).write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        assert docs.columns == columns
        rows = docs.collect()
        assert rows and all(r[c] == (None if r["doc_id"] is None else r["doc_id"] * (7 + i)) for r in rows for i, c in enumerate(names))
        found = {r["doc_id"] for r in rows}
        assert 1000 not in found and 1001 not in found  # no words, no language
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count()
