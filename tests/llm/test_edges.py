"""Empty tables, very long texts, null ids and columns with clashing names, for each operator in turn."""

import hashlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lattiq.llm import bpe, near_dedup, quality, secrets, substring_dedup, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.digest_documents(none, WORDS).count() == 0
    assert toxicity.judge(none, labels).count() == 0
    assert secrets.scan(none).count() == 0
    assert substring_dedup.repeated_passages(none).count() == 0


def test_labels_without_documents_and_documents_without_labels(spark):
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(100, "a b"), (None, "c"), (100, None)], DOCS)
    rows = sorted(map(tuple, toxicity.judge(docs, labels).collect()), key=str)
    assert [r[0] for r in rows] == [100, 100, None] and {r[2] for r in rows} == {0.0}


def test_very_long_texts(spark):
    long = "lorem ipsum dolor sit amet " * 40_000
    docs = spark.createDataFrame([(1, long), (2, long + "password = hunter2hunter2"), (3, long[:-1000])], DOCS)
    ids = {r.doc_id: r for r in bpe.digest_documents(docs, WORDS).collect()}
    lib = Tokenizer.from_file(WORDS)
    lib.no_truncation()
    assert ids[1].n_tokens == len(lib.encode(long, add_special_tokens=False).ids)
    found = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert (found[1].n_assign, found[2].n_assign) == (0, 1)
    assert found[2].base_sha256 == hashlib.sha256(f"assign:{len(long)}:{len(long) + 25}".encode()).hexdigest()
    near = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert near == {1: 1, 2: 2, 3: 1}  # the words that 2 adds are three of its eight shingles


def test_clashing_columns(spark):
    line = " ".join(f"word{k}" for k in range(60))
    rows = [(k, f"intro {k}\n{line}\nend {k}", "x", 7, None) for k in (1, 2)]
    docs = spark.createDataFrame(rows, DOCS + ", node string, start int, paragraph string")
    got = {(r.doc_id, r.first_doc_id, r.removed) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(1, 1, False), (2, 1, True)}
    assert {(r.doc_id, r.n_assign) for r in secrets.scan(docs.withColumnRenamed("node", "spans")).collect()} == {(1, 0), (2, 0)}
    assert {r.doc_id for r in bpe.digest_documents(docs.withColumnRenamed("start", "ids"), WORDS).collect()} == {1, 2}


def test_no_python_on_the_judging_plan(spark):
    """The verdicts of quality, thresholds included, stay in the JVM."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    plan = quality.judge(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
