import os

import public_tokenizers
import pytest

import corpus_pipeline
from lattiq.llm import bpe, near_dedup, secrets, toxicity
from tests.llm.test_duplicates import brute
from tests.llm.test_models import labelled
from tests.llm.test_rules import brute_hits

ITEM = "bench item one two three four five six seven eight nine ten eleven"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t) for i, t, _ in labelled(400, 5)]
    long = [t for _, t in rows if len(t.split()) > 60]
    rows += [(1000, long[0]), (1001, long[1] + " extra"), (1002, f"key password=abcdef99 {long[2][::-1]}"), (1003, None), (1004, ""), (1004, ""), (1005, ITEM)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, y in labelled(400, 5)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontaminate", "secrets", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_against_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, tables).collect())
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    words = toxicity.Words()
    clean = sorted((i, t) for i, t in rows if model.scores(words.batch([t or ""]))[0] < 0.5)
    comp = brute(clean)
    one = {i: t for i, t in clean if comp[i] == i}
    kept = {}
    for i, t in one.items():
        n, h, _ = brute_hits(t, [(1, ITEM)])
        if not (h and 20 * h >= n):
            kept[i] = t
    marks = secrets.train(spark.createDataFrame([(i, t) for i, t in kept.items()], "doc_id long, text string"))
    codec = bpe.word_bpe(public_tokenizers.path("word_bpe_49k.json"))
    want = [(i, len(codec.encode(secrets.redacted(marks, t or "")))) for i, t in sorted(kept.items())]
    assert [(i, n) for i, n, _ in got] == want
    assert 1005 not in kept and 1000 not in kept


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").withColumnRenamed("source", "kept")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == docs.columns, name
        assert out.dtypes == docs.dtypes, name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, tables).count() == 0, name


def test_hidden_secret(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").where("doc_id = 1002")
    row = corpus_pipeline.hide_secrets(spark, docs, tables).first()
    assert "password" not in row.text
    assert row.n_chars == len(row.text)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_registered_queries(spark):
    from lattiq.llm import queries

    assert {n.split("_")[0] for n in queries.queries()} == {f"op{i}" for i in range(1, 11)}
    d = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{d}/documents.parquet").count()
    for name in ("op1_bpe_codec", "op5_quality_rules", "op8_secret_scan", "op9_token_counts"):
        assert queries.queries()[name](spark, d).count() == n


def test_near_duplicates_agree_with_stage(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = corpus_pipeline.drop_near_copies(spark, docs, tables)
    kept = near_dedup.near_duplicates(docs).where("kept").select("doc_id").distinct().count()
    assert out.count() == kept == out.select("doc_id").distinct().count()


def test_no_text_goes_for_its_id(spark):
    say = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(1, say("a")), (1, say("b")), (2, say("c")), (2, say("a") + " more"), (None, say("d")), (None, say("d")), (None, say("e")), (None, say("c")), (3, ""), (3, ""), (4, None), (4, None), (4, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id int, text string, th string")
    got = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert got.dtypes == docs.dtypes
    want = [(1, say("a")), (1, say("b")), (2, say("c")), (None, say("d")), (None, say("e")), (3, ""), (4, "")]
    key = lambda r: (r[0] or 0, r[1])
    assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=key) == sorted(want, key=key)
