import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from lattiq.llm import languages

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pieces():
    return languages.Pieces(PATH)


def segmentations(pieces, word):
    """All ways to cut the marked word into pieces, an unknown character being a piece of its own."""
    word = languages.MARK + word
    for cuts in product((False, True), repeat=len(word) - 1):
        ends = [k + 1 for k, cut in enumerate(cuts) if cut] + [len(word)]
        parts = [word[a:b] for a, b in zip([0, *ends], ends)]
        ids = [pieces.at.get(p, 0 if len(p) == 1 else None) for p in parts]
        if None not in ids:
            yield ids


WORDS = ["a", "the", "house", "été", "straße", "日本", "xq", "Ωλ"]


def test_forward_sums_all_segmentations(pieces):
    p = np.random.default_rng(7).dirichlet(np.ones(pieces.count), 3).T
    got = languages.Lattices(pieces, WORDS).totals(p)
    for word, row in zip(WORDS, got, strict=True):
        want = sum(np.prod(p[ids], 0) for ids in segmentations(pieces, word))
        np.testing.assert_allclose(row, want, rtol=1e-12)
        np.testing.assert_allclose(languages.log_total(pieces, word, p), np.log(want), rtol=1e-12)


def test_expected_counts_over_all_segmentations(pieces):
    p = np.random.default_rng(8).dirichlet(np.ones(pieces.count))
    n = np.arange(1.0, len(WORDS) + 1)
    want = np.zeros(pieces.count)
    for word, times in zip(WORDS, n, strict=True):
        ways = [(np.prod(p[ids]), ids) for ids in segmentations(pieces, word)]
        for weight, ids in ways:
            np.add.at(want, ids, times * weight / sum(w for w, _ in ways))
    np.testing.assert_allclose(languages.Lattices(pieces, WORDS).expected(p, n), want, rtol=1e-9, atol=1e-12)


def test_fitting_raises_the_likelihood(pieces, monkeypatch):
    words, found = Counter({"house": 5, "houses": 2, "mouse": 3, "the": 9}), []
    for rounds in (1, 2, 4):
        monkeypatch.setattr(languages, "ROUNDS", rounds)
        p = languages.fitted(pieces, words)
        assert math.isclose(p.sum(), 1)
        found.append(sum(n * np.log(languages.Lattices(pieces, [w]).totals(p[:, None])[0, 0]) for w, n in words.items()))
    assert found == sorted(found)


def test_words_of_any_length(pieces):
    p = np.random.default_rng(9).dirichlet(np.ones(pieces.count), 2).T
    short = languages.log_total(pieces, "ab" * 40, p)
    assert np.isfinite(languages.log_total(pieces, "ab" * 20_000, p)).all() and (short < 0).all()


def folds(rows):
    return [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 3 == 1 for r in rows]


def test_identify_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = {r.doc_id: r for r in languages.identify(docs, PATH, sample=60).collect()}
    given = docs.select("doc_id", "lang", "source").collect()
    assert len(rows) == len(given)
    assert [rows[r.doc_id].held_out for r in given] == folds([(r.doc_id,) for r in given])
    held = [r for r in given if rows[r.doc_id].held_out]
    right = [rows[r.doc_id].lang_pred == r.lang for r in held]
    assert len(held) > 250 and sum(right) > 0.97 * len(right)
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_labels_of_the_held_out_fold_and_other_columns_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").drop("n_chars")
    from pyspark.sql import functions as F

    other = docs.withColumn("lang", F.when(languages.fold() == 1, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s")).withColumn("h", F.lit("x")).withColumn("n", F.lit(3))
    assert sorted(languages.identify(docs, PATH).collect()) == sorted(languages.identify(other.repartition(3), PATH).collect())


def test_edges(spark):
    teach = [(0, "the house and the garden", "en"), (1, "das Haus und der Garten", "de"), (10, "der Garten und das Haus", "de")]
    assert not any(folds(teach))
    docs = [*teach, (7, None, "en"), (8, "", "de"), (9, "12 -- ²³ !", "en"), (None, "the garden", None), (11, "the the house", None), (11, "the the house", None), (12, "HAUS " + "x" * 50_000, None)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumnRenamed("x", "y")
    got = sorted(((r.doc_id, r.lang_pred, r.score) for r in languages.identify(rows, PATH).collect()), key=lambda r: (r[0] is None, r))
    by = {r[0]: r for r in got}
    assert len(got) == len(docs) and by[7] == (7, "und", 0.0) and by[8][1:] == by[9][1:] == ("und", 0.0)
    assert by[None][1] == "en" and by[11][1] == "en" and by[0][1] == "en" and by[10][1] == "de" and 0.5 < by[11][2] <= 1
    nothing = languages.identify(rows.where("doc_id = 11"), PATH).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)] * 2
    assert languages.identify(rows.limit(0), PATH).count() == 0
