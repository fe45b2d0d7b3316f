import re
import zlib
from collections import Counter

import pytest

from lattiq.llm import spellings


def brute(docs):
    """The contract, word by word: every word against all its possible edits."""
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    letters = {c for w in n for c in w}
    form, near = {}, {}
    for w in n:
        cuts = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        edits = {a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in letters} | {a + c + b for a, b in cuts for c in letters}
        near[w] = sorted(edits & n.keys() - {w}, key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(spark, docs, bucket=spellings.BUCKET):
    rows = spellings.variants(spark.createDataFrame(docs, "doc_id long, text string"), bucket).collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


DOCS = [
    (1, "Colour colour colour COLOUR colour colour colour color color color colors colors colors"),
    (2, None),
    (3, ""),
    (None, "colour colonr colonr colonr naïveté naïveté naïveté naiveté naiveté naiveté É"),
    (4, "aaaaa aaaaa aaaaa aaaab aaaab aaaab aaaaab aaaaab aaaaab aaaaaa aaaaaa aaaaaa baaaa baaaa baaaa abcde ecbda " * 2),
    (5, "x" * 7_000 + " " + ("x" * 7_000 + " ") * 2 + ("x" * 6_999 + " ") * 6),
    (4, "niche nich nichen×÷ nichen×÷ nichen×÷ ÀÉÎÕÜ ÀÉÎÕÜ ÀÉÎÕÜ àÉÎÕÜ àÉÎÕÜ àÉÎÕÜ"),
]


@pytest.mark.parametrize("bucket", [spellings.BUCKET, 1])
def test_edges(spark, bucket):
    got = found(spark, DOCS, bucket)
    want = brute([d for d in DOCS if d[0] != 5])
    assert {w: r for w, r in got.items() if "xxxx" not in w} == want
    assert got["x" * 7_000][:3] == ("x" * 6_999, "x" * 6_999, 3)
    assert want["color"][0] == "colour" and want["naiveté"][3] == 1


@pytest.mark.parametrize("bucket", [spellings.BUCKET, 3])
def test_small_table(spark, bucket):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    assert found(spark, docs, bucket) == want
    assert sum(r[0] is not None for r in want.values()) > 50


def test_empty_and_extra_columns(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spellings.variants(docs).count() == 0
    rows = spark.createDataFrame([(1, "words words words", "z", 3)], "doc_id long, text string, word string, n int")
    assert [tuple(r) for r in spellings.variants(rows).collect()] == [("words", None, "words", 3, 0, None)]


def test_roots_follow_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r.root for r in spellings.roots(forms).collect()} == {"w37"}
