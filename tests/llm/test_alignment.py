import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattiq.llm import alignment
from lattiq.llm.bpe import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", "x", "two words", "  a  b\n\n c ", "a\n \nfoo <|endoftext|> </s> <unk> bar", "don't we'll ' '' 're", "é 日本語 🙂🙂 ½ﬁ", "a ▁ b", "▁", "x\x1c y\x00 z", "aaaa" * 3000, "\n\n\n", " ", "   ", "İstanbul ΑΣ ſK x 　 y", "ab" * 50 + " " + "‍" * 40]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    byte = {c: k for k, c in enumerate(byte_letters())}
    names = {i: n for n, i in a.get_vocab().items()}

    def brute(text):
        """Groups by the libraries' tokens of the whole text and sets of byte offsets."""
        if not text:
            return []
        of_a, of_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        bytes_a = [bytes(byte[c] for c in names[i]) for i in of_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in of_b]
        if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
            return []
        ends_a, ends_b = (list(accumulate(map(len, x))) for x in (bytes_a, bytes_b))
        out, before = [], 0
        for end in sorted({*ends_a} & {*ends_b}):
            out.append(([i for i, e in zip(of_a, ends_a) if before < e <= end], [i for i, e in zip(of_b, ends_b) if before < e <= end]))
            before = end
        return out

    return brute


@pytest.fixture(scope="module")
def aligner():
    return alignment.Aligner(A, B)


@pytest.mark.parametrize("text", TEXTS)
def test_groups(libraries, aligner, text):
    assert aligner.groups(text) == libraries(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab 'tre\n\t12.!é日<|>▁　\x1cſ🙂 ", max_size=50))
def test_groups_of_any_text(libraries, aligner, text):
    assert aligner.groups(text) == libraries(text)


def test_labels_and_spans():
    labels = alignment.labelled(6, np.array([2, 3, 6]), np.array([3, 4, 6]))
    assert labels == b".axb.x"
    assert alignment.spans(labels).tolist() == [[3, 2, 1], [3, 1, 2]]


def test_pairs_of_large_groups(aligner, monkeypatch):
    chunks = aligner.chunks("naïveté ½ﬁ 日本語 " * 3)
    whole = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "MANY", 1)
    aligner.kept.clear()
    aligner.learn(set(chunks))
    monkeypatch.undo()
    whole.learn(set(chunks))
    for x, y in zip(aligner.document(chunks), whole.document(chunks), strict=True):
        assert np.array_equal(x, y)
    aligner.kept.clear()


def test_packed_round_trip():
    for n in (1, 300):
        pairs = np.array([0, 5, 1 << 31, (1 << 32) - 1])
        got = alignment.unpacked(alignment.packed(pairs, np.array([1, n, 2, 9])))
        assert got[0].tolist() == pairs.tolist() and got[1].tolist() == [1, n, 2, 9]


def brute_rows(brute, docs):
    groups = [brute(t) for _, t in docs]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    count = Counter(p for one in links for p in one)
    top = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    for (key, _), g, one in zip(docs, groups, links):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g).encode()).hexdigest() if g else ""
        yield key, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), sum(one.values()), sum(n for p, n in one.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in one.items()), digest


@pytest.mark.parametrize("slice_pairs", [alignment.SLICE, 300])
def test_align(spark, libraries, slice_pairs):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "two words"), (3, None), (1, "x"), (1, "x")]
    docs += [(r.doc_id, r.text[:600]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows = spark.createDataFrame([(*d, "n_a", 7) for d in docs], "doc_id long, text string, row string, pairs int").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(rows, A, B, slice_pairs).collect()), key=str)
    assert got == sorted(brute_rows(libraries, docs), key=str)


def test_align_nothing(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0
    rows = alignment.align(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), A, B).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
