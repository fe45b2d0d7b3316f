import hashlib
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lattiq.llm import bpe, token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "ab 'tre\n\t12.!é日<|>Σ　\x1cſK🙂"
TEXTS = ["", "  a  b\n\n c", "a\n \nfoo <|endoftext|> bar<|startoftext|>x", "ΑΣ Σίσυφος İstanbul ſK", "don't we'll ' '' 're", "x\x1cy\x1fz", "aaaaaaaaaaaaa" * 500, "\n\n\n", "a \n", " lead", "trail ", "<|endoftext|>", "é 日本語 🙂🙂"]


@pytest.fixture(scope="module")
def words():
    return bpe.word_bpe(WORDS), Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counts():
    return token_counts.byte_bpe(BYTES), Tokenizer.from_file(BYTES)


def same(words, text):
    own, lib = words
    want = lib.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.packed(text)[1] == own.decode(want) == lib.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", TEXTS)
def test_encode_and_decode(words, text):
    same(words, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=60))
def test_encode_any(words, text):
    same(words, text)


def test_merge_is_leftmost_lowest():
    ranks = {("a", "b"): (0, "ab"), ("b", "a"): (1, "ba"), ("ab", "ab"): (2, "abab")}
    assert bpe.merge(list("abab"), ranks) == ["abab"]
    assert bpe.merge(list("aaa"), {("a", "a"): (0, "aa")}) == ["aa", "a"]


@pytest.mark.parametrize("text", TEXTS)
def test_counts(counts, text):
    own, lib = counts
    assert own.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=ALPHABET, max_size=40))
def test_every_prefix(counts, text):
    own, lib = counts
    table = own.table(text)
    assert [table.count(i) for i in range(len(text) + 1)] == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    fits(own, text, table)


def fits(own, text, table):
    """Brute force of every budget: the longest prefix within it."""
    for budget in range(own.count(text) + 1):
        want = max(i for i in range(len(text) + 1) if table.count(i) <= budget)
        assert table.longest(budget) == own.fit(text, budget) == want


MORE = ["you're we've they'll don't 're 've", "x-- --  -- y", "a!!<|endoftext|>'re", "word <|endoftext|><|endoftext|> more  ", "a\u2003 \u2003b - -- c", "unbelievablyinterestingly" * 4, "a b\n c\n\n d e\tf g " * 6, "one two" + " " * 15 + "\n three four" + " " * 16 + "five", " " * 40 + "x" + "\n" * 30]


@pytest.mark.parametrize("text", [*(t[:200] for t in TEXTS), *MORE])
def test_every_prefix_of_odd_texts(counts, text):
    own, lib = counts
    table = own.table(text)
    assert [table.count(i) for i in range(len(text) + 1)] == [len(lib.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
    fits(own, text, table)


def test_budget_ends_inside_one_long_piece(counts):
    own, _ = counts
    text = "abcdefghij" * 2000
    n = own.fit(text, 100)
    assert 100 <= n < len(text) and own.count(text[:n]) == 100


def test_clashing_columns_and_long_texts(spark):
    rows = [(1, "word " * 200_000, 1, "a"), (2, "", 2, "b"), (2, "", 2, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, fit_chars string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, BYTES).collect()}
    assert got[1].n_tokens == len(Tokenizer.from_file(BYTES).encode("word " * 200_000, add_special_tokens=False).ids)
    assert (got[2].n_tokens, got[2].fit_chars) == (0, 0)


def test_digests(spark, words):
    rows = [(1, "Hello  World", 5), (2, None, 5), (2, None, 5), (None, "x", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = bpe.digest_documents(docs, WORDS).collect()
    ids = words[1].encode("Hello  World", add_special_tokens=False).ids
    first = next(r for r in got if r.doc_id == 1)
    assert (first.n_tokens, first.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
    assert len(got) == 4
    assert all(r.n_tokens == 0 and r.ids_sha256 == hashlib.sha256(b"").hexdigest() for r in got if r.doc_id == 2)
    ids = bpe.encode_documents(docs, WORDS).where("doc_id = 1").first()
    assert ids.decoded == words[0].decode(ids.ids)


def test_limits(spark):
    docs = spark.createDataFrame([(1, "a b " * 600), (2, None), (3, "x")], "doc_id long, text string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, BYTES).collect()}
    assert got[1].over_limit and not got[2].over_limit
    assert (got[2].n_tokens, got[2].n_bytes) == (0, 0)
    assert token_counts.byte_bpe(BYTES).count(("a b " * 600)[: got[1].fit_chars]) <= 1024
    assert token_counts.count_tokens(docs.limit(0), BYTES).count() == 0
