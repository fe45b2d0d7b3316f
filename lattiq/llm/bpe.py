"""Operator 1: BPE encoding and decoding with a segment tree over pair ranks.

Leaves hold the rank of the pair that starts at a symbol, the root the lowest
rank and, of equal ones, the leftmost; a merge updates three leaves in
logarithmic time, until the root holds no mergeable pair.

Null and empty texts have no tokens; repeated rows each get their row; a text
of any length is encoded whole; of equal ranks the leftmost is merged first. An
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import copy
import hashlib
import json
import struct
import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import DataFrame

from lattiq.llm.common import Memo, map_texts

#: White space as Unicode's White_Space property has it (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: The pre-tokeniser's pattern of the word vocabulary (fixed value).
WORD_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"
#: str.split() also splits at these, which are not White_Space.
NOT_SPACE = "\x1c\x1d\x1e\x1f"
NONE = 1 << 62


@lru_cache(1)
def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next one from U+0100."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def merge(symbols: list, ranks: dict) -> list:
    """Symbols after all merges. ranks: (a, b) -> (rank, merged symbol)."""
    n = len(symbols)
    if n < 2:
        return symbols
    get = ranks.get
    width = 1 << (n - 2).bit_length()
    tree, joined = [NONE] * (2 * width), [None] * n
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found is not None:
            tree[width + i] = found[0] << 32 | i
            joined[i] = found[1]
    for at in range(width - 1, 0, -1):
        left, right = tree[2 * at], tree[2 * at + 1]
        tree[at] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (top := tree[1]) < NONE:
        i = top & 0xFFFFFFFF
        gone = after[i]
        symbols[i] = joined[i]
        after[i] = nxt = after[gone]
        if nxt < n:
            before[nxt] = i
        symbols[gone] = None
        # the pair that was merged, the one that began at the right symbol, the one that ends at the left
        for k in (i, gone, before[i]):
            if k < 0 or (k == gone and k == n - 1):
                continue
            value = NONE
            if k != gone and (j := after[k]) < n:
                found = get((symbols[k], symbols[j]))
                if found is not None:
                    value = found[0] << 32 | k
                    joined[k] = found[1]
            at = width + k
            if tree[at] == value:
                continue
            tree[at] = value
            at >>= 1
            while at:
                left, right = tree[2 * at], tree[2 * at + 1]
                value = left if left < right else right
                if tree[at] == value:
                    break
                tree[at] = value
                at >>= 1
    return [s for s in symbols if s is not None]


class WordBpe:
    """The lower-casing BPE vocabulary with word ends, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        model = conf["model"]
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): (i, a + b) for i, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in conf["added_tokens"]}
        self.names = {i: s for s, i in (*self.vocab.items(), *self.special.items())}
        self.letters = byte_letters()
        self.pieces = regex.compile(WORD_PATTERN).findall
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.of_piece = Memo(self._piece, 120_000)
        self.of_chunk = Memo(self._chunk)

    def fresh(self) -> WordBpe:
        """The same vocabulary and pieces with a memo of chunks of its own, which ends with the task that asks."""
        other = copy.copy(self)
        other.of_chunk = Memo(other._chunk)
        return other

    def _piece(self, piece: str) -> tuple[int, ...]:
        symbols = [self.letters[b] for b in piece.encode()]
        symbols[-1] += self.end
        return tuple(self.vocab[s] for s in merge(symbols, self.ranks) if s in self.vocab)

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        ids = [i for p in self.pieces(chunk) for i in self.of_piece[p]]
        return struct.pack(f"<{len(ids)}I", *ids), self.decode(ids)

    def normalise(self, text: str) -> str:
        # lower case letter by letter: a final sigma is like any other
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str) -> list[str]:
        text = self.normalise(text)
        if any(c in text for c in NOT_SPACE):
            return [c for c in self.spaces.split(text) if c]
        return text.split()

    def packed(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian unsigned 32-bit integers, and the text decoded from them."""
        get = self.of_chunk.__getitem__
        if self.at_special is None or "<|" not in text:
            found = list(map(get, self.chunks(text)))
        else:
            found = []
            for part in self.at_special.split(text):
                if part in self.special:
                    found.append((struct.pack("<I", self.special[part]), part))
                else:
                    found += map(get, self.chunks(part))
        return b"".join([f[0] for f in found]), " ".join([f[1] for f in found if f[0]])

    def encode(self, text: str) -> list[int]:
        raw = self.packed(text)[0]
        return list(struct.unpack(f"<{len(raw) // 4}I", raw))

    def decode(self, ids: list[int]) -> str:
        """As the library's decode without a decoder: tokens joined by a space; unknown ids are skipped.
        So a text's decoding is that of its parts, joined by a space."""
        return " ".join(self.names[i] for i in ids if i in self.names)


@lru_cache(2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) and decoded text of each document."""

    def make():
        bpe = word_bpe(path).fresh()

        def call(keys, texts):
            packed = [bpe.packed(t) for t in texts]
            return {"doc_id": keys, "ids": [list(struct.unpack(f"<{len(p) // 4}i", p)) for p, _ in packed], "decoded": [d for _, d in packed]}

        return call

    return map_texts(docs, make, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document, from the same encoder."""

    def make():
        bpe = word_bpe(path).fresh()

        def call(keys, texts):
            packed = [bpe.packed(t) for t in texts]
            return {"doc_id": keys, "n_tokens": [len(p) // 4 for p, _ in packed], "ids_sha256": [hashlib.sha256(p).hexdigest() for p, _ in packed], "decoded_sha256": [hashlib.sha256(d.encode()).hexdigest() for _, d in packed]}

        return call

    return map_texts(docs, make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
