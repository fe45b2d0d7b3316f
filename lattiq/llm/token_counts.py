"""Operator 9: exact token counts by dynamic programming over prefixes.

For each prefix of a piece the program stores the last token of its one valid
encoding and its token count: of the tokens that end there, the one whose
neighbour on the left is left apart by the merges. A piece's counts are kept for
all its prefixes; the text's table puts them one after the other, so the count of
any prefix of a text is read off, and the longest prefix within a budget is the
last whose count is within it, in the middle of a piece too.

Null and empty texts have zero tokens. A special token's string in a text is
one token, as the library has it by default. Repeated rows each get a row; an empty
table gives none; extra columns are left out. Texts of any length are counted whole;
of prefixes with equal counts the longest fits a budget.
"""

from __future__ import annotations

import copy
import json
from array import array
from collections.abc import Iterator
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import regex
from pyspark.sql import DataFrame

from lattiq.llm.bpe import SPACE, byte_letters
from lattiq.llm.common import Memo, map_texts

#: The pre-tokeniser's pattern of the byte vocabulary (fixed value).
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Pieces of which a shorter prefix is more than one piece (fixed values).
CONTRACTIONS = frozenset(("'re", "'ve", "'ll"))
SPACES = frozenset(regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
WHITE = "".join(SPACES)
#: Added to a count: this chunk's split depends on its neighbours.
ODD = 1 << 48


class ByteBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes(back[c] for c in s)
        self.vocab = {raw(s): i for s, i in conf["model"]["vocab"].items()}
        self.longest = max(map(len, self.vocab))
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(conf["model"]["merges"]):
            a, b = (self.vocab[raw(x)] for x in (m if isinstance(m, list) else m.split(" ")))
            self.rank[a, b] = r
            self.parts.setdefault(self.vocab[raw("".join(m if isinstance(m, list) else m.split(" ")))], (a, b, r))
        self.special = sorted((t["content"] for t in conf["added_tokens"]), key=len, reverse=True)
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.pattern = regex.compile(BYTE_PATTERN)
        # what at the end of a text may make one piece with what follows: a run of one kind, and the spaces before it
        self.tail = regex.compile(rf"(?r)(?:[{SPACE}]*(?:\p{{L}}*|\p{{N}}*|[^{SPACE}\p{{L}}\p{{N}}]*))?\Z")
        self.of_piece = Memo(self._piece, 120_000)
        self.of_chunk = Memo(self._chunk)
        self.apart = Memo(self._apart, 150_000)
        self.edge = {side: Memo(lambda t, side=side: self._edge(t, side), 1 << 16) for side in (0, 1)}

    def fresh(self) -> ByteBpe:
        """The same vocabulary and pieces with a memo of chunks of its own, which ends with the task that asks."""
        other = copy.copy(self)
        other.of_chunk = Memo(other._chunk)
        return other

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens at one side of a token while it is built up, with the rank at which each is used up."""
        found, used = [], ODD
        while True:
            found.append((token, used))
            if token not in self.parts:
                return found
            a, b, used = self.parts[token]
            token = (a, b)[side]

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Whether no merge joins the last symbols of one token with the first of the next.

        A pair on the border merges if its rank comes before both of its
        symbols are used up; of equal ranks the one further left is first.
        """
        rank = self.rank.get
        for x, gone_x in self.edge[1][pair[0]]:
            for y, gone_y in self.edge[0][pair[1]]:
                r = rank((x, y))
                if r is not None and r < gone_x and r <= gone_y:
                    return False
        return True

    def prefixes(self, piece: bytes) -> list[int]:
        """Token counts of all prefixes of a piece, the empty one first."""
        n, vocab, apart = len(piece), self.vocab, self.apart
        counts, last = [0] * (n + 1), [-1] * (n + 1)
        for i in range(1, n + 1):
            # one token at most fits, so the order is free; short ones are the usual
            for j in range(i - 1, max(0, i - self.longest) - 1, -1):
                token = vocab.get(piece[j:i])
                if token is not None and (j == 0 or (last[j] >= 0 and apart[last[j], token])):
                    counts[i], last[i] = counts[j] + 1, token
                    break
        return counts

    def _piece(self, piece: str) -> bytes | array:
        """Token counts of the prefixes of a piece by characters, the whole last."""
        counts = self.prefixes(piece.encode())
        if piece.isascii():
            found = counts[1:]
        else:
            ends, at = [], 0
            for c in piece:
                at += len(c.encode())
                ends.append(at)
            found = [counts[e] for e in ends]
        if piece in CONTRACTIONS:  # cut short, it is an apostrophe and a letter
            found = [1, *(1 + n for n in self.prefixes(piece[1:-1].encode())[1:]), found[-1]]
        return bytes(found) if max(found) < 256 else array("L", found)

    def _chunk(self, chunk: str) -> int:
        """Count of a space and ``chunk``, a run without spaces."""
        if not chunk or self.pattern.match(chunk).group().isspace():
            return ODD
        get = self.of_piece.__getitem__
        return sum([get(p)[-1] for p in self.pattern.findall(" " + chunk)])

    def _part(self, text: str) -> int:
        if not text:
            return 0
        first, *rest = text.split(" ")
        total = sum(map(self.of_chunk.__getitem__, rest))
        get = self.of_piece.__getitem__
        if total >= ODD:  # runs of spaces: split the whole text
            return sum([get(p)[-1] for p in self.pattern.findall(text)])
        return total + sum([get(p)[-1] for p in self.pattern.findall(first)])

    def count(self, text: str) -> int:
        if self.at_special is None or "<|" not in text:
            return self._part(text)
        return sum(1 if p in self.special else self._part(p) for p in self.at_special.split(text))

    def fit(self, text: str, budget: int) -> int:
        """Characters of the longest prefix within ``budget`` tokens.

        Every chunk has a token at least, so the first ``budget`` chunks hold the place. Sums of
        their counts find the chunk in which the budget is spent, and the prefix table of that
        one and its neighbours, whose spaces may join its own, the character."""
        budget = max(0, budget)
        chunks = text.split(" ", budget + 4)
        counts = [self._part(chunks[0]), *map(self.of_chunk.__getitem__, chunks[1 : budget + 4])]
        if sum(counts) >= ODD or (self.at_special and "<|" in text):
            return PrefixTable(self, text, budget).longest(budget)
        sums = list(accumulate(counts))
        at = max(0, bisect_right(sums, budget) - 1)
        start = sum(map(len, chunks[:at])) + max(0, at - 1)
        near = " ".join(["", *chunks[at : at + 3]] if at else chunks[:3])
        return start + PrefixTable(self, near).longest(budget - (sums[at - 1] if at else 0))

    def table(self, text: str) -> PrefixTable:
        return PrefixTable(self, text)


class PrefixTable:
    """The token count of every prefix of one text, by characters; with a budget, of the
    prefixes up to the end of the piece in which it is spent."""

    def __init__(self, bpe: ByteBpe, text: str, budget: int | None = None):
        total, made = 0, [np.zeros(1, np.int64)]
        before = ""  # what stands before a special token, back to a place where pieces are sure to end
        parts = bpe.at_special.split(text) if bpe.at_special and "<|" in text else [text]
        for part in parts:
            if part in bpe.special:
                # cut short it is plain text, which may join what stands before it
                cut = [bpe._part(before + part[:k]) for k in range(1, len(part))]
                made.append(np.array([*(total - bpe._part(before) + n for n in cut), total + 1], np.int64))
                total, before = total + 1, ""
            elif part:
                for counts, whole, joined in self.pieces(bpe, part):
                    if budget is not None and total > budget and not joined:
                        break
                    made.append(counts + total)
                    total += whole
                if len(parts) > 1:
                    tail = bpe.tail.search(part)
                    before = (before if tail.start() == 0 else "") + tail.group()
            if budget is not None and total - bpe._part(before) > budget:
                break
        self.counts = np.concatenate(made)

    @staticmethod
    def pieces(bpe: ByteBpe, part: str) -> Iterator[tuple[np.ndarray, int, bool]]:
        """Counts of the prefixes of each piece, the whole's, and whether it joins the piece before. A run of white space that a cut
        leaves at the end is one piece, though with more text its last space goes to the next word."""
        run = 0  # white space pieces' characters before the piece, of the same run
        for m in bpe.pattern.finditer(part):
            piece = m.group()
            own = bpe.of_piece[piece]
            counts = np.frombuffer(own, np.uint8).astype(np.int64) if isinstance(own, bytes) else np.array(own, np.int64)
            if joined := run > 0 and piece[0] in SPACES:
                # as one run with what stands before it, whose own count is in the total already
                lead = len(piece) - len(piece.lstrip(WHITE))
                whole = bpe.of_piece[part[m.start() - run : m.start() + lead]]
                head = bpe.of_piece[part[m.start() - run : m.start()]][-1]
                counts[:lead] = [n - head for n in list(whole)[run:]]
            run = (run if joined else 0) + len(piece) if piece.isspace() else 0
            yield counts, own[-1], joined

    def count(self, n: int) -> int:
        """Tokens of the first ``n`` characters as a text of its own."""
        return int(self.counts[max(0, min(n, len(self.counts) - 1))])

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix within ``budget`` tokens."""
        return int(np.flatnonzero(self.counts <= max(0, budget))[-1])


@lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), and fit_chars:
    the characters of the longest prefix within the limit."""

    def make():
        bpe = byte_bpe(path).fresh()

        def call(keys, texts):
            n = [bpe.count(t) for t in texts]
            fit = [len(t) if k <= limit else bpe.fit(t, limit) for t, k in zip(texts, n, strict=True)]
            return {"doc_id": keys, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": [k > limit for k in n], "fit_chars": fit}

        return call

    return map_texts(docs, make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
