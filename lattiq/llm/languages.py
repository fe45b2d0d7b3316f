"""Operator 12: language identification by unigrams summed over all segmentations.

The pieces are those of a fixed public vocabulary that can occur in lower-cased words,
and one more for any character that none of them covers. Each language has probabilities
of its own over them. A forward pass adds up the probabilities of all ways to cut a word
into pieces; a piece can begin with the mark of a word's start but hold none later, so a
text's probability is the product of its words'. Probabilities are learned by
expectation maximisation: backward passes give how often each piece is expected over all
segmentations. Bayes' rule over the languages gives the score.

Null texts and those without a letter are ``und`` with score 0, and so is each text if
nothing was learned. Rows without lang, and null or empty texts, teach nothing. Repeated
rows each get a row; an empty table gives none; extra columns are left out. Whole texts
of any length are scored, words of any length too. Of languages with equal scores the
first in code-point order is predicted. A null doc_id counts as an empty string when
folds are drawn.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor

from lattiq.llm.common import map_texts, release, written

WORD = regex.compile(r"\p{L}+")
#: B's white space mark (fixed value).
MARK = "▁"
UNKNOWN = "und"
#: Documents of each language that teach, chosen by hash, and characters of them that do.
SAMPLE, CHARACTERS = 1000, 2_000_000
#: Languages at most; a table of labels with more is refused.
LANGUAGES = 300
#: Rounds of expectation maximisation; share of all languages' pieces mixed into each; expected count added to each piece.
ROUNDS, SHARED, ADDED = 3, 0.02, 0.05
#: Words of up to so many characters are kept and passed through together.
LONGEST = 30
#: Bytes of probabilities kept.
KEPT_BYTES = 24 << 20


def fold() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3


class Pieces:
    """The vocabulary as a lookup of pieces by their text, 0 for an unknown character."""

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        names = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)))
        fit = sorted(n for n in names if (bare := n.removeprefix(MARK)) == bare.lower() and (n == MARK or WORD.fullmatch(bare)))
        self.at = {n: k for k, n in enumerate(fit, 1)}
        self.count = len(fit) + 1
        # every start of a piece, so a search from a place ends early
        self.starts = {n[:k] for n in fit for k in range(1, len(n) + 1)}

    def after(self, word: str, a: int) -> list[tuple[int, int]]:
        """(end, piece) of every piece of the marked ``word`` that begins at ``a``; a character that is none is a step of its own."""
        out = []
        for b in range(a + 1, len(word) + 1):
            part = word[a:b]
            if part not in self.starts:
                break
            if (k := self.at.get(part)) is not None:
                out.append((b, k))
        return out if out and out[0][0] == a + 1 else [(a + 1, 0), *out]


class Lattices:
    """The segmentations of many words, passed through together, place by place."""

    def __init__(self, pieces: Pieces, words: list[str]):
        marked = [MARK + w for w in words]
        steps = np.array([x for k, w in enumerate(marked) for a in range(len(w)) for b, p in pieces.after(w, a) for x in (b, k, a, p)], np.int32).reshape(-1, 4)
        self.to, self.word, self.start, self.piece = steps[np.lexsort((steps[:, 1], steps[:, 0]))].T
        self.size = np.array(list(map(len, marked)), np.int64)
        self.cuts = np.searchsorted(self.to, np.arange(1, self.size.max(initial=0) + 2))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[place, word, language]: the probability of all segmentations of the word up to the place."""
        alpha = np.zeros((len(self.cuts), len(self.size), p.shape[1]))
        alpha[0] = 1
        for j in range(1, len(self.cuts)):
            s = slice(self.cuts[j - 1], self.cuts[j])
            if s.start < s.stop:
                heads = np.flatnonzero(np.diff(self.word[s], prepend=-1))
                alpha[j, self.word[s][heads]] = np.add.reduceat(alpha[self.start[s], self.word[s]] * p[self.piece[s]], heads)
        return alpha

    def totals(self, p: np.ndarray) -> np.ndarray:
        return self.forward(p)[self.size, np.arange(len(self.size))]

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in the words, which occur ``counts`` times, under one language's ``p``."""
        p = p[:, None]
        alpha = self.forward(p)[:, :, 0]
        whole = alpha[self.size, np.arange(len(self.size))]
        beta = np.zeros_like(alpha)
        beta[self.size, np.arange(len(self.size))] = 1
        for j in range(len(self.cuts) - 1, 0, -1):
            s = slice(self.cuts[j - 1], self.cuts[j])
            np.add.at(beta, (self.start[s], self.word[s]), beta[j, self.word[s]] * p[self.piece[s], 0])
        weight = alpha[self.start, self.word] * p[self.piece, 0] * beta[self.to, self.word] / whole[self.word] * counts[self.word]
        return np.bincount(self.piece, weight, len(p))


def log_total(pieces: Pieces, word: str, p: np.ndarray) -> np.ndarray:
    """The log probability of a word of any length in each language; sums are scaled as they go."""
    word = MARK + word
    scale = np.zeros(p.shape[1])
    sums = {0: np.ones(p.shape[1])}  # at the places that steps have come to
    for a in range(len(word)):
        now = sums.pop(a)
        if now.min() < 1e-100:
            scale += np.log(now)
            sums = {k: v / now for k, v in sums.items()}
            now = np.ones_like(now)
        for b, k in pieces.after(word, a):
            sums[b] = sums.get(b, 0) + now * p[k]
    return np.log(sums[len(word)]) + scale


def fitted(pieces: Pieces, words: Counter[str]) -> np.ndarray:
    """One language's probability of each piece."""
    some = sorted(w for w in words if len(w) <= LONGEST)
    blocks = [some[k : k + 5000] for k in range(0, len(some), 5000)]
    lattices = [(Lattices(pieces, block), np.array([words[w] for w in block], float)) for block in blocks]
    p = np.full(pieces.count, 1 / pieces.count)
    for _ in range(ROUNDS):
        expected = ADDED + sum(x.expected(p, n) for x, n in lattices) if lattices else np.ones(pieces.count)
        p = expected / expected.sum()
    return p


class Model:
    """Piece probabilities and prior of each language, and the words seen so far."""

    def __init__(self, path: str, names: list[str], p: np.ndarray, prior: np.ndarray):
        self.pieces, self.names, self.p, self.prior = Pieces(path), names, p, np.log(prior)
        self.most = max(1000, KEPT_BYTES // (8 * len(names)))
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.known = np.empty((0, len(self.names)))

    def learn(self, words: set[str]) -> None:
        if len(self.at) + len(words) > self.most:
            self.forget()
        new = [w for w in words if w not in self.at and len(w) <= LONGEST]
        sums = [self.known]
        size = max(50, 16_000 // len(self.names))
        for k in range(0, len(new), size):
            block = new[k : k + size]
            sums.append(np.log(np.maximum(Lattices(self.pieces, block).totals(self.p), 1e-300)))
            self.at.update(zip(block, range(len(self.at), len(self.at) + len(block)), strict=True))
        self.known = np.concatenate(sums)

    def judge(self, texts: list[str]) -> tuple[list[str], list[float]]:
        found = [WORD.findall(t.lower()) for t in texts]
        self.learn({w for ws in found for w in ws})
        names, scores = [], []
        for words in found:
            if not words:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            at = [self.at.get(w, -1) for w in words]
            own = np.array([k for k in at if k >= 0], np.int64)
            total = self.prior + self.known[own].sum(0)
            for w, k in zip(words, at, strict=True):
                if k < 0:
                    total = total + log_total(self.pieces, w, self.p)
            share = np.exp(total - total.max())
            best = int(share.argmax())
            names.append(self.names[best])
            scores.append(float(share[best] / share.sum()))
        return names, scores


#: The model that this worker used last, beside what it was made of.
last: list = [None, None]


def model_of(path: str, parts: Broadcast) -> Model:
    """One for each worker and model; the words that it keeps have a bound and serve its later tasks."""
    if last[0] is not parts.value:
        last[:] = parts.value, Model(path, *parts.value)
    return last[1]


def sampled(docs: DataFrame, sample: int) -> DataFrame:
    """(lang, n, text) of the ``sample`` documents of each language with the lowest hashes, up to CHARACTERS
    and the text that passes them; n: how many the language has in the training folds."""
    h = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), F.lit(1 << 40))
    own = docs.where("text is not null and text != '' and lang is not null").where(fold() != 1).select("lang", h.alias("h"), "text")
    counts = written(own.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1), "languages")
    if counts.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    # about twice as many as needed go on, by a bound on hashes, so no language's rows meet in a task
    near = own.join(F.broadcast(counts), "lang").where(F.col("h") <= (2 * sample + 200) / F.col("n") * (1 << 40))
    order = Window.partitionBy("lang").orderBy("h", "text")
    before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return near.withColumn("__rank", F.row_number().over(order)).withColumn("__before", F.coalesce(before, F.lit(0))).where((F.col("__rank") <= sample) & (F.col("__before") < CHARACTERS)).select("lang", "n", "text")


def train(docs: DataFrame, path: str, sample: int = SAMPLE) -> Model | None:
    """The model that the training folds of ``docs`` (doc_id, text, lang) give; None without any.

    Each language's sample, which has a bound in rows and characters, is fitted in a task."""

    def run(rows: pa.Table) -> pa.Table:
        words: Counter[str] = Counter()
        for text in rows["text"]:
            words.update(WORD.findall(text.as_py().lower()))
        p = fitted(Pieces(path), words)
        release()
        return pa.table({"lang": rows["lang"][:1], "n": rows["n"][:1], "p": pa.array([p.tolist()], pa.list_(pa.float64()))})

    spark = docs.sparkSession
    rows = written(sampled(docs, sample).groupBy("lang").applyInArrow(run, "lang string, n long, p array<double>"), "piece-probabilities").sort("lang").collect()
    if not rows:
        return None
    p = np.array([r["p"] for r in rows]).T
    p = (1 - SHARED) * p + SHARED * p.mean(1, keepdims=True)
    n = np.array([r["n"] for r in rows], float)
    return Model(path, [r["lang"] for r in rows], p, n / n.sum())


def identify(docs: DataFrame, path: str, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document."""
    model = train(docs, path, sample)
    spark = docs.sparkSession
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 1).alias("held_out"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    parts = spark.sparkContext.broadcast((model.names, model.p, np.exp(model.prior)))

    def make():
        model = model_of(path, parts)

        def call(keys, texts):
            names, scores = model.judge(texts)
            return {"doc_id": keys, "lang_pred": names, "score": scores}

        return call

    return map_texts(docs, make, "doc_id long, lang_pred string, score double").select("doc_id", (fold() == 1).alias("held_out"), "lang_pred", "score")
