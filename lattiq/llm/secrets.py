"""Operator 8: secrets by character Markov models beside fixed patterns.

Two models of first order, of random strings and of ordinary identifiers, are
trained on labelled samples; which letter follows which within an ordinary word
is counted over the words of all documents. A run of token characters is a secret
if its mean log-likelihood ratio passes a threshold for its length, set on
held-out samples. The base patterns' spans always stay; the models add spans that
overlap none of them, also in what a base span leaves of a longer run.

Null and empty texts have no spans; repeated rows each get theirs; equal starts
are ordered by kind; a score equal to its threshold is no secret. Very long texts are
scanned whole. An empty table gives no rows, and one without words leaves the models
with ordinary letters alone. Extra columns are left out; a null doc_id stays null.
"""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import map_texts, written

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Characters of the shortest run the models judge, as of the shortest random string learned.
FLOOR = 16
RUN = re.compile(rf"(?<![\w+/=-])[A-Za-z0-9+/_=-]{{{FLOOR},}}(?![\w])")
WORD = re.compile(r"\b[A-Za-z]{2,19}\b")
#: Lengths from which a threshold of its own holds.
LENGTHS = (FLOOR, 20, 24, 32)
LETTERS = string.ascii_letters + string.digits + "+/_=-"
INDEX = np.full(128, len(LETTERS), np.int64)
INDEX[[ord(c) for c in LETTERS]] = range(len(LETTERS))
#: Ordinary words of identifiers, learned beside those of the documents (fixed values).
COMMON = "account action address array block buffer build cache call change check chunk class client code color column command config connection content context control copy count create cursor data date default delete depth device dict directory document domain edge element email empty end entry error event example export field file filter find first flag format frame function global graph group handler header height hidden home host image import index info input item join key label language last layer left length level library limit line link list load local log main map match max message method min mode model module month name network next node number object offset open option order output owner page panel parent parser path pattern player point pool port position prefix previous process product profile project property query queue random range read record remove render reply report request resource response result return right root row rule sample schema scope score screen search section select sender sequence server service session setting shape share shift show size socket sort source space split stack start state status step stop storage stream string style suffix switch symbol system table target task template test text thread time timer title total track tree type unit update upload user utils valid value vector version view visible web width window word worker write year zone"
#: Distinct words of all documents that labelled identifiers are joined from, the ones with the lowest hash: a bound on the training sample.
SAMPLE_WORDS = 20_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


class Markov:
    """Mean log-likelihood ratio of random strings to identifiers, by characters given the one before."""

    def __init__(self, ratio: np.ndarray, thresholds: list[float]):
        self.ratio, self.thresholds = ratio, thresholds

    @staticmethod
    def codes(run: str) -> np.ndarray:
        raw = np.frombuffer(run.encode("ascii", "replace"), np.uint8)
        return np.concatenate(([len(LETTERS)], INDEX[np.minimum(raw, 127)]))

    def score(self, run: str) -> float:
        c = self.codes(run)
        return float(self.ratio[c[:-1], c[1:]].mean()) if len(c) > 1 else 0.0

    @property
    def threshold(self) -> float:
        """The highest threshold of any length."""
        return max(self.thresholds)

    def random(self, run: str) -> bool:
        """Whether a run of token characters is a secret; one below FLOOR has the threshold of FLOOR."""
        return self.score(run) > self.thresholds[max(0, bisect.bisect_right(LENGTHS, len(run)) - 1)]

    @classmethod
    def train(cls, samples: list[tuple[str, int]], worst: float = 1e-3, follow: np.ndarray | None = None) -> Markov:
        """Fit on labelled (run, 1 if random); every fifth sample is held out for the thresholds,
        above which at most ``worst`` of the held-out identifiers of that length and the next ones score.

        follow: how often a letter follows another within ordinary words, by position in the
        alphabet; it shares out what the samples tell of a letter followed by one of the same case."""
        size = len(LETTERS) + 1
        counts = np.full((2, size, size), 0.1, np.float64)
        for i, (run, label) in enumerate(samples):
            if i % 5:
                c = cls.codes(run)
                np.add.at(counts[label], (c[:-1], c[1:]), 1)
        if follow is not None:
            shares = (follow + 0.1) / (follow + 0.1).sum(1, keepdims=True)
            for case in (string.ascii_lowercase, string.ascii_uppercase):
                at = [LETTERS.index(c) for c in case]
                cells = np.ix_(at, at)
                counts[0][cells] = counts[0][cells].sum(1, keepdims=True) * shares
        logs = np.log(counts / counts.sum(2, keepdims=True))
        model = cls((logs[1] - logs[0]).astype(np.float32), [])
        held = [[(len(r), model.score(r)) for r, y in samples[::5] if y == label] for label in (0, 1)]
        for k, least in enumerate(LENGTHS):
            most = LENGTHS[k + 1] if k + 1 < len(LENGTHS) else float("inf")
            ordinary, chance = ([x for n, x in part if least <= n < most] or [0.0] for part in held)
            low, high = float(np.quantile(ordinary, 1 - worst)), float(np.quantile(chance, 0.01))
            # above held-out identifiers, and halfway up to random strings for words not learned
            model.thresholds.append(max(0.1, low, high / 2))
        # a shorter run is never judged by a lower threshold than a longer one
        model.thresholds = np.maximum.accumulate(model.thresholds[::-1])[::-1].tolist()
        return model

    def spans(self, text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
        """Spans of random runs outside those ``taken``. Of a run that these meet the pieces left are judged;
        one shorter than FLOOR only if the whole run is random too."""
        found = []
        for m in RUN.finditer(text):
            at, end = m.span()
            met = [(a, b) for a, b, _ in taken if a < end and at < b]
            if not met:
                if self.random(m.group()):
                    found.append((at, end, "markov"))
                continue
            pieces = []
            for a, b in sorted(met):
                if a > at:
                    pieces.append((at, a))
                at = max(at, b)
            if at < end:
                pieces.append((at, end))
            found += [(a, b, "markov") for a, b in pieces if self.random(text[a:b]) and (b - a >= FLOOR or self.random(m.group()))]
        return found


def random_runs(n: int, seed: int = 7) -> list[str]:
    """Labelled random strings: hexadecimal, base 32, base 62 and base 64 of 16 to 64 characters."""
    rng = random.Random(seed)
    sets = ("0123456789abcdef", string.ascii_uppercase + "234567", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits)
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(16, 64))) for i in range(n)]


def samples_of(words: list[str], n: int = 8000, seed: int = 7) -> list[tuple[str, int]]:
    """Labelled runs: random strings, and identifiers joined from ordinary words, one in eight of numbers alone."""
    rng = random.Random(seed)
    words = [w for w in words if w.isascii() and w.isalpha()] or ["value", "name", "index", "total", "count"]
    made = []
    for i in range(n):
        part = rng.choices(words, k=rng.randint(2, 5))
        if i % 8 == 7:  # dates, telephone and account numbers
            groups = ["".join(rng.choices(string.digits, k=rng.randint(2, 6))) for _ in range(rng.randint(4, 6))]
            made.append((rng.choice(("-", "/", "")).join(groups), 0))
            continue
        joined = ("_".join(part), "-".join(part), "/".join(part), "".join(part).lower(), part[0] + "".join(p.title() for p in part[1:]), "_".join(part).upper(), "_".join(part) + str(rng.randint(0, 2030)))
        made.append((joined[i % len(joined)], 0))
    made += [(r, 1) for r in random_runs(n, seed)]
    rng.shuffle(made)
    return made


def train(docs: DataFrame, sample: int = SAMPLE_WORDS) -> Markov:
    """Models for these documents: transitions within the words of all of them, and labelled
    identifiers joined from at most ``sample`` of these words; what may be a secret is left out."""
    found = written(words_of(docs), "words")
    # twice as many as asked for by a bound on the hash, so ordering them sends few rows
    rank, ranks = F.pmod(F.xxhash64("word"), F.lit(1 << 30)), 1 << 30
    picked = found.where(rank < min(ranks, 2 * sample * ranks // max(1, found.count()) + 1)).orderBy(rank, "word").limit(sample)
    words = {r.word for r in picked.select("word").collect()} | set(COMMON.split())
    # a letter and the next of each word: 26 x 26 sums at most
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2)))
    follow = np.zeros((26, 26))
    for r in found.select(pair.alias("pair"), F.log1p("n").alias("w")).groupBy("pair").agg(F.sum("w").alias("w")).collect():
        follow[ord(r.pair[0]) - 97, ord(r.pair[1]) - 97] = round(r.w, 6)  # whatever the order of the sum
    return Markov.train(samples_of(sorted(words)), follow=follow)


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of all documents in lower case, and how many texts have each."""

    def make():
        def call(_, texts):
            seen = Counter()
            for t in texts:
                seen.update({w.lower() for w in WORD.findall(without_runs(t))})
            return {"word": list(seen), "n": list(seen.values())}

        return call

    return map_texts(docs, make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def without_runs(text: str) -> str:
    """A text without what may be a secret."""
    for a, b, _ in sorted(base_spans(text), reverse=True):
        text = text[:a] + " " + text[b:]
    return RUN.sub(" ", text)


def all_spans(model: Markov, text: str) -> tuple[list, list]:
    base = sorted(base_spans(text), key=lambda s: (s[0], KINDS.index(s[2])))
    return base, sorted(base + model.spans(text, base), key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of each document."""
    model = model or train(docs)

    def make():
        def call(keys, texts):
            found = [all_spans(model, t) for t in texts]
            count = lambda kind: [sum(s[2] == kind for s in a) for _, a in found]
            return {"doc_id": keys, "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"), "n_markov": count("markov"), "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(a) for _, a in found]}

        return call

    return map_texts(docs, make, "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string")


def redacted(model: Markov, text: str, mark: str = "[SECRET]") -> str:
    """``text`` with every span, overlapping ones as one, replaced by ``mark``."""
    parts, at = [], 0
    for a, b, _ in all_spans(model, text)[1]:
        if a >= at:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join([*parts, text[at:]])
