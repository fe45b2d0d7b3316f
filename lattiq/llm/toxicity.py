"""Operator 6: a convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the mean of hashed buckets of the word, its beginnings
and its end; filters of several widths slide over the words, the largest answer of
each in a text goes through one logistic layer. Thresholds are calibrated for
each language as guessed from a text's own function words (never from the lang
column), on all labelled rows of the training fold that the filters were not fitted
on, and scores are stretched so that 0.5 is the threshold.

Every document is rated once; labels meet these narrow rows, never the texts, and
only counts by language, label and thousandth come to the driver.

Null and empty texts hold padding alone and get the score of that; repeated rows
each get a row; without labels of both kinds every score is 0. Very long texts are rated
whole, each alone. Of equal words' answers a filter has the one number; a score of 0.5
counts as toxic. An empty table gives no rows; extra columns are left out; a null doc_id
is in no held-out fold and stays null.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import Memo, map_texts, texts_of, written

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 16, (1, 2, 3), 16
#: The filters are fitted on at most so many labelled rows of each class, the ones with the lowest hash;
#: the thresholds come from all others.
SAMPLE = 1500
#: One in so many labelled rows is never fitted on, so that few labels leave some for the thresholds.
SPARE = 4
#: Thousandths of a score that are told apart when thresholds are set.
BINS = 1000
EPOCHS, BATCH, SEED = 6, 32, 11
#: Steps at least, unless that takes over 60 epochs.
STEPS = 1200
#: Positive texts not fitted on from which a threshold is set.
LEAST = 30
STRIP = ".,;:!?\"'()[]{}<>|*#$%&-–—…«»¿¡"
NO_WORD = struct.pack("i", 0)
#: Frequent function words by language (fixed values).
FUNCTION_WORDS = {
    "en": "the of and to in a is that it for was on with as are be this from at by",
    "fr": "le la les de des du et un une est que qui dans pour pas sur avec par au en",
    "de": "der die das und ist nicht von zu den mit ein eine für auf des dem im als sich auch",
    "es": "el la los las de del y que en un una es por con para se no su al como",
}
LANGUAGES = (*FUNCTION_WORDS, "other")


def features(w: str) -> bytes:
    """Buckets of a lower-case word, packed: itself, its end and its first 4 and 5 letters."""
    if not w:
        return NO_WORD
    digest, n = xxhash.xxh32_intdigest, len(w)
    if n < 4:
        return struct.pack("2i", digest("=" + w) % BUCKETS, digest(">" + w) % BUCKETS)
    return struct.pack("4i", digest("=" + w) % BUCKETS, digest(">" + w[-3:]) % BUCKETS, digest("<" + w[:4]) % BUCKETS, digest("<" + w[:5]) % BUCKETS)


class Words:
    """Buckets and language marks of words, kept between batches."""

    def __init__(self):
        marks: dict[str, np.ndarray] = {}
        for i, ws in enumerate(FUNCTION_WORDS.values()):
            for w in ws.split():
                marks.setdefault(w, np.zeros(len(FUNCTION_WORDS), np.float32))[i] = 1
        self.none = np.zeros(len(FUNCTION_WORDS), np.float32)
        self.marks = marks
        self.of = Memo(features, 50_000)

    def batch(self, texts: list[str]) -> Batch:
        split = [t.split() for t in texts]
        index: dict[str, int] = {"": 0}
        for ws in split:
            for w in ws:
                if w not in index:
                    index[w] = len(index)
        pad = [0] * (max(WIDTHS) - 1)
        flat, ends = [], []
        get = index.__getitem__
        for ws in split:
            flat += map(get, ws)
            flat += pad
            flat.append(0)  # so an empty text has a whole window
            ends.append(len(flat))
        plain = [w.lower().strip(STRIP) for w in index]
        buckets = list(map(self.of.__getitem__, plain))
        buckets[0] = b""  # padding
        sizes = np.fromiter(map(len, buckets), np.int64, len(buckets)) // 4
        marks = np.array([self.marks.get(w, self.none) for w in plain])
        return Batch(np.array(flat, np.int32), np.array(ends), np.frombuffer(b"".join(buckets), np.int32).astype(np.int64), sizes, marks)


@dataclass
class Batch:
    flat: np.ndarray  # word numbers, padded after each text
    ends: np.ndarray
    buckets: np.ndarray  # of the distinct words, one after the other; word 0 is padding
    sizes: np.ndarray
    marks: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate(([0], self.ends[:-1]))

    def embed(self, table: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.sizes), table.shape[1]), np.float32)
        at = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        some = self.sizes > 0
        if some.any():
            out[some] = np.add.reduceat(table[self.buckets], at[some], 0) / self.sizes[some, None]
        return out

    def languages(self) -> np.ndarray:
        """The number of each text's language, the last if it has no function word."""
        votes = np.add.reduceat(self.marks[self.flat], self.starts, 0)
        return np.where(votes.max(1) > 0, votes.argmax(1), len(FUNCTION_WORDS))


@dataclass
class Cnn:
    table: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    base: float
    thresholds: np.ndarray = field(default_factory=lambda: np.full(len(LANGUAGES), 0.5))

    @classmethod
    def fresh(cls, seed: int = SEED) -> Cnn:
        rng = np.random.default_rng(seed)
        small = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        return cls(small(BUCKETS, DIM), [small(w, DIM, FILTERS) * 3 for w in WIDTHS], np.zeros(len(WIDTHS) * FILTERS, np.float32), small(len(WIDTHS) * FILTERS), 0.0)

    def windows(self, batch: Batch, words: np.ndarray, k: int) -> np.ndarray:
        """Answers of the filters of the k-th width at each place of the flat words."""
        w = self.filters[k]
        total = (words @ w[0])[batch.flat]
        for j in range(1, len(w)):
            total[: len(total) - j] += (words @ w[j])[batch.flat[j:]]
        for j in range(1, len(w)):  # a window that begins here would run into the next text
            total[batch.ends - j] = -np.inf
        return total

    def pooled(self, batch: Batch) -> np.ndarray:
        words = batch.embed(self.table)
        return np.concatenate([np.maximum.reduceat(self.windows(batch, words, k), batch.starts, 0) for k in range(len(WIDTHS))], 1)

    def raw(self, batch: Batch) -> np.ndarray:
        z = np.maximum(self.pooled(batch) + self.bias, 0) @ self.out + self.base
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def scores(self, batch: Batch) -> np.ndarray:
        """Scores stretched so that each language's threshold is at 0.5."""
        s, t = self.raw(batch), self.thresholds[batch.languages()]
        return np.where(s >= t, 0.5 + 0.5 * (s - t) / (1 - t), 0.5 * s / t)

    def step(self, batch: Batch, y: np.ndarray, seen: dict, rate: float) -> float:
        """One Adagrad step on a batch; gradients flow to the places that won the pooling."""
        words = batch.embed(self.table)
        n = len(y)
        places = np.zeros((n, len(WIDTHS), FILTERS), np.int64)
        top = np.zeros((n, len(WIDTHS), FILTERS), np.float32)
        for k in range(len(WIDTHS)):
            conv = self.windows(batch, words, k)
            for i, (a, b) in enumerate(zip(batch.starts, batch.ends, strict=True)):
                own = conv[a:b]
                places[i, k] = a + own.argmax(0)
                top[i, k] = own.max(0)
        h = np.maximum(top.reshape(n, -1) + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.base, -30, 30)))
        err = ((p - y) / n).astype(np.float32)
        back = (err[:, None] * self.out) * (h > 0)
        grads = {"out": h.T @ err, "bias": back.sum(0)}
        d_words = np.zeros_like(words)
        back = back.reshape(n, len(WIDTHS), FILTERS)
        for k, width in enumerate(WIDTHS):
            g = np.zeros_like(self.filters[k])
            for j in range(width):
                at = batch.flat[np.minimum(places[:, k] + j, len(batch.flat) - 1)]
                g[j] = np.einsum("nfd,nf->df", words[at], back[:, k])
                np.add.at(d_words, at.ravel(), (back[:, k][:, :, None] * self.filters[k][j].T[None]).reshape(-1, DIM))
            grads[f"w{k}"] = g
        params = {"out": self.out, "bias": self.bias, **{f"w{k}": w for k, w in enumerate(self.filters)}}
        for name, g in grads.items():
            seen[name] = seen.get(name, 1e-8) + g * g
            params[name] -= rate * g / np.sqrt(seen[name])
        self.base -= rate * float(err.sum())
        owner = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
        hit = np.abs(d_words).sum(1)[owner] > 0
        rows, d = batch.buckets[hit], d_words[owner[hit]] / batch.sizes[owner[hit], None]
        distinct, back_to = np.unique(rows, return_inverse=True)
        total = np.zeros((len(distinct), DIM), np.float32)
        np.add.at(total, back_to, d)
        squares = seen.setdefault("table", np.full((BUCKETS, DIM), 1e-8, np.float32))
        squares[distinct] += total * total
        self.table[distinct] -= rate * total / np.sqrt(squares[distinct])
        return float(-np.mean(np.log(np.where(y == 1, p, 1 - p) + 1e-9)))


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = SEED) -> Cnn | None:
    """Train on whole texts; thresholds stay at 0.5."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    rng, words, model, seen = np.random.default_rng(seed), Words(), Cnn.fresh(seed), {}
    epochs = max(epochs, min(60, STEPS * BATCH // len(y)))  # a small sample is gone over more often
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
            model.step(words.batch([texts[i] for i in at]), y[at], seen, 0.05 if epoch < epochs * 2 // 3 else 0.02)
    return model


def thresholds(counts: np.ndarray, share: float) -> np.ndarray:
    """Each language's threshold where the error, weighed to ``share`` positives, is least; too few positives leave it at 0.5.

    counts: texts by language, label and thousandth of the score."""
    weight = np.array([1 - share, share]) / np.maximum(1, counts.sum((0, 2)))
    cuts = np.arange(BINS // 20, BINS - BINS // 20 + 1)  # from 0.05 to 0.95
    out = np.full(len(counts), 0.5)
    for k, (ordinary, toxic) in enumerate(counts):
        if toxic.sum() < LEAST:
            continue
        below = np.concatenate(([0], np.cumsum(toxic)))[cuts]
        above = ordinary.sum() - np.concatenate(([0], np.cumsum(ordinary)))[cuts]
        error = weight[1] * below + weight[0] * above
        best = cuts[error <= error.min() + 1e-12] / BINS
        out[k] = best[np.abs(best - 0.5).argmin()]
    return out


@dataclass
class Labels:
    """What is known of the training fold's rows, and which of them the filters were fitted on."""

    known: DataFrame  # doc_id, toxic, r
    last: dict[int, int]  # by class: the highest hash among rows fitted on
    share: float

    def counts(self, rated: DataFrame) -> np.ndarray:
        """Texts not fitted on, of documents with ``raw`` and ``language``, by language, label and thousandth."""
        used = F.lit(False)
        for k, r in self.last.items():
            used = used | ((F.col("toxic") == k) & ~spare() & (F.col("r") <= r))
        bin_ = F.least(F.floor(F.col("raw") * BINS), F.lit(BINS - 1))
        found = rated.join(self.known.where(~used), "doc_id").groupBy("language", "toxic", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        out = np.zeros((len(LANGUAGES), 2, BINS), np.int64)
        for r in found.collect():  # two classes and BINS bins a language at most
            out[r.language, int(r.toxic), r.bin] = r.n
        return out


def spare():
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("spare")), F.lit(SPARE)) == 0


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[Cnn | None, Labels | None]:
    """A model fitted on at most ``sample`` labelled rows of each class whose crc32(doc_id) mod 5 is not 0, its thresholds not set."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(~held_out()).withColumn("r", F.xxhash64("doc_id"))
    picked = [known.where((F.col("toxic") == k) & ~spare()).orderBy("r").limit(sample) for k in (0, 1)]
    ids = written(picked[0].unionByName(picked[1]), "fitted")  # two samples at most
    counts = {r.toxic: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    last = {r.toxic: r["last"] for r in ids.groupBy("toxic").agg(F.max("r").alias("last")).collect()}
    if len(last) < 2:
        return None, None
    rows = texts_of(docs).join(F.broadcast(ids), "doc_id").collect()
    rows.sort(key=lambda r: (r.r, r.text))
    return fit([r.text for r in rows], [r.toxic for r in rows]), Labels(known, last, counts[1] / sum(counts.values()))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Cnn | None:
    """A model with its thresholds set; rates all documents for these."""
    model, known = learn(docs, labels, sample)
    if model is not None:
        model.thresholds = thresholds(known.counts(rate(docs, model)), known.share)
    return model


def rater(model: Broadcast) -> Callable:
    """A function of whole texts to their unstretched scores and language numbers, made once a task."""

    def make():
        words, cnn = Words(), model.value

        def call(texts):
            raw, language = [], []
            for part in parts(texts):
                batch = words.batch(part)
                raw += cnn.raw(batch).tolist()
                language += batch.languages().astype(int).tolist()
            return raw, language

        return call

    return make


def rate(docs: DataFrame, model: Cnn) -> DataFrame:
    """doc_id, raw and language of each document."""
    make = rater(docs.sparkSession.sparkContext.broadcast(model))  # its size is fixed by the constants above

    def keyed():
        call = make()

        def run(keys, texts):
            raw, language = call(texts)
            return {"doc_id": keys, "raw": raw, "language": language}

        return run

    return map_texts(docs, keyed, "doc_id long, raw double, language int")


def stretched(at: np.ndarray, raw: str = "raw", language: str = "language"):
    """The score column, as Cnn.scores, for these thresholds."""
    s, t = F.col(raw), F.element_at(F.array(*map(F.lit, at.tolist())), F.col(language) + 1)
    return F.when(s >= t, 0.5 + 0.5 * (s - t) / (1 - t)).otherwise(0.5 * s / t)


def judge(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """As classify with a model trained on ``labels``, but each document is rated once."""
    model, known = learn(docs, labels, sample)
    if model is None:
        return classify(docs, None)
    rated = written(rate(docs, model), "rated")
    return decided(rated.withColumn("score", stretched(thresholds(known.counts(rated), known.share))))


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0


def classify(docs: DataFrame, model: Cnn | None) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= 0.5) of each document."""
    if model is None:
        return decided(texts_of(docs).select("doc_id", F.lit(0.0).alias("score")))
    return decided(rate(docs, model).withColumn("score", stretched(model.thresholds)))


def decided(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def parts(texts: list[str], most: int = 500_000):
    """Runs of texts of about ``most`` characters; a longer text is alone."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run
