"""Operator 4: language-model scores by Katz backoff with Good-Turing discounts.

Tokens stay in chunks of a few million, written once in a table bucketed by
chunk. A chunk's distinct n-grams travel as packed, sorted arrays to tables
partitioned by a hash of the n-gram, are counted there, and the counts travel
back; so a frequent word is one entry of each chunk, never a hot key. Of many chunks
FAN at a time are merged first, a part of the hashes each, and the merged tables go
on to finer parts, level by level; so the arrays sent are FAN for each chunk and level,
in proportion to the input, and none grows with it. Three such rounds give unigram counts, bigram counts and the backoff weight of each context;
then each token is scored: the discounted bigram if it was seen, else the
context's weight times the unigram, else the mass left for unknown words.

Words are told apart by 64-bit hashes. One class stands for all words unseen in
training, as in the add-one base. Each training text begins after an end token.

Null and empty texts are one end token. A null doc_id is learned from. Repeated
rows each get a row. Without training text every token is unknown, with score 0.
Very long texts are one chunk each, in whole. An empty table gives no rows. Extra
columns are left out. Equal n-grams of a chunk are one entry with their count.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import release, shared_dir, slices, texts_of, written
from lattiq.llm.common import batches as small_batches
from lattiq.llm.shingles import mix, words_of

#: Tokens of a chunk, and bytes of packed n-grams that one reducing task holds.
CHUNK, HELD = 2_500_000, 48 << 20
#: Chunks that are merged at once, and parts of the hashes that a merged table is sent to.
FAN = 64
#: Counts up to this are discounted, along a line of this slope at least where they are irregular.
TOP, SLOPE = 5, -1.1
#: Bytes of input for each bucket of the table of chunks.
INPUT = 16 << 20
#: The hash of the end token, which is also the context of a text's first token.
END = np.uint64(0x51ED270B76A5E3F1)
CHUNKS = "chunk long, n_tokens long, n_words long, ids binary, null_ids binary, train binary, sizes binary, words binary, flat binary"


def chunks_of(docs: DataFrame) -> DataFrame:
    """One row a chunk: doc ids, training marks and token numbers of its texts, and its distinct words' hashes."""
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 6

    def pack(number: int, ids: list, hashes: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        words, flat = np.unique(np.concatenate(hashes), return_inverse=True)
        known = np.array([0 if i is None else i for i in ids], np.int64)
        train = np.array([zlib.crc32(str(i).encode()) % 7 != 2 for i in ids], bool)
        row = (TaskContext.get().partitionId() << 32 | number, len(flat), len(words), known.tobytes(), np.array([i is None for i in ids]).tobytes(), train.tobytes(), np.array(sizes, np.int64).tobytes(), words.tobytes(), flat.astype(np.uint32).tobytes())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes, sizes, held, number = [], [], [], 0, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in slices(batch.column(1)):
                flat, own = with_ends(batch.column(1).slice(a, b - a).to_pylist())
                ends, at = np.cumsum(own), 0
                while at < b - a:  # a chunk ends with the text that fills it
                    before = int(ends[at - 1]) if at else 0
                    to = min(b - a, int(np.searchsorted(ends, before + CHUNK - held)) + 1)
                    last = int(ends[to - 1])
                    ids += keys[a + at : a + to]
                    sizes += own[at:to].tolist()
                    hashes.append(flat[before:last])
                    held, at = held + last - before, to
                    if held >= CHUNK:
                        yield pack(number, ids, hashes, sizes)
                        ids, hashes, sizes, held, number = [], [], [], 0, number + 1
        if ids:
            yield pack(number, ids, hashes, sizes)
        release()

    small_batches(docs.sparkSession)
    return texts_of(docs).mapInArrow(run, CHUNKS)


def with_ends(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words with an end token after each text, and how many tokens each has."""
    words = words_of(texts)
    sizes = np.bincount(words.item, minlength=len(texts)) + 1
    flat = np.full(len(words.hashes) + len(texts), END)
    flat[np.arange(len(words.hashes)) + words.item] = words.hashes
    return flat, sizes


@dataclass
class Chunk:
    """A row of the table of chunks, unpacked, with its distinct bigrams in the order in which they travel."""

    ids: np.ndarray
    null_ids: np.ndarray
    train: np.ndarray  # of each text
    sizes: np.ndarray
    words: np.ndarray
    flat: np.ndarray

    @classmethod
    def of(cls, row) -> Chunk:
        kinds = (("ids", np.int64), ("null_ids", bool), ("train", bool), ("sizes", np.int64), ("words", np.uint64), ("flat", np.uint32))
        return cls(**{k: np.frombuffer(row[k], t) for k, t in kinds})

    def word_order(self, buckets: int) -> np.ndarray:
        return np.argsort(self.words % np.uint64(buckets), kind="stable")

    def bigrams(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts and words (numbers in ``words``) and keys of the distinct bigrams by bucket and key, and each token's bigram."""
        before = np.empty_like(self.flat)
        before[1:] = self.flat[:-1]
        if len(before):
            before[0] = np.searchsorted(self.words, END)
        pairs, inverse = np.unique(before.astype(np.uint64) << np.uint64(32) | self.flat, return_inverse=True)
        v, w = (pairs >> np.uint64(32)).astype(np.int64), (pairs & np.uint64(0xFFFFFFFF)).astype(np.int64)
        keys = mix(self.words[v] * np.uint64(0x9E3779B97F4A7C15) + mix(self.words[w]))
        order = np.lexsort((keys, keys % np.uint64(buckets)))
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return v[order], w[order], keys[order], place[inverse]

    def train_tokens(self) -> np.ndarray:
        return np.repeat(self.train, self.sizes)


def dealt(chunk: int, keys: np.ndarray, buckets: int, *values: np.ndarray) -> Iterator[tuple]:
    """(bucket, chunk, keys, values ...) for each bucket that has keys; keys come by bucket."""
    of = (keys % np.uint64(buckets)).astype(np.int64)
    cuts = np.searchsorted(of, np.arange(buckets + 1))
    for b in range(buckets):
        i, j = cuts[b], cuts[b + 1]
        if j > i:
            yield (b, chunk, packed(keys[i:j]), *(x[i:j].tobytes() for x in values))


def packed(keys: np.ndarray) -> bytes:
    """Ascending keys: how many bytes a step takes, the first, and the steps from one to the next."""
    steps = np.diff(keys)
    width = max(1, -(-int(steps.max(initial=0)).bit_length() // 8))
    return bytes([width]) + keys[:1].tobytes() + steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    if len(raw) < 9:
        return np.zeros(0, np.uint64)
    narrow = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    steps = np.zeros((len(narrow), 8), np.uint8)
    steps[:, : raw[0]] = narrow
    return np.cumsum(np.concatenate((np.frombuffer(raw, np.uint64, 1, 1), steps.reshape(-1).view("<u8"))), dtype=np.uint64)


def grams(chunks: DataFrame, buckets: int, order: int) -> DataFrame:
    """(bucket, chunk, keys, counts): each chunk's distinct n-grams and their training counts."""
    need = ["chunk", "train", "sizes", "words", "flat"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(need)} | {"ids": b"", "null_ids": b""}
                c = Chunk.of(row)
                if order == 1:
                    at = c.word_order(buckets)
                    keys, counts = c.words[at], np.bincount(c.flat[c.train_tokens()], minlength=len(c.words))[at]
                else:
                    _, _, keys, inverse = c.bigrams(buckets)
                    counts = np.bincount(inverse[c.train_tokens()], minlength=len(keys))
                made = list(dealt(row["chunk"], keys, buckets, least(counts)))
                del c, keys, counts, row
                yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["bucket", "chunk", "keys", "counts"])
                del made
                release()

    return chunks.select(*need).mapInArrow(run, SENT)


SENT = "bucket long, chunk long, keys binary, counts binary"
TOLD = "kind int, bucket long, chunk long, keys binary, counts binary, owned binary, stats array<long>"


def least(counts: np.ndarray) -> np.ndarray:
    """Counts in the least width: most of a chunk's fit a byte."""
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 256 else np.int32 if most < 1 << 31 else np.int64)


def column(frame: pd.DataFrame, name: str, keys: list[np.ndarray]) -> np.ndarray:
    """The counts or numbers of all rows, one after the other."""
    if name != "counts":
        return np.concatenate([np.frombuffer(x, np.float64) for x in frame[name]])
    kinds = {1: np.uint8, 4: np.int32, 8: np.int64}
    return np.concatenate([np.frombuffer(x, kinds[len(x) // len(k)]).astype(np.int64) for x, k in zip(frame[name], keys, strict=True)])


class Met:
    """The rows of a bucket, by chunk: distinct keys, which one each entry has, and who had each first."""

    def __init__(self, frame: pd.DataFrame):
        self.frame = frame.sort_values("chunk", ignore_index=True)
        self.bucket = int(frame["bucket"].iloc[0])
        self.keys = [unpacked(k) for k in self.frame["keys"]]
        self.every, self.first, self.inverse = np.unique(np.concatenate(self.keys), return_index=True, return_inverse=True)
        self.owned = np.zeros(len(self.inverse), bool)
        self.owned[self.first] = True
        ends = np.cumsum([len(k) for k in self.keys])
        self.parts = list(zip(self.frame["chunk"].tolist(), np.concatenate(([0], ends[:-1])).tolist(), ends.tolist(), strict=True))

    def values(self, name: str) -> np.ndarray:
        return column(self.frame, name, self.keys)

    def sums(self, name: str) -> np.ndarray:
        # sums of integers are exact below 2 ** 53
        return np.bincount(self.inverse, self.values(name).astype(np.float64), len(self.every))

    def merged(self, payload: tuple[str, ...]) -> list[np.ndarray]:
        """One table of the rows: counts of n-grams are summed; of contexts they are known and equal."""
        if payload == ("counts",):
            return [least(self.sums("counts").astype(np.int64))]
        return [least(self.values("counts")[self.first]), self.sums("mass"), self.sums("uni")]


def totals(sent: DataFrame, order: int) -> DataFrame:
    """Sum a bucket's counts, and answer every chunk.

    (kind, bucket, chunk, keys, counts, owned, stats): kind 0 holds the bucket's
    part of the model, n-grams and counts, and as stats the number of n-grams by
    count 1 to TOP + 1, of all, and their sum; kind ``order`` a chunk's answers in
    the order of its keys, owned marking those that no earlier chunk sent.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        met = Met(frame)
        total = met.sums("counts").astype(np.int64)
        seen = total > 0
        stats = np.array([*((total == r).sum() for r in range(1, TOP + 2)), seen.sum(), total.sum()], np.int64)
        rows = [(0, -1, packed(met.every[seen]), small(total[seen]), b"", stats.tolist())]
        for chunk, a, b in met.parts:
            rows.append((order, chunk, b"", small(total[met.inverse[a:b]]), np.packbits(met.owned[a:b]).tobytes() if order > 1 else b"", []))
        out = pd.DataFrame(rows, columns=["kind", "chunk", "keys", "counts", "owned", "stats"])
        out.insert(1, "bucket", met.bucket)
        return out

    return sent.groupBy("bucket").applyInPandas(run, TOLD)


def exchange(sent: DataFrame, chunks: int, parts: int, kind: int, payload: tuple[str, ...], settle: Callable[[DataFrame], DataFrame], schema: str, fan: int) -> DataFrame:
    """What ``settle`` answers to each (bucket, chunk) of ``sent``. Of more than 2 * ``fan`` chunks, groups of about
    ``fan`` are merged, a bucket each, and the merged tables are sent on as chunks to ``fan`` buckets in each
    bucket. ``parts``: buckets so far."""
    groups = -(-chunks // fan)
    if chunks <= 2 * fan:
        return settle(sent)
    own = written(sent.withColumn("own", F.pmod(F.xxhash64("chunk"), F.lit(groups))), "sent")
    fields = ", ".join(f"{n} binary" for n in payload)

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        met = Met(frame)
        rows = []
        order, cuts = digits(met.every, parts, fan)
        columns = [c[order] for c in met.merged(payload)]
        for d in range(fan):
            i, j = cuts[d], cuts[d + 1]
            if j > i:
                rows.append((met.bucket * fan + d, int(frame["own"].iloc[0]), packed(met.every[order][i:j]), *(c[i:j].tobytes() for c in columns)))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", *payload])

    up = own.groupBy("bucket", "own").applyInPandas(merge, f"bucket long, chunk long, keys binary, {fields}")
    told = written(exchange(up, groups, parts * fan, kind, payload, settle, schema, fan), "told")

    def back(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        met = Met(left)
        order = digits(met.every, parts, fan)[0]
        right = right.sort_values("fine")
        rows = []

        def placed(name: str, unpack) -> np.ndarray:
            flat = np.concatenate([unpack(x) for x in right[name]])
            out = np.empty_like(flat)
            out[order] = flat
            return out

        if kind < 3:
            count = placed("counts", wide)
            if kind > 1:
                ours = np.empty(len(order), bool)
                sizes = [len(wide(c)) for c in right["counts"]]
                ours[order] = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8))[:n] for o, n in zip(right["owned"], sizes, strict=True)])
                owned = met.owned & ours[met.inverse]
            for chunk, a, b in met.parts:
                rows.append((kind, met.bucket, chunk, b"", small(count[met.inverse[a:b]]), np.packbits(owned[a:b]).tobytes() if kind > 1 else b"", []))
        else:
            total, alpha = (placed(n, lambda x: np.frombuffer(x, np.float64)) for n in ("total", "alpha"))
            for chunk, a, b in met.parts:
                part = met.inverse[a:b]
                rows.append((kind, met.bucket, chunk, total[part].tobytes(), alpha[part].tobytes()))
        return pd.DataFrame(rows, columns=[f.split(" ")[0] for f in schema.split(", ")])

    answers = told.where("kind > 0").withColumn("fine", F.col("bucket")).withColumn("bucket", F.expr(f"bucket div {fan}")).withColumn("own", F.col("chunk"))
    out = own.groupBy("bucket", "own").cogroup(answers.groupBy("bucket", "own")).applyInPandas(back, schema)
    return out.unionByName(told.where("kind = 0"))


def digits(keys: np.ndarray, parts: int, fan: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of keys by the bucket of ``fan`` that each has after a modulus of ``parts``, and where each bucket starts."""
    digit = (keys // np.uint64(parts)) % np.uint64(fan)
    order = np.argsort(digit, kind="stable")
    return order, np.searchsorted(digit[order], np.arange(fan + 1, dtype=np.uint64))


def small(values: np.ndarray) -> bytes:
    """Counts in the least width that holds all, which is the first byte."""
    kind = next(t for t in (np.uint8, np.uint16, np.int32, np.int64) if values.max(initial=0) <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + values.astype(kind).tobytes()


def wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw[1:], {1: np.uint8, 2: np.uint16, 4: np.int32, 8: np.int64}[raw[0]]).astype(np.int64)


def discounts(ns: list[int]) -> np.ndarray:
    """Factors for counts 0 to TOP (0 unused): Good-Turing's ratios, made to leave counts above TOP alone.

    Where copies make the numbers of n-grams by count too irregular for that, the
    numbers are first smoothed by a line through their logarithms. A line at least as
    steep as SLOPE always gives factors between 0 and 1; a flatter one is turned to it."""
    n = np.array(ns[: TOP + 1], float)
    r = np.arange(1, TOP + 2)
    some = n > 0
    slope = np.polyfit(np.log(r[some]), np.log(n[some]), 1)[0] if some.sum() > 1 else 2 * SLOPE
    for n in (n, np.exp(min(slope, SLOPE) * np.log(r))):
        if min(n) > 0 and (share := (TOP + 1) * n[TOP] / n[0]) < 1:
            d = (r[1:] * n[1:] / (r[:-1] * n[:-1]) - share) / (1 - share)
            if ((d > 0) & (d < 1)).all():
                break
    return np.concatenate(([1.0], d))


@dataclass
class Model:
    """The few numbers that all tasks need."""

    tokens: int
    words: int
    uni: np.ndarray  # discounts of unigrams
    bi: np.ndarray
    unknown: float  # probability of the class of unknown words

    @classmethod
    def of(cls, uni: list[int], bi: list[int]) -> Model:
        tokens, d = uni[TOP + 2], discounts(uni)
        left = sum((1 - d[r]) * r * uni[r - 1] for r in range(1, TOP + 1)) / tokens if tokens else 1.0
        return cls(tokens, uni[TOP + 1], d, discounts(bi), left if left > 0 else 1 / (tokens + 1))

    def unigram(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= TOP, self.uni[np.minimum(c, TOP)], 1.0)
        known = d * c / max(1, self.tokens)
        if self.tokens and not any((1 - self.uni[1:]) > 0):
            known = known * (1 - self.unknown)
        return np.where(c > 0, known, self.unknown)

    def mass(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts of bigrams."""
        return np.where(c <= TOP, self.bi[np.minimum(c, TOP)], 1.0) * c

    @staticmethod
    def backoff(seen: np.ndarray, mass: np.ndarray, uni: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of contexts with count ``seen``: what divides their bigrams' discounted counts, and the weight of unigrams.

        A context without any discount gets a count more, so unseen words keep
        some mass; one after which all words were seen divides by its own mass."""
        total = np.where(seen - mass > 1e-9, seen, seen + 1.0)
        rest = 1 - uni
        some = rest > 1e-12
        alpha = np.where(some, (1 - mass / np.maximum(total, 1e-300)) / np.where(some, rest, 1), 0.0)
        return np.where(some, total, np.maximum(mass, 1e-300)), alpha


def joined(right: pd.DataFrame, kind: int, column: str, unpack) -> np.ndarray:
    """A chunk's answers of a kind, put together in the order of its keys."""
    own = right[right["kind"] == kind].sort_values("bucket")
    parts = [unpack(x) for x in own[column]]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


class Answers:
    """A chunk with what it was told: word counts (in the order of words) and bigram counts."""

    def __init__(self, left: pd.DataFrame, right: pd.DataFrame, words: int, pairs: int):
        self.chunk = Chunk.of(left.iloc[0])
        self.order = self.chunk.word_order(words)
        self.count = np.empty(len(self.order), np.int64)
        self.count[self.order] = joined(right, 1, "counts", wide)
        self.v, self.w, self.keys, self.inverse = self.chunk.bigrams(pairs)
        self.pair_count = joined(right, 2, "counts", wide)


def weights_sent(chunks: DataFrame, told: DataFrame, model: Model, words: int, pairs: int) -> DataFrame:
    """(bucket, chunk, keys, counts, mass, uni): per context of a chunk its count, and the sums of
    discounted counts and of unigram probabilities over the seen bigrams that the chunk owns."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = Answers(left, right, words, pairs)
        own = right[right["kind"] == 2].sort_values("bucket")
        owned = np.concatenate([np.unpackbits(np.frombuffer(o, np.uint8))[: len(wide(c))] for o, c in zip(own["owned"], own["counts"], strict=True)]).astype(bool)
        on = owned & (a.pair_count > 0)
        n = len(a.count)
        mass = np.bincount(a.v[on], model.mass(a.pair_count[on]), n)
        uni = np.bincount(a.v[on], model.unigram(a.count[a.w[on]]), n)
        rows = list(dealt(int(left["chunk"].iloc[0]), a.chunk.words[a.order], words, a.count[a.order], mass[a.order], uni[a.order]))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "counts", "mass", "uni"])

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(run, "bucket long, chunk long, keys binary, counts binary, mass binary, uni binary")


WEIGHED = "kind int, bucket long, chunk long, total binary, alpha binary"


def weights(sent: DataFrame) -> DataFrame:
    """(kind 3, bucket, chunk, total, alpha): each chunk's divisors and backoff weights."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        met = Met(frame)
        seen = met.values("counts")[met.first].astype(np.float64)
        total, alpha = Model.backoff(seen, met.sums("mass"), met.sums("uni"))
        rows = [(3, met.bucket, chunk, total[met.inverse[a:b]].tobytes(), alpha[met.inverse[a:b]].tobytes()) for chunk, a, b in met.parts]
        return pd.DataFrame(rows, columns=["kind", "bucket", "chunk", "total", "alpha"])

    return sent.groupBy("bucket").applyInPandas(run, WEIGHED)


def scored(chunks: DataFrame, told: DataFrame, model: Model, words: int, pairs: int) -> DataFrame:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = Answers(left, right, words, pairs)
        total, alpha = np.empty(len(a.count)), np.empty(len(a.count))
        floats = lambda x: np.frombuffer(x, np.float64)
        total[a.order] = joined(right, 3, "total", floats)
        alpha[a.order] = joined(right, 3, "alpha", floats)
        uni = model.unigram(a.count)
        context = a.count[a.v] > 0
        backed = np.where(context, alpha[a.v], 1.0) * uni[a.w]
        direct = model.mass(a.pair_count) / np.where(context, total[a.v], 1.0)
        p = np.where(a.pair_count > 0, direct, backed)
        c = a.chunk
        starts = np.cumsum(c.sizes) - c.sizes
        each = lambda x: np.add.reduceat(x, starts)
        known = a.count[c.flat]
        base = np.log10((known + 1) / (model.tokens + model.words + 1))
        held = np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in c.ids]) & ~c.null_ids
        ids = pd.array(c.ids, "Int64")
        ids[c.null_ids] = pd.NA
        return pd.DataFrame({"doc_id": ids, "held_out": held, "n_tokens": c.sizes, "n_known": each((known > 0).astype(np.int64)), "train_tokens": model.tokens, "base_score": each(base), "score": each(np.log10(np.maximum(p, 1e-300))[a.inverse])})

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInPandas(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each document."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # what the plan knows of the input's size; an unknown one is given as near the largest number there is
    held = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    held = 0 if held >= 1 << 60 else held
    # bucketed by chunk: later joins by chunk move the answers, never the tokens
    name = f"lattiq_chunks_{uuid.uuid4().hex}"
    tokens = chunks_of(docs)
    tokens.write.format("parquet").option("path", f"{shared_dir(spark)}/{name}").option("compression", "zstd").bucketBy(max(partitions, min(100_000, held // INPUT)), "chunk").saveAsTable(name)
    chunks = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay, and so does the frame; no name is left in the catalog
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    # few chunks meet in as many buckets as memory asks for; many in ``fan``, and in finer ones by levels
    words, pairs = (fan if size.n > 2 * fan else max(partitions, math.ceil(x * b / HELD)) for x, b in ((size.w, 24), (size.t, 9)))
    one = written(exchange(grams(chunks, words, 1), size.n, words, 1, ("counts",), lambda s: totals(s, 1), TOLD, fan), "unigrams")
    two = written(exchange(grams(chunks, pairs, 2), size.n, pairs, 2, ("counts",), lambda s: totals(s, 2), TOLD, fan), "bigrams")
    model = Model.of(stats(one), stats(two))
    answers = lambda df: df.where("kind > 0").select("kind", "bucket", "chunk", "counts", "owned")
    told = answers(one).unionByName(answers(two))
    three = written(exchange(weights_sent(chunks, told, model, words, pairs), size.n, words, 3, ("counts", "mass", "uni"), weights, WEIGHED, fan), "weights")
    told = told.drop("owned").unionByName(three, allowMissingColumns=True)
    return scored(chunks, told, model, words, pairs)


def stats(table: DataFrame) -> list[int]:
    row = table.where("kind = 0").select(*[F.coalesce(F.sum(F.get("stats", F.lit(i))), F.lit(0)) for i in range(TOP + 3)]).first()
    return [int(x) for x in row]
