"""Operator 13: alignment of two tokenisers by a label string over bytes.

Each byte of a text has a label: no token ends there, one of A's, one of B's, or one
of both. A regular expression scans the labels for spans up to each place where both
end; the labels counted in a span tell how many tokens of each side make its group.

Between a character that is no white space and a single space before another such
character both tokenisers always part (no piece of B holds a space elsewhere than at
its start, which is looked up; else texts stay whole). So a text's labels are those of
its chunks between such places, and frequent chunks are kept.

The links of each document, as pairs of ids, are written once, packed. Pairs are counted
over the corpus from there, and sums over links are read off against the counts, a slice
of at most about SLICE pairs at a time, so what is broadcast has a bound at any size.

Null and empty texts, and those that a tokeniser does not give back, have no tokens.
Repeated rows each get a row and count as documents of their own; an empty table gives
none; extra columns are left out; a null doc_id stays null. Whole texts of any length
are aligned. Of an A id's pairs with equal highest counts all are its best.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tiktoken import Encoding

from lattiq.llm.bpe import byte_letters
from lattiq.llm.common import batches, release, shared_dir, slices, texts_of, written
from lattiq.llm.token_counts import BYTE_PATTERN

#: Labels of a byte, and a span of them up to the next place where both tokenisers end a token.
NONE, A_END, B_END, BOTH = b".abx"
SPAN = re.compile(b"[^x]*x")
#: Where both tokenisers part: the space is the next chunk's first character.
PART = re.compile(r"(?<=\S) (?=\S)")
#: B's white space mark (fixed value).
MARK = "▁"
#: A pair of ids is one number: A's times this, plus B's.
WIDE = 1 << 16
#: Chunks kept, their greatest length, and chunks that a library call encodes at once.
KEPT, LONGEST, AT_ONCE = 300_000, 64, 4000
#: Links of a group beyond which they are counted by distinct ids.
MANY = 1 << 14
#: Pairs of ids looked up at a time.
SLICE = 2_000_000


def labelled(size: int, a_ends: np.ndarray, b_ends: np.ndarray) -> bytes:
    """The label string of ``size`` bytes."""
    labels = np.full(size, NONE, np.uint8)
    labels[a_ends - 1] = A_END
    labels[b_ends - 1] = np.where(labels[b_ends - 1] == A_END, BOTH, B_END)
    return labels.tobytes()


def spans(labels: bytes) -> np.ndarray:
    """Bytes, tokens of A and tokens of B of each group."""
    found = SPAN.findall(labels)
    return np.array([(len(s), s.count(A_END) + 1, s.count(B_END) + 1) for s in found], np.int64).reshape(-1, 3)


class Aligner:
    """Groups of two tokenisers' tokens: ``a_path`` a byte-level BPE file, ``b_path`` a piece model."""

    def __init__(self, a_path: str, b_path: str):
        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = {c: k for k, c in enumerate(byte_letters())}
        a_bytes = {i: bytes(map(byte.__getitem__, n)) for n, i in model["vocab"].items()}
        # where ids are in the order of merges they serve as ranks; no special token is among them
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merged != sorted(set(merged)) or len(a_bytes) != len(byte) + len(merged):
            raise ValueError(f"{a_path}: ids are not in the order of merges")
        self.a = Encoding("a", pat_str=BYTE_PATTERN, mergeable_ranks={b: i for i, b in a_bytes.items()}, special_tokens={})
        self.b = SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = (list(map(str, range(len(x)))) for x in (self.a_bytes, self.b_bytes))
        self.parts = not any(MARK in p[1:] and p.strip(MARK) for p in pieces)
        self.kept: dict[str, tuple] = {}

    def chunks(self, text: str) -> list[str]:
        """``text`` cut where both sides part, each chunk without its first space."""
        return (PART.split(text) if self.parts else [text]) if text else []

    def groups(self, text: str) -> list[tuple[list[int], list[int]]]:
        """(A ids, B ids) of each group."""
        chunks = self.chunks(text)
        self.learn(set(chunks))
        if any(self.kept[c][0] is None for c in chunks):
            return []
        return [tuple([int(i) for i in side.split(",")] for side in g.split("|")) for c in chunks for g in self.kept[c][4].split(";")]

    def learn(self, chunks: set[str]) -> None:
        """Keep what documents need of each chunk: A's, B's tokens, groups, links, the groups' text, the links' pairs."""
        if len(self.kept) + len(chunks) > KEPT:
            self.kept.clear()
        new = [c for c in chunks if c not in self.kept]
        for at in range(0, len(new), AT_ONCE):
            some = new[at : at + AT_ONCE]
            a, b = [self.a.encode_ordinary(" " + c) for c in some], self.b.encode(some, num_threads=1)
            raw = [b" " + c.encode() for c in some]
            whole = b"".join(raw)
            if b"".join([self.a_bytes[i] for x in a for i in x]) != whole or b"".join([self.b_bytes[i] for x in b for i in x]) != whole:
                same = [b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(a, b, raw, strict=True)]
                self.kept.update((c, (None,) * 7) for c, s in zip(some, same, strict=True) if not s)
                some, a, b, raw = (list(compress(x, same)) for x in (some, a, b, raw))
            if some:
                self.kept.update(zip(some, self.records(a, b, np.cumsum(list(map(len, raw)))), strict=True))

    def records(self, a: list[list[int]], b: list[list[int]], ends: np.ndarray) -> Iterator[tuple]:
        """One for each chunk, of its tokens ``a`` and ``b``; ``ends`` are the chunks' in the bytes of all."""
        a_ids, b_ids = (np.fromiter(chain.from_iterable(x), np.int64) for x in (a, b))
        labels = labelled(int(ends[-1]), np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids]))
        size, n, m = spans(labels).T
        # a chunk ends in a byte where both end, so groups lie in one chunk each
        group_end = np.searchsorted(np.cumsum(size), ends) + 1
        a_at, b_at = np.cumsum(n) - n, np.cumsum(m) - m
        links = n * m
        many = np.flatnonzero(links > MANY)
        dealt = np.where(links > MANY, 0, links)
        group = np.repeat(np.arange(len(n)), dealt)
        inner = np.arange(len(group)) - (np.cumsum(dealt) - dealt)[group]
        pairs = (WIDE * a_ids[a_at[group] + inner // m[group]] + b_ids[b_at[group] + inner % m[group]]).astype(np.uint32).tobytes()
        pair_end = 4 * np.cumsum(dealt)
        x, y = [self.a_name[i] for i in a_ids.tolist()], [self.b_name[i] for i in b_ids.tolist()]
        texts = [f"{x[i]}|{y[j]}" if p == q == 1 else f"{','.join(x[i : i + p])}|{','.join(y[j : j + q])}" for i, p, j, q in zip(a_at.tolist(), n.tolist(), b_at.tolist(), m.tolist(), strict=True)]
        g, p = 0, 0
        for of_a, of_b, to, link_sum, pair_to in zip(a, b, group_end.tolist(), np.add.reduceat(links, [0, *group_end[:-1]]).tolist(), pair_end[group_end - 1].tolist(), strict=True):
            large = [self.distinct(a_ids[a_at[k] : a_at[k] + n[k]], b_ids[b_at[k] : b_at[k] + m[k]]) for k in many if g <= k < to] if len(many) else ()
            yield len(of_a), len(of_b), to - g, link_sum, ";".join(texts[g:to]), pairs[p:pair_to], large
            g, p = to, pair_to

    @staticmethod
    def distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of a large group, each once, and how often each occurs."""
        (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
        return (WIDE * x[:, None] + y).ravel(), (n[:, None] * m).ravel()

    def document(self, chunks: list[str]) -> tuple | None:
        """n_a, n_b, n_groups, n_links, the groups' hash, distinct pairs in order, how often each occurs."""
        a, b, groups, links, texts, raw, large = zip(*map(self.kept.__getitem__, chunks), strict=True)
        if None in a:
            return None
        pairs, n = np.unique(np.frombuffer(b"".join(raw), np.uint32), return_counts=True)
        if extra := [x for some in large for x in some]:
            every, times = np.concatenate([pairs, *(p for p, _ in extra)]), np.concatenate([n, *(t for _, t in extra)])
            pairs, at = np.unique(every, return_inverse=True)
            n = np.bincount(at, times).astype(np.int64)
        return sum(a), sum(b), sum(groups), sum(links), hashlib.sha256(";".join(texts).encode()).hexdigest(), pairs, n


@lru_cache(1)
def aligner_of(a_path: str, b_path: str) -> Aligner:
    """One for each worker; what it keeps has a bound and serves its later tasks."""
    return Aligner(a_path, b_path)


def packed(pairs: np.ndarray, n: np.ndarray) -> bytes:
    """Pairs as steps in order, then how often each occurs."""
    small = int(n.max(initial=0) < 256)
    raw = np.diff(pairs.astype(np.int64), prepend=0).astype(np.uint32).tobytes() + n.astype(np.uint8 if small else np.uint32).tobytes()
    return bytes([small]) + zstandard.compress(raw, 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    small, raw = raw[0], zstandard.decompress(raw[1:])
    size = len(raw) // (5 if small else 8)
    return np.cumsum(np.frombuffer(raw, np.uint32, size), dtype=np.int64), np.frombuffer(raw, np.uint8 if small else np.uint32, size, 4 * size).astype(np.int64)


def linked(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document, with its counts and its links' ``pairs``, packed (null without tokens)."""
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()), ("pairs", pa.binary())])

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            aligner = aligner_of(a_path, b_path)
            for start, end in slices(batch.column(1), 1 << 20):
                parts = [aligner.chunks(t) for t in batch.column(1)[start:end].to_pylist()]
                aligner.learn({c for p in parts for c in p})
                rows = []
                for p in parts:
                    found = aligner.document(p) if p else None
                    rows.append((0, 0, 0, 0, "", None) if found is None else (*found[:5], packed(*found[5:])))
                for c in {c for p in parts for c in p if len(c) > LONGEST}:
                    del aligner.kept[c]
                yield pa.RecordBatch.from_arrays([batch.column(0)[start:end], *(pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)
        release()

    batches(docs.sparkSession, 500)
    return texts_of(docs).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary")


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold each pair of ids linked."""

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            pairs, n = np.unique(np.concatenate([unpacked(r)[0] for r in batch.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n)], ["pair", "n"])
        release()

    return documents.where("pairs is not null").select("pairs").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def a_of(pair: str) -> Column:
    return F.floor(F.col(pair) / WIDE)


def with_best(counts: DataFrame) -> DataFrame:
    """``counts`` with whether a pair's count is the highest of its A id; ids are at most 65,536."""
    top = counts.groupBy(a_of("pair").alias("__a")).agg(F.max("n").alias("__top"))
    return counts.join(F.broadcast(top), a_of("pair") == F.col("__a")).select("pair", "n", (F.col("n") == F.col("__top")).alias("best"))


def sums(documents: DataFrame, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(row, n_best, count_sum) over those links of ``documents`` (row, pairs) that are in ``table``: pairs in order, their counts, whether best."""
    shared = documents.sparkSession.sparkContext.broadcast(table)

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = shared.value
        for batch in given:
            out = []
            for raw in batch.column(1).to_pylist():
                pairs, n = unpacked(raw)
                at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                n = n * (known[at] == pairs)
                out.append((int(n @ best[at]), int(n @ count[at])))
            best_n, sum_n = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best_n, pa.int64()), pa.array(sum_n, pa.int64())], ["row", "n_best", "count_sum"])
        release()

    return documents.mapInArrow(run, "row long, n_best long, count_sum long")


def dealt(documents: DataFrame, parts: int) -> DataFrame:
    """``documents`` (row, pairs) with each one's pairs dealt to slices, in a folder for each, so that a slice is read alone."""

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            for row, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pairs, n = unpacked(raw)
                own = pairs % parts
                some = [(int(k), packed(pairs[own == k], n[own == k])) for k in np.unique(own)]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(some), pa.int64()), pa.array([p for _, p in some], pa.binary()), pa.array([k for k, _ in some], pa.int32())], ["row", "pairs", "slice"])
        release()

    spark, path = documents.sparkSession, f"{shared_dir(documents.sparkSession)}/slices-{uuid.uuid4().hex}"
    documents.mapInArrow(run, "row long, pairs binary, slice int").write.partitionBy("slice").parquet(path)
    return spark.read.schema("row long, pairs binary, slice int").parquet(path)


def align(docs: DataFrame, a_path: str, b_path: str, slice_pairs: int = SLICE) -> DataFrame:
    """n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document's alignment."""
    documents = written(linked(docs, a_path, b_path).withColumn("row", F.monotonically_increasing_id()), "linked")
    counts = written(with_best(written(pair_counts(documents), "pair-counts")), "pairs")
    parts = -(-counts.count() // slice_pairs)
    have = documents.where("pairs is not null").select("row", "pairs")
    if parts > 1:
        have = dealt(have, parts)
    found = None
    for k in range(parts):
        some = counts.where(F.pmod("pair", F.lit(parts)) == k).toArrow().sort_by("pair")
        part = sums(have if parts == 1 else have.where(F.col("slice") == k).select("row", "pairs"), tuple(some.column(c).to_numpy() for c in ("pair", "n", "best")))
        found = part if found is None else found.unionByName(part)
    if found is None:
        return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"), "groups_sha256")
    total = found.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return documents.join(total, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
