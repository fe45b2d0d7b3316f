"""Word shingle sets and their sketches, for whole batches of items at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash

ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words of more bytes are hashed one by one.
LONG = 48
#: A random number for each byte.
OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
PRIME = np.uint64(0x100000001B3)


@dataclass
class Words:
    """The words of a batch of texts, parted by white space x20 and x09-x0D, A-Z lower-cased:
    their hashes, which text each is of, and where it starts and ends in ``raw``, the texts
    in UTF-8 as they are, with a line end between two."""

    raw: np.ndarray
    begins: np.ndarray  # of each text in ``raw``
    hashes: np.ndarray
    item: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def words_of(texts: list[str]) -> Words:
    encoded = [t.encode() for t in texts]
    whole = b"\n".join(encoded)
    raw, low = np.frombuffer(whole, np.uint8), np.frombuffer(whole.lower(), np.uint8)
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sizes = ends - starts
    h = mix(sizes.astype(np.uint64) + ODD)
    on, at = np.flatnonzero(sizes <= LONG), 0
    while len(on):  # byte after byte of all words that have one
        h[on] = (h[on] ^ OF_BYTE[low[starts[on] + at]]) * PRIME
        h[on] ^= h[on] >> np.uint64(29)
        at += 1
        on = on[sizes[on] > at]
    for i in np.flatnonzero(sizes > LONG):
        h[i] = xxhash.xxh64_intdigest(low[starts[i] : ends[i]].tobytes())
    lengths = np.fromiter((len(t) + 1 for t in encoded), np.int64, len(encoded))
    begins = np.cumsum(lengths) - lengths
    return Words(raw, begins, mix(h), np.searchsorted(begins, starts, "right") - 1, starts, ends)


@dataclass
class Sets:
    """Sets of distinct 64-bit shingle hashes; item i has values[ends[i-1]:ends[i]], ascending."""

    values: np.ndarray
    ends: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.ends, prepend=0)

    def of(self, i: int) -> np.ndarray:
        return self.values[self.ends[i - 1] if i else 0 : self.ends[i]]

    def nodes(self) -> list[int | None]:
        """64 bits of a hash of each set: equal sets, equal nodes; None for the empty set."""
        sizes = self.sizes
        some = np.flatnonzero(sizes > 0)
        out: list[int | None] = [None] * len(sizes)
        if len(some):
            sums = np.add.reduceat(mix(self.values ^ ODD), (self.ends - sizes)[some])
            for i, n in zip(some.tolist(), mix(sums + sizes[some].astype(np.uint64)).view(np.int64).tolist(), strict=True):
                out[i] = n
        return out


def shingle_sets(texts: list[str], width: int = 5) -> Sets:
    """Distinct ``width``-word shingles of each text; a text with fewer words is one
    shingle, one without any has none."""
    words = words_of(texts)
    return sets_by(words.hashes, words.item, len(texts), width)


def rolled(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` words from each place ``at`` on."""
    h = np.zeros(len(at), np.uint64)
    for k in range(width):
        h = (h + flat[at + k]) * (PRIME + np.uint64(2 * k))
    return mix(h)


def sets_by(flat: np.ndarray, item: np.ndarray, count: int, width: int = 5) -> Sets:
    """Distinct shingles of each of ``count`` items, whose words stand together in ``flat``."""
    n = len(flat)
    sizes = np.bincount(item, minlength=count) if n else np.zeros(count, np.int64)
    parts, owners = [], []
    if n >= width:
        whole = np.flatnonzero(item[: n - width + 1] == item[width - 1 :])
        parts.append(rolled(flat, whole, width))
        owners.append(item[whole])
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    if len(short):
        first = np.searchsorted(item, short)
        h, left = np.full(len(short), ODD), sizes[short]
        for k in range(width - 1):
            on = left > k
            h[on] = (mix(h[on]) + flat[first[on] + k]) * PRIME
        parts.append(mix(h + left.astype(np.uint64)))
        owners.append(short)
    if not parts:
        return Sets(np.zeros(0, np.uint64), np.zeros(count, np.int64))
    h, own = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((h, own))
    h, own = h[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return Sets(h[new], np.cumsum(np.bincount(own[new], minlength=count)))


def sketches(sets: Sets, size: int = 128) -> np.ndarray:
    """Fast similarity sketches: (items, size) values.

    Round i of the first ``size`` rounds hashes every element to one of the
    bins, later round size + b puts all in bin b, and a bin keeps its lowest
    (round, hash); so all bins fill after 2 * size rounds at most, after one or
    two for sets larger than ``size``, and estimates concentrate as if each
    coordinate were drawn apart. An item leaves the rounds once its bins are full.
    """
    count = len(sets.ends)
    out = np.full((count, size), np.iinfo(np.uint64).max, np.uint64)
    flat, empty = out.reshape(-1), np.iinfo(np.uint64).max
    item = np.repeat(np.arange(count), sets.sizes)
    values = sets.values
    for i in range(2 * size):
        if not len(values):
            break
        v = mix(values + np.uint64(int(ODD) * (i + 1) % (1 << 64)))
        bins = (v % np.uint64(size)).astype(np.int64) if i < size else i - size
        np.minimum.at(flat, item * size + bins, (v >> np.uint64(9)) | np.uint64(i) << np.uint64(55))
        full = (out != empty).all(1)
        stay = ~full[item]
        values, item = values[stay], item[stay]
    return out


def band_keys(sketch: np.ndarray, bands: int) -> np.ndarray:
    """(items, bands) keys as signed integers: equal where all rows of a band are."""
    parts = sketch.reshape(len(sketch), bands, sketch.shape[1] // bands)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64) * ODD), parts.shape[:2]).copy()
    for r in range(parts.shape[2]):
        key = mix(key * np.uint64(0x100000001B3) + parts[:, :, r])
    return key.view(np.int64)
