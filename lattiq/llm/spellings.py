"""Operator 11: spelling variants by letter-parity bitmask bands.

A word's mask holds one bit a letter: whether the letter occurs an odd number of
times. One edit flips at most two bits, so of three bands of the mask one is equal
at least, and two are where a letter was added or taken away, which flips one bit.
Words of equal bands and of lengths that fit are joined; masks and then the words
themselves verify. An edit leaves the first or the second half of the shorter word
untouched: buckets are split by the half that two words share, so words of a frequent
band never meet in one task. A bucket that is still large is split by what is left of
a word without one letter, which words one edit apart share.

Null and empty texts have no words; a null doc_id counts as an empty string. Repeated
rows count each time. An empty table gives no words; extra columns are left out. Texts
and words of any length are read whole. Of near words with equal counts the smallest in
code-point order is the form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import batches, release, small, written

#: The contract's words: runs of these letters, of which A-Z alone are lower-cased (fixed values).
LETTERS = "a-zÀ-ÿ"
RUN = re.compile(f"[{LETTERS}]+")
#: One occurrence in so many loses a letter; the least code points and occurrences of a word (fixed values).
SPOILT, LEAST_CHARS, LEAST_COUNT = 97, 5, 3
#: Different words that a task holds before it hands on their counts.
HELD = 200_000
BANDS, BAND_BITS = 3, 21
#: Words of a bucket beyond which it is split once more.
BUCKET = 256


def occurrences(docs: DataFrame) -> DataFrame:
    """(word, n): how often each result of at least LEAST_CHARS code points occurs."""

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in given:
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = zlib.crc32(f"{'' if key is None else key}:".encode())
                # bytes.lower() changes A-Z alone
                for word, n in Counter(RUN.findall(text.encode().lower().decode())).items():
                    if len(word) < LEAST_CHARS:
                        continue
                    h = zlib.crc32(word.encode(), start)
                    if h % SPOILT == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < LEAST_CHARS:
                            continue
                    held[word] += n
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        release()

    batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text is not null")
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters_of(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def bits(words: DataFrame) -> dict[str, int]:
    """Each letter's place in the mask. Letters that split the words best are dealt first,
    so the bands tell about as many words apart; at most 90 letters come to the driver."""
    total = max(1, words.count())
    seen = words.select(F.explode(F.array_distinct(letters_of(F.col("word")))).alias("c")).groupBy("c").count().collect()
    best = sorted(seen, key=lambda r: (abs(r["count"] / total - 0.5), r["c"]))
    return {r["c"]: BAND_BITS * (k % BANDS) + k // BANDS % BAND_BITS for k, r in enumerate(best)}


def masks(words: DataFrame) -> DataFrame:
    """``words`` with their mask: BAND_BITS bits for each of BANDS bands. Beyond 63 letters the rarest share bits."""
    at = bits(words)
    if not at:
        return words.withColumn("mask", F.lit(0).cast("long"))
    bit = F.create_map(*(F.lit(x) for c, k in at.items() for x in (c, 1 << k)))
    mask = F.aggregate(letters_of(F.col("word")), F.lit(0).cast("long"), lambda m, c: m.bitwiseXOR(F.element_at(bit, c).cast("long")))
    return words.withColumn("mask", mask)


def band(mask: Column, k: int) -> Column:
    return F.shiftright(mask, BAND_BITS * k).bitwiseAND(F.lit((1 << BAND_BITS) - 1))


def keyed(words: DataFrame) -> DataFrame:
    """A row for each band, half and role of a word. ``own`` rows meet words of the same
    length and those with one letter more; the latter come in rows with ``own`` false."""
    word, size = F.col("word"), F.length("word")

    def rows(own: bool) -> list[Column]:
        short = size if own else size - 1
        first = F.floor(short / 2).cast("int")
        halves = ((0, F.substr(word, F.lit(1), first)), (1, F.substr(word, first + (1 if own else 2), short - first)))
        return [F.struct(F.lit(k).alias("k"), F.lit(side).alias("side"), F.lit(own).alias("own"), F.xxhash64(F.lit(k), F.lit(side), short, band(F.col("mask"), k), half).alias("key")) for k in range(BANDS) for side, half in halves]

    return words.select("word", "n", "mask", F.explode(F.array(*rows(True), *rows(False))).alias("r")).select("word", "n", "mask", "r.*")


def met(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of one bucket that verify. A pair that shares several bands or both halves comes from the first."""
    a, b = left.alias("a"), right.where("own").alias("b")
    flips = F.bit_count(F.col("a.mask").bitwiseXOR(F.col("b.mask")))
    size = F.length("b.word")
    first = F.floor(size / 2).cast("int")
    longer = F.when(F.col("a.own"), 0).otherwise(1)
    again = F.lit(False)
    for k in range(1, BANDS):
        again = again | ((F.col("a.k") >= k) & (band(F.col("a.mask"), k - 1) == band(F.col("b.mask"), k - 1)))
    same_first = F.substr(F.col("a.word"), F.lit(1), first) == F.substr(F.col("b.word"), F.lit(1), first)
    return (
        a.join(b, F.col("a.key") == F.col("b.key"))
        .where((flips <= 2 - longer) & (F.length("a.word") == size + longer) & (F.col("a.k") == F.col("b.k")) & (F.col("a.side") == F.col("b.side")))
        .where((~F.col("a.own") | (F.col("a.word") < F.col("b.word"))) & ~again & ~((F.col("a.side") == 1) & same_first))
        .where(F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1)
        .select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))
    )


def without_each(word: Column) -> Column:
    """The different strings that ``word`` becomes without one letter, hashed."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.xxhash64(F.concat(F.substr(word, F.lit(1), i - 1), F.substr(word, i + 1)))))


def near_pairs(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, a_n, b, b_n), once for each two of ``words`` (word, n) that are one edit apart."""
    rows = keyed(masks(words))
    large = written(rows.where("own").groupBy("key").count().where(F.col("count") > bucket).select("key"), "large")
    if not large.limit(1).count():
        return met(rows, rows)
    large = small(large)
    rest = rows.join(large, "key", "left_anti")
    # in a large bucket: words of one length share what is left without a letter, a longer one without it is the other word
    hot = rows.join(large, "key", "left_semi")
    own = hot.where("own").select("*", F.explode(without_each(F.col("word"))).alias("left"))
    again = [own.withColumn("key", F.xxhash64("key", F.lit(0), "left")).drop("left")]
    again.append(hot.where("own").withColumn("key", F.xxhash64("key", F.lit(1), F.xxhash64("word"))).withColumn("own", F.lit(True)))
    longer = hot.where("not own").select("*", F.explode(without_each(F.col("word"))).alias("left")).withColumn("key", F.xxhash64("key", F.lit(1), "left")).drop("left")
    return met(rest, rest).unionByName(met(again[0], again[0]).unionByName(met(longer, again[1])).distinct())


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each of ``forms`` (word, form): the last word that forms lead to.

    Forms occur twice as often as their words at least, so there are no loops, and
    each round doubles how far a word has come: a few rounds are enough.
    """
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("__from"), F.col("root").alias("__to"))
        step = at.join(on, F.col("root") == F.col("__from"), "left")
        if not step.where("__to is not null").limit(1).count():
            return at
        at = written(step.select("word", F.coalesce("__to", "root").alias("root")), "roots")


def variants(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """A row for each word of ``docs`` (doc_id, text): word, n, form, form_n, n_near, root.

    ``form`` is the most frequent near word if it occurs twice as often at least.
    """
    words = written(occurrences(docs).where(F.col("n") >= LEAST_COUNT), "words")
    pairs = near_pairs(words, bucket)
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("least"), F.col("b").alias("form")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("least"), F.col("a").alias("form")).alias("near")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    named = words.join(best, "word", "left").withColumn("is_form", -F.col("near.least") >= 2 * F.col("n"))
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("is_form"), F.col("near.form")).alias("form"), F.when(F.col("is_form"), -F.col("near.least")).alias("form_n")), "named")
    return named.join(roots(named.where("form is not null")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
