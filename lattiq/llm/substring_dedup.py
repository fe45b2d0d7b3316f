"""Operator 2: repeated passages by MinHash banding of paragraphs.

Paragraphs, lines of at least ``MIN_WORDS`` words, are sketched by bands of ``ROWS``
values, as many as the recall asked for needs. Those that share a band are joined,
the exact Jaccard similarity of their five-word shingles confirms links, and
components of links are clusters.

What repeats inside longer lines or over several short ones is found by windows of
``MIN_WORDS`` words over the whole text, wherever its lines end. They start where the
hash of five words, a MinHash value of the text around, is the lowest of ``STEP``
starts in a row, so any two texts with the same ``MIN_WORDS + STEP - 1`` = 51 words in a
row have an equal window. Equal windows are one cluster; edited ones are not linked.

Of a cluster the occurrence with the lowest (doc_id, start) stays, the others are to be
removed. Windows of a document that repeat the same document and overlap are one
run; up to ``STEP - 1`` words at either end of a repeat may stay outside it.

Only clusters with two documents count, unless ``within`` asks for repeats inside one
document too. Null and empty texts have no paragraphs. Documents without a repeated
passage have no row. Rows that share a doc_id are one document. Rows with a null
doc_id are left out. Of equal places the first counts. Very long texts are read whole,
one at a time. An empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import hot_and_cold, join_hot, map_texts, small, written
from lattiq.llm.links import link
from lattiq.llm.shingles import Sets, Words, band_keys, rolled, sets_by, sketches, words_of

#: Shorter paragraphs are too common to be passages; those of over 50 words are well within.
MIN_WORDS, ROWS, RECALL = 32, 2, 0.998
#: Of so many starts in a row at least one has a window.
STEP = 20


def bands_for(similarity: float, rows: int = ROWS, recall: float = RECALL) -> int:
    """The least number of bands that catches a pair at ``similarity`` with chance ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


@dataclass
class Places:
    """The words of a batch of texts, with the line each is in and code points of each byte."""

    words: Words
    points: np.ndarray  # code points before each byte of the batch
    line: np.ndarray  # of each word, counted over the batch
    lines: np.ndarray  # where each line starts, and the end
    first: np.ndarray  # line of each text's start

    @classmethod
    def of(cls, texts: list[str]) -> Places:
        words = words_of(texts)
        points = np.zeros(len(words.raw) + 1, np.int64)
        np.cumsum((words.raw & 0xC0) != 0x80, out=points[1:])
        lines = np.concatenate(([0], np.flatnonzero(words.raw == 10) + 1, [len(words.raw) + 1]))
        find = lambda at: np.searchsorted(lines, at, "right") - 1
        return cls(words, points, find(words.starts), lines, find(words.begins))

    def long_lines(self, least: int) -> tuple[dict[str, np.ndarray], Sets]:
        """text, paragraph, last, start and end of each line with at least ``least`` words, and its shingles."""
        sizes = np.bincount(self.line, minlength=len(self.lines) - 1)
        which = np.flatnonzero(sizes >= max(1, least))
        number = np.full(len(sizes), -1)
        number[which] = np.arange(len(which))
        mine = number[self.line] >= 0
        own = np.searchsorted(self.words.begins, self.lines[which], "right") - 1
        zero = self.points[self.words.begins[own]]
        at = which - self.first[own]
        found = {"text": own, "paragraph": at, "last": at, "start": self.points[self.lines[which]] - zero, "end": self.points[self.lines[which + 1] - 1] - zero}
        return found, sets_by(self.words.hashes[mine], number[self.line[mine]], len(which))

    def windows(self, least: int) -> dict[str, np.ndarray]:
        """text, paragraph and last (lines of the first and last word), start, end and node (a hash)
        of each window; a window that overlaps an equal one of its text is left out."""
        w = self.words
        at = window_starts(w.hashes, w.item, least)
        h, own = rolled(w.hashes, at, least).view(np.int64), w.item[at]
        order = np.lexsort((at, h, own))
        keep, prev = np.ones(len(at), bool), None
        same = np.zeros(len(at), bool)
        same[1:] = (h[order][1:] == h[order][:-1]) & (own[order][1:] == own[order][:-1])
        for i in np.flatnonzero(same):
            prev = order[i - 1] if not same[i - 1] else prev
            if at[order[i]] < at[prev] + least:
                keep[order[i]] = False
            else:
                prev = order[i]
        at, h, own = at[keep], h[keep], own[keep]
        end, zero = at + least - 1, self.points[w.begins[own]]
        return {"text": own, "paragraph": self.line[at] - self.first[own], "last": self.line[end] - self.first[own], "start": self.points[w.starts[at]] - zero, "end": self.points[w.ends[end]] - zero, "node": h}


SCHEMA = "doc_id long, paragraph long, last long, start long, end long, node long, whole boolean, bands array<long>"


def sketched(docs: DataFrame, percent: int, least: int) -> DataFrame:
    """doc_id, paragraph, last, start, end and node of each long line (``whole``, with its bands) and window."""
    bands = bands_for(percent / 100)

    def make():
        def call(keys, texts):
            places = Places.of(texts)
            found, sets = places.long_lines(least)
            other = places.windows(least)
            keyed = band_keys(sketches(sets, bands * ROWS), bands)
            found["node"] = np.array(sets.nodes(), np.int64)
            n, m = len(found["node"]), len(other["node"])
            rows = {k: np.concatenate((found[k], other[k])) for k in other}
            return {"doc_id": np.asarray(keys, np.int64)[rows.pop("text")]} | rows | {"whole": np.arange(n + m) < n, "bands": [*keyed, *[None] * m]}

        return call

    return map_texts(docs.where("doc_id is not null"), make, SCHEMA)


def window_starts(flat: np.ndarray, item: np.ndarray, least: int, step: int = STEP) -> np.ndarray:
    """Word numbers at which windows start: the lowest hash of five words in each ``step`` starts of one text."""
    n = len(flat) - least + 1
    if n < step:
        return np.zeros(0, np.int64)
    low = np.uint64((1 << 24) - 1)  # a batch of texts has fewer words; of equal hashes the last is taken
    best = (rolled(flat, np.arange(n), min(5, least)) & ~low) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    width = 1
    while width < step:
        more = min(width, step - width)
        best = np.minimum(best[:-more], best[more:])
        width += more
    whole = item[: len(best)] == item[least + step - 2 :]
    return np.unique(n - 1 - (best[whole] & low).astype(np.int64))


def sets_in(docs: DataFrame, least: int) -> DataFrame:
    """node and set of each long line."""

    def make():
        def call(keys, texts):
            sets = Places.of(texts).long_lines(least)[1]
            return {"node": sets.nodes(), "set": [sets.of(i).tobytes() for i in range(len(sets.ends))]}

        return call

    return map_texts(docs, make, "node long, set binary")


def totals(within: bool) -> tuple[Column, Column, Column]:
    """first (doc_id, start, paragraph), n_occurrences and far of the places of a key; several documents (or places) have it if ``spread``."""
    place = F.struct("doc_id", "start", "paragraph")
    # the first place tells the lowest doc_id, so it is not sent a second time
    return F.min(place), F.count(F.lit(1)), F.max(place if within else F.col("doc_id"))


def spread(within: bool) -> Column:
    return F.col("first" if within else "first.doc_id") != F.col("far")


def clusters_of(places: DataFrame, key: str, within: bool) -> DataFrame:
    """key, first (doc_id, start, paragraph) and n_occurrences of the keys that several documents (or places) have."""
    first, n, far = totals(within)
    found = places.groupBy(key).agg(first.alias("first"), n.alias("n_occurrences"), far.alias("far"))
    return found.where(spread(within)).drop("far")


def judged(places: DataFrame, key: str, within: bool) -> DataFrame:
    """The places, of a written table, in clusters, with first_doc_id, first_paragraph, n_occurrences and removed.

    Places are sent once, by key; only those of keys with very many are summed up before they are joined.
    """
    hot, cold = hot_and_cold(places, key)
    own = Window.partitionBy(key)
    first, n, far = (x.over(own) for x in totals(within))
    # dealt before the window, else its structs would be sent as well
    out = cold.repartition(key).select("*", first.alias("first"), n.alias("n_occurrences"), far.alias("far")).where(spread(within)).drop("far")
    if hot:
        out = out.unionByName(join_hot(hot, written(clusters_of(hot, key, within), "clusters"), key, "n_occurrences"))
    gone = F.struct("doc_id", "start", "paragraph") != F.col("first")
    return out.select("doc_id", "paragraph", "last", "start", "end", F.col("first.doc_id").alias("first_doc_id"), F.col("first.paragraph").alias("first_paragraph"), "n_occurrences", gone.alias("removed"), key)


def repeated_lines(docs: DataFrame, made: DataFrame, percent: int, least: int, within: bool) -> DataFrame:
    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = small(written(wanted, "wanted"))
        ids = made.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
        mine = docs.join(small(written(ids, "ids")), "doc_id", "left_semi")
        return sets_in(mine, least).join(wanted, "node", "left_semi").dropDuplicates(["node"])

    labels = link(made.select("node", "bands"), sets_of, percent)
    # lines alone in their cluster are out first, by one number a line
    nodes = made.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    nodes = nodes.join(small(labels), "node", "left").where("size > 1 or comp is not null")
    nodes = written(nodes.select("node", F.coalesce("comp", "node").alias("cluster"), "size"), "repeated")
    places = written(join_hot(made.drop("bands", "whole"), nodes, "node", "size").drop("node", "size"), "places")
    return judged(places, "cluster", within).drop("last", "cluster")


def repeated_windows(made: DataFrame, lines: DataFrame, within: bool) -> DataFrame:
    """Runs of windows that repeat and that no line of ``lines`` tells."""
    found = judged(made.drop("bands", "whole"), "node", within)
    # what a removed line holds is gone, and a place that stays in a line that stays is told by the line
    told = small(lines.select("doc_id", "paragraph", F.col("paragraph").alias("last"), F.col("removed").alias("gone")))
    same = [found[c] == told[c] for c in ("doc_id", "paragraph", "last")]
    return runs(found.join(told, [*same, told["gone"] | ~found["removed"]], "left_anti"))


def runs(found: DataFrame) -> DataFrame:
    """Windows of a document that repeat the same document (or are both first) and overlap, as one row."""
    own = Window.partitionBy("doc_id", "first_doc_id", "removed").orderBy("start", "end")
    reached = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("start") > reached).cast("int"), F.lit(1))
    each = found.withColumn("run", F.sum(new).over(own))
    return each.groupBy("doc_id", "first_doc_id", "removed", "run").agg(F.min("paragraph").alias("paragraph"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("first_paragraph").alias("first_paragraph"), F.max("n_occurrences").alias("n_occurrences")).drop("run")


def repeated_passages(docs: DataFrame, percent: int = 75, least: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """doc_id, paragraph, start, end (code points), first_doc_id and first_paragraph of the
    cluster, n_occurrences and removed, of every line that is not alone in its cluster, then
    the same of runs of windows that no such line tells; a run's paragraph is the line it
    starts in, its n_occurrences the most of its windows. Runs may overlap."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = written(sketched(docs, percent, least), "paragraphs")
    lines = written(repeated_lines(docs, made.where("whole"), percent, least, within), "lines")
    return lines.unionByName(repeated_windows(made.where("not whole"), lines, within))


def cut_spans(text: str, spans: list | None) -> str:
    """``text`` without the spans (start, end); a line that is cut whole goes with its line end."""
    if not spans:
        return text
    marks = np.zeros(len(text) + 1, bool)
    for start, end in spans:
        marks[start:end] = True
    kept, at = [], 0
    for line in text.split("\n"):
        gone = marks[at : at + len(line)]
        if not (gone.all() if line else marks[at]):
            kept.append("".join(c for c, g in zip(line, gone, strict=True) if not g) if gone.any() else line)
        at += len(line) + 1
    return "\n".join(kept)


def without_repeats(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """doc_id and text of each document, its removed paragraphs cut out with their line ends, and its removed windows."""
    cut = repeats.where("removed").groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("cut"))
    left = F.udf(cut_spans, "string")(F.coalesce("text", F.lit("")), "cut")
    return docs.select("doc_id", "text").join(cut, "doc_id", "left").select("doc_id", left.alias("text"))
