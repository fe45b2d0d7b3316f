"""Similarity links within band buckets, verified exactly, without all pairs of a bucket.

A bucket's members are first compared with one of them. Members in one component
need no further comparison. Members of buckets that hold several components are
open, and pairs of these are found exactly by their sets' rarest elements: two
sets at the similarity asked for share an element of their prefixes in any common
order, and the place of the first shared one bounds their overlap. So parts that
very many texts share lead to no pairs, though they lead to common bands. Within
a prefix element's bucket again only members of different components are
compared, all members of a bucket of up to WHOLE at once, SLOTS at a time of a
larger one, until every member has been a centre: no link between components of a
bucket is lost, at a number of rows linear in the members for each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import batches as small_batches
from lattiq.llm.common import hot_and_cold, join_hot, release, small, written
from lattiq.llm.components import components

#: Members of a bucket that are all centres at once, centres of a larger one in a round, and pairs that share one copy of their centre's set.
WHOLE, SLOTS, SHARED = 256, 64, 128
#: Later rounds, when most members are in one component, take so many times more centres.
LATER = 8
#: Counters of the frequency sketch, and the slices in which they travel.
COUNTERS, SLICES = 1 << 18, 64


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union.

    A centre with many partners is dealt in parts of about SHARED pairs, each with
    one copy of its set, read in a stream: a task holds one centre's set at a time.
    """
    n = written(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARED), "shared")
    dealt = pairs.join(small(n), "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / SHARED)), F.lit(0)).alias("part"))
    dealt = written(dealt, "pairs")
    members = dealt.join(sets.select(F.col("node").alias("b"), "set"), "b").select("a", "part", "b", "set")
    heads = dealt.select("a", "part").distinct().join(sets.select(F.col("node").alias("a"), "set"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "set")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            kept: list[tuple[int, int]] = []
            a, part, b, blobs = (batch.column(i) for i in range(4))
            for x, p, y, blob in zip(a.to_pylist(), part.to_pylist(), b.to_pylist(), blobs, strict=True):
                if at != (x, p):
                    at, heads = (x, p), []
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                if y is None:
                    heads.append(own)
                    continue
                for head in heads:
                    small, large = min(len(own), len(head)), max(len(own), len(head))
                    if 100 * small < percent * large:
                        continue
                    both = len(np.intersect1d(own, head, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(head) - both):
                        kept.append((x, y))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])
        release()

    ordered = members.unionByName(heads).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return ordered.mapInArrow(run, "a long, b long").distinct()


def frequencies(sets: DataFrame) -> np.ndarray:
    """A sketch of fixed size of how many sets hold an element, by its hash.

    Any order of elements is right for prefixes; this one puts the frequent last.
    Tasks add up their own counts, which travel in slices and are summed by slice.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                total += np.bincount(counter(np.frombuffer(blob.as_buffer(), np.uint64)), minlength=COUNTERS)
        parts = np.split(total, SLICES)
        some = [i for i, p in enumerate(parts) if p.any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([parts[i].tobytes() for i in some], pa.binary())], ["slice", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(c, np.int64) for c in frame["counts"])
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "counts": [total.tobytes()]})

    shape = "slice int, counts binary"
    out = np.zeros((SLICES, COUNTERS // SLICES), np.int64)
    for r in sets.select("set").mapInArrow(count, shape).groupBy("slice").applyInPandas(add, shape).collect():  # SLICES rows
        out[r["slice"]] = np.frombuffer(r.counts, np.int64)
    return out.reshape(-1)


def counter(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """(key, node, n, rest, comp): the elements of each set's prefix, the set's size, how many elements follow, the element included, and its comp."""
    known = sets.sparkSession.sparkContext.broadcast(frequencies(sets))  # COUNTERS numbers

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = known.value
        for batch in batches:
            keys, nodes, sizes, rests, comps = [], [], [], [], []
            for node, blob, comp in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = np.frombuffer(blob.as_buffer(), np.uint64)
                n = len(own)
                least = -(-percent * n // 100)  # elements that a similar set shares at least
                first = own[np.lexsort((own, counts[counter(own)]))][: n - least + 1]
                keys.append(first.view(np.int64))
                nodes.append(np.full(len(first), node))
                sizes.append(np.full(len(first), n))
                rests.append(n - np.arange(len(first)))
                comps.append(np.full(len(first), comp))
            flat = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (keys, nodes, sizes, rests, comps)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in flat], ["key", "node", "n", "rest", "comp"])
        release()

    return sets.select("node", "set", "comp").mapInArrow(run, "key long, node long, n long, rest long, comp long")


def members_of(keyed: DataFrame) -> DataFrame:
    """key, node and a, the key's lowest node, of each node of the keys that several nodes have. keyed: (node, key), of a written table.

    Nodes are sent once, by key; only those of keys with very many rows are summed up before they are joined.
    """
    hot, cold = hot_and_cold(keyed, "key")
    own = Window.partitionBy("key")
    found = cold.select("key", "node", F.min("node").over(own).alias("a"), F.max("node").over(own).alias("hi")).where("a != hi").drop("hi").distinct()
    if hot:
        lows = hot.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("hi")).where("a != hi").drop("hi")
        found = found.unionByName(hot.join(small(written(lows, "lows")), "key").select("key", "node", "a").distinct())
    return found


def link(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int = 75) -> DataFrame:
    """(node, comp) of the nodes that have a link.

    nodes: (node, bands), of a written table; a node may have several rows with equal
    bands. sets_of: from a frame of wanted (node) to their (node, set), sets as
    ascending 64-bit integers.
    """
    small_batches(nodes.sparkSession, 1000)
    members = written(members_of(nodes.select("node", F.explode("bands").alias("key"))), "members")
    if not members.limit(1).count():
        return nodes.sparkSession.createDataFrame([], "node long, comp long")
    sets = written(sets_of(members.select("node").distinct()), "sets")
    tested = members.where("a != node").select("a", F.col("node").alias("b")).distinct()
    labels = written(components(verified(tested, sets, percent)), "labels")
    named = members.select("key", "node").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("key", "size")
    open_ = join_hot(members.select("key", "node"), written(mixed, "mixed"), "key", "size").select("node").distinct()
    # their component goes with the sets, so it need not be joined to each element
    open_ = open_.join(labels, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    rest = written(sets.join(open_, "node"), "open")
    if not rest.limit(1).count():
        return labels
    return link_exactly(prefixes(rest, percent), rest, labels, percent)


def may_link(x: str, y: str, percent: int) -> Column:
    """Whether two members of a bucket can be similar: the elements from the shared one on are enough of both."""
    least = F.least(f"{x}.rest", f"{y}.rest")
    return least * (100 + percent) >= (F.col(f"{x}.n") + F.col(f"{y}.n")) * percent


def link_exactly(members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """``labels`` with all links among the members of the prefix buckets (key, node, n, rest, and comp by ``labels``)."""
    more = 1
    while True:
        mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("low"), F.count(F.lit(1)).alias("size")).where("lo != hi").select("key", "low", "size")
        # buckets of one component are closed for good, and members that can't
        # link even to the smallest left in their bucket leave it
        fit = F.col("rest") * (100 + percent) >= (F.col("n") + F.col("low")) * percent
        named = written(members.join(mixed, "key").where(fit).drop("low"), "open")
        slot = F.when(F.col("size") <= WHOLE * more, F.col("node")).otherwise(F.pmod(F.xxhash64("node"), F.lit(SLOTS * more)))
        more = LATER
        # of a slot the smallest set: if any links to a member, it does
        centres = named.groupBy("key", slot.alias("slot")).agg(F.min(F.struct("n", "node", "rest", "comp")).alias("c"))
        centres = written(centres.select("key", "c.*"), "centres")
        if not centres.limit(1).count():
            return labels
        # a centre meets all members of its bucket now, and leaves it
        members = named.join(centres, ["key", "node"], "left_anti").select("key", "node", "n", "rest", "comp")
        x, y = centres.alias("x"), named.alias("y")
        both = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.comp") != F.col("y.comp")) & may_link("x", "y", percent))
        pairs = both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        pairs = written(pairs, "more")
        if not pairs.limit(1).count():
            continue
        found = verified(pairs, sets, percent)
        # links between components, then components of components
        for end in ("a", "b"):
            found = found.join(labels.select(F.col("node").alias(end), F.col("comp").alias("c_" + end)), end, "left").withColumn("c_" + end, F.coalesce("c_" + end, end))
        found = written(found.where("c_a != c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "found")
        if found.limit(1).count():
            above = components(found)
            known = labels.join(above.select(F.col("node").alias("comp"), F.col("comp").alias("above")), "comp", "left").select("node", F.coalesce("above", "comp").alias("comp"))
            labels = written(known.unionByName(above.join(labels, "node", "left_anti")), "labels")
            members = members.drop("comp").join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
