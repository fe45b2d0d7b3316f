"""Operator 10: near-duplicate documents by fast similarity sketching.

A document's set of five-word shingles is sketched by rounds of hashed bin
placement, documents with equal sets become one node, nodes that share a band
are candidates, and links are confirmed on full sets recomputed from whole texts.

Null, empty and wordless texts have an empty set and are linked with nothing.
Rows with equal texts form one group, and a row's component is that of its own
text. A null doc_id is linked with nothing, gets a null component and is kept.
Very long texts are sketched whole, one at a time. An empty table gives no rows.
Extra columns are left out. Shingles are compared as 64-bit hashes. Of a component's
rows the lowest doc_id stays, and all rows that share it.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import join_hot, map_texts, written
from lattiq.llm.links import link
from lattiq.llm.shingles import band_keys, shingle_sets, sketches

#: At similarity 0.75 a pair shares no band of 32 with a chance of 5e-6.
BANDS, ROWS = 32, 4


def sketch(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (Spark's xxhash64 of the text), n_shingles, node (digest of the set, null if empty) and bands."""

    def make():
        def call(keys, texts):
            sets = shingle_sets(texts)
            keyed = band_keys(sketches(sets, bands * rows), bands)
            sizes = sets.sizes
            th = np.array([xxhash.xxh64_intdigest(t.encode(), 42) for t in texts], np.uint64).view(np.int64)
            return {"doc_id": keys, "th": th, "n_shingles": sizes, "node": sets.nodes(), "bands": [k if n else [] for k, n in zip(keyed, sizes, strict=True)]}

        return call

    return map_texts(docs, make, "doc_id long, th long, n_shingles long, node long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """node and set of each text with words."""

    def make():
        def call(keys, texts):
            sets = shingle_sets(texts)
            return {"node": sets.nodes(), "set": [sets.of(i).tobytes() for i in range(len(texts))]}

        return call

    return map_texts(docs, make, "node long, set binary").where("node is not null")


def grouped(docs: DataFrame, percent: int = 75, null_ids: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): doc_id, th, n_shingles and node of each row, and the component comp, named by
    one of its nodes, of each node with its lowest doc_id. Rows with a null doc_id take part if ``null_ids``."""
    made = written(sketch(docs), "sketch")
    own = made.where("node is not null" if null_ids else "node is not null and doc_id is not null")
    nodes = own.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min(F.struct("th", "bands")).alias("x")).select("node", "doc_id", "x.*")
    nodes = written(nodes, "nodes")

    def sets_of(wanted: DataFrame) -> DataFrame:
        texts = nodes.join(wanted, "node", "left_semi").select("th")
        mine = docs.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
        return full_sets(mine.join(texts, "th", "left_semi")).dropDuplicates(["node"])

    labels = link(nodes.select("node", "bands"), sets_of, percent)
    nodes = nodes.join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))
    return made.drop("bands"), written(nodes, "groups")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each document."""
    made, nodes = grouped(docs, percent)
    lowest = written(nodes.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("size")), "lowest")
    nodes = written(join_hot(nodes, lowest, "comp", "size").select("node", "component_id"), "components")
    linked = F.col("node").isNotNull() & F.col("doc_id").isNotNull()
    rows = made.where(linked).groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    nodes = written(nodes.join(rows, "node"), "sized")
    out = join_hot(made.where(linked), nodes, "node", "size").drop("size").unionByName(made.where(~linked).withColumn("component_id", F.col("doc_id")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def spare_rows(docs: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, th) of the rows that a pass for one text a group leaves out: those of a component but
    the one with the lowest doc_id (null last) and hash of its text. No text goes for its doc_id alone."""
    made, nodes = grouped(docs, percent, null_ids=True)
    made = made.where("node is not null")
    rows = written(made.groupBy("node").agg(F.count(F.lit(1)).alias("size")).join(nodes.select("node", "comp"), "node"), "sized")
    named = written(join_hot(made.select("doc_id", "th", "node"), rows, "node", "size").select("doc_id", "th", "comp"), "named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    first = written(named.groupBy("comp").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1"), "first")
    return join_hot(named, first, "comp", "size").where(order != F.col("first")).select("doc_id", "th").distinct()


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, sh FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT x, y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id WHERE 100 * c >= 75 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, both_ways.y FROM r JOIN both_ways ON r.b = both_ways.x),
m AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.a
"""
