"""Operator 3: benchmark decontamination by a prefix-filtered set join, in DataFrame functions only.

A window is 13 consecutive words of an item (the whole item if it has fewer).
Its shingles of three words are ordered by how rare they are in the documents;
as all of a window must be contained, the necessary prefix is its rarest
shingle. Documents join on these shingles, a candidate keeps only if the window
fits by position and length, and containment is verified word by word.

Null, empty and wordless texts and items have no words, windows or hits; rows
that share a doc_id are told apart by their text; repeated rows each get a row.
Overlapping windows hit a word once, and an item counts once however often it
occurs. Very long texts are one array of words each. An empty table of documents
gives no rows, an empty benchmark rows without hits. Extra columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattiq.llm.common import small, written

WINDOW, SHINGLE = 13, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What parts words, in texts of either case and in lower-cased ones.
PARTS_ANY, PARTS_LOW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column, parts: str) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), parts), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def folded(text: Column) -> Column:
    """Lower case without regard to neighbours: sigma, whose small letter depends on them, goes first."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def shingles(low: Column, k: int) -> Column:
    """Hashes of ``k`` consecutive words; positions are those of their first words."""
    if k == 1:
        return F.transform(low, lambda w: F.xxhash64(w))
    each = lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (k - 1)), lambda i: F.xxhash64(*[F.get(ws, i + (j - 1)) for j in range(k)]))
    return let(low, lambda ws: F.when(F.size(ws) >= k, each(ws)).otherwise(F.array().cast("array<bigint>")))


def windows_of(benchmark: DataFrame, window: int) -> DataFrame:
    """win (words joined by spaces), len, items (ids as strings) of each distinct window."""
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(ascii_lower(F.col("text")), PARTS_LOW).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    cut = item.select("item_id", "w", F.explode(starts).alias("s")).select("item_id", F.slice("w", F.col("s"), window).alias("w"))
    return cut.groupBy(F.array_join("w", " ").alias("win")).agg(F.first(F.size("w")).alias("len"), F.array_sort(F.collect_set("item_id")).alias("items"))


def hits(docs: DataFrame, wins: DataFrame, k: int) -> DataFrame:
    """doc_id, th (hash of the text), start, len, items of every occurrence of a window; all windows have ``k`` words at least."""
    # Folding letter by letter maps words that are equal but for A-Z to equal ones:
    # it finds all candidates, and verification tells the others from them
    low = folded(F.coalesce("text", F.lit("")))
    of_window = wins.select("win", "len", F.posexplode(shingles(F.split(folded(F.col("win")), " "), k)).alias("offset", "h"))
    tokens = small(of_window.select("h").distinct())
    seen = docs.select(F.explode(shingles(words(low, PARTS_LOW), k)).alias("h")).join(tokens, "h").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    rarest = of_window.join(seen, "h", "left").groupBy("win").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "offset")).alias("x"))
    prefix = rarest.where("x.n > 0").select("win", "x.h", "x.offset").join(wins, "win")
    prefix = small(written(prefix, "prefix"))
    each = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text"), PARTS_ANY).alias("w"), shingles(words(low, PARTS_LOW), k).alias("hs"))
    at = each.select("doc_id", "th", "w", F.posexplode("hs").alias("p", "h")).join(prefix, "h").withColumn("start", F.col("p") - F.col("offset"))
    fits = at.where((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("w")))
    same = ascii_lower(F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ")) == F.col("win")
    return fits.where(same).select("doc_id", "th", "start", "len", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and th, a hash of the text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wins = written(windows_of(benchmark.select("item_id", "text"), window), "windows")
    found = None
    # items of fewer words than a shingle have shorter ones, and none of that length is usual
    for k in [r.k for r in wins.select(F.least("len", F.lit(SHINGLE)).alias("k")).distinct().collect()]:
        some = hits(docs, wins.where(F.least("len", F.lit(SHINGLE)) == k), k)
        found = some if found is None else found.unionByName(some)
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"), PARTS_ANY)).cast("long").alias("n_words"))
    if found is None:
        out = base.withColumn("spans", F.lit(None).cast("array<struct<start:int,len:int>>")).withColumn("ids", F.lit(None).cast("array<string>"))
    else:
        by = found.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("start", "len"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("ids"))
        by = by.withColumnsRenamed({"doc_id": "id_", "th": "th_"})
        out = base.join(by, base.doc_id.eqNullSafe(by.id_) & (base.th == by.th_), "left")
    start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc: Column, s: Column) -> Column:
        end = s["start"] + s["len"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], s["start"]))).alias("n"))

    n_hit = F.coalesce(F.aggregate("spans", start, add)["n"], F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    out = out.select("doc_id", "th", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[s : s + 12], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, s, k, array_to_string(w[s : s + k - 1], ' ') AS win
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d CROSS JOIN (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)
), hit AS (SELECT dw.r, dw.s, dw.k, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM hit) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN it USING (r)
"""
