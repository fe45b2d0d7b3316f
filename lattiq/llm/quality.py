"""Operator 5: quality rules with risk-controlled thresholds, in DataFrame functions only.

Labelled good documents are halved by a hash. One half proposes, for each stratum
(language), cutoffs at several levels: from far beyond the worst good value down
to small shares of good documents beyond the cutoff. A rule takes part in a level
only if it rejects more bad than good documents there, so rules that tell nothing
add no risk. On the other half the exact binomial distribution tests whether all
rules of a level together reject more than ``ALPHA`` of good documents. Levels are
tested from the mildest on and stop at the first that fails, so only the strata
need Bonferroni's correction. Of the levels certified, the one that tells good
from bad best on the proposing half is used, the mildest of equals; a stratum
without any keeps what passes the base. With s strata no level of a stratum can
be certified on fewer than log(s / DELTA) / -log(1 - ALPHA) good testing
documents, 436 of four strata.

Null and empty texts have no words and fail the base. Documents without a
two-letter language form one stratum. Repeated rows each get a row; of labels that
differ for a document the lowest counts. A value at a cutoff is rejected. Very
long texts are one array of words each. An empty table gives no rows, empty labels
no cutoffs. Extra columns are left out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattiq.llm.common import small, written
from lattiq.llm.decontaminate import let

SPACE = r"[\x20\x09-\x0D]+"
#: Bound on false rejection of good documents in a stratum, and on the chance that any stratum breaks it.
ALPHA, DELTA = 0.01, 0.05
#: By level: the share of the proposing half's good documents beyond a rule's value, and how many bins further the cutoff is.
LEVELS = ((0.0, 32), (0.0, 16), (0.0, 8), (0.0, 4), (0.0, 2), (0.0, 1), (0.0005, 1), (0.001, 1), (0.002, 1), (0.004, 1), (0.008, 1))
BINS = 200
#: Few distinct repeated windows are looked up one by one, more by sorting.
FEW = 32


def repeated_words(ws: Column) -> Column:
    """Words in three-word windows that occur twice or more, windows compared as 64-bit hashes."""
    hashes = F.transform(F.sequence(F.lit(2), F.size(ws) - 1), lambda i: F.xxhash64(F.get(ws, i - 2), F.get(ws, i - 1), F.get(ws, i)))

    def positions(hs: Column) -> Column:
        twice = let(F.sort_array(hs), lambda s: F.array_distinct(F.filter(s, lambda x, k: (k > 0) & (F.get(s, k - 1) == x))))
        few = lambda t: F.filter(F.transform(hs, lambda h, i: F.when(F.array_contains(t, h), i)), lambda x: x.isNotNull())
        near = lambda s, k: (F.get(s, k - 1)["h"] == F.get(s, k)["h"]) | (F.get(s, k + 1)["h"] == F.get(s, k)["h"])
        many = let(F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: F.sort_array(F.filter(F.transform(s, lambda x, k: F.when(near(s, k), x["i"])), lambda x: x.isNotNull())))
        return let(twice, lambda t: F.when(F.size(t) <= FEW, few(t)).otherwise(many))

    start = F.struct(F.lit(-3).alias("at"), F.lit(0).cast("long").alias("n"))
    covered = lambda ps: F.aggregate(ps, start, lambda a, p: F.struct(p.alias("at"), (a["n"] + F.least(F.lit(3), p - a["at"])).alias("n")))["n"]
    none = F.lit(0).cast("long")
    some = let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), none).otherwise(covered(positions(hs))))
    return F.when(F.size(ws) < 4, none).otherwise(some)


def counted(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).cast("long")


def features(docs: DataFrame) -> DataFrame:
    """The base columns, the stratum and a bin for each rule (higher: worse), one scan of the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ws = F.array_remove(F.split(text, SPACE), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(ws, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda ls: F.struct(F.size(ls).alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(lang.rlike("^[a-z]{2}$"), lang).otherwise("other").alias("stratum"), of_words.alias("a"), of_lines.alias("b"), counted(text, "[#*$%&|<>]").alias("n_symbols"), counted(text, "[A-Z]").alias("upper"), counted(text, "!").alias("bangs"))
    raw = raw.select("doc_id", "stratum", "a.*", "b.*", "n_symbols", "upper", "bangs")
    n, chars = F.greatest(F.lit(1), "n_words"), F.greatest(F.lit(1), "word_chars")
    #: Each rule's value, from 0 to 1.
    rules = (F.col("n_symbols") / n / 4, F.col("n_dup_lines") / F.greatest(F.lit(1), "n_lines"), F.col("n_repeat_words") / n, F.col("upper") / chars, F.col("bangs") / n / 3, chars / n / 25, 1 - chars / n / 25)
    bins = F.array(*[F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor(r * BINS))).cast("int") for r in rules])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return raw.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), bins.alias("bins"))


def tail_probability(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly summed from zero."""
    odds = math.log(p / (1 - p))
    first = F.struct((n * math.log1p(-p)).alias("log"), F.exp(n * math.log1p(-p)).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i) + odds
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), first, step)["sum"]


def proposed(labelled: DataFrame) -> DataFrame:
    """stratum, level and cutoffs (a bin for each rule, BINS where it takes no part), from the proposing half ``labelled``."""
    of = lambda good: F.count(F.when((F.col("quality") == 1) == good, 1))
    counts = labelled.select("stratum", "quality", F.posexplode("bins").alias("rule", "bin")).groupBy("stratum", "rule", "bin").agg(of(True).alias("good"), of(False).alias("bad"))
    per_rule = Window.partitionBy("stratum", "rule")
    down = per_rule.orderBy(F.desc("bin"))
    tails = counts.withColumn("tail", F.sum("good").over(down)).withColumn("all", F.sum("good").over(per_rule))
    levels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(q).alias("q"), F.lit(m).alias("margin")) for i, (q, m) in enumerate(LEVELS)])).alias("x")
    # beyond the lowest value with at most a share q of good documents above it
    over = F.coalesce(F.max(F.when(F.col("tail") > F.col("q") * F.col("all"), F.col("bin"))), F.lit(-1))
    values = F.collect_list(F.struct("bin", "good", "bad"))
    cut = tails.where(F.col("all") > 0).select("*", levels).select("*", "x.*").groupBy("stratum", "rule", "level", "margin").agg(over.alias("over"), values.alias("values"))
    cut = cut.withColumn("cutoff", F.col("over") + F.col("margin"))
    beyond = lambda name: F.aggregate("values", F.lit(0).cast("long"), lambda n, v: n + F.when(v["bin"] >= F.col("cutoff"), v[name]).otherwise(0))
    used = F.when(beyond("bad") > beyond("good"), F.col("cutoff")).otherwise(F.lit(BINS)).alias("cutoff")
    each = cut.select("stratum", "level", "rule", used)
    return each.groupBy("stratum", "level").agg(F.transform(F.sort_array(F.collect_list(F.struct("rule", "cutoff"))), lambda x: x["cutoff"]).alias("cutoffs"))


def thresholds(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum, cutoffs (a bin for each rule), level, and n, k and chance of its test (k of n good
    documents of the testing half rejected), of the strata where a useful level is certified.

    labelled: doc_id, stratum, bins, quality. All tables after the first counts
    have a row for each of at most 677 strata, a rule and a bin or level.
    """
    proposing = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    own = labelled.withColumn("first", proposing)
    cutoffs = written(proposed(own.where("first")), "cutoffs")
    judged = own.join(small(cutoffs), "stratum")
    hit = rejected("bins", "cutoffs")
    half = lambda first, good: (F.col("first") == first) & ((F.col("quality") == 1) == good)
    of = lambda c: F.count(F.when(c, 1))
    tally = judged.groupBy("stratum", "level").agg(of(half(False, True)).alias("n"), of(half(False, True) & hit).alias("k"), of(half(True, True) & hit).alias("good"), of(half(True, False) & hit).alias("bad"))
    strata = max(1, cutoffs.select("stratum").distinct().count())
    most = F.col("n") * alpha
    # beyond the share itself the chance is above a half at least
    chance = F.when(F.col("k") <= most, tail_probability(F.least(F.col("k"), F.ceil(most)), F.col("n"), alpha)).otherwise(F.lit(1.0))
    tally = tally.withColumn("chance", chance)
    milder = Window.partitionBy("stratum").orderBy("level")
    sure = tally.withColumn("passed", F.min((F.col("chance") <= delta / strata).cast("int")).over(milder)).where("passed = 1 and bad > good")
    best = sure.groupBy("stratum").agg(F.max(F.struct((F.col("bad") - F.col("good")).alias("gain"), (-F.col("level")).alias("mild"), "n", "k", "chance")).alias("x")).select("stratum", (-F.col("x.mild")).alias("level"), "x.n", "x.k", "x.chance")
    return written(best.join(cutoffs, ["stratum", "level"]).select("stratum", "cutoffs", "level", "n", "k", "chance"), "thresholds")


def rejected(bins: str, cutoffs: str) -> Column:
    return F.exists(F.zip_with(bins, cutoffs, lambda b, c: b >= c), lambda x: x)


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of each document."""
    made = written(features(docs), "features")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    labelled = written(made.where("not base_failed").select("doc_id", "stratum", "bins").join(known, "doc_id"), "labelled")
    cut = thresholds(labelled, alpha, delta)
    out = made.join(small(cut.select("stratum", "cutoffs")), "stratum", "left")
    kept = ~F.col("base_failed") & ~F.coalesce(rejected("bins", "cutoffs"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))
