"""The corpus pipeline: stages over ``documents``, each written and reread as the next one's input.

Every stage but the last returns the columns of its input. Documents judged toxic
go; of near duplicates the row with the lowest doc_id stays, of repeated rows one;
contaminated documents go; secrets are replaced by a mark; the last encodes.

Rows are told apart by doc_id and text: texts that differ stay, whatever their
doc_id. Null and empty texts are never toxic, near copies, contaminated or secret,
and have no tokens. A null doc_id sorts last among near copies. Texts of any length
are read whole, one at a time. An empty table gives no rows. Columns beside
doc_id and text pass through; n_chars, where there is one, follows the text.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattiq.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from lattiq.llm.common import Memo, batches, release, shared_dir, slices, small, spark_schema, written

#: Bytes of texts that a worker decodes at a time, and words and pieces that it keeps: the stages share executors whose
#: other memory is taken by then.
SLICE, KEPT = 1 << 20, 40_000

#: A trained classifier decides in one stage, which SQL can't express.
ORACLE_SQL = None


def over_texts(docs: DataFrame, make: Callable[[], Callable], added: str = "") -> DataFrame:
    """Rows with all their columns, by a function of whole texts: with the texts (and
    n_chars) that it returns, or with the columns ``added`` (a schema), of which it returns the lists."""
    names = docs.columns
    at = names.index("text")
    new = spark_schema(docs.sparkSession, added) if added else []

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in given:
            call = call or make()
            for a, b in slices(batch.column(at), SLICE):
                part = batch.slice(a, b - a)
                texts = part.column(at).to_pylist()
                found = call(["" if t is None else t for t in texts])
                cols = list(part.columns)
                if new:
                    cols += [pa.array(f, kind) for f, (_, kind) in zip(found, new, strict=True)]
                    yield pa.RecordBatch.from_arrays(cols, [*names, *(n for n, _ in new)])
                    continue
                changed = [None if t is None else f for t, f in zip(texts, found, strict=True)]
                cols[at] = pa.array(changed, cols[at].type)
                if "n_chars" in names:
                    k = names.index("n_chars")
                    cols[k] = pa.array([n if t == f or f is None else len(f) for t, f, n in zip(texts, changed, cols[k].to_pylist(), strict=True)], cols[k].type)
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)
        call = None
        release()

    batches(docs.sparkSession)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *(StructType.fromDDL(added) if added else [])]))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model, known = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    # each text is rated once: the thresholds are set from, and applied to, what is written here
    rated = written(over_texts(docs, toxicity.rater(spark.sparkContext.broadcast(model)), "__raw double, __language int"), "rated")
    narrow = rated.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__raw").alias("raw"), F.col("__language").alias("language"))
    at = toxicity.thresholds(known.counts(narrow), known.share)
    return rated.where(toxicity.stretched(at, "__raw", "__language") < 0.5).drop("__raw", "__language")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` but those whose doc_id and text's hash are in ``rows`` (doc_id, th)."""
    bad = small(written(rows.select(F.col("doc_id").cast("long").alias("__gone_id"), F.col("th").alias("__gone_th")), "gone"))
    return docs.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (text_hash() == F.col("__gone_th")), "left_anti")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = without(docs, near_dedup.spare_rows(docs))
    # rows that repeat in both doc_id and text: one of them stays
    mine = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("th"))
    again = written(mine.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th"), "again")
    if not again.limit(1).count():
        return out
    bad = small(again.select(F.col("doc_id").alias("__gone_id"), F.col("th").alias("__gone_th")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__gone_id")) & (text_hash() == F.col("__gone_th"))
    once = out.join(bad, same, "left_semi").withColumn("__gone_th", text_hash()).dropDuplicates(["doc_id", "__gone_th"]).select(docs.columns)
    return out.join(bad, same, "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, judged.where("contaminated").select("doc_id", "th").distinct())


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = secrets.train(docs)
    return over_texts(docs, lambda: lambda texts: [secrets.redacted(model, t) for t in texts])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")

    def make():
        own = bpe.word_bpe(path).fresh()
        own.of_piece, own.of_chunk = Memo(own._piece, KEPT), Memo(own._chunk, KEPT)

        def call(texts):
            packed = [own.packed(t) for t in texts]
            return [len(ids) // 4 for ids, _ in packed], [hashlib.sha256(ids).hexdigest() for ids, _ in packed], [hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in packed]

        return call

    digests = over_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return digests.drop("text")


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("decontaminate", drop_contaminated), ("secrets", hide_secrets), ("bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{at}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{at}/{k}")
    return docs
