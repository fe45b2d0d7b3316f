"""Shared plumbing: joins on hot keys, and Arrow text maps."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattiq.storage import BROADCAST_ROWS, shared_dir, small, written

__all__ = ["BROADCAST_ROWS", "Memo", "batches", "hot_and_cold", "join_hot", "map_texts", "release", "shared_dir", "slices", "small", "spark_schema", "texts_of", "written"]

#: Counters by which keys of many rows are told from the others.
COUNTERS = 4096


def hot_and_cold(rows: DataFrame, key: str, least: int = 512) -> tuple[DataFrame | None, DataFrame]:
    """``rows``, of a written table, dealt by key: all rows of keys that may have many (None: there are none), and the rest.

    Rows are counted by a hash of their key, and the driver gets these COUNTERS numbers alone.
    A key with more rows than two counters hold on average, and than ``least``, is always hot,
    so the rest can be sent to tasks by key, once.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(COUNTERS))
    counts = rows.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()  # COUNTERS rows
    most = max(least, 2 * sum(r.n for r in counts) // COUNTERS)
    hot = [r.slot for r in counts if r.n > most]
    return (rows.where(slot.isin(hot)), rows.where(~slot.isin(hot))) if hot else (None, rows)


def join_hot(left: DataFrame, right: DataFrame, key: str, size: str, least: int = 512) -> DataFrame:
    """``left`` joined with ``right``, which has one row a key and in ``size`` how many rows of ``left`` have it.

    Keys of many rows are broadcast, so none of them lands in one task. As a key
    counts as hot from rows / BROADCAST_ROWS on, BROADCAST_ROWS of them are the most.
    """
    hot = F.col(size) > max(least, left.count() // BROADCAST_ROWS)
    some = F.broadcast(right.where(hot))
    rest = left.join(some.select(key), key, "left_anti").join(right.where(~hot), key)
    return left.join(some, key).unionByName(rest)


def batches(spark: SparkSession, rows: int = 2000, most: str = "8m") -> None:
    """Smaller Arrow batches than usual, by rows and bytes: a row here is a whole text or set."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", most)


def release() -> None:
    """Give freed memory back at the end of a task: its worker lives on for others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone (null text: empty), so extra columns can't clash."""
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias(text))


def map_texts(docs: DataFrame, make: Callable[[], Callable[[list, list], dict]], schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Apply a function of (keys, texts) -> columns to Arrow batches.

    ``make`` runs once in each task, so models load there; rows stay in order
    and no row waits for another, so memory is that of one batch.
    """
    target = spark_schema(docs.sparkSession, schema)

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in given:
            call = call or make()
            keys, whole = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(whole):
                cols = call(keys[a:b], whole.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(cols[n], t) for n, t in target], [n for n, _ in target])
        call = None
        release()

    batches(docs.sparkSession)
    return texts_of(docs, key, text).mapInArrow(run, schema)


def slices(column: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes, so one batch of long texts isn't decoded at once."""
    n, per = len(column), max(1, column.nbytes // max(1, len(column)))
    step = max(1, most // per)
    for a in range(0, n, step):
        yield a, min(n, a + step)


def spark_schema(spark: SparkSession, schema: str) -> list[tuple[str, pa.DataType]]:
    kinds = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    return [(n, kinds[t]) for n, t in (x.strip().split(" ", 1) for x in schema.split(","))]


class Memo(dict):
    """A bounded memo: two generations, the older one dropped when the newer fills."""

    def __init__(self, make: Callable, most: int = 300_000):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if (found := self.old.get(key)) is None:
            found = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = found
        return found
