"""Lineage cuts in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows beyond which a lookup side is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset a folder of this machine is made, in local mode only."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lattiq-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/lattiq"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor costs running tasks only."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if a count proves ``df`` has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def sized(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``small``, with a hint against a broadcast of more rows: Spark goes by the size of files, where columns that compress
    well hide millions of rows, which would all pass through the driver."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df.hint("merge")


def shuffled(df: DataFrame) -> DataFrame:
    """A hint against a broadcast of ``df``, whose rows grow with the input, without a count of them."""
    return df.hint("merge")
