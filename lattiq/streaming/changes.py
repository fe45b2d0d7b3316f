"""A feed of file changes, processed in micro-batches: each batch's impact and diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattiq.config import Config
from lattiq.operators import views
from lattiq.plans.incremental import RuleCache, reanalyze
from lattiq.schemas import Frames
from lattiq.storage import shared_dir, written


def settled(feed: DataFrame, time: str = "ts", delay: str = "10 minutes", window: str = "1 minute") -> DataFrame:
    """path, status and window of a streaming feed (path, status, ts): the last status of a path in each window, late rows dropped."""
    marked = feed.withWatermark(time, delay)
    return marked.groupBy(F.window(time, window).alias("w"), "path").agg(F.max_by("status", time).alias("status")).select("path", "status", F.col("w.start").alias("window"))


def on_changes(feed: DataFrame, frames_of: Callable[[DataFrame], Frames], config: Config, publish: Callable[[DataFrame, int], None], name: str, interval: str = "1 second") -> StreamingQuery:
    """For each micro-batch of (path, status) rebuild the project's relations, rerun the
    rules on what the changes affect, and publish the diagnostics.

    Batches that arrive during a run are taken together in the next one. Replays of
    a batch publish the same rows again under the same number.
    """
    cache = RuleCache()

    def run(batch: DataFrame, number: int) -> None:
        changes = written(batch.select("path", "status").dropDuplicates(["path"]), "changes")
        if not changes.limit(1).count():
            return
        frames = frames_of(changes)
        affected = written(views.impact(frames, changes), "affected")
        publish(reanalyze(frames, config, cache, affected)[0].diagnostics, number)

    at = f"{shared_dir(feed.sparkSession)}/streams/{name}"
    return feed.writeStream.foreachBatch(run).option("checkpointLocation", at).trigger(processingTime=interval).start()
