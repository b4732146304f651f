"""Incremental maintenance as a stream: each tick lists the sources, diffs them by hash and updates all tables in one micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.sources import store
from sparkloom.sources.tables import cut


def tick(index: store.Index, now: DataFrame, update: Callable[[DataFrame, DataFrame], None]) -> DataFrame:
    """Compare the listing ``now`` (path, content) with the index's ``files`` and hand over what changed: (new or modified files, changes)."""
    old = index.read("files") if index.version() else now.limit(0)
    # not cached: the plan of a later tick may be the same, and would be given this one's rows
    changes = cut(store.changed(old.select("path", "content"), now.select("path", "content")))
    if not changes.isEmpty():
        fresh = now.join(changes.filter("change <> 'deleted'").select("path"), "path", "left_semi")
        update(fresh, changes)
    return changes


def watch(spark: SparkSession, root: str, index: store.Index, update: Callable[[DataFrame, DataFrame], None], seconds: float = 2, checkpoint: str | None = None) -> StreamingQuery:
    """A running query.  The file source isn't used: it never reports edits and deletions."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()

    def batch(_: DataFrame, __: int) -> None:
        tick(index, store.scan(spark, root), update)

    w = ticks.writeStream.foreachBatch(batch).trigger(processingTime=f"{seconds} seconds")
    return (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", group: str = "event_type") -> DataFrame:
    """Counts and sums of an event stream (or table) by tumbling window; on a stream, later events than the watermark are dropped."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), group, "n", "total")
