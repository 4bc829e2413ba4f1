"""Windows over event streams, and change batches applied to tables; the same functions serve batches and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withWatermark("ts", late) if late and e.isStreaming else e


def _plain(column: str) -> Column:
    return F.col(column).cast("timestamp_ntz")


def tumbling(events: DataFrame, width: str, late: str | None = "1 hour") -> DataFrame:
    """start, event_type, n, total of each window of this width; a stream drops what is later than `late`."""
    g = _timed(events, late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(_plain("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, every: str, late: str | None = "1 hour") -> DataFrame:
    g = _timed(events, late).groupBy(F.window("ts", width, every), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(_plain("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str | None = "1 hour") -> DataFrame:
    """user_id, start, n of each run of events that follow one another within the gap: the debounce of a change feed."""
    g = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", _plain("session_window.start").alias("start"), "n")


def latest(events: DataFrame) -> DataFrame:
    """user_id, event_id, ts of each user's last event: what upserts by key leave."""
    g = events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    return g.select("user_id", F.col("m.event_id").alias("event_id"), F.col("m.ts").alias("ts"))


def drained(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Runs apply on each micro-batch of changes (path, kind, ts), only the last change of each path: drained, deduplicated batches."""

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("path").agg(F.max(F.struct("ts", "kind")).alias("m")).select("path", F.col("m.kind").alias("kind"), F.col("m.ts").alias("ts"))
        apply(last, number)

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def upserted(table: DataFrame, fresh: DataFrame, removed: DataFrame, key: str = "path") -> DataFrame:
    """table without the keys of fresh or removed, and with the rows of fresh."""
    gone = fresh.select(key).union(removed.select(key)).distinct()
    return table.join(gone, key, "left_anti").unionByName(fresh)
