"""Streams: incremental ingest of changed files and daily sums of token events; budgets with reservations are in ``reservations``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tablelog import Table


def daily_usage(events: DataFrame, time: str, tokens: str, limit: int, late: str = "1 day", by: list[str] | None = None) -> DataFrame:
    """(by, day, used, over): tokens of each UTC day. For a stream a day is final once the watermark has passed it."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    used = rows.groupBy(*(by or []), F.window(time, "1 day").alias("w")).agg(F.sum(tokens).alias("used"))
    return used.select(*(by or []), F.to_date("w.start").alias("day"), "used", (F.col("used") > limit).alias("over"))


def ingest(files: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch of a file stream to ``apply`` (an upsert, which must give the same when repeated), then stop."""

    def step(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            apply(batch)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_table(changes: DataFrame, table: Table, name: str, checkpoint: str, deleted: Column | None = None) -> StreamingQuery:
    """Upsert a stream of changed rows into a versioned table, then stop.

    A batch that is delivered again after a restart is known by ``name`` and its number, so its rows are not applied twice.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, deleted, (name, batch_id))

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
