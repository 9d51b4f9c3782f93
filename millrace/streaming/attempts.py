"""Attempts and trace events as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_wins_stream(events: DataFrame, keys: list[str], ts: str, delay: str = "1 hour") -> DataFrame:
    """The first event per key within the watermark; later copies and late rows are dropped."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, ts: str, kind: str, window: str = "1 hour", delay: str | None = "1 hour") -> DataFrame:
    """Events per tumbling window and kind, complete once the watermark passes the window.

    ``delay`` is None for a stream that has its watermark already.
    """
    events = events if delay is None else events.withWatermark(ts, delay)
    return events.groupBy(F.window(ts, window).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")


def emit_new(stream: DataFrame, keys: list[str], journal: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Passes rows whose key is not in the journal yet to ``sink``, then journals them; a replayed batch adds nothing."""

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        try:
            known = spark.read.parquet(journal).where(F.col("_epoch") != epoch).select(*keys).distinct()
            df = df.join(known, keys, "left_anti")
        except Exception as e:  # the journal does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh = df.dropDuplicates(keys)
        sink(fresh, epoch)
        fresh.select(*keys, F.lit(epoch).alias("_epoch")).write.mode("append").parquet(journal)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
