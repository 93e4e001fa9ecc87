"""Incremental ingestion of files by Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, folder: str, pattern: str, schema: str, checkpoint: str, merge: Callable[[DataFrame, int], None]) -> None:
    """Hand the files of a folder that no earlier call has seen to merge(rows, batch), then stop.

    The checkpoint remembers which files are done; a batch that failed is handed over again, so
    merge must be idempotent for a batch number.
    """
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(rows: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Counts and sums by time window, for streams with a watermark as for tables."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def latest_by_key(log: DataFrame, key: str, time: str, valid: Column | None = None) -> DataFrame:
    """The last valid row of each key of an append-only log, for streams as for tables.

    As a stream it is written in update mode: a key's row comes again whenever a later one is
    valid, so a sink that replaces by key holds the newest. State is one row a key; of equal times
    the greatest row stays. Rows without a key, and those that aren't valid, change nothing.
    """
    others = [c for c in log.columns if c not in (key, time)]
    kept = log.filter(F.col(key).isNotNull() & (valid if valid is not None else F.lit(True)))
    last = kept.groupBy(key).agg(F.max(F.struct(time, *others)).alias("_last"))
    return last.select(*[F.col(key) if c == key else F.col("_last")[c].alias(c) for c in log.columns])
