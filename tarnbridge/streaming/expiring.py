"""The last valid row of each key of a log, for as long as it is fresh, as keyed state with timers."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside have the state store that timers need; the session's own comes back."""
    old = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, old)


class _Cache(StatefulProcessor):
    """Holds time and rank of the last row of a key, and a timer for the moment it is no longer fresh."""

    def __init__(self, inputs: list[str], columns: list[str], ttl_ms: int):
        self.inputs, self.columns, self.ttl_ms = inputs, columns, ttl_ms  # inputs by place: computed columns come without their names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "micros bigint, rank bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for pdf in rows:
            if len(pdf):
                top = pdf.set_axis(self.inputs, axis=1).sort_values(["_micros", "_rank"]).iloc[[-1]]
                at = (int(top["_micros"].iloc[0]), int(top["_rank"].iloc[0]))
                if best is None or at > best[0]:
                    best = (at, top)
        if best is None:
            return
        at, top = best
        old = tuple(self.last.get()) if self.last.exists() else None
        if old is not None and old >= at:
            return
        if old is not None:
            self.handle.deleteTimer(self._ends(old[0]))
        self.last.update(at)
        self.handle.registerTimer(self._ends(at[0]))
        out = top[self.columns].copy()
        out["fresh"] = True
        yield out

    def _ends(self, micros: int) -> int:
        return micros // 1000 + self.ttl_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        out = pd.DataFrame([[None] * len(self.columns)], columns=self.columns)
        out[self.columns[0]] = key[0]
        out["fresh"] = False
        yield out

    def close(self) -> None:
        pass


def fresh_by_key(log: DataFrame, key: str, time: str, rank: str, ttl_seconds: int, late: str = "0 seconds", valid: Column | None = None) -> DataFrame:
    """A stream of changes: a key's new last valid row with fresh = true, and the key alone with fresh = false when
    the watermark has passed the time of its row by ttl_seconds.

    State is a row and a timer for each key that is fresh; a key that has expired leaves nothing. Of equal
    times the greatest rank, a whole number, counts. Rows without a key or time, and those that aren't valid, change
    nothing. A sink that replaces by key (UpsertTable) holds the answer. Start the query inside keyed_state().
    """
    others = [c for c in log.columns if c != key]
    kept = log.withWatermark(time, late).filter(F.col(key).isNotNull() & F.col(time).isNotNull() & (valid if valid is not None else F.lit(True)))
    kept = kept.withColumns({"_micros": F.unix_micros(F.col(time).cast("timestamp")), "_rank": F.coalesce(F.col(rank).cast("bigint"), F.lit(0))})
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    schema = ", ".join([f"`{key}` {kinds[key]}", *[f"`{c}` {kinds[c]}" for c in others], "fresh boolean"])
    processor = _Cache(kept.columns, [key, *others], 1000 * ttl_seconds)
    return kept.groupBy(key).transformWithStateInPandas(processor, outputStructType=schema, outputMode="Update", timeMode="EventTime")
