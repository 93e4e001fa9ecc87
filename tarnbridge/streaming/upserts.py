"""A table that streams keep up to date by key, batch by batch.

Rows are in buckets by a hash of the key. A batch writes the buckets that it changes, whole, to a folder
of its own, and then publishes a ledger entry: a small file, named by the batch's number, that says
for each bucket which batch's folder holds it. The entry appears by one rename, so a reader sees all of a
batch or nothing of it. A batch that is handed over again after it was published changes nothing; one that
failed before is written anew over what it left.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.operators.sync import first_by, upsert

#: Buckets of a table; a batch rewrites those that its keys fall into.
BUCKETS = 64


class UpsertTable:
    """The table in a folder. key are the columns that a row is known by.

    keep and stamp are those of sync.upsert(): columns that stay as they were first, and columns that get
    a value when a row changes. order settles which row of a key counts where a batch has several (the last).
    """

    def __init__(self, spark: SparkSession, path: str, key: Sequence[str], order: Callable[[], Column], keep: Sequence[str] = (), stamp: dict[str, Column] | None = None, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.order = spark, path, list(key), order
        self.keep, self.stamp, self.buckets = keep, stamp, buckets

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def batches(self) -> list[int]:
        """Numbers of the published batches."""
        fs, ledger = self._fs(f"{self.path}/ledger")
        names = [s.getPath().getName() for s in fs.listStatus(ledger)] if fs.exists(ledger) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _entry(self) -> dict[str, int]:
        """By bucket the batch that has it, from the latest entry."""
        known = self.batches()
        if not known:
            return {}
        fs, place = self._fs(f"{self.path}/ledger/{known[-1]:012d}.json")
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, entry: dict[str, int], batch: int) -> None:
        fs, draft = self._fs(f"{self.path}/drafts/{batch:012d}")
        stream = fs.create(draft, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        _, place = self._fs(f"{self.path}/ledger/{batch:012d}.json")
        fs.mkdirs(place.getParent())
        if not fs.rename(draft, place):
            raise RuntimeError(f"batch {batch} could not be published")

    def read(self, schema: str | None = None, of: Sequence[str] | None = None) -> DataFrame | None:
        """The rows now, or those of some buckets; None where nothing has been published."""
        entry = self._entry()
        paths = [f"{self.path}/data/batch={b}/_bucket={k}" for k, b in entry.items() if of is None or k in of]
        if not paths:
            return None
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*paths)

    def merge(self, rows: DataFrame, batch: int) -> None:
        """Puts the rows of a batch into the table, for foreachBatch."""
        if batch in self.batches():
            return
        new = first_by(rows, self.key, self.order(), last=True).withColumn("_bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string"))
        new = new.persist()
        try:
            touched = [r["_bucket"] for r in new.select("_bucket").distinct().collect()]  # as many as there are buckets at most
            entry = self._entry()
            if touched:
                old = self.read(of=touched)
                fresh = new.drop("_bucket")
                whole = fresh if old is None else upsert(old, fresh, self.key, self.keep, self.stamp)
                whole = whole.select(*fresh.columns) if old is None else whole.select(*old.columns)
                if old is None:
                    for c, x in (self.stamp or {}).items():
                        whole = whole.withColumn(c, x)
                bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("string")
                whole.withColumn("_bucket", bucket).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/data/batch={batch}")
            self._publish(entry | dict.fromkeys(touched, batch), batch)
        finally:
            new.unpersist()
