"""Tables of a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Bytes that a table may have, by the planner's estimate, to be dealt out again.
SPREAD_BYTES = 128 << 20


def spread(rows: DataFrame) -> DataFrame:
    """Rows for work that takes long per row: dealt to all cores where one small file has put them into few tasks.

    Files that are larger stay as the scan splits them, so no table of size is shuffled for this.
    """
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


#: Rows of a task, where tables of any size meet by a key.
DEALT_ROWS = 1 << 19


def parts_for(rows: DataFrame) -> int:
    """Into how many parts a table is dealt out by a key, so that a task's rows do not grow with the table.

    A number that is given is kept: partitions that Spark chooses are merged by compressed bytes, and sorted keys take few of these.
    """
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // DEALT_ROWS))


#: Rows of a table that is broadcast at most; a larger one is joined by its key.
BROADCAST_ROWS = 10_000


def is_small(rows: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether a table has so many rows at most; it reads no more than one row beyond."""
    return rows.limit(most + 1).count() <= most


def small_side(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """The side of an equi-join: broadcast where it is small, else left to a shuffled join."""
    return F.broadcast(rows) if is_small(rows, most) else rows


def by_id(rows: DataFrame, key: str, value: int | str) -> DataFrame:
    """Rows whose key is the value, as a number or as text."""
    return rows.filter(F.col(key).cast("string") == F.lit(str(value)))


def repeated_keys(rows: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has: empty if the key is unique."""
    return rows.groupBy(key).count().filter("count > 1")


def missing_tables(spark: SparkSession, wanted: list[str]) -> list[str]:
    """Of some tables those that the catalog doesn't have."""
    return [name for name in wanted if not spark.catalog.tableExists(name)]


def jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """A table of a relational database, read in parts of a numeric key."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    return reader.load()
