"""Writing tables and records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, append: bool = False) -> None:
    """JSON lines; append adds files to a log."""
    rows.write.mode("append" if append else "overwrite").json(path)


def write_snapshot(rows: DataFrame, path: str, run_id: str) -> bool:
    """New rows as a partition of their run; nothing is written, and False returned, without rows."""
    if rows.isEmpty():
        return False
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)
    return True


def swap(rows: DataFrame, path: str) -> None:
    """Replace a table by rows that may be read from it: written beside it, then renamed.

    What fails before the renaming leaves the old table. Between the two renames a reader that starts finds none for a
    moment; streaming.upserts.UpsertTable publishes by one rename, where readers come at any time.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.new")
    jvm = spark._jvm
    at = lambda suffix="": jvm.org.apache.hadoop.fs.Path(path + suffix)
    fs = at().getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(".old"), True)
    if fs.exists(at()):
        fs.rename(at(), at(".old"))
    fs.rename(at(".new"), at())
    fs.delete(at(".old"), True)


def grounding(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """A JSON array of each key's rows, by order, without nulls."""
    item = F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("r"))
    return rows.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])).alias("payload"))


def checked_vectors(rows: DataFrame, size: int, column: str = "embedding") -> DataFrame:
    """The rows, if all vectors have the size; else an error that says how many have not."""
    wrong = rows.filter(F.coalesce(F.size(column), F.lit(-1)) != size).count()
    if wrong:
        raise ValueError(f"{wrong} vectors are not of size {size}")
    return rows


def dry_run(rows: DataFrame, *keys: str) -> DataFrame:
    """What would be written: how many rows, and how many have each key; nothing is."""
    return rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count(k).alias(k) for k in keys])


def append_log(rows: DataFrame, path: str, keep) -> None:
    """Append the rows worth keeping to a log of JSON lines."""
    write_json(rows.filter(keep), path, append=True)
