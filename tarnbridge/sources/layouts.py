"""Tables laid out for what asks them: bucketed by the key that they are joined by, with filters for point lookups.

Two tables bucketed alike by the key of a join are joined bucket by bucket, without a shuffle; the price is one
shuffle when they are written. A lookup by the bucket key reads one bucket; one by another column skips the row
groups whose Bloom filter says that the value isn't there.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a row group where lookups matter: the less, the fewer rows a hit reads; the more, the better the columns pack.
LOOKUP_GROUP = 16 << 20


def write_bucketed(rows: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int, sort: Sequence[str] = (), bloom: dict[str, int] | None = None, group: int = LOOKUP_GROUP) -> None:
    """A table of the catalog, in a folder, with one file for each bucket of the keys.

    A bucket's rows are sorted by sort (by the keys if there is none). bloom gives columns that get Bloom filters, and
    how many different values a file has of each at most: beyond that more row groups are read, but no row is lost.
    Buckets have equal numbers of keys, not of rows: a key with a large part of all rows makes one bucket large, so keys
    should be unique or nearly. Null keys are in one bucket. An empty table is written with its columns.
    """
    writer = rows.repartition(buckets, *keys).write.format("parquet").mode("overwrite").option("path", path).option("parquet.block.size", str(group))
    for column, values in (bloom or {}).items():
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true").option(f"parquet.bloom.filter.expected.ndv#{column}", str(values))
    writer.bucketBy(buckets, *keys).sortBy(*(sort or keys)).saveAsTable(name)


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join of two tables bucketed alike by the keys: merged bucket by bucket; neither side is broadcast or shuffled."""
    return left.hint("merge").join(right.hint("merge"), list(keys), how)


def dropped(spark: SparkSession, *names: str) -> None:
    """Take tables off the catalog; the files of a folder given by path stay."""
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
