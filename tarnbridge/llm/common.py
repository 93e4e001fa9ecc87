"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.session import shared_folder

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextlib.contextmanager
def written(df: DataFrame) -> Iterator[DataFrame]:
    """Cut the lineage with a Parquet table in the shared folder, which goes when the block ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def forget(spark: SparkSession) -> None:
    """Let shuffle files and checkpoints that no frame needs any more go now.

    Spark removes them when the driver collects the frames that made them, which can be long after.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def unused(df: DataFrame, name: str) -> str:
    """A column name like this that the frame, whatever the case of its names, doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Give memory that a task has freed back to the system: its worker may idle while others need it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library can be told
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hex_int(hexed, first: int, length: int):
    """Some hexadecimal digits of a digest, as a bigint column (at most 15 digits)."""
    return F.conv(F.substring(hexed, first, length), 16, 10).cast("bigint")
