"""What a session needs to run this package."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Rows in an Arrow batch: texts can be long, and a batch is held as a whole on both sides.
BATCH_ROWS = "1000"
#: Bytes in an Arrow batch: blocks of vectors are some hundred kB a row, and each worker holds a batch or two.
BATCH_BYTES = "8m"


def prepared(spark: SparkSession) -> SparkSession:
    """Let the executors' Python workers find this package where the driver has it.

    Arrow batches get BATCH_ROWS rows and BATCH_BYTES, unless the session has set another number than the default.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "64MB").upper() in ("64MB", "67108864", "67108864B"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([ROOT, *filter(None, paths)])
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, which all executors share.

    Where that is unset, a session in one process gets a local folder of its own; on a cluster it is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        wanted = context.getConf().get("spark.checkpoint.dir")
        if not wanted:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            wanted = tempfile.mkdtemp(prefix="tarnbridge-checkpoint-")
            atexit.register(shutil.rmtree, wanted, ignore_errors=True)
        context.setCheckpointDir(wanted)
    return context.getCheckpointDir()
