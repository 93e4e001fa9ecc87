"""Reading records from JSON and text files, and finding the latest snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_records(spark: SparkSession, path: str, schema: str, wrapper: str | None = None) -> DataFrame:
    """Lines (.jsonl), a list, one object, or a list inside an object under the wrapper's name."""
    if path.endswith(".jsonl"):
        return json_lines(spark, path, schema)
    if wrapper is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    kind = T._parse_datatype_string(schema)
    whole = T.StructType([*kind.fields, T.StructField(wrapper, T.ArrayType(kind))])
    rows = spark.read.schema(whole).option("multiLine", True).json(path)
    flat = rows.filter(F.col(wrapper).isNull()).select(*kind.names)
    return flat.unionByName(rows.filter(F.col(wrapper).isNotNull()).select(F.explode(wrapper).alias("_r")).select("_r.*"))


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """A row (value) for each file."""
    return spark.read.text(path, wholetext=True)


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a text file but blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")


def latest_snapshot(files: DataFrame) -> DataFrame:
    """The path of the latest of some files (path, modified).

    A time in the name, _YYYYMMDD_HHMMSS, beats the time of modification; of equals the last name.
    """
    named = F.regexp_extract("path", r"_(\d{8}_\d{6})", 1)
    return files.select(F.max_by("path", F.struct(named != "", named, "modified", "path")).alias("path"), F.max_by(named, F.struct(named != "", named, "modified", "path")).alias("run_id"))


def files_in(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path and modified of the files in a folder, from the store's own listing."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return listing.select("path", F.col("modificationTime").alias("modified"))


def qrels(rows: DataFrame, order: str) -> DataFrame:
    """qid and relevant ids: of equal qids the last, a missing list is empty. Ids go beyond 63 bits."""
    last = rows.groupBy("qid").agg(F.max_by("relevant_ids", order).alias("ids"))
    return last.select("qid", F.coalesce(F.col("ids").cast("array<decimal(20,0)>"), F.array().cast("array<decimal(20,0)>")).alias("relevant_ids"))


def config(text: str, known: set[str]) -> dict:
    """A configuration object; a name that isn't known is an error."""
    found = json.loads(text)
    if unknown := set(found) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return found


def last_named(files: DataFrame, kinds: tuple[str, ...] = (".json", ".jsonl")) -> DataFrame:
    """The lexicographically last path of some kinds."""
    wanted = files.filter(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(*kinds))
    return wanted.agg(F.max("path").alias("path"))


def run_id(time):
    """A name for a run: its time in UTC, to the second."""
    return F.date_format(time, "yyyyMMdd_HHmmss")


def first_rows(rows: DataFrame, order: str, most: int | None) -> DataFrame:
    """The first rows by an ordinal, or all."""
    return rows if most is None else rows.orderBy(order).limit(most)
