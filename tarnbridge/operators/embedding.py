"""Filling the vectors of texts: the embedding itself is a function that can be exchanged."""

from __future__ import annotations

import re
import time
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnbridge.functions.text import blank, squeezed
from tarnbridge.operators.calls import WAITS, WINDOW, called, parted
from tarnbridge.session import shared_folder

Embed = Callable[[list[str]], np.ndarray]


def hashed_words(dim: int = 64) -> Embed:
    """A deterministic stand-in for a model: signed word hashes, scaled to length 1."""

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts, strict=True):
            for word in re.findall(r"\w+", text.lower()):
                h = zlib.crc32(word.encode())
                row[h % dim] += 1 if h >> 31 else -1
        length = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(length > 0, length, 1)

    return embed


#: Digits of a text's hash that name a folder of the store.
PREFIX = 2


def with_retries(embed: Embed, waits: Sequence[float] = WAITS) -> Embed:
    """The same function, called again where it fails, once for each wait; then its last error is raised."""

    def call(texts: list[str]) -> np.ndarray:
        error: Exception | None = None
        for i, wait in enumerate(waits):
            try:
                return embed(texts)
            except Exception as e:  # whatever a model's client raises
                error = e
                if i + 1 < len(waits):
                    time.sleep(wait)
        raise RuntimeError(f"no embedding after {len(waits)} calls") from error

    return call


def embedded(rows: DataFrame, key: str, text: str, embed: Embed, dim: int, batch: int = 128) -> DataFrame:
    """key and embedding of every row, in batches; a blank text or a vector of another size is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                if any(t is None or not t.strip() for t in part["text"]):
                    raise ValueError("a blank text has no embedding")
                vectors = np.asarray(embed(part["text"].tolist()), np.float32)
                if vectors.shape != (len(part), dim):
                    raise ValueError(f"the embedding gave {vectors.shape}, not {(len(part), dim)}")
                yield pd.DataFrame({"key": part["key"].to_numpy(), "embedding": list(vectors)})

    kind = rows.schema[key].dataType.simpleString()
    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, embedding array<float>")
    return out.withColumnRenamed("key", key)


def to_embed(rows: DataFrame, known: DataFrame, key: str, text: str, mode: str = "missing") -> DataFrame:
    """Rows that get a vector: those without one, or all (modes all and rebuild); blank texts get none."""
    rows = rows.filter(~blank(F.col(text)))
    return rows.join(known.select(key).distinct(), key, "left_anti") if mode == "missing" else rows


def embedded_once(rows: DataFrame, key: str, text: str, embed: Embed, dim: int) -> DataFrame:
    """As embedded(), but texts that are the same but for case and blanks are embedded once."""
    normal = rows.withColumn("_normal", squeezed(F.col(text))).withColumn("_id", F.sha2("_normal", 256))
    vectors = embedded(normal.dropDuplicates(["_id"]), "_id", "_normal", embed, dim)
    return normal.select(key, "_id").join(vectors, "_id").select(key, "embedding")


def embedded_with_store(rows: DataFrame, key: str, text: str, embed: Embed, dim: int, store: str, window: int = WINDOW, waits: Sequence[float] = WAITS) -> tuple[DataFrame, DataFrame]:
    """key and embedding of the rows, and the rejects (id, the text's hash, and error); texts that the store has are not embedded again.

    The store is a folder that stays from run to run: a vector by the SHA-256 of the text, in folders by the hash's
    first digits, so a run reads the folders that its texts fall into. Texts that are the same but for case and
    blanks are one; blank ones have no vector. Calls are in flight together, and what fails is a reject. A run that dies
    before its vectors are in the store makes their calls again.
    """
    spark = rows.sparkSession
    shared_folder(spark)
    normal = rows.filter(~blank(F.col(text))).select(F.col(key).alias("_key"), squeezed(F.col(text)).alias("_normal")).withColumn("id", F.sha2("_normal", 256)).withColumn("prefix", F.substring("id", 1, PREFIX))
    schema = "id string, embedding array<float>, prefix string"
    place = spark._jvm.org.apache.hadoop.fs.Path(store)
    has = place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    known = spark.read.schema(schema).parquet(store) if has else spark.createDataFrame([], schema)
    new = normal.select("prefix", "id", "_normal").dropDuplicates(["id"]).join(known.select("prefix", "id"), ["prefix", "id"], "left_anti")

    def checked(texts: list[str]) -> list[np.ndarray]:
        vectors = np.asarray(embed(texts), np.float32)
        if vectors.shape != (len(texts), dim):
            raise ValueError(f"the embedding gave {vectors.shape}, not {(len(texts), dim)}")
        return list(vectors)

    good, rejects = parted(called(new, "id", "_normal", checked, "array<float>", window=window, waits=waits).checkpoint())
    good.select("id", F.col("answer").alias("embedding"), F.substring("id", 1, PREFIX).alias("prefix")).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(store)
    vectors = spark.read.schema(schema).parquet(store)
    return normal.select("_key", "prefix", "id").join(vectors, ["prefix", "id"]).select(F.col("_key").alias(key), "embedding"), rejects
