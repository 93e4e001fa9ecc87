"""Op 2: quality classifier with naive Bayes support vectors.

A text's features are indicators of its n-grams: of 1 to 3 characters, of one and two words (both
hashed to DIMENSIONS) and of the shapes of two to SHAPE_WORDS words, which tell only whether each
word is the one before it again. Each indicator is scaled by the log-ratio of its counts in the two classes, and a linear
model of the hinge loss is fitted by dual coordinate descent, then drawn towards the mean scale as
naive Bayes would have it.

The model is fitted on the driver on at most SAMPLE labelled texts a class, chosen by a hash of
doc_id, never of rows held out; every whole text, however long, is scored on the executors.
A null text counts as empty; an empty text has no features and the score of the bias alone. A
document with several labels has their mean, a tie counting as 1; of a doc_id that many documents
share one text is learned from, the least by its hash; each row is scored on its own. With labels
of fewer than two classes the bias says which class there is (1 without any). Only doc_id and text,
of labels doc_id and quality, are read; other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.sources.tables import spread

from .common import release, table
from .shingles import mix, word_hashes

#: Numbers that n-grams of characters are hashed to, and as many of words; shapes come after these.
DIMENSIONS = 1 << 18
#: Words of the longest shape; shapes of 2 words and more are as many as the numbers of so many bits.
SHAPE_WORDS = 5
FEATURES = 2 * DIMENSIONS + 2**SHAPE_WORDS - 2
SAMPLE = 2500
#: Added to each count; upper bound of the dual variables; share of the fitted weights in the model.
SMOOTHING, COST, FITTED = 1.0, 1.0, 0.75
EPOCHS = 12
#: Slope of the logistic curve that makes a score of a margin.
SLOPE = 2.0

_MULTIPLIERS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_last = np.zeros(FEATURES, np.int32)


def features(text: str | None) -> np.ndarray:
    """The distinct feature numbers of a text, as int32."""
    if not text:
        return np.zeros(0, np.int32)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    found, value = [], np.zeros(len(code), np.uint64)
    for n, m in enumerate(_MULTIPLIERS):
        if len(code) <= n:
            break
        value = (value[: len(code) - n] + code[n:] + np.uint64(1)) * m
        value ^= value >> np.uint64(29)
        found.append((value >> np.uint64(40)).astype(np.int64) & (DIMENSIONS - 1))
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    word = word_hashes(data, np.array([len(data)]))[1]
    for value in (word, mix(word[:-1] * _MULTIPLIERS[0] + word[1:])):
        found.append(DIMENSIONS + (value >> np.uint64(40)).astype(np.int64) % DIMENSIONS)
    same = (word[1:] == word[:-1]).astype(np.int64)
    shape = np.zeros(len(word), np.int64)
    for n in range(2, SHAPE_WORDS + 1):
        shape = 2 * shape[:-1] + same[n - 2 :]
        found.append(2 * DIMENSIONS + 2 ** (n - 1) - 2 + shape)
    ids = np.concatenate(found).astype(np.int32)
    at = np.arange(len(ids), dtype=np.int32)
    _last[ids] = at  # one of equal numbers stays
    return ids[_last[ids] == at]


def fit(texts: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by feature number and the bias."""
    size = FEATURES
    if len(set(labels.tolist())) < 2:
        return np.zeros(size), 1.0 if not len(labels) or labels[0] else -1.0
    counts = {k: np.full(size, SMOOTHING) for k in (0, 1)}
    for ids, label in zip(texts, labels.tolist(), strict=True):
        counts[label][ids] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    seen = (counts[0] + counts[1]) > 2 * SMOOTHING
    w, bias, y = np.zeros(size), 0.0, np.where(labels == 1, 1.0, -1.0)
    # texts of any length weigh the same: a row is scaled to length 1
    rows = [(ids, ratio[ids] / max(1e-9, float(np.sqrt((ratio[ids] ** 2).sum())))) for ids in texts]
    dual, order = np.zeros(len(rows)), np.random.default_rng(7)
    norms = [1.0 + float(x @ x) for _, x in rows]
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            ids, x = rows[i]
            step = y[i] * (float(w[ids] @ x) + bias) - 1
            new = min(COST, max(0.0, dual[i] - step / norms[i]))
            if new != dual[i]:
                w[ids] += (new - dual[i]) * y[i] * x
                bias += (new - dual[i]) * y[i]
                dual[i] = new
    mean = float(np.abs(w[seen]).mean())
    model = np.where(seen, FITTED * w + (1 - FITTED) * mean, 0.0)
    return np.stack([model * ratio, ratio]).astype(np.float32), bias


def margin(model: tuple[np.ndarray, float], ids: np.ndarray) -> float:
    weights, bias = model
    if not len(ids) or weights.ndim == 1:
        return bias
    return float(weights[0, ids].sum()) / max(1e-9, math.sqrt(float((weights[1, ids] ** 2).sum()))) + bias


def held_out() -> Column:
    """True for rows that no label is learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """A model from at most ``sample`` labelled texts a class that aren't held out.

    The labels that are broadcast and the features that come to the driver are as many at most.
    """
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
    marked = marked.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    by_hash = [F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|sample"))), F.col("doc_id")]
    chosen = marked.filter("label = 0").orderBy(*by_hash).limit(sample).unionAll(marked.filter("label = 1").orderBy(*by_hash).limit(sample))
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["label"]) for r in chosen.collect()], "doc_id bigint, label int")

    # one text a doc_id, so no more than the chosen ones come to the driver
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t")).select("doc_id", "label", "t.text")

    def extract(batches):
        for batch in batches:
            ids = [features(t).astype("<i4").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["doc_id", "label", "ids"])

    found = texts.mapInArrow(extract, "doc_id bigint, label int, ids binary")  # bytes: a list of numbers takes many times as much in the driver
    rows = sorted(((r["doc_id"], r["label"], r["ids"]) for r in found.toLocalIterator()), key=lambda r: r[0])
    model = fit([np.frombuffer(r[2], "<i4") for r in rows], np.asarray([r[1] for r in rows], int))
    release()
    return model


def score_column(model: tuple[np.ndarray, float], text: str = "text") -> Column:
    """The score of a text column, 0 to 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([1 / (1 + math.exp(-max(-30.0, min(30.0, SLOPE * margin(model, features(t)))))) for t in texts.to_pylist()], pa.float64())

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = spread(docs.select("doc_id", "text")).withColumn("score", score_column(train(docs, labels)))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that are predicted to be of label 1."""
    return spread(docs).filter(score_column(train(docs, labels)) >= 0.5)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
