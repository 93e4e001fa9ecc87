"""Op 9: token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then answer totals,
quantiles and truncated totals for any context limit without touching the documents again.

A null or empty text has length 0; texts are encoded whole, one at a time, however long. Repeated
rows count as often as they come and rows of equal length share a row of the histogram, so there
are no ties in it. Only the text column is read; others may have any name. An empty table gives an
empty histogram, no totals and a null quantile.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.sources.tables import spread

from .common import checkpointed, table

#: A ranks file of byte-pair merges, one base64 token and rank a line; on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths are summed in blocks of so many, then over blocks.
BLOCK = 256
#: Context limits that can be asked for at once.
MOST_LIMITS = 10_000

_encodings: dict = {}


def encoding(path: str):
    """The tokenizer of a ranks file, once a process."""
    if path not in _encodings:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def token_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text") -> DataFrame:
    """One row (n_tokens) per document, from its whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            lengths = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(lengths, pa.int64())], ["n_tokens"])

    return spread(docs.select(F.col(text).alias("text"))).mapInArrow(count, "n_tokens bigint")


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs: how many documents have each encoded length.

    A checkpoint, so that whatever is asked of it later encodes no text again.
    """
    return checkpointed(token_lengths(docs, vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs")))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """Adds, for each length taken as a context limit:

    sum_tokens (of documents this long), docs_ge and tokens_ge (of documents at least this long),
    docs_le, share_le (share of documents that fit whole: the quantile function) and
    truncated_total (tokens left when every document is cut at this length).
    Sums run within blocks of lengths, then over blocks, so no task reads the whole histogram.
    """
    h = histogram.withColumns({"sum_tokens": F.col("n_tokens") * F.col("n_docs"), "block": F.floor(F.col("n_tokens") / BLOCK)})
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("sum_tokens").alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("all_docs"), F.sum("t").over(every).alias("all_tokens"),
    )
    down = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        h.join(blocks, "block")
        .withColumns({"docs_ge": F.sum("n_docs").over(down) + F.col("d_after"), "tokens_ge": F.sum("sum_tokens").over(down) + F.col("t_after")})
        .withColumns({"docs_le": F.col("all_docs") - F.col("docs_ge") + F.col("n_docs")})
        .select(
            "n_tokens", "n_docs", "sum_tokens", "docs_ge", "tokens_ge", "docs_le",
            (F.col("docs_le") / F.col("all_docs")).alias("share_le"),
            (F.col("all_tokens") - F.col("tokens_ge") + F.col("docs_ge") * F.col("n_tokens")).alias("truncated_total"),
        )
    )


def totals_at(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For any context limits: docs_over, tokens_kept (every document cut there), tokens_lost."""
    if len(limits) > MOST_LIMITS:
        raise ValueError(f"{len(limits)} context limits; {MOST_LIMITS} at most")
    asked = F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in dict.fromkeys(limits)]) if limits else F.array().cast("array<bigint>")).alias("context_limit")
    over = F.col("n_tokens") > F.col("context_limit")
    lost = F.when(over, (F.col("n_tokens") - F.col("context_limit")) * F.col("n_docs")).otherwise(0)
    kept = F.least("n_tokens", "context_limit") * F.col("n_docs")
    return sums.select("n_tokens", "n_docs", asked).groupBy("context_limit").agg(
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"), F.sum(kept).alias("tokens_kept"), F.sum(lost).alias("tokens_lost")
    )


def quantile(sums: DataFrame, q: float) -> DataFrame:
    """One row: the least length that at least a share q of the documents does not exceed."""
    return sums.filter(F.col("share_le") >= F.lit(float(q))).agg(F.min("n_tokens").alias("n_tokens"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents")))
