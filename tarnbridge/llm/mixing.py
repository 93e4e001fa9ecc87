"""Op 7: mixing sources to target weights by weighted fair queueing.

Each source's documents are put into a hashed order and served twice over at most. A document's
virtual finish time is its source's cumulative tokens divided by the source's target, so every
source reaches its target at time 1. All servings are ordered by finish time and the mix ends
where the next one would exceed the total budget.

Sources weigh WEIGHTS in turn, ordered by code point, null last. They share SHARE of all tokens;
a target stops at PASSES times its source's tokens and the excess is shared again by weight.

Cumulative sums run within hash buckets of a source, then over the buckets, and the cut is found
from histograms of finish times, finer and finer until a bin has few rows, then exactly within that
bin: no task holds a source. The order key is hashed from doc_id and text, so rows that share a
doc_id, or have none, are spread.
A null text, or one without words, has size 0; the stream has such a document once where its first
serving lies before the cut; a null source is a source; texts of any length are counted whole;
repeated rows are documents of their own, and ties in the order are such rows; other columns may
have any name; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpointed, table

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
SEED = "mix-1"
#: Hash buckets of a source, as hexadecimal digits of the order key (16 ** 3).
BUCKET_DIGITS = 3
#: Bins of a unit of virtual time in the first histogram that finds the cut; a bin is cut into so many in the next.
BINS = 16384
#: Rows of a bin that one task sorts; finest bins of a unit of time.
BIN_ROWS = 50_000
FINEST = 2**50


def _targets(sources: DataFrame) -> DataFrame:
    """skey, source_size, target: water-filling over the sources, a row each."""
    order = Window.orderBy("skey")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    s = sources.withColumn("w", weight).withColumn("cap", F.col("source_size") * PASSES).withColumn("full_at", F.col("cap") / F.col("w"))
    by_level = Window.orderBy("full_at", "skey")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(every) * F.lit(SHARE))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "skey", "level"))).over(every).getField("level"))
    return s.select("skey", "source_size", F.least(F.col("w") * F.col("level"), F.col("cap").cast("double")).alias("target"), "budget")


def _rows(docs: DataFrame, keep: dict[str, str]) -> DataFrame:
    """doc_id, skey, size, k and bucket of every document, and the columns to carry under their new names."""
    return docs.select(
        "doc_id", *[F.col(f"`{old}`").alias(new) for old, new in keep.items()],
        F.coalesce(F.concat(F.lit("a:"), F.col("source")), F.lit("b")).alias("skey"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit(""))), F.lit("|" + SEED))).alias("k"),
    ).withColumn("bucket", F.substring("k", 1, BUCKET_DIGITS))


def _offsets(rows: DataFrame) -> DataFrame:
    """skey, bucket, source_size, target, budget, and offset: the words of the source in the buckets before."""
    counts = checkpointed(rows.groupBy("skey", "bucket").agg(F.sum("size").alias("n")))
    before = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    targets = _targets(counts.groupBy("skey").agg(F.sum("n").alias("source_size")))
    return counts.select("skey", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).join(targets, "skey")


def _queued(rows: DataFrame, offsets: DataFrame) -> DataFrame:
    """The rows with source_size, target, budget, finish_1 and finish_2."""
    running = Window.partitionBy("skey", "bucket").orderBy("k", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    finish = lambda done: F.when(F.col("target") > 0, done / F.col("target")).otherwise(F.lit(0.0))
    cum = rows.join(offsets, ["skey", "bucket"]).withColumn("cum", F.col("offset") + F.sum("size").over(running))
    both = {"finish_1": finish(F.col("cum").cast("double")), "finish_2": finish((F.col("source_size") + F.col("cum")).cast("double"))}
    return cum.withColumns(both).drop("bucket", "offset", "cum")


def queue(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, skey, size, k (the order key), source_size, target, budget, finish_1, finish_2.

    Texts are read once, for a narrow table.
    """
    rows = checkpointed(_rows(docs, {}))
    return checkpointed(_queued(rows, _offsets(rows)))


def _bin(finish: Column, bins: int) -> Column:
    """Beyond 4 units of virtual time one bin has the rest: the mix ends at about 1."""
    return F.least(F.floor(finish * F.lit(float(bins))), F.lit(4 * bins))


def servings(queued: DataFrame) -> DataFrame:
    """Two rows per document: its servings, each with a finish time."""
    both = F.explode(F.array(*[F.struct(F.col(f"finish_{p}").alias("finish"), F.lit(p).alias("serving")) for p in (1, 2)])).alias("_s")
    return queued.select("*", both).select("*", "_s.finish", "_s.serving").drop("_s")


def cut(queued: DataFrame) -> tuple:
    """bins, edge, over: the first serving that the budget has no room for, as (finish, skey, serving, k), and its bin.

    A few numbers and strings come to the driver, whatever the size of the input.
    """
    rows = servings(queued).filter("size > 0")
    bins, edge, done = BINS, None, 0
    while True:
        some = rows if edge is None else rows.filter(_bin(F.col("finish"), bins // BINS) == edge)
        sums = some.groupBy(_bin(F.col("finish"), bins).alias("bin")).agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"), F.max("budget").alias("budget"))
        upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = sums.withColumn("cum", F.sum("n").over(upto)).filter(F.col("cum") + done > F.col("budget")).orderBy("bin").limit(1).collect()
        if not first:
            return None, None, None
        edge, done = first[0]["bin"], done + first[0]["cum"] - first[0]["n"]
        if first[0]["rows"] <= BIN_ROWS or bins * BINS > FINEST or edge >= 4 * bins:
            break
        bins *= BINS
    order = Window.orderBy("finish", "skey", "serving", "k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = (
        rows.filter(_bin(F.col("finish"), bins) == edge).select("finish", "skey", "serving", "k", "size").withColumn("cum", F.sum("size").over(order))
        .filter(F.col("cum") > F.lit(first[0]["budget"] - done)).agg(F.min(F.struct("finish", "skey", "serving", "k")).alias("over")).collect()[0]["over"]
    )
    return bins, edge, over


def _is_in(finish: Column, serving: Column, bins, edge, over) -> Column:
    if edge is None:
        return F.lit(True)
    mine = F.struct(finish.alias("finish"), F.col("skey").alias("skey"), serving.alias("serving"), F.col("k").alias("k"))
    theirs = F.struct(F.lit(over["finish"]).alias("finish"), F.lit(over["skey"]).alias("skey"), F.lit(over["serving"]).alias("serving"), F.lit(over["k"]).alias("k"))
    return (_bin(finish, bins) < edge) | ((_bin(finish, bins) == edge) & (mine < theirs))


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and both finish times, a row per document."""
    queued = queue(docs)
    end = cut(queued)
    served = [F.when(_is_in(F.col(f"finish_{p}"), F.lit(p), *end), F.col("size")).otherwise(F.lit(0)) for p in (1, 2)]
    return queued.select("doc_id", "size", "source_size", "target", (served[0] + served[1]).cast("bigint").alias("taken"), "finish_1", "finish_2")


def mixed_stream(docs: DataFrame) -> DataFrame:
    """The mix itself: the columns of docs, a row per serving, globally sorted by finish time.

    The cut is found from a narrow table; the texts are read once more, for the rows of the mix.
    """
    keep = {c: f"_keep_{i}" for i, c in enumerate(docs.columns)}
    narrow = checkpointed(_rows(docs, {}))
    offsets = _offsets(narrow)
    end = cut(checkpointed(_queued(narrow, offsets)))
    queued = _queued(_rows(docs, keep), offsets)
    mixed = servings(queued).filter(_is_in(F.col("finish"), F.col("serving"), *end) & ((F.col("size") > 0) | (F.col("serving") == 1)))
    return mixed.sort("finish", "skey", "serving", "k").select(*[F.col(new).alias(old) for old, new in keep.items()])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents"))


def oracle(documents: str = "documents") -> str:
    """SQL for the queue and the cut over the servings of a table: CTEs that end in ``served``."""
    return rf"""
rows AS (
  SELECT *, CASE WHEN source IS NULL THEN 'b' ELSE 'a:' || source END AS skey,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, '')) || '|{SEED}') AS k
  FROM {documents}
), src AS (
  SELECT skey, sum(size)::BIGINT AS source_size, [{', '.join(map(str, WEIGHTS))}][((row_number() OVER (ORDER BY skey)) - 1) % {len(WEIGHTS)} + 1] AS w
  FROM rows GROUP BY skey
), lev AS (
  SELECT *, {PASSES} * source_size AS cap, {PASSES} * source_size / w AS full_at, {SHARE}::DOUBLE * (sum(source_size) OVER ())::BIGINT AS budget FROM src
), lev2 AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (ORDER BY full_at, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / (sum(w) OVER (ORDER BY full_at, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM lev
), tgt AS (
  SELECT skey, source_size, budget,
    least(w * (SELECT level FROM lev2 WHERE level <= full_at ORDER BY full_at, skey LIMIT 1), cap::DOUBLE) AS target FROM lev2
), cum AS (
  SELECT rows.*, source_size, target, budget,
    (sum(size) OVER (PARTITION BY skey ORDER BY substr(k, 1, {BUCKET_DIGITS}), k, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS done
  FROM rows JOIN tgt USING (skey)
), fin AS (
  SELECT *, CASE WHEN target > 0 THEN done::DOUBLE / target ELSE 0.0 END AS finish_1,
    CASE WHEN target > 0 THEN (source_size + done)::DOUBLE / target ELSE 0.0 END AS finish_2 FROM cum
), served AS (
  SELECT * FROM (
    SELECT *, sum(size) OVER (ORDER BY finish, skey, serving, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= budget AS inside
    FROM (SELECT *, finish_1 AS finish, 1 AS serving FROM fin UNION ALL SELECT *, finish_2, 2 FROM fin))
)"""


ORACLE = f"""WITH {oracle()}
SELECT doc_id, size, source_size, target, sum(CASE WHEN inside THEN size ELSE 0 END)::BIGINT AS taken, finish_1, finish_2
FROM served GROUP BY doc_id, size, source_size, target, finish_1, finish_2
"""
