"""Retrieval metrics over ranked lists: set at a time, a row per query.

ranked: query_id, doc_id, pos (from 1). relevant: query_id, doc_id, rel (graded, above 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def metrics(ranked: DataFrame, relevant: DataFrame, ks: list[int]) -> DataFrame:
    """query_id, k and hitrate, recall, precision, mrr, ap, dcg and ndcg at every k.

    A query of ranked without relevant documents has 0 in all. Documents count once in recall.
    """
    queries = ranked.select("query_id").distinct()
    cuts = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    judged = ranked.join(relevant, ["query_id", "doc_id"], "left").select("query_id", "doc_id", "pos", F.coalesce("rel", F.lit(0)).alias("rel"))
    hit = F.col("rel") > 0
    so_far = Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    judged = judged.withColumns({"hits": F.sum(hit.cast("int")).over(so_far), "gain": (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("pos") + 1)})
    ideal = relevant.filter("rel > 0").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "doc_id")))
    n_relevant = relevant.filter("rel > 0").groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_rel"))
    at = judged.select("*", cuts).filter("pos <= k").groupBy("query_id", "k").agg(
        F.max(hit.cast("int")).cast("double").alias("hitrate"), F.countDistinct(F.when(hit, F.col("doc_id"))).alias("found"), F.min(F.when(hit, F.col("pos"))).alias("first_hit"),
        F.sum(F.when(hit, F.col("hits") / F.col("pos")).otherwise(0.0)).alias("precision_sum"), F.sum("gain").alias("dcg"),
    )
    best = ideal.select("*", cuts).filter("place <= k").groupBy("query_id", "k").agg(F.sum((F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(F.col("place") + 1)).alias("idcg"))
    rows = queries.select("*", cuts).join(at, ["query_id", "k"], "left").join(best, ["query_id", "k"], "left").join(n_relevant, "query_id", "left")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return rows.select(
        "query_id", "k", zero(F.col("hitrate")).alias("hitrate"), zero(F.col("found") / F.col("n_rel")).alias("recall"),
        zero(F.when(F.col("k") > 0, F.col("found") / F.col("k"))).alias("precision"), zero(1 / F.col("first_hit")).alias("mrr"),
        zero(F.col("precision_sum") / F.col("n_rel")).alias("ap"), zero(F.col("dcg")).alias("dcg"), zero(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg"),
    )


def report(queries: DataFrame, labelled: DataFrame, latency: DataFrame) -> DataFrame:
    """One row: how many queries and labelled ones, means of the metrics that count, mean latencies, fallbacks and regressions.

    queries has query_id; labelled is of safe_fallback(); latency has query_id, retrieval_ms and rerank_ms. A
    regression is a query whose reranked list is worse than the base, whether or not it fell back.
    Means over nothing are 0.
    """
    rows = queries.select("query_id").distinct().join(labelled, "query_id", "left").join(latency, "query_id", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    worse = (F.col("reranked_hitrate") < F.col("base_hitrate")) | ((F.col("reranked_hitrate") == F.col("base_hitrate")) & (F.col("reranked_mrr") + 1e-12 < F.col("base_mrr")))
    return rows.agg(
        F.count(F.lit(1)).alias("n_queries"), F.count("final_mrr").alias("n_labelled"), mean("final_hitrate").alias("hitrate"), mean("final_mrr").alias("mrr"),
        mean("retrieval_ms").alias("retrieval_ms"), mean("rerank_ms").alias("rerank_ms"), mean(F.col("retrieval_ms") + F.col("rerank_ms")).alias("total_ms"),
        F.count_if("fallback").alias("n_fallback"), F.count_if(worse).alias("n_regressed"),
    )


def safe_fallback(base: DataFrame, other: DataFrame) -> DataFrame:
    """Per query whether the other ranking is worse than the base, and the metrics that count.

    It is worse where the hit rate drops, or ties and the reciprocal rank drops. Both have query_id,
    hitrate and mrr.
    """
    b = base.select("query_id", F.col("hitrate").alias("base_hitrate"), F.col("mrr").alias("base_mrr"))
    worse = (F.col("hitrate") < F.col("base_hitrate")) | ((F.col("hitrate") == F.col("base_hitrate")) & (F.col("mrr") + 1e-12 < F.col("base_mrr")))
    rows = other.select("query_id", "hitrate", "mrr").join(b, "query_id").withColumn("fallback", worse)
    final = lambda x: F.when(F.col("fallback"), F.col(f"base_{x}")).otherwise(F.col(x)).alias(f"final_{x}")
    return rows.select("query_id", "base_hitrate", "base_mrr", F.col("hitrate").alias("reranked_hitrate"), F.col("mrr").alias("reranked_mrr"), "fallback", final("hitrate"), final("mrr"))
