"""From nearest chunks to ranked owners, and what is done with ranked lists of hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: weight of the score of an owner found only in a similar scope.
SIMILAR_WEIGHT = 0.72


def rank_owners(hits: DataFrame, k_owners: int | None, per_owner: int) -> DataFrame:
    """Owners by their nearest chunk, each with up to per_owner nearest chunks.

    hits has query_id, owner_id, chunk_id and distance: the chunks that count, already cut to the
    nearest ones where a limit is wanted. Gives query_id, owner_id, rn, chunk_id, distance,
    best_distance, avg_distance, n_hits and score = 1 / (1 + distance). Ties go by id.
    """
    each = hits.groupBy("query_id", "owner_id").agg(F.min("distance").alias("best_distance"), F.avg("distance").alias("avg_distance"), F.count(F.lit(1)).alias("n_hits"))
    if k_owners is not None:
        by_best = Window.partitionBy("query_id").orderBy(F.round("best_distance", 9), "owner_id")
        each = each.withColumn("place", F.row_number().over(by_best)).filter(F.col("place") <= k_owners).drop("place")
    within = Window.partitionBy("query_id", "owner_id").orderBy(F.round("distance", 9), "chunk_id")
    chunks = hits.withColumn("rn", F.row_number().over(within)).filter(F.col("rn") <= per_owner)
    return chunks.join(each, ["query_id", "owner_id"]).withColumn("score", 1 / (1 + F.col("distance")))


def best_per_owner(hits: DataFrame, by: str = "owner_id") -> DataFrame:
    """One hit per owner and query: the best score, the first of equals; in order of first sight."""
    first = Window.partitionBy("query_id", by)
    order = first.orderBy(F.desc("score"), "pos")
    out = hits.filter(F.col(by).isNotNull()).withColumns({"_n": F.row_number().over(order), "first_pos": F.min("pos").over(first)})
    return out.filter("_n = 1").drop("_n")


def grouped(hits: DataFrame, k_owners: int, per_owner: int) -> DataFrame:
    """Owners by their best hit, with that hit's data and up to per_owner hits each."""
    own = Window.partitionBy("query_id", "owner_id")
    order = own.orderBy(F.desc("score"), "pos")
    rows = hits.filter(F.col("owner_id").isNotNull()).withColumns({"rn": F.row_number().over(order), "best_score": F.max("score").over(own), "best_pos": F.first("pos").over(order)})
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.desc("best_score"), "best_pos"))
    return rows.withColumn("place", rank).filter((F.col("place") <= k_owners) & (F.col("rn") <= per_owner))


def merge_scopes(exact: DataFrame, similar: DataFrame, weight: float = SIMILAR_WEIGHT) -> DataFrame:
    """Owners of both lists; one that is in the exact list is not taken from the similar one."""
    a = exact.withColumns({"scope": F.lit("exact"), "weighted": F.col("score").cast("double")})
    rest = similar.join(exact.select("query_id", "owner_id"), ["query_id", "owner_id"], "left_anti")
    return a.unionByName(rest.withColumns({"scope": F.lit("similar"), "weighted": F.col("score") * weight}))


def or_global(filtered: DataFrame, everything: DataFrame) -> DataFrame:
    """A query's filtered hits, or all its hits where the filter leaves none."""
    left = everything.join(filtered.select("query_id").distinct(), "query_id", "left_anti")
    return filtered.withColumn("fallback", F.lit(False)).unionByName(left.withColumn("fallback", F.lit(True)))


def most_common(hits: DataFrame, value: str, k: int) -> DataFrame:
    """The k most frequent values over all hits; ties by first sight, then value."""
    n = hits.groupBy(value).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("query_id", "pos")).alias("_first"))
    return n.orderBy(F.desc("n"), "_first", value).limit(k).select(value, "n")


def mode(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """The most frequent value that isn't blank for each key; of equals the first by order."""
    n = rows.filter(F.trim(value) != "").groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "_first")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(*keys, value, "n")


#: Fixed value: of how many queries the lists are compared.
COMPARED = 30


def pairwise_jaccard(lists: DataFrame, first: int = COMPARED) -> DataFrame:
    """query_a, query_b, jaccard of the id lists (query_id, ids) of the first queries, all pairs of them."""
    lists = lists.orderBy("query_id").limit(first)
    a = lists.select(F.col("query_id").alias("query_a"), F.array_distinct("ids").alias("x"))
    b = lists.select(F.col("query_id").alias("query_b"), F.array_distinct("ids").alias("y"))
    common = F.size(F.array_intersect("x", "y")) / F.greatest(F.size(F.array_union("x", "y")), F.lit(1))
    return a.join(b, F.col("query_a") < F.col("query_b")).select("query_a", "query_b", common.alias("jaccard"))
