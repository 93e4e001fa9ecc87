"""The search for similar riders from end to end, and lists of candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.operators import nearest, rerank, retrieval


@dataclass(frozen=True)
class Limits:
    """How many chunks are looked at, how many owners are kept, how many chunks each shows."""

    chunks: int = 80
    owners: int = 5
    per_owner: int = 2


def rank_candidates(hits: DataFrame, k: int, asked: dict[str, Column] | None = None, payload: dict[str, Column] | None = None, weights: rerank.Weights | None = None) -> DataFrame:
    """The k best owners of each query: one hit each, densest first, reranked if rules are given."""
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_pos")
    dense = retrieval.best_per_owner(hits).withColumn("pos", F.row_number().over(order))
    ranked = rerank.rerank(dense, asked, payload or {}, weights or rerank.Weights()) if asked else dense.withColumns({"delta": F.lit(0.0), "total": F.col("score"), "place": F.col("pos")})
    return ranked.filter(F.col("place") <= k)


def candidate_lists(ranked: DataFrame, columns: list[str]) -> DataFrame:
    """query_id and an array of its hits in order, for files of candidates."""
    item = F.struct("place", *columns)
    return ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("candidates"))


def similar_owners(vectors: DataFrame, queries: DataFrame, owner: Column, scope: str, limits: Limits = Limits(), factor: Column | None = None) -> DataFrame:  # noqa: B008
    """Owners near each query in its scope, filled up with those near it anywhere.

    vectors and queries have id, vector and the scope; queries whose scope is null search anywhere.
    A scoped query that finds nothing stays empty, rather than going on anywhere. Owners of the
    scope come first; the others' scores weigh less. factor changes the final score.
    """

    def owners(found: DataFrame) -> DataFrame:
        hits = found.select("query_id", F.col("id").alias("chunk_id"), (1 - F.col("similarity")).alias("distance"), "id").withColumn("owner_id", owner)
        return retrieval.rank_owners(hits.drop("id"), limits.owners, 1).select("query_id", "owner_id", "chunk_id", "best_distance", "score")

    exact = owners(nearest.nearest(vectors, queries.filter(F.col(scope).isNotNull()), limits.chunks, scope))
    anywhere = owners(nearest.nearest(vectors, queries.drop(scope), limits.chunks))
    empty = queries.filter(F.col(scope).isNotNull()).select(F.col("id").alias("query_id")).join(exact.select("query_id").distinct(), "query_id", "left_anti")
    merged = retrieval.merge_scopes(exact, anywhere.join(empty, "query_id", "left_anti"))
    final = F.col("weighted") * factor if factor is not None else F.col("weighted")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("scope") == "exact"), F.desc(F.round("final", 9)), "owner_id")
    return merged.withColumn("final", final).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limits.owners)


def filled(*fields: Column) -> Column:
    """How many of some texts aren't blank."""
    return sum((F.coalesce((F.trim(c) != "").cast("int"), F.lit(0)) for c in fields), F.lit(0))


def final_rank(owners: DataFrame, k: int, component_asked: Column | None = None) -> DataFrame:
    """Adds place, and keeps the k first owners of each query.

    owners has query_id, owner_id, same_event, exact_scope, known_event and component_hit (booleans),
    score (weighted, with surface factor and subtype bonus), coverage, year and text_length. Owners
    of the same event come first and the others fill up; then those found in the exact scope; then,
    where the query asks for a component, those that have it; then known events, and the greater
    score, coverage, year and length. Nulls count as false and 0; equals go by owner_id.
    """
    hit = F.col("component_hit") & (component_asked if component_asked is not None else F.lit(True))
    flags = [F.coalesce(c, F.lit(False)) for c in (F.col("same_event"), F.col("exact_scope"), hit, F.col("known_event"))]
    sizes = [F.coalesce(c, F.lit(0)) for c in (F.round("score", 9), F.col("coverage"), F.col("year"), F.col("text_length"))]
    order = Window.partitionBy("query_id").orderBy(*[c.desc() for c in (*flags, *sizes)], "owner_id")
    return owners.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
