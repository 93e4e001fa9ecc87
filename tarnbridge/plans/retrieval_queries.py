"""Queries of vector retrieval and its evaluation over the driver's tables, with their SQL.

The query vectors are all rows of embeddings whose vec_id is divisible by 100; five vectors in a row
are the chunks of one owner, labels are the scopes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.text import title_exact, title_words, token_jaccard, year_in
from tarnbridge.functions.vectors import cosine, tidy
from tarnbridge.operators import events as E
from tarnbridge.operators import index as X
from tarnbridge.operators import metrics as M
from tarnbridge.operators import retrieval as R
from tarnbridge.operators import search as S
from tarnbridge.operators.nearest import nearest
from tarnbridge.session import shared_folder
from tarnbridge.sources.tables import is_small, table

OWNER = 5
EVERY = 100
#: Lists of the index and how many a search looks into: many, as the table's vectors form no clusters (recall 0.94 at sf0.01, 0.965 at sf0.1).
LISTS, PROBES = 32, 22
#: Vectors that a search by codes ranks at last.
CANDIDATES = 60


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _hits(spark: SparkSession, d: str, k: int, scope: str | None = None) -> DataFrame:
    v = _vectors(spark, d)
    found = nearest(v, v.filter(F.col("id") % EVERY == 0), k, scope)
    return found.select(
        "query_id", F.col("id").alias("chunk_id"), F.floor(F.col("id") / OWNER).alias("owner_id"), F.col("similarity").alias("score"), (1 - F.col("similarity")).alias("distance"), "pos"
    )


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.select("query_id", "owner_id", "rn", "chunk_id", tidy(F.col("distance")).alias("distance"), tidy(F.col("best_distance")).alias("best_distance"), tidy(F.col("avg_distance")).alias("avg_distance"), "n_hits", tidy(F.col("score")).alias("score"))


def chunk_rank_global(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(R.rank_owners(_hits(spark, d, 100), 5, 3))


def chunk_rank_scoped(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(R.rank_owners(_hits(spark, d, 20, "label"), 5, 2))


def chunk_rank_for_ids(spark: SparkSession, d: str) -> DataFrame:
    """All chunks, without limits, of the owners that the scoped search has found."""
    owners = R.rank_owners(_hits(spark, d, 20, "label"), 5, 1).select("query_id", "owner_id")
    v = _vectors(spark, d)
    chunks = owners.join(v.select(F.floor(F.col("id") / OWNER).alias("owner_id"), F.col("id").alias("chunk_id"), "vector"), "owner_id")
    both = chunks.join(v.select(F.col("id").alias("query_id"), F.col("vector").alias("query")), "query_id")
    return _ranked(R.rank_owners(both.select("query_id", "owner_id", "chunk_id", (1 - cosine(F.col("query"), F.col("vector"))).alias("distance")), None, 3))


def _merged(spark: SparkSession, d: str) -> DataFrame:
    best = lambda hits: R.rank_owners(hits, 5, 1).select("query_id", "owner_id", "best_distance", "score")
    return R.merge_scopes(best(_hits(spark, d, 20, "label")), best(_hits(spark, d, 100)))


def scope_merge_weighted(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("scope") != "exact", F.desc(F.round("weighted", 9)), "owner_id")
    return _merged(spark, d).withColumn("place", F.row_number().over(order)).select("query_id", "owner_id", "scope", "place", tidy(F.col("weighted")).alias("weighted"))


def vector_topk_meta_left(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "lang", "source")
    return _hits(spark, d, 10).join(meta, "chunk_id", "left").select("query_id", "chunk_id", "pos", "lang", "source", tidy(F.col("score")).alias("score"))


def index_search(spark: SparkSession, d: str) -> DataFrame:
    """Each query's nearest by an index of LISTS lists, PROBES of which are looked into."""
    v = _vectors(spark, d)
    centres = X.fit(v, LISTS)
    found = X.search(X.assigned(v, centres), v.filter(F.col("id") % EVERY == 0), centres, 10, PROBES)
    return found.select("query_id", F.col("id").alias("chunk_id"), "pos", tidy(F.col("similarity")).alias("similarity"))


def _code_index(spark: SparkSession, d: str) -> DataFrame:
    """What a search finds in an index of codes that is written and read again."""
    v = _vectors(spark, d)
    centres, books = X.fit(v, LISTS), X.fit_codes(v)
    path = f"{shared_folder(spark)}/codes-{uuid.uuid4().hex}"
    X.write_codes(v, centres, books, path)
    codes, lists = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors")
    found = X.search_codes(codes, lists, v.filter(F.col("id") % EVERY == 0), centres, books, 10, LISTS, CANDIDATES).checkpoint()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return found


def code_search(spark: SparkSession, d: str) -> DataFrame:
    """Each query's nearest by codes of 16 bytes in all lists, the best CANDIDATES of which are ranked by their vectors."""
    return _code_index(spark, d).select("query_id", F.col("id").alias("chunk_id"), "pos", tidy(F.col("similarity")).alias("similarity"))


def vector_filtered_or_global(spark: SparkSession, d: str) -> DataFrame:
    """Queries of even labels are held to their label; the others to one that has no vectors."""
    v = _vectors(spark, d)
    q = v.filter(F.col("id") % EVERY == 0).withColumn("label", F.when(F.col("label") % 2 == 0, F.col("label")).otherwise(-1))
    both = R.or_global(nearest(v, q, 8, "label"), nearest(v, q.drop("label"), 8))
    return both.select("query_id", F.col("id").alias("chunk_id"), "pos", "fallback", tidy(F.col("similarity")).alias("score"))


def hits_grouped(spark: SparkSession, d: str) -> DataFrame:
    return R.grouped(_hits(spark, d, 50), 6, 3).select("query_id", "owner_id", "place", "rn", "chunk_id", tidy(F.col("best_score")).alias("best_score"), tidy(F.col("score")).alias("score"))


def _deduped(spark: SparkSession, d: str, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "first_pos")
    return R.best_per_owner(_hits(spark, d, k)).withColumn("place", F.row_number().over(order))


def hits_deduped(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d, 50).filter("place <= 10").select("query_id", "owner_id", "chunk_id", "first_pos", "place", tidy(F.col("score")).alias("score"))


def cosine_guarded(spark: SparkSession, d: str) -> DataFrame:
    """Each vector with the one after it; the last has none and gets 0."""
    v = _vectors(spark, d)
    after = v.select((F.col("id") - 1).alias("id"), F.col("vector").alias("other"))
    return v.join(after, "id", "left").select(F.col("id").alias("vec_id"), tidy(cosine(F.col("vector"), F.col("other"))).alias("similarity"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    """Owners with chunks of the query's label, graded by how many, up to 3."""
    v = _vectors(spark, d)
    n = v.groupBy("label", F.floor(F.col("id") / OWNER).alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return v.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "label").join(n, "label").select("query_id", "doc_id", F.least("n", F.lit(3)).alias("rel"))


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return _deduped(spark, d, 100).select("query_id", F.col("owner_id").alias("doc_id"), F.col("place").alias("pos"))


_NAMES = ("hitrate", "recall", "precision", "mrr", "ap", "dcg", "ndcg")


def metrics_at_ks(spark: SparkSession, d: str) -> DataFrame:
    m = M.metrics(_lists(spark, d), _qrels(spark, d), [1, 3, 5, 10, 20])
    return m.select("query_id", "k", *[tidy(F.col(n)).alias(n) for n in _NAMES])


def metrics_summary(spark: SparkSession, d: str) -> DataFrame:
    m = M.metrics(_lists(spark, d), _qrels(spark, d), [1, 3, 5, 10, 20])
    return m.groupBy("k").agg(F.count(F.lit(1)).alias("queries"), *[tidy(F.coalesce(F.avg(n), F.lit(0.0)), 5).alias(n) for n in _NAMES])


def rerank_safe_fallback(spark: SparkSession, d: str) -> DataFrame:
    """The dense order against one by rising owner, with the better of both for each query."""
    dense, qrels = _lists(spark, d).filter("pos <= 10"), _qrels(spark, d)
    order = Window.partitionBy("query_id").orderBy("doc_id")
    other = dense.withColumn("pos", F.row_number().over(order))
    out = M.safe_fallback(M.metrics(dense, qrels, [5]), M.metrics(other, qrels, [5]))
    return out.select("query_id", "fallback", *[tidy(F.col(c)).alias(c) for c in out.columns if c not in ("query_id", "fallback")])


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """The report over all queries, with latencies made of their ids."""
    q = _vectors(spark, d).filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"))
    latency = q.select("query_id", (F.col("query_id") % 700 / 10).alias("retrieval_ms"), (F.col("query_id") % 300 / 100).alias("rerank_ms"))
    out = M.report(q, rerank_safe_fallback(spark, d), latency)
    return out.select(*[tidy(F.col(c), 5).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def worst_queries(spark: SparkSession, d: str) -> DataFrame:
    """The ten queries with the least reciprocal rank (a top-k report)."""
    m = M.metrics(_lists(spark, d), _qrels(spark, d), [10])
    return m.orderBy(F.round("mrr", 9), "query_id").limit(10).select("query_id", tidy(F.col("mrr")).alias("mrr"))


def overlap_jaccard(spark: SparkSession, d: str) -> DataFrame:
    lists = _hits(spark, d, 20).groupBy("query_id").agg(F.collect_set("owner_id").alias("ids"))
    pairs = R.pairwise_jaccard(lists)
    return pairs.select("query_a", "query_b", tidy(F.col("jaccard")).alias("jaccard"))


def overlap_average(spark: SparkSession, d: str) -> DataFrame:
    lists = _hits(spark, d, 20).groupBy("query_id").agg(F.collect_set("owner_id").alias("ids"))
    return R.pairwise_jaccard(lists).agg(F.count(F.lit(1)).alias("pairs"), tidy(F.avg("jaccard"), 5).alias("average"))


def top_frequent(spark: SparkSession, d: str) -> DataFrame:
    return R.most_common(_hits(spark, d, 20), "owner_id", 10)


def qrels_from_labels(spark: SparkSession, d: str) -> DataFrame:
    """Relevant documents by source: those of at least the least grade; sources without one are kept."""
    labels = table(spark, d, "labels").filter("quality >= 1").select("doc_id", F.col("quality").alias("rel"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    judged = docs.join(labels, "doc_id")
    return docs.select("source").distinct().join(judged, "source", "left").select(F.col("source").alias("qid"), "doc_id", "rel")


def similar_events(spark: SparkSession, d: str) -> DataFrame:
    """Labels as events with nations' names as titles: linked where they follow each other."""
    v = _vectors(spark, d).filter("label is not null").select("label", F.posexplode("vector").alias("i", "x"))
    centre = v.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("x")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", F.round("x", 3).alias("x")))), lambda s: s["x"]).alias("c"))
    title = table(spark, d, "nation").select(F.col("n_nationkey").alias("label"), F.lower(F.regexp_replace("n_name", "_", " ")).alias("title"))
    e = centre.join(title, "label")
    a = e.select(F.col("label").alias("event"), F.col("c").alias("ca"), F.col("title").alias("ta"))
    b = e.select(F.col("label").alias("other"), F.col("c").alias("cb"), "title")
    if not is_small(b):  # each event meets each other: a dimension, not a table that grows
        raise ValueError("too many events to compare all of them")
    pairs = a.join(b, F.col("event") != F.col("other")).select(
        "event", "other", "title", ((F.col("event") + 1) % 10 == F.col("other")).alias("curated"), F.greatest(F.lit(0.0), cosine(F.col("ca"), F.col("cb"))).alias("cosine"), token_jaccard(F.col("ta"), F.col("title")).alias("jaccard")
    )
    return E.similar_events(pairs).select("event", "other", "place", tidy(F.col("score"), 5).alias("score"))


def event_scope(spark: SparkSession, d: str) -> DataFrame:
    """For each query, what the search is held to: owners all of whose chunks have its label are exact."""
    v = _vectors(spark, d)
    pure = v.groupBy(F.floor(F.col("id") / OWNER).alias("owner_id")).agg(F.min("label").alias("label"), F.max("label").alias("high")).filter("label = high").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    q = v.filter(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "label").join(pure, "label", "left")
    n = F.coalesce("n", F.lit(0))
    return q.select("query_id", n.alias("exact_owners"), E.scope(n, F.col("label") % 2).alias("scope"))


TITLES = ("Granguanche Audax Road", "Granguanche Audax Trail 2024", "Highland Trail 550", "Unknown Event", "", "Gravel Birds 2023", "All Road Ultra")
ASKED = ("granguanche road setup", "trail tyres for the granguanche", "gravel", "what to pack")
HINTS = ("Granguanche Audax", "", "Gravel Birds")


def _chosen(values: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def final_rank_tuple(spark: SparkSession, d: str) -> DataFrame:
    """Merged owners by the whole rank: event, scope, component, score with its changes, fields filled, year, length.

    Each owner has one of TITLES as its event; each query asks one of ASKED about one of HINTS.
    """
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("owner_id"), "lang", "source", "n_chars")
    asked = F.floor(F.col("query_id") / EVERY)
    rows = _merged(spark, d).join(docs, "owner_id", "left").withColumns({"title": _chosen(TITLES, F.col("owner_id")), "t": title_words(_chosen(TITLES, F.col("owner_id"))), "h": title_words(_chosen(HINTS, asked)), "q": title_words(_chosen(ASKED, asked))})
    factor = F.when(F.col("lang") == "en", 1.15).when(F.col("lang") == "de", 0.72).when(F.col("lang") == "fr", 0.92).otherwise(1.0)
    rows = rows.withColumns({
        "same_event": title_exact(F.col("t"), F.col("h")), "exact_scope": F.col("scope") == "exact", "known_event": E.is_known(F.col("title")), "component_hit": F.pmod("owner_id", F.lit(3)) == 0,
        "score": F.col("weighted") * factor + E.subtype_bonus(F.col("t"), F.col("h"), F.col("q")), "coverage": S.filled(F.col("lang"), F.col("source"), F.col("title")),
        "year": year_in(F.col("title")), "text_length": F.col("n_chars"),
    })
    ranked = S.final_rank(rows, 5, F.pmod(asked, F.lit(2)) == 0)
    return ranked.select("query_id", "owner_id", "scope", "place", "same_event", "coverage", tidy(F.col("score")).alias("final"))


def event_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Nations as articles, suppliers as their owners, customers' questions; each event is like the next two."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("article_id"), "n_name")
    articles = n.select("article_id", F.concat("n_name", F.lit(" Race "), (F.lit(2020) + F.col("article_id") % 5).cast("string")).alias("title"))
    owners = table(spark, d, "supplier").select(F.col("s_nationkey").cast("bigint").alias("article_id"), F.col("s_suppkey").alias("owner_id"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), F.col("c_nationkey").cast("bigint").alias("article_id"), F.col("c_custkey").alias("k")).join(n, "article_id", "left")
    text = F.when(F.col("k") % 3 == 0, F.concat(F.lit("setup for the "), "n_name", F.lit(" race 2019?"))).when(F.col("k") % 3 == 1, F.concat(F.lit("what to pack for "), "n_name")).otherwise("which tyres")
    hint = F.when(F.col("k") % 4 == 0, F.concat(F.lit("NATION_"), (F.col("article_id") + 1).cast("string"))).when(F.col("k") % 4 == 1, "")
    queries = c.select("query_id", text.alias("query"), hint.alias("hint"))
    like = articles.select("article_id", F.col("title").alias("other"))
    after = articles.withColumn("to", F.explode(F.array(F.col("article_id") + 1, F.col("article_id") + 2))).join(like.withColumnRenamed("article_id", "to"), "to")
    similar = after.select(F.col("title").alias("event"), F.col("other").alias("title")).unionAll(after.select(F.regexp_extract("title", "^(\\S+)", 1), "other"))
    out = E.ground(queries, articles, owners, similar)
    return out.select("query_id", "hint", F.array_join("exact_articles", ",").alias("exact_articles"), "exact_owners", "needs_similar", F.array_join("similar_titles", "|").alias("similar_titles"), "scope")


QUERIES = {
    f.__name__: f
    for f in (
        chunk_rank_global, chunk_rank_scoped, chunk_rank_for_ids, scope_merge_weighted, vector_topk_meta_left, index_search, code_search, vector_filtered_or_global, hits_grouped, hits_deduped, cosine_guarded, metrics_at_ks,
        metrics_summary, rerank_safe_fallback, evaluation_report, worst_queries, overlap_jaccard, overlap_average, top_frequent, qrels_from_labels, similar_events, event_scope, event_grounding, final_rank_tuple,
    )
}

_R = lambda x, n=6: f"(round({x}, {n}) + 0.0)"
_norm = lambda x: rf"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '\b(?:19|20)\d{{2}}\b', ' ', 'g'), '[''’`]', '', 'g'), '[^a-z0-9]+', ' ', 'g'))"
_pick = lambda values, by: "([" + ", ".join(f"'{v}'" for v in values) + f"])[({by}) % {len(values)} + 1]"
_ALL = f"""
e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
q AS (SELECT vec_id AS query_id, label AS q_label, v AS qv FROM e WHERE vec_id % {EVERY} = 0),
a AS (SELECT query_id, q_label, vec_id AS chunk_id, vec_id // {OWNER} AS owner_id, label, list_cosine_similarity(qv, v) AS score, 1 - list_cosine_similarity(qv, v) AS distance FROM q, e)"""


def _h(k: int, scoped: bool = False, name: str = "h") -> str:
    where = "WHERE label = q_label" if scoped else ""
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS pos FROM a {where} QUALIFY pos <= {k})"


def _owners(hits: str, k: int | None, name: str = "o") -> str:
    cut = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(best_distance, 9), owner_id) <= {k}" if k else ""
    return f"{name} AS (SELECT * FROM (SELECT query_id, owner_id, min(distance) AS best_distance, avg(distance) AS avg_distance, count(*) AS n_hits FROM {hits} GROUP BY ALL) {cut})"


def _chunks(hits: str, m: int, name: str = "c") -> str:
    return f"{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id, owner_id ORDER BY round(distance, 9), chunk_id) AS rn FROM {hits} QUALIFY rn <= {m})"


_OUT = f"SELECT query_id, owner_id, rn::INTEGER AS rn, chunk_id, {_R('distance')} AS distance, {_R('best_distance')} AS best_distance, {_R('avg_distance')} AS avg_distance, n_hits, {_R('1 / (1 + distance)')} AS score FROM c JOIN o USING (query_id, owner_id)"
_MERGED = f"""{_h(20, True, 'hs')}, {_h(100, False, 'hg')}, {_owners('hs', 5, 'os')}, {_owners('hg', 5, 'og')},
m AS (
  SELECT query_id, owner_id, 'exact' AS scope, 1 / (1 + best_distance) AS weighted FROM os
  UNION ALL SELECT query_id, owner_id, 'similar', 1 / (1 + best_distance) * {R.SIMILAR_WEIGHT} FROM og ANTI JOIN os USING (query_id, owner_id)
)"""


def _dedup(k: int) -> str:
    return f"""{_h(k)}, f AS (
  SELECT *, min(pos) OVER (PARTITION BY query_id, owner_id) AS first_pos FROM h QUALIFY row_number() OVER (PARTITION BY query_id, owner_id ORDER BY score DESC, pos) = 1
), l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, first_pos) AS place FROM f)"""


_QRELS = f"""n AS (SELECT label AS q_label, vec_id // {OWNER} AS doc_id, least(count(*), 3) AS rel FROM e GROUP BY ALL), r AS (SELECT query_id, doc_id, rel FROM q JOIN n USING (q_label))"""


def _metrics(lists: str, name: str, ks: str = "(1), (3), (5), (10), (20)") -> str:
    return f"""{name}_j AS (
  SELECT g.query_id, g.doc_id, g.pos, coalesce(rel, 0) AS rel, sum(CASE WHEN coalesce(rel, 0) > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g.query_id ORDER BY g.pos) AS hits,
    (2.0::DOUBLE ** coalesce(rel, 0) - 1) / log2(g.pos + 1) AS gain FROM {lists} g LEFT JOIN r ON g.query_id = r.query_id AND g.doc_id = r.doc_id
), {name}_i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, doc_id) AS place FROM r
), {name} AS (
  SELECT q0.query_id, k,
    coalesce((SELECT max(CASE WHEN rel > 0 THEN 1.0 ELSE 0.0 END) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k), 0)::DOUBLE AS hitrate,
    coalesce((SELECT count(DISTINCT doc_id) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k AND rel > 0)::DOUBLE / nullif((SELECT count(*) FROM r WHERE r.query_id = q0.query_id), 0), 0) AS recall,
    (SELECT count(DISTINCT doc_id) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k AND rel > 0)::DOUBLE / k AS precision,
    coalesce(1.0::DOUBLE / (SELECT min(pos) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k AND rel > 0), 0) AS mrr,
    coalesce((SELECT sum(hits::DOUBLE / pos) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k AND rel > 0) / nullif((SELECT count(*) FROM r WHERE r.query_id = q0.query_id), 0), 0) AS ap,
    coalesce((SELECT sum(gain) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k), 0) AS dcg,
    coalesce((SELECT sum(gain) FROM {name}_j j WHERE j.query_id = q0.query_id AND j.pos <= k) / (SELECT sum((2.0::DOUBLE ** rel - 1) / log2(place + 1)) FROM {name}_i i WHERE i.query_id = q0.query_id AND i.place <= k), 0) AS ndcg
  FROM (SELECT DISTINCT query_id FROM {lists}) q0, (VALUES {ks}) ks(k))"""


_LIST = "g AS (SELECT query_id, owner_id AS doc_id, place AS pos FROM l)"
ORACLES = {
    "chunk_rank_global": f"WITH {_ALL}, {_h(100)}, {_owners('h', 5)}, {_chunks('h', 3)} {_OUT}",
    "chunk_rank_scoped": f"WITH {_ALL}, {_h(20, True)}, {_owners('h', 5)}, {_chunks('h', 2)} {_OUT}",
    "chunk_rank_for_ids": f"WITH {_ALL}, {_h(20, True)}, {_owners('h', 5, 'w')}, b AS (SELECT a.* FROM a SEMI JOIN w USING (query_id, owner_id)), {_owners('b', None)}, {_chunks('b', 3)} {_OUT}",
    "scope_merge_weighted": f"WITH {_ALL}, {_MERGED} SELECT query_id, owner_id, scope, row_number() OVER (PARTITION BY query_id ORDER BY scope <> 'exact', round(weighted, 9) DESC, owner_id)::INTEGER AS place, {_R('weighted')} AS weighted FROM m",
    "vector_topk_meta_left": f"WITH {_ALL}, {_h(10)} SELECT query_id, chunk_id, pos::INTEGER AS pos, lang, source, {_R('score')} AS score FROM h LEFT JOIN documents ON doc_id = chunk_id",
    "vector_filtered_or_global": f"""WITH {_ALL}, b AS (SELECT *, q_label % 2 <> 0 AS fallback FROM a WHERE q_label % 2 <> 0 OR label = q_label)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS pos, fallback, {_R('score')} AS score FROM b QUALIFY pos <= 8""",
    "hits_grouped": f"""WITH {_ALL}, {_h(50)}, x AS (
  SELECT *, row_number() OVER w AS rn, max(score) OVER (PARTITION BY query_id, owner_id) AS best_score, first_value(pos) OVER w AS best_pos FROM h WINDOW w AS (PARTITION BY query_id, owner_id ORDER BY score DESC, pos)
), y AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best_score DESC, best_pos) AS place FROM x)
SELECT query_id, owner_id, place::INTEGER AS place, rn::INTEGER AS rn, chunk_id, {_R('best_score')} AS best_score, {_R('score')} AS score FROM y WHERE place <= 6 AND rn <= 3""",
    "hits_deduped": f"WITH {_ALL}, {_dedup(50)} SELECT query_id, owner_id, chunk_id, first_pos::INTEGER AS first_pos, place::INTEGER AS place, {_R('score')} AS score FROM l WHERE place <= 10",
    "cosine_guarded": f"SELECT x.vec_id, {_R('coalesce(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 0)')} AS similarity FROM embeddings x LEFT JOIN embeddings y ON y.vec_id = x.vec_id + 1",
    "metrics_at_ks": f"WITH {_ALL}, {_dedup(100)}, {_LIST}, {_QRELS}, {_metrics('g', 'm')} SELECT query_id, k, {', '.join(f'{_R(n)} AS {n}' for n in _NAMES)} FROM m",
    "metrics_summary": f"WITH {_ALL}, {_dedup(100)}, {_LIST}, {_QRELS}, {_metrics('g', 'm')} SELECT k, count(*) AS queries, {', '.join(f'{_R(f"avg({n})", 5)} AS {n}' for n in _NAMES)} FROM m GROUP BY k",
    "rerank_safe_fallback": f"""WITH {_ALL}, {_dedup(100)}, g AS (SELECT query_id, owner_id AS doc_id, place AS pos FROM l WHERE place <= 10), z AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS pos FROM g),
{_QRELS}, {_metrics('g', 'b', '(5)')}, {_metrics('z', 'x', '(5)')}, y AS (
  SELECT b.query_id, b.hitrate AS bh, b.mrr AS bm, x.hitrate AS xh, x.mrr AS xm, x.hitrate < b.hitrate OR (x.hitrate = b.hitrate AND x.mrr + 1e-12 < b.mrr) AS fallback FROM b JOIN x USING (query_id))
SELECT query_id, fallback, {_R('bh')} AS base_hitrate, {_R('bm')} AS base_mrr, {_R('xh')} AS reranked_hitrate, {_R('xm')} AS reranked_mrr, {_R('CASE WHEN fallback THEN bh ELSE xh END')} AS final_hitrate, {_R('CASE WHEN fallback THEN bm ELSE xm END')} AS final_mrr FROM y""",
    "worst_queries": f"WITH {_ALL}, {_dedup(100)}, {_LIST}, {_QRELS}, {_metrics('g', 'm', '(10)')} SELECT query_id, {_R('mrr')} AS mrr FROM m ORDER BY round(m.mrr, 9), query_id LIMIT 10",
    "overlap_average": f"""WITH {_ALL}, {_h(20)}, s AS (SELECT query_id, list(DISTINCT owner_id) AS ids FROM h GROUP BY query_id ORDER BY query_id LIMIT {R.COMPARED})
SELECT count(*) AS pairs, {_R('avg(len(list_intersect(x.ids, y.ids))::DOUBLE / greatest(len(list_distinct(list_concat(x.ids, y.ids))), 1))', 5)} AS average FROM s x JOIN s y ON x.query_id < y.query_id""",
    "overlap_jaccard": f"""WITH {_ALL}, {_h(20)}, s AS (SELECT query_id, list(DISTINCT owner_id) AS ids FROM h GROUP BY query_id ORDER BY query_id LIMIT {R.COMPARED})
SELECT x.query_id AS query_a, y.query_id AS query_b, {_R('len(list_intersect(x.ids, y.ids))::DOUBLE / greatest(len(list_distinct(list_concat(x.ids, y.ids))), 1)')} AS jaccard FROM s x JOIN s y ON x.query_id < y.query_id""",
    "top_frequent": f"WITH {_ALL}, {_h(20)}, s AS (SELECT owner_id, count(*) AS n, min(query_id * 1000000 + pos) AS f FROM h GROUP BY owner_id) SELECT owner_id, n FROM s ORDER BY n DESC, f, owner_id LIMIT 10",
    "qrels_from_labels": """
WITH j AS (SELECT source, doc_id, quality AS rel FROM documents JOIN labels USING (doc_id) WHERE quality >= 1)
SELECT s.source AS qid, doc_id, rel FROM (SELECT DISTINCT source FROM documents) s LEFT JOIN j USING (source)""",
    "similar_events": f"""
WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE label IS NOT NULL),
c AS (SELECT label, list(round(s, 3) ORDER BY i) AS c FROM (SELECT label, i, sum(x::DOUBLE) AS s FROM x GROUP BY ALL) GROUP BY label),
e AS (SELECT label, c, lower(replace(n_name, '_', ' ')) AS title, list_distinct(list_filter(string_split(lower(replace(n_name, '_', ' ')), ' '), lambda t: t <> '')) AS w FROM c JOIN nation ON n_nationkey = label),
p AS (SELECT a.label AS event, b.label AS other, b.title, {E.SHARES[0]} * ((a.label + 1) % 10 = b.label)::INTEGER + {E.SHARES[1]} * greatest(0, list_cosine_similarity(a.c, b.c))
  + {E.SHARES[2]} * len(list_intersect(a.w, b.w))::DOUBLE / greatest(1, len(list_distinct(list_concat(a.w, b.w)))) AS score FROM e a JOIN e b ON a.label <> b.label),
f AS (SELECT * FROM p WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY event, title ORDER BY round(score, 9) DESC, other) = 1)
SELECT event, other, row_number() OVER (PARTITION BY event ORDER BY round(score, 9) DESC, other)::INTEGER AS place, {_R('score', 5)} AS score FROM f QUALIFY place <= {E.MOST_SIMILAR}""",
    "event_scope": f"""
WITH p AS (SELECT label, count(*) AS n FROM (SELECT vec_id // {OWNER} AS o, min(label) AS label FROM embeddings GROUP BY o HAVING min(label) = max(label)) GROUP BY label)
SELECT vec_id AS query_id, coalesce(n, 0)::BIGINT AS exact_owners, CASE WHEN coalesce(n, 0) >= {E.ENOUGH_EXACT} THEN 'exact_event' WHEN coalesce(n, 0) > 0 THEN 'exact_plus_similar' WHEN label % 2 > 0 THEN 'similar_events' ELSE 'global' END AS scope FROM embeddings LEFT JOIN p USING (label) WHERE vec_id % {EVERY} = 0""",
    "event_grounding": rf"""
WITH a AS (SELECT n_nationkey::BIGINT AS article_id, n_name || ' Race ' || (2020 + n_nationkey % 5) AS title, n_name FROM nation),
o AS (SELECT s_nationkey::BIGINT AS article_id, s_suppkey AS owner_id FROM supplier),
k AS (SELECT *, {_norm('title')} AS norm FROM a SEMI JOIN o USING (article_id)),
c AS (
  SELECT c_custkey AS query_id, CASE c_custkey % 3 WHEN 0 THEN 'setup for the ' || n_name || ' race 2019?' WHEN 1 THEN 'what to pack for ' || n_name ELSE 'which tyres' END AS query,
    CASE c_custkey % 4 WHEN 0 THEN 'NATION_' || (c_nationkey + 1) END AS given FROM customer JOIN nation ON n_nationkey = c_nationkey),
h AS (SELECT *, (SELECT title FROM k WHERE norm <> '' AND contains({_norm('query')}, norm) ORDER BY length(title) DESC, title LIMIT 1) AS named FROM c),
m AS (SELECT *, coalesce(named, given) AS h1, (SELECT count(*) FROM k WHERE contains(' ' || norm || ' ', ' ' || {_norm('coalesce(named, given)')} || ' ')) AS n1,
  (SELECT count(*) FROM k WHERE contains(' ' || norm || ' ', ' ' || {_norm('given')} || ' ')) AS n2 FROM h),
f AS (SELECT query_id, CASE WHEN n1 = 0 AND n2 > 0 THEN given ELSE h1 END AS hint FROM m),
x AS (SELECT query_id, hint, article_id FROM f JOIN k ON contains(' ' || norm || ' ', ' ' || {_norm('hint')} || ' ')),
e AS (SELECT query_id, list(article_id ORDER BY article_id) AS ids FROM x GROUP BY query_id),
n AS (SELECT query_id, count(DISTINCT owner_id) AS n FROM x JOIN o USING (article_id) GROUP BY query_id),
l AS (SELECT p.title AS event, q.title, p.n_name FROM a p JOIN a q ON q.article_id IN (p.article_id + 1, p.article_id + 2)),
s AS (SELECT event, list(DISTINCT title ORDER BY title) AS titles FROM (SELECT event, title FROM l UNION ALL SELECT n_name, title FROM l) GROUP BY event),
r AS (SELECT f.query_id, hint, coalesce(array_to_string(ids, ','), '') AS exact_articles, coalesce(n, 0) AS exact_owners, hint IS NOT NULL AND coalesce(n, 0) < {E.ENOUGH_EXACT} AS needs_similar, titles
  FROM f LEFT JOIN e USING (query_id) LEFT JOIN n USING (query_id) LEFT JOIN s ON s.event = f.hint)
SELECT query_id, hint, exact_articles, exact_owners, needs_similar, CASE WHEN needs_similar THEN coalesce(array_to_string(titles, '|'), '') ELSE '' END AS similar_titles,
  CASE WHEN exact_owners >= {E.ENOUGH_EXACT} THEN 'exact_event' WHEN exact_articles <> '' THEN 'exact_plus_similar' WHEN needs_similar AND len(titles) > 0 THEN 'similar_events' ELSE 'global' END AS scope FROM r""",
    "final_rank_tuple": f"""WITH {_ALL}, {_MERGED}, g AS (
  SELECT m.*, n_chars, lang, source, {_pick(TITLES, 'owner_id')} AS title, query_id // {EVERY} AS asked FROM m LEFT JOIN documents ON doc_id = owner_id
), t AS (SELECT *, ' ' || {_norm('title')} || ' ' AS t, ' ' || {_norm(_pick(HINTS, 'asked'))} || ' ' AS h, ' ' || {_norm(_pick(ASKED, 'asked'))} || ' ' AS q FROM g
), f AS (
  SELECT *, trim(h) <> '' AND contains(t, h) AS same_event, trim(title) NOT IN ('', 'Unknown Event') AS known, asked % 2 = 0 AND owner_id % 3 = 0 AS hit,
    weighted * CASE lang WHEN 'en' THEN 1.15 WHEN 'de' THEN 0.72 WHEN 'fr' THEN 0.92 ELSE 1.0 END
      + CASE WHEN contains(t, ' granguanche ') AND contains(h, ' granguanche ') THEN 0.08 ELSE 0 END
      + CASE WHEN contains(q, ' road ') THEN CASE WHEN contains(t, ' road ') THEN 0.16 WHEN contains(t, ' gravel ') THEN -0.04 WHEN contains(t, ' trail ') THEN -0.08 ELSE 0 END
             WHEN contains(q, ' gravel ') THEN CASE WHEN contains(t, ' gravel ') THEN 0.16 WHEN contains(t, ' trail ') THEN 0.04 WHEN contains(t, ' road ') THEN -0.05 ELSE 0 END
             WHEN contains(q, ' trail ') THEN CASE WHEN contains(t, ' trail ') THEN 0.16 WHEN contains(t, ' gravel ') THEN 0.04 WHEN contains(t, ' road ') THEN -0.08 ELSE 0 END ELSE 0 END AS final,
    coalesce((trim(lang) <> '')::INTEGER, 0) + coalesce((trim(source) <> '')::INTEGER, 0) + (trim(title) <> '')::INTEGER AS coverage,
    coalesce(try_cast(regexp_extract(title, '(19|20)\\d{{2}}') AS INTEGER), 0) AS year FROM t)
SELECT query_id, owner_id, scope, row_number() OVER (PARTITION BY query_id ORDER BY same_event DESC, scope = 'exact' DESC, hit DESC, known DESC, round(final, 9) DESC, coverage DESC, year DESC, coalesce(n_chars, 0) DESC, owner_id)::INTEGER AS place,
  same_event, coverage::INTEGER AS coverage, {_R('final')} AS final FROM f QUALIFY place <= 5""",
}
ORACLES["evaluation_report"] = f"""
WITH s AS ({ORACLES["rerank_safe_fallback"]}), q AS (SELECT vec_id AS query_id FROM embeddings WHERE vec_id % {EVERY} = 0), r AS (SELECT * FROM q LEFT JOIN s USING (query_id))
SELECT count(*) AS n_queries, count(final_mrr) AS n_labelled, {_R('coalesce(avg(final_hitrate), 0)', 5)} AS hitrate, {_R('coalesce(avg(final_mrr), 0)', 5)} AS mrr, {_R('avg(query_id % 700 / 10.0::DOUBLE)', 5)} AS retrieval_ms,
  {_R('avg(query_id % 300 / 100.0::DOUBLE)', 5)} AS rerank_ms, {_R('avg(query_id % 700 / 10.0::DOUBLE + query_id % 300 / 100.0::DOUBLE)', 5)} AS total_ms, count(*) FILTER (WHERE fallback) AS n_fallback,
  count(*) FILTER (WHERE reranked_hitrate < base_hitrate OR (reranked_hitrate = base_hitrate AND reranked_mrr + 1e-12 < base_mrr)) AS n_regressed FROM r"""
