"""Queries of web context, embedding, recommendation and synthesis over the driver's tables, with their SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.functions import text as X
from tarnbridge.functions.vectors import norm, tidy
from tarnbridge.operators import chunks as C
from tarnbridge.operators import embedding as B
from tarnbridge.operators import event_names as N
from tarnbridge.operators import intent as I
from tarnbridge.operators import judging
from tarnbridge.operators import recommend as R
from tarnbridge.operators import search as P
from tarnbridge.operators import synthesis as S
from tarnbridge.operators import web_context as W
from tarnbridge.operators.parsing import article_of
from tarnbridge.plans import retrieval_queries as Q
from tarnbridge.plans import rule_queries as U
from tarnbridge.session import shared_folder
from tarnbridge.sources.tables import spread, table

#: Ten pages in a row are the results of one search; kinds of sites by their names.
KINDS = {"social": ("m.",), "listings": (".example.net",), "trackers": (".example.org",)}
EVENTS = ("Gravel 500", "Road 300", "Colorado Trail 2024", "Alps Ultra 200", "Divide", "Sprint Brevet", "")
TEMPLATES = ("I am riding {event} {year}. Which setup?", "For {event} {year}, which tyres and bags?", "What should I carry for {event} {year}?")
SUFFIXES = ("Constraints: night riding.", "Constraints: few spares.", "Constraints: low gears.")


def _results(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.select(F.floor(F.col("page_id") / 10).alias("event"), (F.col("page_id") % 10).cast("int").alias("rank"), X.canonical_url(F.col("url")).alias("url"))


def search_merge(spark: SparkSession, d: str) -> DataFrame:
    """Two searches for each event that have results in common."""
    r = _results(spark, d)
    first, second = r.filter("rank < 7"), r.filter("rank >= 4").withColumn("rank", F.col("rank") - 4)
    return W.merged_results(first, second).select("event", "rank", "url")


def site_candidates(spark: SparkSession, d: str) -> DataFrame:
    return W.candidates(_results(spark, d), **KINDS)


def context_pages(spark: SparkSession, d: str) -> DataFrame:
    """Each event's first candidate or its site's first rule page that has a text, and that text; parsing has no SQL form."""
    chosen = W.candidates(_results(spark, d), **KINDS).filter("place = 1").select("event", "url")
    pages = table(spark, d, "pages").select(X.canonical_url(F.col("url")).alias("url"), article_of(F.col("html")).getField("page_text").alias("text"))
    return W.context_pages(chosen, pages).select("event", "page_url", "text")


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """A context for each document: some fields empty, some numbers without evidence."""
    i = F.col("doc_id")
    some = lambda n, x: F.when(i % n == 0, x)
    context = F.struct(
        some(2, F.col("lang")).alias("summary"), some(3, F.lit(" gravel ")).alias("surface"), some(5, F.lit("")).alias("route_character"), F.lit(None).cast("string").alias("climate_notes"),
        F.lit(None).cast("string").alias("resupply_notes"), some(7, F.array(F.lit("a"), F.lit("b"))).alias("constraints"), some(4, F.lit(100.0)).alias("distance_km"), some(11, F.lit(9)).alias("total_climbing_m"),
        some(8, F.lit("e")).alias("distance_evidence"), some(11, F.lit("e")).alias("climbing_evidence"),
    )
    results = some(13, F.array(F.struct(F.col("source").alias("title"), F.lit("s").alias("snippet"))))
    return table(spark, d, "documents").select("doc_id", context.alias("c"), results.alias("r"), some(6, F.lit("https://o")).alias("o"), F.lit("").alias("t"))


def context_texts(spark: SparkSession, d: str) -> DataFrame:
    c, r, o, t = map(F.col, "crot")
    return _contexts(spark, d).select("doc_id", W.is_useful(c, o, t, r).alias("useful"), W.context_text(c, r, o, t).alias("text"), W.context_text(c, r, o, t, False).alias("notes"))


def unproven_contexts(spark: SparkSession, d: str) -> DataFrame:
    return W.unproven(_contexts(spark, d).select("doc_id", "c.*")).select("doc_id")


def embed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents that have no label yet, by the offline embedding; hashing has no SQL form."""
    known = table(spark, d, "labels").select("doc_id")
    rows = B.to_embed(table(spark, d, "documents").select("doc_id", "text"), known, "doc_id", "text")
    return B.embedded_once(rows, "doc_id", "text", B.hashed_words(64), 64).select("doc_id", F.size("embedding").alias("dim"), tidy(norm(F.col("embedding")), 4).alias("length"))


def embed_store(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the names of parts in two runs over a store; the second embeds only what the first has not."""
    p = table(spark, d, "part").select("p_partkey", "p_name")
    store = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    counted = lambda texts: np.array([[len(t), t.count("a")] for t in texts])
    try:
        B.embedded_with_store(p.filter("p_partkey % 2 = 0"), "p_partkey", "p_name", counted, 2, store)
        rows, _ = B.embedded_with_store(p, "p_partkey", "p_name", counted, 2, store)
        return rows.select("p_partkey", F.col("embedding")[0].cast("int").alias("n"), F.col("embedding")[1].cast("int").alias("a")).checkpoint()
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(store)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def judged_calls(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts on documents by a judge that fails for some of them; these are rejects."""

    def judge(prompts: list[str]) -> list[str]:
        if any(x.endswith("00") for x in prompts):
            raise TimeoutError("no answer")
        return [f'{{"score": {int(x) % 9}, "tags": "t"}}' for x in prompts]

    docs = table(spark, d, "documents").select("doc_id")
    good, rejects = judging.judged_in_flight(docs, "doc_id", F.col("doc_id").cast("string"), judge, batch=16, waits=(0.0,))
    return good.select("doc_id", F.col("score").cast("int").alias("score"), F.lit(False).alias("rejected")).unionByName(rejects.select("doc_id", F.lit(None).cast("int").alias("score"), F.lit(True).alias("rejected")))


def eval_queries(spark: SparkSession, d: str) -> DataFrame:
    """How many of the queries made for each nation's event differ: all."""
    events = table(spark, d, "nation").select(F.concat(F.col("n_name"), F.lit(" Ultra")).alias("event"))
    rows = S.eval_queries(events, {"year": [str(y) for y in range(2015, 2026)], "suffix": SUFFIXES}, [t + " {suffix}" for t in TEMPLATES], 40, 7)
    whole = F.count_if(F.contains("query", F.col("event")) & ~F.contains("query", F.lit("{")))
    return rows.groupBy("event").agg(F.count_distinct("query").alias("queries"), F.count_distinct("qid").alias("ids"), whole.alias("whole"))


#: Questions, the events that they are about, and whether they would pass as names themselves.
ASKED = {
    "Which tyres for the Tour Divide?": ("Tour Divide", False), "is the silk road a mountain race": ("Silk Road Mountain Race", True), "TCR setup": ("Transcontinental Race", True),
    "I am doing Long Ridge Trail 300 next week": ("Long Ridge Trail 300", False), "what now": ("Unknown event", False), "Which bags for the Gran Sasso Odyssey?": ("Gran Sasso Odyssey", False),
    "use Alpen Dash website rules": ("Alpen Dash", True), "Show 3 riders": ("Unknown event", True), "lights at Sierra y Mar, please": ("Sierra y Mar", True),
}


def event_names(spark: SparkSession, d: str) -> DataFrame:
    """The event that each question is about."""
    q = U.chosen(tuple(ASKED), F.col("doc_id"))
    return spread(table(spark, d, "documents").select("doc_id")).select("doc_id", N.event_names(q).alias("event"), N.is_event_name(q).alias("reads_as_name"))


def enough_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Sources as queries: whether two documents of theirs at least have two of language, quality and toxicity."""
    both = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    covered = sum((F.coalesce(c, F.lit(False)).cast("int") for c in (F.col("lang") != "", F.col("quality").isNotNull(), F.col("toxic").isNotNull())), F.lit(0))
    return R.enough_evidence(both.select(F.concat_ws("/", "source", "lang").alias("query_id"), covered.alias("covered")), "covered", of=3)


def intent_searches(spark: SparkSession, d: str) -> DataFrame:
    """Both searches for each document's component, its whole text being the question."""
    component = U.chosen(("full_setup", "bags", "tyres", "cockpit"), F.col("doc_id"))
    first, second = R.intent_queries(F.col("source"), F.col("text"), component, {"bags": "bags, packs", "tyres": "tyre width"})
    return table(spark, d, "documents").select("doc_id", first.alias("first"), second.alias("second"))


def two_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Near riders of the query's label first, then of all, for the component that its phrase asks for."""
    q = Q._vectors(spark, d).filter(F.col("id") % Q.EVERY == 0).select(F.col("id").alias("query_id"))
    phrase = U.chosen(U.PHRASES, F.floor(F.col("query_id") / Q.EVERY))
    asks = q.withColumn("best", I.component_counts(phrase)).select("query_id", I.component(phrase, F.col("best"))[0].alias("component"))
    hits = lambda h: h.select("query_id", "chunk_id", F.col("pos"), U.chosen(U.PHRASES, F.col("chunk_id")).alias("text"))
    near = Q._hits(spark, d, 5, "label").filter("score >= 0.25")
    shows = F.coalesce(*[F.when(F.col("component") == n, I.component_hit(F.col("text"), t)) for n, t in I.COMPONENTS.items()], F.lit(False))
    attempt = lambda h: hits(h).join(asks, "query_id").select("query_id", "chunk_id", "pos", shows.alias("hit"))
    return R.two_attempts(attempt(near), attempt(Q._hits(spark, d, 5)), asks).select("query_id", "attempt", "chunk_id", "pos", "hit")


def default_setup(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a size as riders: their most frequent fields."""
    p = table(spark, d, "part")
    word = lambda c, i: F.split_part(F.col(c), F.lit(" "), F.lit(i))
    r = p.select("p_size", "p_partkey", F.col("p_brand").alias("frame_type"), word("p_type", 1).alias("frame_material"), word("p_type", -1).alias("wheel_size"), F.when(F.col("p_size") % 5 != 0, word("p_name", 1)).alias("tyre_width"))
    return R.default_setup(r, "p_size", F.col("p_partkey"))


def fill_component(spark: SparkSession, d: str) -> DataFrame:
    """For each query the tyres of the first of its hits that has any, else a chunk that tells of them."""
    h = Q._hits(spark, d, 10)
    rows = h.select("query_id", F.col("pos").alias("place"), F.when(F.col("chunk_id") % 9 == 0, F.lit(" 40mm ")).otherwise("").alias("tyres"), F.array(U.chosen(U.PHRASES, F.col("chunk_id"))).alias("chunks"))
    return R.filled_component(rows, "tyres", R.CHUNK_WORDS["tyres"])


def postprocess(spark: SparkSession, d: str) -> DataFrame:
    h = Q._hits(spark, d, 10)
    title = F.when(F.col("chunk_id") % 4 == 0, "Big Divide 2023").when(F.col("chunk_id") % 4 == 1, "Tour 2021").otherwise("Tour")
    rows = h.select("query_id", "chunk_id", "pos", F.round("score", 6).alias("score"), title.alias("event_title"), F.when(F.col("chunk_id") % 3 == 0, 2019).alias("year"))
    return R.postprocessed(rows, F.lit("big divide")).select("query_id", "chunk_id", "year", "place")


def gt_expectations(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.concat_ws(" ", "n_name", U.chosen(EVENTS, F.col("n_nationkey"))).alias("name"))
    e = S.expectations(n, "name", 2025)
    return e.select("n_nationkey", "event", "year", "style", *[F.array_join(c, "|").alias(c) for c in ("tags", "must_include", "must_avoid")])


def gt_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions chosen by hash; see the tests."""
    e = table(spark, d, "nation").select(F.col("n_name").alias("event"), F.lit(2025).alias("year"))
    return S.questions(e, TEMPLATES, SUFFIXES, 2, 7).select("id", "event", "year", "question")


def rider_chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Customers as riders, their segment and name as key items."""
    c = table(spark, d, "customer")
    r = c.select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.concat(F.col("c_mktsegment"), F.lit(" bike"))).alias("bike"), F.concat_ws(", ", "c_name", "c_mktsegment", "c_name").alias("key_items"), F.when(F.col("c_custkey") % 3 == 0, "steel").alias("frame_material"), (F.col("c_acctbal") > 0).alias("electronic_shifting"))
    return C.rider_chunks(r, "c_custkey")


def ranked_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The ten best owners of each query after reranking."""
    asked = U.R.constraints(U.chosen(U.PHRASES, F.floor(F.col("query_id") / Q.EVERY)))
    rows = P.rank_candidates(Q._hits(spark, d, 50), 10, asked, U._hit_columns(F.col("chunk_id")))
    return rows.select("query_id", "owner_id", "pos", "place", tidy(F.col("total")).alias("total"))


def similar_search(spark: SparkSession, d: str) -> DataFrame:
    """The whole search: scoped by label for queries of even labels, anywhere for the others."""
    v = Q._vectors(spark, d)
    q = v.filter(F.col("id") % Q.EVERY == 0).withColumn("label", F.when(F.col("label") % 2 == 0, F.col("label")))
    factor = F.when(F.col("owner_id") % 3 == 0, 1.15).when(F.col("owner_id") % 3 == 1, 0.92).otherwise(1.0)
    rows = P.similar_owners(v, q, F.floor(F.col("id") / Q.OWNER), "label", factor=factor)
    return rows.select("query_id", "owner_id", "scope", "place", tidy(F.col("final")).alias("final"))


def coverage_counters(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    out = R.counters(rows, ["lang", "quality", "toxic"], "source")
    return out.withColumn("avg_coverage", tidy(F.col("avg_coverage"), 5))


QUERIES = {
    f.__name__: f
    for f in (enough_evidence, intent_searches, rider_chunk_rows, ranked_candidates, similar_search, coverage_counters, search_merge, site_candidates, context_pages, context_texts, unproven_contexts, embed_missing, embed_store, judged_calls, eval_queries, event_names, two_attempts, default_setup, fill_component, postprocess, gt_expectations, gt_questions)
}

_RES = "r AS (SELECT page_id // 10 AS event, (page_id % 10)::INTEGER AS rank, regexp_replace(url, '[?#].*$', '') AS url FROM pages)"
_CAND = f"""{_RES}, k AS (
  SELECT *, lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)) AS dm FROM r
), kk AS (
  SELECT *, CASE WHEN {U._has('dm', KINDS['social'])} THEN 'social' WHEN {U._has('dm', KINDS['trackers'])} THEN 'tracker' WHEN {U._has('dm', KINDS['listings'])} THEN 'listing' ELSE 'site' END AS kind FROM k
), s AS (
  SELECT *, max((kind = 'site')::INTEGER) OVER (PARTITION BY event) AS has_site FROM kk
), t AS (
  SELECT event, arg_min(url, rank) FILTER (WHERE kind = 'tracker') AS tracker_url FROM kk GROUP BY event
), c AS (
  SELECT event, row_number() OVER (PARTITION BY event ORDER BY rank, url) AS place, url FROM s WHERE kind = 'site' OR (kind = 'listing' AND has_site = 0) QUALIFY place <= {W.CANDIDATES}
)"""
_BASE = "coalesce(nullif(regexp_extract({0}, '^(https?://[^/]+)', 1), ''), {0})"
_CTX = """x AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'gravel' END AS surface, CASE WHEN doc_id % 7 = 0 THEN 'a b' END AS cs, doc_id % 4 = 0 AS km, doc_id % 11 = 0 AS up,
    CASE WHEN doc_id % 13 = 0 THEN source END AS title, CASE WHEN doc_id % 13 = 0 THEN 's' END AS snippet, CASE WHEN doc_id % 6 = 0 THEN 'https://o' END AS o FROM documents)"""
_COMP = f"CASE WHEN trim(ql) = '' OR {U._MOST.replace('(l,', '(ql,')} = 0 THEN 'full_setup' {' '.join(f"WHEN {U._count('ql', t)} = {U._MOST.replace('(l,', '(ql,')} THEN '{n}'" for n, t in I.COMPONENTS.items())} END"
_MODE = "mode_{0} AS (SELECT p_size, {0} FROM (SELECT p_size, {0}, count(*) AS n, min(p_partkey) AS f FROM p WHERE trim({0}) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_size ORDER BY n DESC, f) = 1)"
_TAG = lambda words, tag: f"CASE WHEN {U._has('l', words)} THEN '{tag}' END"
_W = lambda cond, *words: ", ".join(f"CASE WHEN {cond} THEN '{w}' END" for w in words)
_UNIQUE = "list_filter(list_filter({0}, lambda v: v IS NOT NULL), lambda v, i: list_position(list_filter({0}, lambda v: v IS NOT NULL), v) = i)"

_RR = U._RERANKED.replace(Q._h(30), Q._dedup(50)).replace("FROM h\n), c AS", "FROM (SELECT * EXCLUDE (pos, place), place AS pos FROM l)\n), c AS")
ORACLES = {
    "event_names": f"""SELECT doc_id, {U._choose([e for e, _ in ASKED.values()], 'doc_id')} AS event, ([{', '.join(str(n).lower() for _, n in ASKED.values())}])[doc_id % {len(ASKED)} + 1] AS reads_as_name FROM documents""",
    "enough_evidence": """SELECT concat_ws('/', source, lang) AS query_id, count(*) FILTER (WHERE coalesce(lang <> '', false)::INTEGER + (quality IS NOT NULL)::INTEGER + (toxic IS NOT NULL)::INTEGER >= 3) >= 2 AS enough
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""",
    "intent_searches": f"""WITH c AS (SELECT doc_id, source, text, {U._choose(('full_setup', 'bags', 'tyres', 'cockpit'), 'doc_id')} AS c FROM documents),
p AS (SELECT *, CASE c WHEN 'bags' THEN 'bags, packs' WHEN 'tyres' THEN 'tyre width' ELSE c END AS phrase FROM c)
SELECT doc_id, CASE WHEN c = 'full_setup' THEN source ELSE source || '. Focus: ' || phrase END AS first,
  CASE WHEN c <> 'full_setup' OR text IS NULL OR trim(text) = '' THEN source ELSE source || '. Question focus: ' || trim(text) END AS second FROM p""",
    "embed_store": "SELECT p_partkey, length(p_name)::INTEGER AS n, (length(p_name) - length(replace(lower(p_name), 'a', '')))::INTEGER AS a FROM part WHERE trim(p_name) <> ''",
    "eval_queries": "SELECT n_name || ' Ultra' AS event, 40 AS queries, 40 AS ids, 40 AS whole FROM nation",
    "judged_calls": "SELECT doc_id, CASE WHEN doc_id::VARCHAR NOT LIKE '%00' THEN least(6, doc_id % 9) END::INTEGER AS score, doc_id::VARCHAR LIKE '%00' AS rejected FROM documents",
    "rider_chunk_rows": f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment || ' bike' END AS bike, c_name, c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN 'frame_material=steel' END AS fm, c_acctbal > 0 AS el FROM customer),
t AS (SELECT c_custkey, 'bike' AS chunk_kind, 0 AS chunk_ix, 'Bike: ' || bike || ' (' || concat_ws(', ', fm, 'electronic_shifting=' || CASE WHEN el THEN 'True' ELSE 'False' END) || ')' AS chunk_text FROM r WHERE bike IS NOT NULL
  UNION ALL SELECT c_custkey, 'key_items', 0, 'Key items: ' || c_name || '; ' || c_mktsegment FROM r) SELECT *, greatest(1, length(chunk_text) // 4)::BIGINT AS chunk_tokens FROM t""",
    "ranked_candidates": f"WITH {_RR} SELECT query_id, owner_id, pos::INTEGER AS pos, place::INTEGER AS place, {Q._R('total')} AS total FROM y WHERE place <= 10",
    "similar_search": f"""WITH {Q._ALL}, {Q._h(80, True, 'hs')}, {Q._h(80, False, 'hg')}, {Q._owners('hs', 5, 'os')}, {Q._owners('hg', 5, 'og')}, ev AS (SELECT query_id FROM q WHERE q_label % 2 = 0),
x AS (SELECT * FROM os SEMI JOIN ev USING (query_id)), m AS (SELECT query_id, owner_id, 'exact' AS scope, 1 / (1 + best_distance) AS w FROM x
  UNION ALL SELECT query_id, owner_id, 'similar', 1 / (1 + best_distance) * {Q.R.SIMILAR_WEIGHT} FROM og ANTI JOIN x USING (query_id, owner_id)),
f AS (SELECT *, w * CASE owner_id % 3 WHEN 0 THEN 1.15 WHEN 1 THEN 0.92 ELSE 1.0 END AS final FROM m)
SELECT query_id, owner_id, scope, row_number() OVER (PARTITION BY query_id ORDER BY scope = 'exact' DESC, round(final, 9) DESC, owner_id)::INTEGER AS place, {Q._R('final')} AS final FROM f QUALIFY place <= 5""",
    "coverage_counters": """SELECT source, (round(avg((lang <> '')::INTEGER + (quality IS NOT NULL)::INTEGER + (toxic IS NOT NULL)::INTEGER), 5) + 0.0) AS avg_coverage,
  count(*) FILTER (WHERE lang <> '') AS lang, count(quality) AS quality, count(toxic) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "search_merge": f"""WITH {_RES}, b AS (SELECT event, 1 AS s, rank, url FROM r WHERE rank < 7 UNION ALL SELECT event, 2, rank - 4, url FROM r WHERE rank >= 4),
o AS (SELECT * FROM b WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY event, url ORDER BY s, rank) = 1) SELECT event, row_number() OVER (PARTITION BY event ORDER BY s, rank, url)::INTEGER AS rank, url FROM o""",
    "site_candidates": f"WITH {_CAND} SELECT t.event, tracker_url, place::INTEGER AS place, url FROM t LEFT JOIN c ON t.event = c.event",
    "context_texts": f"""WITH {_CTX} SELECT doc_id, coalesce(summary <> '', false) OR surface IS NOT NULL OR cs IS NOT NULL OR km OR up OR o IS NOT NULL OR title IS NOT NULL AS useful,
  concat_ws(chr(10), nullif(summary, ''), surface, cs, nullif(title, ''), snippet, o) AS text, concat_ws(chr(10), nullif(summary, ''), surface, cs) AS notes FROM x""",
    "unproven_contexts": "SELECT doc_id FROM documents WHERE doc_id % 4 = 0 AND doc_id % 8 <> 0",
    "two_attempts": f"""WITH {Q._ALL}, {Q._h(5, True, 'h1')}, {Q._h(5, False, 'h2')}, w AS (SELECT query_id, lower({U._choose(U.PHRASES, f'query_id // {Q.EVERY}')}) AS ql FROM q), k AS (SELECT query_id, {_COMP} AS component FROM w),
b AS (SELECT 1 AS attempt, query_id, chunk_id, pos FROM h1 WHERE score >= 0.25 UNION ALL SELECT 2, query_id, chunk_id, pos FROM h2), bt AS (SELECT *, lower({U._choose(U.PHRASES, 'chunk_id')}) AS cl FROM b),
z AS (SELECT attempt, bt.query_id, chunk_id, pos, CASE component {' '.join(f"WHEN '{n}' THEN {U._has('cl', t)}" for n, t in I.COMPONENTS.items())} ELSE false END AS hit FROM bt JOIN k USING (query_id)),
g AS (SELECT k.query_id, component, (SELECT count(*) FROM z WHERE z.query_id = k.query_id AND attempt = 1) AS n1, (SELECT count(*) FROM z WHERE z.query_id = k.query_id AND attempt = 1 AND hit) AS i1,
  (SELECT count(*) FROM z WHERE z.query_id = k.query_id AND attempt = 2 AND hit) AS i2 FROM k),
f AS (SELECT query_id, CASE WHEN (n1 < {R.FEW_RIDERS} OR (component <> 'full_setup' AND i1 = 0)) AND (n1 < {R.FEW_RIDERS} OR i2 > i1) THEN 2 ELSE 1 END AS attempt FROM g)
SELECT query_id, attempt, chunk_id, pos::INTEGER AS pos, hit FROM z JOIN f USING (query_id, attempt)""",
    "default_setup": f"""WITH p AS (SELECT p_size, p_partkey, p_brand AS frame_type, split_part(p_type, ' ', 1) AS frame_material, split_part(p_type, ' ', -1) AS wheel_size, CASE WHEN p_size % 5 <> 0 THEN split_part(p_name, ' ', 1) END AS tyre_width FROM part),
{', '.join(_MODE.format(c) for c in ('frame_type', 'frame_material', 'wheel_size', 'tyre_width'))}
SELECT s.p_size, nullif(concat_ws(' ', frame_type, frame_material), '') AS bike_type, wheel_size AS wheels, CASE WHEN tyre_width IS NOT NULL AND wheel_size IS NOT NULL THEN tyre_width || ' on ' || wheel_size ELSE tyre_width END AS tyres
FROM (SELECT DISTINCT p_size FROM p) s LEFT JOIN mode_frame_type USING (p_size) LEFT JOIN mode_frame_material USING (p_size) LEFT JOIN mode_wheel_size USING (p_size) LEFT JOIN mode_tyre_width USING (p_size)""",
    "fill_component": f"""WITH {Q._ALL}, {Q._h(10)}, x AS (SELECT query_id, pos, CASE WHEN chunk_id % 9 = 0 THEN '40mm' END AS s, {U._choose(U.PHRASES, 'chunk_id')} AS c FROM h)
SELECT query_id, coalesce(arg_min(s, pos) FILTER (WHERE s IS NOT NULL), arg_min(trim(c), pos) FILTER (WHERE {U._has('lower(c)', R.CHUNK_WORDS['tyres'])} AND trim(c) <> '')) AS value FROM x GROUP BY query_id""",
    "postprocess": f"""WITH {Q._ALL}, {Q._h(10)}, x AS (SELECT query_id, chunk_id, pos, round(score, 6) AS sc, chunk_id % 4 = 0 AS same, CASE WHEN chunk_id % 3 = 0 THEN 2019 WHEN chunk_id % 4 = 0 THEN 2023 WHEN chunk_id % 4 = 1 THEN 2021 END AS year FROM h)
SELECT query_id, chunk_id, year::INTEGER AS year, row_number() OVER (PARTITION BY query_id ORDER BY same DESC, sc DESC, coalesce(year, 0) DESC, pos)::INTEGER AS place FROM x""",
    "gt_expectations": rf"""WITH n AS (SELECT n_nationkey, concat_ws(' ', n_name, {U._choose(EVENTS, 'n_nationkey')}) AS name FROM nation),
e AS (SELECT n_nationkey, trim(regexp_replace(name, '\s*\b20\d{{2}}\b\s*', ' ', 'g')) AS event, coalesce(try_cast(regexp_extract(name, '\b(20\d{{2}})\b', 1) AS INTEGER), 2025) AS year, try_cast(regexp_extract(name, '{S.DISTANCE}', 1) AS INTEGER) AS km FROM n),
f AS (SELECT *, lower(event) AS l FROM e), g AS (SELECT *, list_filter([{', '.join(_TAG(w, t) for t, w in S.STYLES.items())}], lambda v: v IS NOT NULL) AS st,
  list_filter([{', '.join(_TAG(w, t) for w, ts in S.SURROUNDINGS for t in ts)}, CASE WHEN km >= 500 THEN 'multi-day' WHEN km >= 300 THEN 'overnight_possible' WHEN km IS NOT NULL THEN 'shorter' END], lambda v: v IS NOT NULL) AS su FROM f),
h AS (SELECT *, list_concat(st, su) AS tg, CASE WHEN list_contains(st, 'trail') THEN 'trail' WHEN list_contains(st, 'road') AND NOT list_contains(st, 'gravel') THEN 'road' WHEN list_contains(st, 'gravel') AND NOT list_contains(st, 'road') THEN 'gravel'
  WHEN list_contains(st, 'gravel') OR list_contains(st, 'mixed') THEN 'mixed' ELSE 'unknown' END AS style FROM g),
i AS (SELECT *, [{', '.join(map(U._quoted, S.MUST_INCLUDE))}, {_W('km >= 500', 'lights', 'power', 'layers')}, {_W('km >= 300 AND km < 500', 'nutrition', 'spares')}, {_W("style = 'trail'", 'repair', 'traction')},
  {_W("list_contains(tg, 'mountains')", 'low gears', 'warm layers')}, {_W("list_contains(tg, 'wet') OR list_contains(tg, 'rain')", 'waterproof')}, {_W("list_contains(tg, 'night')", 'navigation', 'backup')}, {_W("list_contains(tg, 'hydration')", 'hydration')}] AS mi,
  [{_W("style = 'trail'", 'slick tyres', 'time trial')}, {_W("style = 'road'", 'MTB tyres')}, {_W("list_contains(tg, 'short') OR list_contains(tg, 'shorter')", 'tent', 'heavy sleeping bag')}] AS ma FROM h)
SELECT n_nationkey, event, year, style, array_to_string(tg, '|') AS tags, array_to_string({_UNIQUE.format('mi')}, '|') AS must_include, array_to_string({_UNIQUE.format('ma')}, '|') AS must_avoid FROM i""",
}
