"""Queries of table maintenance, joins, parsing, judging and streaming, with their SQL."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.functions import text as X
from tarnbridge.functions.hashing import content_hash, fresh
from tarnbridge.functions.vectors import tidy
from tarnbridge.operators import judging as J
from tarnbridge.operators import parsing as P
from tarnbridge.operators import sync as S
from tarnbridge.operators.retrieval import mode
from tarnbridge.session import shared_folder
from tarnbridge.sources.tables import small_side, table
from tarnbridge.streaming.expiring import fresh_by_key, keyed_state
from tarnbridge.streaming.incremental import ingest, windowed_counts
from tarnbridge.streaming.upserts import UpsertTable

NOW, TTL = 1_706_745_600.0, 7 * 86_400.0


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two overlapping states of the pages: an old one, and a later load with other lengths."""
    p = table(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("url"), F.length("html").alias("size"))
    old = p.filter("page_id % 3 <> 1").withColumn("version", F.lit(1))
    new = p.filter("page_id % 3 <> 0").withColumns({"size": F.col("size") + 1, "version": F.lit(2)})
    return old, new


def articles_upsert(spark: SparkSession, d: str) -> DataFrame:
    old, new = _slices(spark, d)
    return S.upsert(old, new.drop("url"), ["page_id"], keep=["version"]).select("page_id", "url", "size", "version")


def merge_existing_wins(spark: SparkSession, d: str) -> DataFrame:
    old, new = _slices(spark, d)
    once = S.first_by(old, ["url"], F.col("page_id"))
    return S.merge_existing_wins(once, new, "url", F.col("page_id")).select("page_id", "url", "version")


def new_urls_only(spark: SparkSession, d: str) -> DataFrame:
    old, new = _slices(spark, d)
    return new.select("url").distinct().join(old.select("url").distinct(), "url", "left_anti")


def riders_delete_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one priority go, with their line items; what is left is counted by flag."""
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    gone = orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey")
    _, left = S.delete_cascade(orders, items, gone, "o_orderkey", "l_orderkey")
    return left.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_items"), F.countDistinct("l_orderkey").alias("n_orders"))


def missing_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a vector."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return table(spark, d, "documents").join(vectors, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("missing"))


def event_articles(spark: SparkSession, d: str) -> DataFrame:
    """Customers of some nations that have orders."""
    c, o, n = table(spark, d, "customer"), table(spark, d, "orders"), table(spark, d, "nation")
    wanted = c.join(small_side(n.filter(F.trim("n_name") != "").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")), "c_nationkey")
    return wanted.join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name", "n_name").distinct()


def distinct_count(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_nationkey").agg(
        F.countDistinct("o_orderkey").alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers"), F.count(F.lit(1)).alias("n_rows"))


def rider_hydration(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customer's and nation's data, kept where these are missing."""
    c = S.first_by(table(spark, d, "customer"), ["c_custkey"], F.col("c_name"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return o.join(c.select("c_custkey", "c_name", "c_nationkey"), "c_custkey", "left").join(n, "c_nationkey", "left").select("o_orderkey", "c_name", "n_name", F.col("c_name").isNotNull().alias("found"))


def dedupe_by_name_key(spark: SparkSession, d: str) -> DataFrame:
    """Documents once for each source and first word; those without a word are one."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.regexp_extract("text", r"^\s*([^\s]+)", 1).alias("name"))
    return S.unnamed_once(docs, ["source"], "name", F.col("doc_id")).select("doc_id", "source", "name")


def mode_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return mode(table(spark, d, "events"), ["user_id"], "event_type", F.col("event_id")).select("user_id", "event_type", F.col("n").alias("times"))


def cache_latest_valid(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event that isn't too old at a fixed time and has a value of use."""
    e = table(spark, d, "events").withColumn("created_at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    valid = fresh(F.col("created_at"), NOW, TTL) & (F.col("value") > 10) & (F.get_json_object("props", "$.k").try_cast("int") >= 0)
    return S.latest_valid(e, "user_id", valid, F.struct("ts", "event_id")).select("user_id", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


def gt_priority_join(spark: SparkSession, d: str) -> DataFrame:
    """A truth for each document: its own label, else one by its language, else a fallback."""
    docs, labels = table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels")
    by_id = labels.select(F.col("doc_id").alias("key"), F.concat(F.lit("label "), F.col("quality").cast("string")).alias("truth"))
    by_name = spark.createDataFrame([("en", "english"), ("fr", "french")], "key string, truth string")
    out = S.by_priority(docs, (by_id, "truth", F.col("doc_id")), (by_name, "truth", F.col("lang")), fallback=F.lit("rubric"))
    return out.select("doc_id", "truth", "found_by")


def resume_rows(spark: SparkSession, d: str) -> DataFrame:
    """Documents that aren't labelled yet nor have the text of one that is, each text once."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    done = docs.join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return S.not_done(docs, done, "doc_id", "text_hash", F.col("doc_id")).select("doc_id", "text_hash")


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Traces made of conversations: a message each, some with tool calls; and a scan of their text."""
    c = table(spark, d, "conversations")
    name = F.concat(F.lit("tool_"), F.pmod(F.length("text"), F.lit(4)).cast("string"))
    message = F.to_json(F.struct(F.when(F.col("role") == "user", name).alias("tool_name"), F.when(F.col("role") != "user", F.array(F.struct(F.struct(name.alias("name")).alias("function")))).alias("tool_calls")))
    trace = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]), ",").alias("ms"))
    calls = trace.select("conv_id", J.calls_in_messages(F.concat(F.lit("["), "ms", F.lit("]"))).alias("calls"), J.calls_in_text(F.col("ms"), ["tool_1", "tool_9", "tool_3"]).alias("words"))
    return calls.select("conv_id", F.array_join("calls", ",").alias("calls"), F.array_join("words", ",").alias("words"), J.used_any(F.col("calls"), ["tool_2"]).alias("web"))


def web_used_pct(spark: SparkSession, d: str) -> DataFrame:
    rows = tool_calls(spark, d).withColumn("score", F.pmod("conv_id", F.lit(7)))
    out = J.report(rows, "score", "web")
    return out.select("n", tidy(F.col("avg_score"), 5).alias("avg_score"), tidy(F.col("pct_web"), 5).alias("pct_web"))


def judge_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Answers written from labels in the ways that judges write them, and what is read from them."""
    tags = F.when(F.col("toxic") == 1, F.lit('"a, b ,"')).when(F.col("doc_id") % 2 == 0, F.lit('["x"," y "]')).otherwise(F.lit("null"))
    key = F.when(F.col("doc_id") % 3 == 0, "score").otherwise("score_0_to_6")
    raw = F.concat(F.lit('<think>{"score": 1}</think> {"'), key, F.lit('": '), (F.col("quality") * 9 + F.col("doc_id") % 5).cast("string"), F.lit(', "notes": "n", "notes_b": "two", "notes_a": "one", "tags": '), tags, F.lit("} end"))
    v = J.verdict(raw)
    return table(spark, d, "labels").select("doc_id", v["score"].alias("score"), v["notes"].alias("notes"), F.array_join(v["tags"], "|").alias("tags"), v["valid"].alias("valid"))


def html_article(spark: SparkSession, d: str) -> DataFrame:
    """Title, article text and hash of every page; parsing has no SQL form."""
    p = table(spark, d, "pages").withColumn("a", P.article_of(F.col("html")))
    return p.select("page_id", "a.title", "a.body", F.length("a.page_text").alias("page_chars"), content_hash(F.col("a.title"), F.col("a.body")).alias("content_hash"))


def clean_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Pages' texts below a menu and above a tail; the result is the text itself."""
    docs = table(spark, d, "documents")
    framed = F.concat(F.lit("\nResults\n  Features \n\n"), F.col("text"), F.lit("\n \nAlso from us\nmore"))
    return docs.select("doc_id", X.clean_body(framed).alias("body"))


def parsed_riders(spark: SparkSession, d: str) -> DataFrame:
    """Articles made of customers, read back as records."""
    c = table(spark, d, "customer")
    body = F.concat_ws("\n", F.lit("Bikes of 2024"), "c_name", F.lit("Your age:"), (F.col("c_custkey") % 60 + 20).cast("string"), F.lit("Location"), "c_mktsegment", F.lit("Electronic shifting"), F.when(F.col("c_acctbal") > 0, "Yes").otherwise("no"), F.lit("Key items of kit"), F.lit("tent"), F.lit("stove"))
    r = c.select("c_custkey", F.explode(P.riders_of(body)).alias("r"))
    return r.select("c_custkey", "r.name", "r.age", "r.location", F.col("r.electronic_shifting").alias("electronic"), "r.key_items")


def incremental_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events read by a stream once, then counted by day; the same as over the table."""
    schema = table(spark, d, "events").schema
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    with _stream_folder(spark) as folder:
        ingest(spark, d, "events.parquet", ddl, f"{folder}/checkpoint", lambda rows, batch: rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={batch}"))
        rows = spark.read.parquet(f"{folder}/rows").withColumn("ts", F.col("ts").cast("timestamp"))
        counted = windowed_counts(rows, "ts", "1 day", "1 day", "event_type")
        return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", tidy(F.col("value"), 3).alias("value")).checkpoint()


@contextlib.contextmanager
def _stream_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, which goes when the block ends."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def articles_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two states of the pages come one after the other as a stream that keeps a table up to date; size and version as in articles_upsert."""
    old, new = _slices(spark, d)
    with _stream_folder(spark) as folder:
        known = UpsertTable(spark, f"{folder}/table", ["page_id"], lambda: F.col("size"), keep=["version", "url"], buckets=8)
        for state in (old, new):
            state.write.mode("append").parquet(f"{folder}/in")
            ingest(spark, f"{folder}/in", "*.parquet", "page_id bigint, url string, size int, version int", f"{folder}/checkpoint", known.merge)
        return known.read().select("page_id", "url", "size", "version").checkpoint()


#: Seconds that an event stays fresh in the streamed cache.
STREAM_TTL = 12 * 3600


def cache_stream(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last event with a value of use, while it is fresh, kept by a stream that forgets users in time."""
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    middle = e.select(F.percentile_approx(F.unix_micros("ts"), 0.5)).collect()[0][0]
    with _stream_folder(spark) as folder, keyed_state(spark):
        known = UpsertTable(spark, f"{folder}/table", ["user_id"], lambda: F.struct("fresh", "ts", "event_id"), buckets=8)
        for part in (F.unix_micros("ts") <= middle, F.unix_micros("ts") > middle):
            e.filter(part).write.mode("append").parquet(f"{folder}/in")
            log = spark.readStream.schema(e.schema).parquet(f"{folder}/in").select("user_id", "ts", "event_id", "value")
            changes = fresh_by_key(log, "user_id", "ts", "event_id", STREAM_TTL, valid=F.col("value") > 10)
            query = changes.writeStream.outputMode("update").foreachBatch(known.merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
        return known.read().filter("fresh").select("user_id", "event_id").checkpoint()


QUERIES = {
    f.__name__: f
    for f in (
        articles_upsert, merge_existing_wins, new_urls_only, riders_delete_cascade, missing_chunks, event_articles, distinct_count, rider_hydration, dedupe_by_name_key, mode_first_seen,
        cache_latest_valid, gt_priority_join, resume_rows, tool_calls, web_used_pct, judge_verdicts, html_article, clean_bodies, parsed_riders, incremental_stream, articles_stream, cache_stream,
    )
}

_P = """p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, length(html) AS size FROM pages), o AS (SELECT *, 1 AS version FROM p WHERE page_id % 3 <> 1),
n AS (SELECT page_id, url, size + 1 AS size, 2 AS version FROM p WHERE page_id % 3 <> 0)"""
_CALLS = """
m AS (SELECT conv_id, turn, 'tool_' || length(text) % 4 AS t FROM conversations), l AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST) AS ts FROM m GROUP BY conv_id),
c AS (SELECT conv_id, list_filter(ts, lambda t, i: list_position(ts, t) = i) AS ts FROM l),
k AS (SELECT conv_id, array_to_string(ts, ',') AS calls, array_to_string(list_filter(['tool_1', 'tool_9', 'tool_3'], lambda t: list_contains(ts, t)), ',') AS words, list_contains(ts, 'tool_2') AS web FROM c)"""
ORACLES = {
    "articles_upsert": f"WITH {_P} SELECT page_id, o.url, coalesce(n.size, o.size)::INTEGER AS size, coalesce(o.version, n.version)::INTEGER AS version FROM o FULL JOIN n USING (page_id)",
    "merge_existing_wins": f"""WITH {_P}, x AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1), y AS (SELECT * FROM n WHERE url <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1)
SELECT page_id, url, version FROM x UNION ALL SELECT page_id, url, version FROM y ANTI JOIN x USING (url)""",
    "new_urls_only": f"WITH {_P} SELECT DISTINCT url FROM n WHERE url NOT IN (SELECT url FROM o)",
    "riders_delete_cascade": "SELECT l_returnflag, count(*) AS n_items, count(DISTINCT l_orderkey) AS n_orders FROM lineitem SEMI JOIN (SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) o ON l_orderkey = o.o_orderkey GROUP BY 1",
    "missing_chunks": "SELECT lang, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) GROUP BY lang",
    "event_articles": "SELECT DISTINCT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE trim(n_name) <> '' AND c_custkey IN (SELECT o_custkey FROM orders)",
    "distinct_count": "SELECT c_nationkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT c_custkey) AS n_customers, count(*) AS n_rows FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "rider_hydration": "SELECT o_orderkey, c_name, n_name, c_name IS NOT NULL AS found FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey",
    "dedupe_by_name_key": r"""SELECT doc_id, source, name FROM (SELECT doc_id, source, regexp_extract(text, '^\s*([^\s]+)', 1) AS name FROM documents)
QUALIFY row_number() OVER (PARTITION BY source, lower(name) ORDER BY doc_id) = 1""",
    "mode_first_seen": "SELECT user_id, event_type, n AS times FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events WHERE trim(event_type) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1",
    "cache_latest_valid": f"""SELECT user_id, event_id, try_cast(props->>'$.k' AS INTEGER) AS k FROM events WHERE user_id IS NOT NULL AND (epoch_us(ts) / 1e6 = 0 OR {NOW} - epoch_us(ts) / 1e6 <= {TTL}) AND value > 10
AND try_cast(props->>'$.k' AS INTEGER) >= 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    "gt_priority_join": """SELECT d.doc_id, coalesce('label ' || quality, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' END, 'rubric') AS truth,
  CASE WHEN quality IS NOT NULL THEN 1 WHEN lang IN ('en', 'fr') THEN 2 ELSE 0 END AS found_by FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "resume_rows": """WITH h AS (SELECT doc_id, sha256(text) AS text_hash FROM documents), x AS (SELECT * FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, text_hash FROM h WHERE doc_id NOT IN (SELECT doc_id FROM x) AND text_hash NOT IN (SELECT text_hash FROM x) QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY doc_id) = 1""",
    "tool_calls": f"WITH {_CALLS} SELECT * FROM k",
    "web_used_pct": f"WITH {_CALLS} SELECT count(*) AS n, (round(avg(conv_id % 7), 5) + 0.0) AS avg_score, (round(100 * avg(web::INTEGER), 5) + 0.0) AS pct_web FROM k",
    "judge_verdicts": """SELECT doc_id, least(6, greatest(0, quality * 9 + doc_id % 5))::INTEGER AS score, 'n' || chr(10) || '- a: one' || chr(10) || '- b: two' AS notes,
  CASE WHEN toxic = 1 THEN 'a|b' WHEN doc_id % 2 = 0 THEN 'x|y' ELSE '' END AS tags, true AS valid FROM labels""",
    "clean_bodies": r"SELECT doc_id, regexp_replace(regexp_replace(text, '^([\s]*(Results|Features|Event Commentary|Event Calendar|About Us)?[ \t]*\n)+', ''), '\s+$', '') AS body FROM documents",
    "parsed_riders": "SELECT c_custkey, c_name AS name, (c_custkey % 60 + 20)::VARCHAR AS age, c_mktsegment AS location, c_acctbal > 0 AS electronic, 'tent' || chr(10) || 'stove' AS key_items FROM customer",
    "articles_stream": f"WITH {_P} SELECT page_id, coalesce(o.url, n.url) AS url, coalesce(n.size, o.size)::INTEGER AS size, coalesce(o.version, n.version)::INTEGER AS version FROM o FULL JOIN n USING (page_id)",
    "cache_stream": f"""WITH v AS (SELECT user_id, event_id, value, ts, epoch_ms(ts) AS t, epoch_ms(max(ts) OVER ()) AS newest FROM events),
k AS (SELECT * FROM v WHERE user_id IS NOT NULL AND value > 10 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT user_id, event_id FROM k WHERE t + {1000 * STREAM_TTL} > newest""",
    "incremental_stream": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, (round(sum(value), 3) + 0.0) AS value FROM events GROUP BY ALL",
}
