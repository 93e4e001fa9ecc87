"""Queries of sources, sinks and record projections over the driver's tables, with their SQL.

What is written goes to the shared folder, is read back by the engine's own readers and removed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.functions.vectors import tidy
from tarnbridge.operators import chunks, json_stream, recommend, search
from tarnbridge.operators import sync as S
from tarnbridge.plans import retrieval_queries as Q
from tarnbridge.session import shared_folder
from tarnbridge.sources import files, layouts, sinks, tables
from tarnbridge.sources.tables import table
from tarnbridge.tracing import Trace


def _through(spark: SparkSession, use: Callable[[str], DataFrame]) -> DataFrame:
    """Rows that use(folder) reads from what it has written to the folder; the folder goes."""
    folder = f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"
    try:
        return use(folder).checkpoint()
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def json_lines(spark: SparkSession, d: str) -> DataFrame:
    def use(folder: str) -> DataFrame:
        sinks.write_json(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), folder)
        return files.json_lines(spark, folder, "c_custkey bigint, c_name string, c_acctbal double, c_mktsegment string")

    return _through(spark, use)


def json_wrapped(spark: SparkSession, d: str) -> DataFrame:
    """An object that holds a list, and plain lists, as files of one folder."""

    def use(folder: str) -> DataFrame:
        rows = table(spark, d, "nation").select(F.struct("n_nationkey", "n_name").alias("r"), (F.col("n_nationkey") % 3).alias("kind"))
        group = rows.groupBy("kind").agg(F.to_json(F.sort_array(F.collect_list("r"))).alias("j"))
        text = F.when(F.col("kind") == 0, F.concat(F.lit('{"articles":\n'), "j", F.lit("}"))).otherwise(F.col("j"))
        group.select("kind", text.alias("value")).write.partitionBy("kind").text(folder)
        return files.json_records(spark, folder, "n_nationkey int, n_name string", wrapper="articles")

    return _through(spark, use)


def json_object_stream(spark: SparkSession, d: str) -> DataFrame:
    """Objects printed over several lines, with blank lines between, in one file."""

    def use(folder: str) -> DataFrame:
        one = F.concat(F.lit('{"qid":\n  "'), "n_name", F.lit('",\n\n "n": '), F.col("n_nationkey").cast("string"), F.lit("}\n\n"))
        table(spark, d, "nation").select(one.alias("o"), "n_nationkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "o"))), lambda x: x["o"]), "").alias("value")).write.text(folder)
        return json_stream.read_stream(spark, folder, "qid string, n int").select(F.col("pos").cast("int").alias("pos"), "qid", "n")

    return _through(spark, use)


def json_object_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders as objects within objects, over several lines and side by side, with braces, quotes and backslashes in strings."""

    def use(folder: str) -> DataFrame:
        o = table(spark, d, "orders")
        odd = F.concat(F.col("o_orderpriority"), F.lit(r' } \\ \" { \\'))
        one = F.concat(F.lit('{"id": '), F.col("o_orderkey").cast("string"), F.lit(', "of":\n {"who": {"cust": '), F.col("o_custkey").cast("string"), F.lit('}, "note": "'), odd, F.lit('"}}'))
        o.select(F.concat(one, F.when(F.col("o_orderkey") % 2 == 0, " \n").otherwise(","))).write.option("lineSep", " ").text(folder)
        rows = json_stream.read_stream(spark, folder, "id bigint, of struct<who: struct<cust: bigint>, note: string>")
        return rows.select("id", F.col("of.who.cust").alias("cust"), F.col("of.note").alias("note"))

    return _through(spark, use)


def latest_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The latest of files named after orders, and the last by name; most names have no time."""
    o = table(spark, d, "orders")
    named = F.concat(F.lit("raw_"), files.run_id(F.col("o_orderdate")), F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".json"))
    rows = o.select(F.when(F.col("o_orderkey") % 50 == 0, named).otherwise(F.concat(F.lit("z"), F.col("o_orderkey").cast("string"), F.lit(".txt"))).alias("path"), F.col("o_orderdate").alias("modified"))
    return files.latest_snapshot(rows).select("path", "run_id").crossJoin(files.last_named(rows).select(F.col("path").alias("last")))


def qrels_last_wins(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").select((F.col("l_orderkey") % 97).cast("string").alias("qid"), F.when(F.col("l_linenumber") < 6, F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))).alias("relevant_ids"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("o"))
    return files.qrels(line, "o").select("qid", F.array_join(F.col("relevant_ids").cast("array<string>"), ",").alias("ids"))


def listed_lines(spark: SparkSession, d: str) -> DataFrame:
    def use(folder: str) -> DataFrame:
        line = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("# "), "p_name")).when(F.col("p_partkey") % 5 == 1, "  ").otherwise(F.concat(F.lit("  "), "p_name", F.col("p_partkey").cast("string"), F.lit(" ")))
        table(spark, d, "part").select(line.alias("value")).write.text(folder)
        return files.listed(spark, folder)

    return _through(spark, use)


def rows_prefix(spark: SparkSession, d: str) -> DataFrame:
    """The first so many evaluation rows, as asked for."""
    return files.first_rows(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 40)


def title_by_id(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return tables.by_id(n, "n_nationkey", 7).unionAll(tables.by_id(n, "n_nationkey", "12")).unionAll(tables.by_id(n, "n_nationkey", "none"))


def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return tables.repeated_keys(table(spark, d, "lineitem"), "l_orderkey")


def missing_tables(spark: SparkSession, d: str) -> DataFrame:
    for name in ("region", "nation"):
        table(spark, d, name).createOrReplaceTempView(f"probe_{name}")
    missing = tables.missing_tables(spark, ["probe_region", "probe_riders", "probe_nation", "probe_articles"])
    return spark.createDataFrame([(x,) for x in missing], "name string")


def articles_normalised(spark: SparkSession, d: str) -> DataFrame:
    i, text = F.col("page_id"), F.col("url")
    raw = table(spark, d, "pages").select(
        "page_id", F.when(i % 4 == 0, "").when(i % 4 == 1, text).alias("title"), F.when(i % 3 == 0, text).alias("article_title"),
        F.when(i % 5 > 1, text).when(i % 5 == 1, "").alias("url"), F.when(i % 5 == 0, text).alias("article_url"), F.when(i % 2 == 0, "b").alias("content"), F.lit("t").alias("text"),
    )
    return S.articles(raw).select("page_id", "title", "url", "body")


def riders_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Names and ages from the columns that have them, of the first list of a record that is there."""
    k = F.col("c_custkey")
    one = lambda add: F.struct((k + add).cast("string").alias("rider_name"), F.when(k % 3 == 0, "Bo").alias("name"), F.when(k % 2 == 0, F.concat(F.lit(" "), (k % 90).cast("string"))).otherwise("old").alias("age"))
    rows = table(spark, d, "customer").select("c_custkey", F.when(k % 4 == 0, F.array(one(0), one(1))).alias("setups"), F.when(k % 4 < 2, F.array(one(2))).alias("people"))
    return S.riders(S.rider_list(rows).select("c_custkey", "rider.*"), {"name": ["name", "rider_name"], "age": ["age"], "bike": ["bike", "bicycle"]}).select("c_custkey", "name", "age", "bike")


def writer_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a writer gets of a document, the whole source text, and an answer in lines."""
    i = F.col("doc_id")
    parts = F.array(F.substring("text", 1, 400), F.lit(" "), F.col("lang"), F.lit("x"))
    short = recommend.compact(F.col("text"), F.transform(F.sequence(F.lit(1), (i % 9 + 1).cast("int")), lambda x: x.cast("string")), parts)
    answer = recommend.answer(F.col("source"), F.col("lang"), {"bike": F.when(i % 2 == 0, "steel"), "bags": F.lit(" "), "tyres": F.when(i % 3 == 0, "45mm")})
    rows = table(spark, d, "documents")
    return rows.select(
        "doc_id", short["text"].alias("short"), F.array_join(short["key_items"], ",").alias("key_items"), F.size(short["chunks"]).alias("chunks"), recommend.source_text([F.col("source"), F.lit(" "), F.col("lang")], F.array(F.lit(""), F.lit("c"))).alias("whole"),
        answer.alias("answer"), chunks.without_bullet(F.concat(F.lit("•: - "), "source")).alias("line"),
    )


def dry_run_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, "x").alias("mark"))
    return sinks.dry_run(rows, "lang", "mark")


def log_of_useful(spark: SparkSession, d: str) -> DataFrame:
    """Only rows worth keeping reach the log; a second append adds to it."""

    def use(folder: str) -> DataFrame:
        rows = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
        sinks.append_log(rows.filter("s_suppkey % 2 = 0"), folder, F.col("s_acctbal") > 0)
        sinks.append_log(rows.filter("s_suppkey % 2 = 1"), folder, F.col("s_acctbal") > 0)
        return files.json_lines(spark, folder, "s_suppkey bigint, s_name string")

    return _through(spark, use)


def snapshot_runs(spark: SparkSession, d: str) -> DataFrame:
    """New rows by run; a run without rows leaves nothing."""

    def use(folder: str) -> DataFrame:
        rows = table(spark, d, "part").select("p_partkey", "p_brand")
        told = [sinks.write_snapshot(rows.filter(f"p_partkey % 3 = {k}"), folder, f"2024010{k}_000000") for k in (0, 1, 2, 7)]
        return spark.read.schema("p_partkey bigint, p_brand string, run_id string").parquet(folder).withColumn("runs", F.lit(sum(told)))

    return _through(spark, use)


def grounding_payload(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").select("c_nationkey", "c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    found = F.from_json("payload", "array<struct<c_custkey: bigint, name: string>>")
    out = sinks.grounding(rows, ["c_nationkey"], "c_custkey", ["c_custkey", "name"]).withColumn("a", found)
    return out.select("c_nationkey", F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: x["c_custkey"].cast("string")), ",").alias("keys"), F.array_join(F.transform("a", lambda x: x["name"]), ",").alias("names"), F.contains("payload", F.lit("null")).alias("has_null"))


def checked_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    size = e.agg(F.max(F.size("embedding"))).collect()[0][0]
    return sinks.checked_vectors(e.filter(F.size("embedding") == size), size).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def candidate_lists(spark: SparkSession, d: str) -> DataFrame:
    """Each query's first hits as one list, in order."""
    hits = Q._hits(spark, d, 12).withColumn("place", F.col("pos"))
    out = search.candidate_lists(hits.withColumn("s", tidy(F.col("score"))), ["chunk_id", "s"])
    return out.select("query_id", F.size("candidates").alias("n"), F.array_join(F.transform("candidates", lambda x: x["chunk_id"].cast("string")), ",").alias("ids"))


#: Buckets of the tables below; at 100 TB some thousands, so that a bucket fits a task.
BUCKETS = 8


def _bucketed(spark: SparkSession, use: Callable[..., DataFrame], *tables: tuple[DataFrame, list[str], dict]) -> DataFrame:
    """Rows that use(tables) makes of some tables that are written in buckets of their keys; they go afterwards."""
    names = [f"laid_{uuid.uuid4().hex}" for _ in tables]

    def written(folder: str) -> DataFrame:
        for name, (rows, keys, more) in zip(names, tables, strict=True):
            layouts.write_bucketed(rows, name, f"{folder}/{name}", keys, BUCKETS, **more)
        return use(*map(spark.table, names)).checkpoint()

    try:
        return _through(spark, written)
    finally:
        layouts.dropped(spark, *names)


def bucketed_missing(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a vector, of tables in buckets of the id."""
    docs = table(spark, d, "documents").select("doc_id", "lang")
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))
    return _bucketed(spark, lambda a, b: layouts.joined(a, b, ["doc_id"], "left_anti"), (docs, ["doc_id"], {}), (vectors, ["doc_id"], {}))


def bucketed_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Line items that stay when the orders of one priority go, of tables in buckets of the order."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderpriority")
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), "l_linenumber", "l_quantity")
    left = lambda o, i: layouts.joined(i, o.filter("o_orderpriority is null or o_orderpriority <> '1-URGENT'"), ["key"], "left_semi")
    return _bucketed(spark, left, (orders, ["key"], {}), (items, ["key"], {}))


def bucketed_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Line items as chunks with a key of three parts: later ones replace or join earlier ones and get their time."""
    key = ["l_orderkey", "l_returnflag", "l_linenumber"]
    items = table(spark, d, "lineitem").groupBy(*key).agg(F.max("l_quantity").cast("int").alias("size")).withColumn("updated_at", F.lit("first"))
    old, new = items.filter("l_linenumber < 6"), items.filter("l_orderkey % 2 = 0").withColumn("size", F.col("size") + 1).drop("updated_at")
    both = lambda a, b: S.upsert(a.hint("merge"), b.hint("merge"), key, stamp={"updated_at": F.lit("later")})
    return _bucketed(spark, both, (old, key, {}), (new, key, {}))


def page_lookups(spark: SparkSession, d: str) -> DataFrame:
    """The pages of the first and the last url, by the bucket key, and of the greatest id, by its Bloom filter."""
    pages = table(spark, d, "pages").select("page_id", "url", F.length("html").alias("size"))
    first, last, most = pages.agg(F.min("url"), F.max("url"), F.max("page_id")).collect()[0]
    by_url = lambda p: p.filter(F.col("url").isin([u for u in (first, last) if u is not None])).withColumn("by", F.lit("url"))
    by_page = lambda p: p.filter(F.col("page_id") == F.lit(most)).withColumn("by", F.lit("id"))
    return _bucketed(spark, lambda p: by_url(p).unionByName(by_page(p)), (pages, ["url"], {"bloom": {"page_id": 1_000_000}}))


def trace_events(spark: SparkSession, d: str) -> DataFrame:
    trace = Trace()
    count = trace.traced("count")(lambda name: table(spark, d, name).count())
    count("region")
    count("nation")
    return trace.as_table(spark).select("tool", "args", "result")


QUERIES = {
    f.__name__: f
    for f in (
        json_lines, json_wrapped, json_object_stream, json_object_ranges, latest_snapshot, qrels_last_wins, listed_lines, rows_prefix, title_by_id, repeated_keys, missing_tables, articles_normalised, riders_normalised,
        writer_texts, dry_run_counts, log_of_useful, snapshot_runs, grounding_payload, checked_vectors, candidate_lists, trace_events, bucketed_missing,
        bucketed_cascade, bucketed_upsert, page_lookups,
    )
}

_RUN = "strftime(o_orderdate, '%Y%m%d_%H%M%S')"
_BULLET = "regexp_replace('•: - ' || source, '^[:\\-–—•\\s]+', '')"
ORACLES = {
    "bucketed_missing": "SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings WHERE vec_id = d.doc_id)",
    "bucketed_cascade": "SELECT l_orderkey AS key, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority IS DISTINCT FROM '1-URGENT')",
    "bucketed_upsert": """WITH i AS (SELECT l_orderkey, l_returnflag, l_linenumber, max(l_quantity)::INTEGER AS size FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_returnflag, l_linenumber, CASE WHEN l_orderkey % 2 = 0 THEN size + 1 ELSE size END::INTEGER AS size, CASE WHEN l_orderkey % 2 = 0 THEN 'later' ELSE 'first' END AS updated_at
FROM i WHERE l_linenumber < 6 OR l_orderkey % 2 = 0""",
    "page_lookups": """SELECT page_id, url, length(html)::INTEGER AS size, 'url' AS by FROM pages WHERE url IN ((SELECT min(url) FROM pages), (SELECT max(url) FROM pages))
UNION ALL SELECT page_id, url, length(html)::INTEGER, 'id' FROM pages WHERE page_id = (SELECT max(page_id) FROM pages)""",
    "json_lines": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "json_wrapped": "SELECT n_nationkey, n_name FROM nation",
    "json_object_stream": "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INTEGER AS pos, n_name AS qid, n_nationkey::INTEGER AS n FROM nation",
    "json_object_ranges": r"""SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority || ' } \ " { \' AS note FROM orders""",
    "latest_snapshot": f"""WITH f AS (SELECT o_orderkey, o_orderdate AS modified, CASE WHEN o_orderkey % 50 = 0 THEN {_RUN} ELSE '' END AS run FROM orders),
p AS (SELECT *, CASE WHEN run <> '' THEN 'raw_' || run || '_' || o_orderkey || '.json' ELSE 'z' || o_orderkey || '.txt' END AS path FROM f)
SELECT path, run AS run_id, (SELECT max(path) FROM p WHERE path LIKE '%.json') AS last FROM p ORDER BY run <> '' DESC, run DESC, modified DESC, path DESC LIMIT 1""",
    "qrels_last_wins": """WITH l AS (SELECT (l_orderkey % 97)::VARCHAR AS qid, CASE WHEN l_linenumber < 6 THEN l_partkey || ',' || l_suppkey ELSE '' END AS ids, row_number() OVER (PARTITION BY l_orderkey % 97 ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) AS r FROM lineitem)
SELECT qid, ids FROM l WHERE r = 1""",
    "listed_lines": "SELECT p_name || p_partkey AS value FROM part WHERE p_partkey % 5 > 1",
    "rows_prefix": "SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40",
    "title_by_id": "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (7, 12)",
    "repeated_keys": "SELECT l_orderkey, count(*) AS count FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
    "missing_tables": "SELECT * FROM (VALUES ('probe_riders'), ('probe_articles')) v(name)",
    "articles_normalised": """WITH r AS (SELECT page_id, CASE page_id % 4 WHEN 1 THEN url END AS t1, CASE WHEN page_id % 3 = 0 THEN url END AS t2, CASE WHEN page_id % 5 > 1 THEN url END AS u1, CASE WHEN page_id % 5 = 0 THEN url END AS u2, CASE WHEN page_id % 2 = 0 THEN 'b' ELSE 't' END AS body FROM pages)
SELECT page_id, coalesce(nullif(t1, ''), nullif(t2, ''), 'Untitled') AS title, coalesce(nullif(u1, ''), nullif(u2, '')) AS url, body FROM r WHERE coalesce(nullif(u1, ''), nullif(u2, '')) IS NOT NULL""",
    "riders_normalised": """WITH r AS (SELECT c_custkey, unnest(CASE WHEN c_custkey % 4 = 0 THEN [0, 1] WHEN c_custkey % 4 = 1 THEN [2] END) AS a FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'Bo' ELSE (c_custkey + a)::VARCHAR END AS name, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 90)::INTEGER END AS age, NULL::VARCHAR AS bike FROM r""",
    "writer_texts": f"""SELECT doc_id, substring(text, 1, {recommend.TEXT_CHARS}) AS short, array_to_string(range(1, least(doc_id % 9 + 1, {recommend.KEY_ITEMS}) + 1), ',') AS key_items, least(4, {recommend.CHUNKS})::INTEGER AS chunks,
  concat_ws(' | ', nullif(trim(source), ''), nullif(trim(lang), ''), 'c') AS whole,
  concat_ws(chr(10), 'Event: ' || source, lang, CASE WHEN doc_id % 2 = 0 THEN 'bike: steel' END, CASE WHEN doc_id % 3 = 0 THEN 'tyres: 45mm' END) AS answer, {_BULLET} AS line FROM documents""",
    "dry_run_counts": "SELECT count(*) AS rows, count(lang) AS lang, count(*) FILTER (WHERE doc_id % 3 = 0) AS mark FROM documents",
    "log_of_useful": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0",
    "snapshot_runs": "SELECT p_partkey, p_brand, '2024010' || (p_partkey % 3) || '_000000' AS run_id, 3 AS runs FROM part",
    "grounding_payload": """SELECT c_nationkey, count(*)::INTEGER AS n, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys, coalesce(string_agg(c_name, ',' ORDER BY c_custkey) FILTER (WHERE c_custkey % 2 = 0), '') AS names, false AS has_null
FROM customer GROUP BY c_nationkey""",
    "checked_vectors": "SELECT label, count(*) AS n FROM embeddings WHERE len(embedding) = (SELECT max(len(embedding)) FROM embeddings) GROUP BY label",
    "candidate_lists": f"WITH {Q._ALL}, {Q._h(12)} SELECT query_id, count(*)::INTEGER AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY pos) AS ids FROM h GROUP BY query_id",
    "trace_events": """SELECT 'count' AS tool, '[["region"], {}]' AS args, (SELECT count(*) FROM region)::VARCHAR AS result UNION ALL SELECT 'count', '[["nation"], {}]', (SELECT count(*) FROM nation)::VARCHAR""",
}
