"""Queries of the text functions over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.functions import hashing as H
from tarnbridge.functions import text as X
from tarnbridge.operators.judging import serialized
from tarnbridge.operators.parsing import links_of
from tarnbridge.sources.tables import spread, table


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text", "lang", "source"))


def phrases_split(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(X.phrases(F.col("text"))).alias("pos", "phrase"))


def list_items(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.posexplode(X.list_items(F.col("text"))).alias("pos", "item"))


def pack_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = _docs(spark, d).select("doc_id", F.posexplode(X.packed(X.phrases(F.col("text")))).alias("chunk_ix", "chunk"))
    text = F.concat(F.lit("Key items: "), "chunk")
    return chunks.select("doc_id", "chunk_ix", text.alias("chunk_text"), X.rough_tokens(text).alias("chunk_tokens"))


def chunk_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", X.rough_tokens(F.col("text")).alias("tokens"))


def embedding_text(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _docs(spark, d), table(spark, d, "labels")
    part = lambda name, c: F.when(~X.blank(c), F.concat(F.lit(f"{name}: "), c))
    both = docs.join(labels, "doc_id", "left")
    return both.select("doc_id", F.concat_ws(
        " | ", part("Rider", F.col("doc_id").cast("string")), part("Event", F.col("source")), part("Location", F.col("lang")),
        part("Quality", F.col("quality").cast("string")), part("Text", F.trim("text")),
    ).alias("embedding_text"))


def payload_summary(spark: SparkSession, d: str) -> DataFrame:
    both = _docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    pairs = X.labelled([("lang", F.col("lang")), ("source", F.col("source")), ("quality", F.col("quality").cast("string")), ("toxic", F.col("toxic").cast("string"))], " | ")
    short = F.when(F.length("text") <= 60, X.or_null(F.trim("text")))
    return both.select("doc_id", F.coalesce(short, pairs).alias("summary"))


def rider_chunk_text(spark: SparkSession, d: str) -> DataFrame:
    """The structured chunk of each part: name and the attributes that it has."""
    p = table(spark, d, "part")
    flag = X.python_bool(F.col("p_size") > 25)
    bits = X.labelled([("brand", F.col("p_brand")), ("type", F.col("p_type")), ("size", F.col("p_size").cast("string")), ("large", flag)], ", ")
    text = F.concat(F.lit("Bike: "), "p_name", F.lit(" ("), bits, F.lit(")"))
    return p.select("p_partkey", text.alias("chunk_text"), X.rough_tokens(text).alias("chunk_tokens"))


def year_extract(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select(
        "doc_id", X.year_in(F.col("text")).alias("year"), X.year_in(F.col("text"), r"\b(20\d{2})\b", 2025).alias("year_or_default"),
        F.regexp_extract("text", r"(\d{2,4})\s*km", 1).try_cast("int").alias("distance_km"), F.regexp_extract("text", r"(\d{3,5})\s*m\b", 1).try_cast("int").alias("elevation_m"),
    )


def redact_logs(spark: SparkSession, d: str) -> DataFrame:
    out = X.redacted(F.col("text"))
    return _docs(spark, d).select("doc_id", out.alias("redacted"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    return _docs(spark, d).select(
        "doc_id", H.content_hash(c("source"), c("text")).alias("content_hash"), H.answer_hash(c("text")).alias("answer_hash"),
        H.cache_key(c("source"), c("lang"), F.lit("model"), F.lit(8)).alias("cache_key"), H.stable_id("gt", c("text")).alias("stable_id"),
        X.slug(c("text")).alias("slug"), X.without_year(c("text")).alias("without_year"), X.normal_question(c("text")).alias("question"),
    )


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Unsigned 64-bit ids of chunks; SQL has no BLAKE2b, see the tests."""
    return table(spark, d, "embeddings").select("vec_id", H.point_id(F.concat_ws(":", F.col("vec_id").cast("string"), F.lit("0"), F.col("label").cast("string"))).alias("point_id"))


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select(
        "page_id", X.canonical_url(u).alias("canonical"), X.domain(u).alias("domain"), X.base_site(u).alias("base"), X.joined_url(X.base_site(u), F.lit("/rules")).alias("rules_url"),
        is_social(X.domain(u)).alias("social"),
    )


#: Domains of social networks, as parts of a name.
SOCIAL = ("facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com")


def is_social(domain: Column) -> Column:
    return X.contains_any(domain, SOCIAL)


def event_text_norm(spark: SparkSession, d: str) -> DataFrame:
    """Texts in both normal forms; Unicode decomposition has no SQL form."""
    t = F.col("text")
    return _docs(spark, d).select("doc_id", X.title_words(t).alias("title_words"), X.letters_and_digits(t).alias("letters"))


def words_by_letters(spark: SparkSession, d: str) -> DataFrame:
    """Each language's words but for case and accents: how often, in how many spellings, and the first of these."""
    words = _docs(spark, d).select("lang", F.explode(F.split("text", r"[^\p{L}\p{N}]+")).alias("word")).filter("word <> ''")
    spelt = words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))  # far fewer rows than words reach the collated key
    groups = spelt.groupBy("lang", X.letters_key(F.col("word")).alias("key")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"), F.min("word").alias("first"))
    return groups.select("lang", "first", "n", "spellings")


def text_details(spark: SparkSession, d: str) -> DataFrame:
    """Each document's text as a title, its source and language as a login and as a record, and the start of its text for a trace."""
    title = X.clean_title(F.concat(F.lit(" Bikes of "), F.coalesce("text", F.lit("")), F.lit(" bikes OF")))
    login = F.concat(F.lit("postgresql://u:"), F.coalesce("source", F.lit("")), F.lit("@"), F.coalesce("lang", F.lit("")), F.lit("/db"))
    record = serialized(F.struct("doc_id", F.array(F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))).alias("of")))
    return _docs(spark, d).select("doc_id", title.alias("title"), X.masked_dsn(login).alias("login"), record.alias("record"), X.clipped(F.col("text"), 80).alias("clip"))


def title_match(spark: SparkSession, d: str) -> DataFrame:
    """Parts' names as titles, matched with the types of the same size as events."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    p = table(spark, d, "part")
    types = p.select("p_size", plain("p_type").alias("b")).distinct()
    pair = p.select("p_partkey", "p_size", plain("p_name").alias("a")).join(types, "p_size")
    a, b = F.col("a"), F.col("b")
    return pair.select("p_partkey", "b", X.titles_match(a, b).alias("fuzzy"), X.title_exact(a, b).alias("exact"), (F.round(X.token_jaccard(a, b), 6) + 0.0).alias("jaccard"))


def html_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages below a prefix, canonical, distinct in page order."""
    found = F.array_distinct(F.transform(F.filter(links_of("html"), lambda u: u.startswith("/")), X.canonical_url))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "link"))


_STRIP = r"regexp_replace({0}, '^[\s\x0B\x85\p{{Z}}]+|[\s\x0B\x85\p{{Z}}]+$', '', 'g')"
_PHRASES = rf"""
p0 AS (
  SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '(?:\n+|•|- |\t|;|,|\|)+'), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS parts FROM documents
), p1 AS (
  SELECT doc_id, list_filter(parts, lambda p, i: list_position(list_transform(parts, lambda q: lower(q)), lower(p)) = i) AS ph FROM p0
)"""
_TOKENS = "CASE WHEN {0} IS NULL OR length(" + _STRIP + ") = 0 THEN 0 ELSE greatest(1, length(" + _STRIP + ") // 4) END::BIGINT"
_NORM = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_TOK = "list_distinct(list_filter(string_split({0}, ' '), lambda t: t <> ''))"

QUERIES = {
    "phrases_split": phrases_split, "list_items": list_items, "pack_chunks": pack_chunks, "chunk_tokens": chunk_tokens, "embedding_text": embedding_text, "payload_summary": payload_summary,
    "rider_chunk_text": rider_chunk_text, "year_extract": year_extract, "redact_logs": redact_logs, "stable_ids": stable_ids, "point_ids": point_ids, "url_parts": url_parts,
    "event_text_norm": event_text_norm, "title_match": title_match, "words_by_letters": words_by_letters, "text_details": text_details, "html_links": html_links,
}

ORACLES = {
    "phrases_split": f"WITH {_PHRASES} SELECT doc_id, (i - 1)::INTEGER AS pos, ph[i] AS phrase FROM (SELECT doc_id, ph, unnest(range(1, len(ph) + 1)) AS i FROM p1)",
    "list_items": rf"""
WITH x AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[|,]'), lambda p: {_STRIP.format('p')}), lambda p: p <> '') AS ph FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS pos, ph[i] AS item FROM (SELECT doc_id, ph, unnest(range(1, len(ph) + 1)) AS i FROM x)""",
    "pack_chunks": rf"""
WITH {_PHRASES}, p2 AS (
  SELECT doc_id, string_split(list_reduce(ph, lambda a, b: CASE WHEN length(a) - length(regexp_replace(a, '[^\x01]*$', '')) + 2 + length(b) <= {X.MAX_CHUNK} THEN a || '; ' || b ELSE a || chr(1) || b END), chr(1)) AS c
  FROM p1 WHERE len(ph) > 0
), p3 AS (
  SELECT doc_id, (i - 1)::INTEGER AS chunk_ix, 'Key items: ' || c[i] AS chunk_text FROM (SELECT doc_id, c, unnest(range(1, len(c) + 1)) AS i FROM p2)
)
SELECT *, {_TOKENS.format('chunk_text')} AS chunk_tokens FROM p3""",
    "chunk_tokens": f"SELECT doc_id, {_TOKENS.format('text')} AS tokens FROM documents",
    "embedding_text": """
SELECT doc_id, concat_ws(' | ', 'Rider: ' || doc_id, 'Event: ' || nullif(source, ''), 'Location: ' || nullif(lang, ''), 'Quality: ' || quality,
  'Text: ' || nullif(trim(text), '')) AS embedding_text FROM documents LEFT JOIN labels USING (doc_id)""",
    "payload_summary": """
SELECT doc_id, coalesce(CASE WHEN length(text) <= 60 THEN nullif(trim(text), '') END,
  concat_ws(' | ', 'lang=' || lang, 'source=' || source, 'quality=' || quality, 'toxic=' || toxic)) AS summary FROM documents LEFT JOIN labels USING (doc_id)""",
    "rider_chunk_text": f"""
WITH t AS (SELECT p_partkey, 'Bike: ' || p_name || ' (' || concat_ws(', ', 'brand=' || p_brand, 'type=' || p_type, 'size=' || p_size, 'large=' || CASE WHEN p_size > 25 THEN 'True' ELSE 'False' END) || ')' AS chunk_text FROM part)
SELECT *, {_TOKENS.format('chunk_text')} AS chunk_tokens FROM t""",
    "year_extract": r"""
SELECT doc_id, try_cast(regexp_extract(text, '((?:19|20)\d{2})', 1) AS INTEGER) AS year, coalesce(try_cast(regexp_extract(text, '\b(20\d{2})\b', 1) AS INTEGER), 2025) AS year_or_default,
  try_cast(regexp_extract(text, '(\d{2,4})\s*km', 1) AS INTEGER) AS distance_km, try_cast(regexp_extract(text, '(\d{3,5})\s*m\b', 1) AS INTEGER) AS elevation_m FROM documents""",
    "redact_logs": rf"""
WITH l AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r'), lambda x: NOT regexp_matches(x, '{X.WEB_LOG}')) AS ls FROM documents
), k AS (
  SELECT doc_id, list_filter(ls, lambda x: NOT regexp_matches(x, '{X.ADDRESS}') OR length(regexp_replace(regexp_replace(x, '{X.ADDRESS}', '', 'g'), '^[ \-:\t]+|[ \-:\t]+$', '', 'g')) >= {X.LEAST_REMARK}) AS ls FROM l
), j AS (
  SELECT doc_id, array_to_string(list_transform(ls, lambda x: regexp_replace(x, '{X.ADDRESS}', '[url removed]', 'g')), chr(10)) AS t FROM k
)
SELECT doc_id, {_STRIP.format("regexp_replace(t, chr(10) || '{3,}', chr(10) || chr(10), 'g')")} AS redacted FROM j""",
    "stable_ids": rf"""
SELECT doc_id, sha256({_STRIP.format("coalesce(source, '')")} || chr(10) || {_STRIP.format("coalesce(text, '')")}) AS content_hash, sha256({_STRIP.format('text')}) AS answer_hash,
  substring(sha256(concat_ws('|', lower({_STRIP.format("coalesce(source, '')")}), lower({_STRIP.format("coalesce(lang, '')")}), 'model', '8')), 1, 16) AS cache_key,
  'gt_' || substring(sha256(text), 1, 12) AS stable_id,
  regexp_replace(regexp_replace(lower(trim(text)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  trim(regexp_replace(text, '\s*\b20\d{{2}}\b\s*', ' ', 'g')) AS without_year,
  translate({_STRIP.format(r"regexp_replace(lower(text), '[\s\x0B\x85\p{Z}]+', ' ', 'g')")}, '’–—', '''--') AS question FROM documents""",
    "url_parts": f"""
WITH u AS (SELECT page_id, url, lower(split_part(regexp_replace(url, '^https?://', ''), '/', 1)) AS domain, coalesce(nullif(regexp_extract(url, '^(https?://[^/]+)', 1), ''), url) AS base FROM pages)
SELECT page_id, regexp_replace(url, '[?#].*$', '') AS canonical, domain, base, regexp_replace(base, '/+$', '') || '/rules' AS rules_url,
  {' OR '.join(f"contains(domain, '{s}')" for s in SOCIAL)} AS social FROM u""",
    "text_details": """SELECT doc_id, trim(regexp_replace(' Bikes of ' || coalesce(text, '') || ' bikes OF', 'bikes of', '', 'gi')) AS title, CASE WHEN coalesce(source, '') = '' THEN 'postgresql://u:@' ELSE 'postgresql://u:***@' END || coalesce(lang, '') || '/db' AS login,
  to_json({doc_id: doc_id, of: [coalesce(source, ''), coalesce(lang, '')]})::VARCHAR AS record, CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS clip FROM documents""",
    "words_by_letters": r"""WITH w AS (SELECT lang, unnest(regexp_split_to_array(text, '[^\p{L}\p{N}]+')) AS word FROM documents)
SELECT lang, min(word) AS first, count(*) AS n, count(DISTINCT word) AS spellings FROM w WHERE word <> '' GROUP BY lang, replace(strip_accents(lower(word)), 'ß', 'ss')""",
    "title_match": f"""
WITH n AS (SELECT p_partkey, p_size, {_NORM.format('p_name')} AS a, {_NORM.format('p_type')} AS b FROM part), p AS (
  SELECT p_partkey, a, y.b FROM n JOIN (SELECT DISTINCT p_size, b FROM n) y USING (p_size)
), t AS (
  SELECT *, {_TOK.format('a')} AS x, {_TOK.format('b')} AS y FROM p
)
SELECT p_partkey, b,
  a <> '' AND b <> '' AND (a = b OR len(list_filter(x, lambda v: NOT list_contains(y, v))) = 0 OR len(list_filter(y, lambda v: NOT list_contains(x, v))) = 0 OR contains(a, b) OR contains(b, a)) AS fuzzy,
  a <> '' AND b <> '' AND contains(' ' || a || ' ', ' ' || b || ' ') AS exact,
  CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) END::DOUBLE AS jaccard FROM t""",
    "html_links": r"""
WITH h AS (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="(/[^"]*)"', 1), lambda u: regexp_replace(u, '[?#].*$', '')) AS l FROM pages),
g AS (SELECT page_id, list_filter(l, lambda u, i: list_position(l, u) = i) AS l FROM h)
SELECT page_id, (i - 1)::INTEGER AS pos, l[i] AS link FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM g)""",
}
