"""Queries of the rules about queries, events and hits, with their SQL.

The driver's texts are invented words, so each document's text is followed by one of PHRASES, which
the rules can bite on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.functions.vectors import tidy
from tarnbridge.operators import events as E
from tarnbridge.operators import intent as I
from tarnbridge.operators import lexicon as L
from tarnbridge.operators import rerank as R
from tarnbridge.operators.metrics import metrics
from tarnbridge.plans import retrieval_queries as Q
from tarnbridge.sources.tables import spread, table

PHRASES = (
    "gravel race in the mountain, 2.2 tubeless and Schwalbe G-One tyres, GRX 1x11, frame bag",
    "which tyres for a 1200 km road race with 14000 m climbing? 28-32mm, mechanical only",
    "desert singletrack, hardtail with suspension, bivy, no suspension, 50mm+",
    "lights and dynamo hub for night riding, navigation: garmin, remote route",
    "rigid steel, puncture and flat protection, sealant, steep climbs, 11-46 cassette",
    "road bike with 700c wheels, 30mm slick, sleeping bag, Apidura seat bags",
    "alpine off road trail, rough terrain, cold, Zipp 303 wheels, SRAM Eagle AXS | quilt",
    "wahoo navigation, wide range gearing, 10-50, tent, drybag, avoid electronic",
    "mountain bike, jeep track, freezing nights, 29er, shimano xt 12s; mat",
    "", "what to pack", "all road 45mm - 50mm tyres, garmin only, no electronic, mullet",
)
FRAMES = ("", "hardtail suspension", "rigid steel", "full suspension")
EVENTS = ("Badlands", "", " Atlas Mountain Race ", "Unknown event", "What race is it", "Tour Divide", "Some Other Race")
WIDTHS = ("", "50mm+", "28mm - 32mm", "45-50mm", "40mm", "wide")


def chosen(values: Sequence[str], by: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.concat_ws(" ", "text", chosen(PHRASES, F.col("doc_id"))).alias("text"))


def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    f = {n: F.col(n) for n in I.FLAGS}
    return I.with_flags(_texts(spark, d), F.col("text")).select("doc_id", *f, I.surface_family(f).alias("family"), I.archetype(f).alias("archetype"))


def surface_rules(spark: SparkSession, d: str) -> DataFrame:
    t, bias = F.col("lower"), F.col("bias")
    rows = _texts(spark, d).withColumn("lower", F.lower("text")).withColumn("bias", I.surface_bias(t))
    return rows.select("doc_id", "bias", I.surface_hint(t).alias("hint"), I.surface_factor(t, bias).alias("factor"))


def setup_hints(spark: SparkSession, d: str) -> DataFrame:
    t, low = F.col("text"), F.col("lower")
    rows = _texts(spark, d).withColumn("lower", F.lower(t))
    return rows.select("doc_id", I.bike_type(t, low).alias("bike_type"), *[I.setup_detail(t, p, low).alias(n) for n, p in I.SETUP.items()])


def query_intent(spark: SparkSession, d: str) -> DataFrame:
    name, sure = I.component(F.col("text"), F.col("best"))
    return _texts(spark, d).withColumn("best", I.component_counts(F.col("text"))).select("doc_id", name.alias("component"), tidy(sure).alias("confidence"))


def descriptor_query(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    found = {"hint": I.surface_hint(t), "km": I.metric(t, I.KM), "metres": I.metric(t, I.METRES), "event": chosen(EVENTS, F.col("doc_id"))}
    out = I.descriptors({n: F.col(n) for n in I.FLAGS}, *map(F.col, found))
    return I.with_flags(_texts(spark, d), t).withColumns(found).select("doc_id", out.alias("descriptor"))


def archetype_details(spark: SparkSession, d: str) -> DataFrame:
    f = {n: F.col(n) for n in I.FLAGS}
    return I.with_flags(_texts(spark, d), F.col("text")).select("doc_id", I.archetype(f).alias("archetype"), *[F.array_join(c, ",").alias(n) for n, c in I.archetype_details(f).items()])


def component_hits(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d).join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return rows.groupBy("source").agg(*[F.count_if(I.component_hit(F.col("text"), t)).alias(n) for n, t in I.COMPONENTS.items()])


_LEXICON = (("garmin", "garmin"), ("trail", "trail"), ("road", "road race"), ("road", "all road"), ("gravel", "gravel race"), ("mountain", "mountain bike"), ("mountain", "mountain"), ("night", "night"))


def alias_detect(spark: SparkSession, d: str) -> DataFrame:
    """The first and the longest alias of a lexicon in each text."""
    lexicon = spark.createDataFrame([(i, *x) for i, x in enumerate(_LEXICON)], "ord int, key string, alias string")
    texts = _texts(spark, d).withColumn("text", F.lower("text"))
    first = L.first_in_lexicon(texts, lexicon).select("doc_id", F.col("key").alias("first_key"))
    longest = L.first_in_lexicon(texts, lexicon, longest=True).select("doc_id", F.col("alias").alias("longest_alias"))
    words = F.trim(F.regexp_replace("text", "[^a-z0-9]+", " "))
    whole = texts.select("doc_id", E.whole_alias(words, F.lit("mountain bike")).alias("whole"))
    return first.join(longest, "doc_id").join(whole, "doc_id")


def lexicon_matches(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one to four words of the benchmark, tens of thousands, found as whole words in every document."""
    normal = lambda name, key: table(spark, d, name).select(F.col(key).alias("id"), F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " ")).alias("text"))
    words = F.split("text", " ")
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda n: F.when(i + n <= F.size(words), F.array_join(F.slice(words, i + 1, n), " "))))
    lexicon = normal("benchmark", "item_id").filter("text <> ''").select(F.explode(F.flatten(runs)).alias("alias")).filter("alias is not null").distinct()
    found = L.matches(normal("documents", "doc_id"), lexicon, key="id", whole=True)
    longest = F.min(F.struct((-F.length("alias")).alias("l"), "alias"))
    first = F.min(F.struct("first", F.length("alias").alias("l"), "alias"))
    return found.groupBy(F.col("id").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("aliases"), F.sum("times").alias("times"), longest.getField("alias").alias("longest"), first.getField("first").alias("first"), first.getField("alias").alias("first_alias")
    )


def _hit_columns(by: Column) -> dict[str, Column]:
    return {
        "text": chosen(PHRASES, by), "event_key": F.lit(""), "frame_type": chosen(FRAMES, by), "tyre_width": chosen(WIDTHS, by), "wheel_size": F.lit(""),
        "electronic": F.when(F.pmod(by, F.lit(3)) == 0, True).when(F.pmod(by, F.lit(3)) == 1, False),
    }


def _reranked(spark: SparkSession, d: str) -> DataFrame:
    hits = Q._hits(spark, d, 30)
    asked = {n: c for n, c in R.constraints(chosen(PHRASES, F.floor(F.col("query_id") / Q.EVERY))).items()}
    return R.rerank(hits, asked, _hit_columns(F.col("chunk_id")))


def rerank_rules(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("query_id", "chunk_id", "pos", "place", tidy(F.col("delta")).alias("delta"), tidy(F.col("total")).alias("total"))


def rerank_effect(spark: SparkSession, d: str) -> DataFrame:
    """Means of the metrics before and after reranking."""
    qrels = Q._vectors(spark, d).select(F.col("id").alias("doc_id"), "label").join(
        Q._vectors(spark, d).filter(F.col("id") % Q.EVERY == 0).select(F.col("id").alias("query_id"), "label"), "label").select("query_id", "doc_id", F.lit(1).alias("rel"))
    rows = _reranked(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), "pos", "place")
    before = metrics(rows.select("query_id", "doc_id", "pos"), qrels, [10]).withColumn("ranking", F.lit("dense"))
    after = metrics(rows.select("query_id", "doc_id", F.col("place").alias("pos")), qrels, [10]).withColumn("ranking", F.lit("reranked"))
    return before.unionByName(after).groupBy("ranking").agg(F.count(F.lit(1)).alias("queries"), *[tidy(F.avg(n), 5).alias(n) for n in ("hitrate", "precision", "mrr")])


QUERIES = {f.__name__: f for f in (keyword_flags, surface_rules, setup_hints, query_intent, descriptor_query, archetype_details, component_hits, alias_detect, lexicon_matches, rerank_rules, rerank_effect)}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _choose(values: Sequence[str], by: str) -> str:
    return f"([{', '.join(map(_quoted, values))}])[({by}) % {len(values)} + 1]"


def _has(x: str, terms: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {_quoted(t)})" for t in terms) + ")"


def _count(x: str, terms: Sequence[str]) -> str:
    return "(" + " + ".join(f"contains({x}, {_quoted(t)})::INTEGER" for t in terms) + ")"


_T = f"t AS (SELECT doc_id, source, x AS text, lower(x) AS l FROM (SELECT doc_id, source, concat_ws(' ', text, {_choose(PHRASES, 'doc_id')}) AS x FROM documents))"
_F = f"f AS (SELECT *, {', '.join(f'{_has("l", terms)} AS {n}' for n, terms in I.FLAGS.items())} FROM t)"
_FAMILY = "CASE WHEN mtb THEN 'mtb' WHEN gravel THEN 'gravel' WHEN road THEN 'road' WHEN off_road THEN 'mixed_offroad' ELSE 'unknown' END"
_KIND = """CASE family WHEN 'mtb' THEN CASE WHEN desert THEN 'desert_mtb_ultra' WHEN mountain THEN 'mountain_mtb_ultra' ELSE 'mtb_ultra' END
  WHEN 'gravel' THEN CASE WHEN mountain THEN 'mountain_gravel_ultra' ELSE 'gravel_ultra' END WHEN 'road' THEN CASE WHEN mountain THEN 'mountain_road_ultra' ELSE 'road_ultra' END
  WHEN 'mixed_offroad' THEN CASE WHEN desert THEN 'desert_offroad_ultra' WHEN mountain THEN 'mountain_offroad_ultra' ELSE 'offroad_bikepacking_ultra' END ELSE 'general_bikepacking_ultra' END"""
_BIAS = f"CASE WHEN {_count('l', I.ROAD_TERMS)} > {_count('l', I.GRAVEL_TERMS)} THEN 'road' WHEN {_count('l', I.GRAVEL_TERMS)} > {_count('l', I.ROAD_TERMS)} THEN 'gravel' ELSE 'neutral' END"
_HINT = f"CASE WHEN {_has('(chr(32) || l || chr(32))', [' road ', ' all-road ', ' all road '])} THEN 'road' WHEN contains(' ' || l || ' ', ' gravel ') THEN 'gravel' WHEN {_has('(chr(32) || l || chr(32))', [' trail ', ' mtb ', ' mountain bike '])} THEN 'trail' END"
_WORDS = [
    _quoted(I.FIRST_WORDS), "CASE WHEN e NOT IN ('', 'Unknown event') AND NOT starts_with(lower(e), 'what ') THEN e END", *[f"CASE WHEN hint = 'road' THEN {_quoted(w)} END" for w in ("road event", "road-oriented setup", "faster rolling tyres", "avoid MTB-style tyre widths")],
    *[f"CASE WHEN hint = '{h}' THEN {_quoted(w)} END" for h in ("gravel", "trail") for w in (f"{h} event", f"{h}-oriented setup")],
    *[f"CASE WHEN lower(e) = '{n}' THEN {_quoted(w)} END" for n, ws in I.EVENT_HINTS.items() for w in ws],
    *[f"CASE WHEN family = '{n}' THEN {_quoted(w)} END" for n, ws in I.SURFACE_WORDS.items() for w in ws], *[f"CASE WHEN {n} THEN {_quoted(w)} END" for n, w in I.FLAG_WORDS.items()],
    "CASE WHEN km > 0 THEN km || ' km' END", "CASE WHEN m > 0 THEN m || ' m climbing' END",
]
_MOST = f"greatest({', '.join(_count('l', t) for t in I.COMPONENTS.values())})"
_D = R.Weights()
_RX = lambda x, p, i: f"try_cast(regexp_extract({x}, '{p}', {i}) AS INTEGER)"
_PAIR, _SHORT, _ONE = r"(\d{2})\s*mm\s*-\s*(\d{2})\s*mm", r"(\d{2})\s*-\s*(\d{2})\s*mm", r"(\d{2})\s*mm"
_RERANKED = rf"""{Q._ALL}, {Q._h(30)}, k AS (
  SELECT *, lower({_choose(PHRASES, f'query_id // {Q.EVERY}')}) AS qt, lower({_choose(PHRASES, 'chunk_id')}) AS ct, {_choose(FRAMES, 'chunk_id')} AS frame, {_choose(WIDTHS, 'chunk_id')} AS width,
    CASE chunk_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS electronic FROM h
), c AS (
  SELECT *, {_has('qt', ['mechanical shifting', 'mechanical only', 'avoid electronic', 'no electronic'])} AS no_el, {_has('qt', ['garmin only', 'navigation: garmin', 'nav: garmin'])} AS garmin,
    {_has('qt', ['rigid', 'avoid suspension', 'no suspension'])} AS rigid, {_has('qt', ['puncture', 'flat'])} AS puncture, {_has('qt', ['wide range gearing', 'steep climbs', 'wide gear range'])} AS gearing,
    coalesce({_RX('qt', r'(\d{2})\s*[-–]\s*(\d{2})\s*mm', 1)}, {_RX('qt', r'(\d{2})\s*mm\+', 1)}) AS tmin, {_RX('qt', r'(\d{2})\s*[-–]\s*(\d{2})\s*mm', 2)} AS tmax,
    CASE WHEN ends_with(width, 'mm+') THEN {_RX('width', r'^(\d+)mm\+$', 1)} ELSE coalesce({_RX('width', _PAIR, 1)}, {_RX('width', _SHORT, 1)}, {_RX('width', _ONE, 1)}) END AS wmin,
    CASE WHEN NOT ends_with(width, 'mm+') THEN coalesce({_RX('width', _PAIR, 2)}, {_RX('width', _SHORT, 2)}, {_RX('width', _ONE, 1)}) END AS wmax FROM k
), d AS (
  SELECT *, CASE WHEN no_el AND electronic THEN {_D.electronic_violation} WHEN no_el AND NOT electronic THEN {_D.mechanical_ok} ELSE 0 END
    + CASE WHEN garmin AND contains(ct, 'garmin') THEN {_D.garmin_ok} WHEN garmin AND {_has('ct', R.OTHER_NAVIGATION)} THEN {_D.garmin_violation} ELSE 0 END
    + CASE WHEN rigid AND contains(frame, 'suspension') THEN {_D.suspension_violation} WHEN rigid AND frame <> '' THEN {_D.rigid_ok} ELSE 0 END
    + CASE WHEN (tmin IS NOT NULL OR tmax IS NOT NULL) AND (wmin IS NOT NULL OR wmax IS NOT NULL) THEN
        CASE WHEN coalesce(tmax, 1e9) < coalesce(wmin, -1e9) OR coalesce(wmax, 1e9) < coalesce(tmin, -1e9) THEN {_D.tyre_mismatch} ELSE {_D.tyre_match} END ELSE 0 END
    + CASE WHEN puncture AND {_has('ct', R.PUNCTURE)} THEN {_D.puncture_terms} ELSE 0 END + CASE WHEN gearing AND {_has('ct', R.WIDE_GEARING)} THEN {_D.wide_gearing_terms} ELSE 0 END
    + CASE WHEN frame <> '' OR width <> '' OR coalesce(electronic, false) THEN {_D.has_structured} ELSE 0 END AS raw FROM c
), rr AS (
  SELECT *, greatest(-{_D.most}, least({_D.most}, raw))::DOUBLE AS delta, score + greatest(-{_D.most}, least({_D.most}, raw))::DOUBLE AS total FROM d
), y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(total, 9) DESC, pos) AS place FROM rr)"""

ORACLES = {
    "keyword_flags": f"WITH {_T}, {_F}, g AS (SELECT *, {_FAMILY} AS family FROM f) SELECT doc_id, {', '.join(I.FLAGS)}, family, {_KIND} AS archetype FROM g",
    "surface_rules": f"""WITH {_T}, b AS (SELECT *, {_BIAS} AS bias, {_HINT} AS hint, {_has('l', I.ROAD_MARKS)} AS r, {_has('l', I.GRAVEL_MARKS)} AS g FROM t)
SELECT doc_id, bias, hint, CASE WHEN bias = 'road' THEN CASE WHEN r AND NOT g THEN 1.15 WHEN g AND NOT r THEN 0.72 WHEN r AND g THEN 0.92 ELSE 1.0 END
  WHEN bias = 'gravel' THEN CASE WHEN g AND NOT r THEN 1.15 WHEN r AND NOT g THEN 0.80 WHEN r AND g THEN 0.95 ELSE 1.0 END ELSE 1.0 END::DOUBLE AS factor FROM b""",
    "setup_hints": f"""WITH {_T} SELECT doc_id, CASE WHEN contains(l, 'hardtail') THEN 'hardtail' WHEN {_has('l', ['mountain bike', ' mtb'])} THEN 'mtb' WHEN contains(l, 'gravel') THEN 'gravel bike'
  WHEN {_has('l', ['road bike', 'endurace', 'domane', 'emonda'])} THEN 'road / endurance bike' END AS bike_type,
  {', '.join('coalesce(' + ', '.join(f"nullif(regexp_extract(text, {_quoted('(?i)' + p)}), '')" for p in ps) + f') AS {n}' for n, ps in I.SETUP.items())} FROM t""",
    "query_intent": f"""WITH {_T}, m AS (SELECT *, {_MOST} AS most FROM t)
SELECT doc_id, CASE WHEN trim(l) = '' OR most = 0 THEN 'full_setup' {' '.join(f"WHEN {_count('l', t)} = most THEN '{n}'" for n, t in I.COMPONENTS.items())} END AS component,
  (round(CASE WHEN trim(l) = '' THEN 0.0 WHEN most = 0 THEN 0.25 ELSE least(1.0, 0.35 + 0.15 * most) END::DOUBLE, 6) + 0.0) AS confidence FROM m""",
    "descriptor_query": rf"""WITH {_T}, {_F}, g AS (SELECT *, {_FAMILY} AS family, {_HINT} AS hint, trim({_choose(EVENTS, 'doc_id')}) AS e, {_RX('text', r'(?i)(\d{2,4})\s*km\b', 1)} AS km, {_RX('text', r'(?i)(\d{3,5})\s*m\b', 1)} AS m FROM f),
x AS (SELECT doc_id, list_filter([{', '.join(_WORDS)}], lambda w: w IS NOT NULL) AS ws FROM g) SELECT doc_id, array_to_string(list_filter(ws, lambda w, i: list_position(ws, w) = i), ', ') AS descriptor FROM x""",
    "archetype_details": f"""WITH {_T}, {_F}, g AS (SELECT *, {_FAMILY} AS family FROM f), k AS (SELECT *, {_KIND} AS archetype FROM g)
SELECT doc_id, archetype, {', '.join(f"concat_ws(',', {', '.join(_quoted(w) if flag is None else f'CASE WHEN {flag} THEN {_quoted(w)} END' for flag, w in items)}) AS {n}" for n, items in I.DETAILS.items())},
  CASE archetype {' '.join(f"WHEN '{n}' THEN '{','.join(v)}'" for n, v in I.ADJACENT.items())} ELSE '' END AS adjacent FROM k""",
    "component_hits": f"WITH {_T} SELECT source, {', '.join(f'count(*) FILTER (WHERE {_has("l", t)}) AS {n}' for n, t in I.COMPONENTS.items())} FROM t GROUP BY source",
    "alias_detect": f"""WITH {_T}, x AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{k}', '{a}')" for i, (k, a) in enumerate(_LEXICON))}) v(ord, key, alias)),
h AS (SELECT doc_id, l, ord, key, alias FROM t LEFT JOIN x ON contains(l, alias))
SELECT doc_id, arg_min(key, ord) AS first_key, arg_min(alias, -length(alias) * 1000 + ord) AS longest_alias,
  any_value(contains(' ' || trim(regexp_replace(l, '[^a-z0-9]+', ' ', 'g')) || ' ', ' mountain bike ')) AS whole FROM h GROUP BY doc_id""",
    "lexicon_matches": r"""WITH b AS (SELECT string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM benchmark),
x AS (SELECT DISTINCT array_to_string(w[i:i + n - 1], ' ') AS alias FROM b, range(1, 5) s(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i) WHERE w[1] <> ''),
t AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), w AS (SELECT doc_id, string_split(t, ' ') AS w FROM t WHERE t <> ''),
g AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS alias FROM w, range(1, 5) s(n), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
o AS (SELECT doc_id, i, (sum(length(y) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(y) - 1)::BIGINT AS pl FROM (SELECT doc_id, unnest(w) AS y, generate_subscripts(w, 1) AS i FROM w)),
m AS (SELECT doc_id, alias, count(*) AS times, min(pl) AS first FROM g SEMI JOIN x USING (alias) JOIN o USING (doc_id, i) GROUP BY doc_id, alias)
SELECT doc_id, count(*) AS aliases, sum(times)::BIGINT AS times, min({l: -length(alias), a: alias}).a AS longest, min(first) AS first, min({f: first, l: length(alias), a: alias}).a AS first_alias FROM m GROUP BY doc_id""",
    "rerank_rules": f"WITH {_RERANKED} SELECT query_id, chunk_id, pos::INTEGER AS pos, place::INTEGER AS place, {Q._R('delta')} AS delta, {Q._R('total')} AS total FROM y",
    "rerank_effect": f"""WITH {_RERANKED}, u AS (SELECT 'dense' AS ranking, query_id, pos, label = q_label AS hit FROM y UNION ALL SELECT 'reranked', query_id, place, label = q_label FROM y),
z AS (SELECT ranking, query_id, max(hit::INTEGER) AS hitrate, sum(hit::INTEGER) / 10.0::DOUBLE AS precision, coalesce(1.0::DOUBLE / min(CASE WHEN hit THEN pos END), 0) AS mrr FROM u WHERE pos <= 10 GROUP BY ALL)
SELECT ranking, count(*) AS queries, {Q._R('avg(hitrate)', 5)} AS hitrate, {Q._R('avg(precision)', 5)} AS precision, {Q._R('avg(mrr)', 5)} AS mrr FROM z GROUP BY ranking""",
}
