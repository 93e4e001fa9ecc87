"""Op 6: document fingerprints by a homomorphic multiset hash.

Each paragraph (line) is hashed to a wide vector and a document's fingerprint begins with the sum of
its paragraphs' vectors, each lane modulo 2**56. Hence the order of the paragraphs doesn't matter,
equal texts have equal fingerprints, and a paragraph is put in or taken out by adding or subtracting
its vector (``insert``, ``delete``).

How alike two documents are is read from the rest of the fingerprint, sums as well: SPARSE lanes at
each of LEVELS sampling rates. A unit (a piece between line breaks and marks that end sentences, so
that a text of one line has several) adds to one lane that its digest picks: at level 0 every unit,
at each further level a quarter of those before. Documents are compared at the level that suits the
larger one's number of units: the share of used lanes that agree. Only lanes that aren't 0 are kept.

All columns are DataFrame functions. A null text counts as empty; an empty text has one empty
paragraph and no units. Documents follow each other by descending doc_id (null last), then by text;
equal rows have one fingerprint, whichever comes first; after the last comes the first. Texts of any
length are hashed whole. Columns but doc_id and text aren't read. A table of one row has itself as
the next; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import hex_int, table

#: Lanes of a paragraph's vector, and hexadecimal digits of each.
DENSE, DIGITS = 18, 14
MOD = 16**DIGITS
#: Lanes of each level, levels, and what a level's share of the one before is; units that a level should have at most.
SPARSE, LEVELS, RATE, UNITS = 256, 6, 4, 128
SPARSE_MOD = 2**16
#: Bits of a unit's hash that tell its lane and what it adds; those above draw its levels.
LANE_BITS = 24
#: What ends a unit.
ENDS = "[.!?\n]"
#: Rows a bucket of neighbouring doc_ids, and the most buckets (a square, for two-step lookup).
BUCKET_ROWS = 1000
MAX_BUCKETS = 128 * 128


def _named(value: Column, use) -> Column:
    """use(value), with the value made once."""
    return F.transform(F.array(value), use).getItem(0)


def _vector(paragraph: Column) -> Column:
    """DENSE numbers: one hash of the paragraph, widened by hashing it again."""
    wide = lambda d: F.concat(*[F.sha2(F.concat(d, F.lit(str(i))), 256) for i in range(4)])
    return _named(F.sha2(paragraph, 256), lambda d: _named(wide(d), lambda w: F.array(*[hex_int(w, i * DIGITS + 1, DIGITS) for i in range(DENSE)])))


def _picked(text: Column) -> Column:
    """lane * SPARSE_MOD + v of every unit at every level that takes it; lanes are numbered through all levels."""
    units = F.filter(F.split(text, ENDS, -1), lambda u: u != "")
    taken = lambda x: F.transform(F.sequence(F.lit(0), _last_level(F.shiftright(x, LANE_BITS))), lambda j: (x % (SPARSE * SPARSE_MOD)) + j * (SPARSE * SPARSE_MOD))
    return F.flatten(F.transform(F.transform(units, lambda u: hex_int(F.md5(u), 1, 14)), taken))


def _last_level(draw: Column) -> Column:
    """The last level that takes a unit."""
    out = F.when(draw % RATE != 0, 0)
    for j in range(1, LEVELS - 1):
        out = out.when(draw % RATE ** (j + 1) != 0, j)
    return out.otherwise(LEVELS - 1)


def _summed(picked: Column) -> Column:
    """lane * SPARSE_MOD + sum, in order, for the lanes whose sum isn't 0."""
    start = F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(-1).cast("bigint").alias("lane"), F.lit(0).cast("bigint").alias("sum"))
    closed = lambda a: F.when(a["sum"] == 0, a["done"]).otherwise(F.array_append(a["done"], a["lane"] * SPARSE_MOD + a["sum"]))

    def add(a: Column, x: Column) -> Column:
        same = F.struct(a["done"].alias("done"), a["lane"].alias("lane"), ((a["sum"] + x) % SPARSE_MOD).alias("sum"))
        return F.when(a["lane"] == F.shiftright(x, 16), same).otherwise(F.struct(closed(a).alias("done"), F.shiftright(x, 16).alias("lane"), (x % SPARSE_MOD).alias("sum")))

    return F.aggregate(F.array_sort(picked), start, add, closed)


def lanes(text: Column) -> Column:
    """struct(dense, units, sparse): sums over the text's paragraphs, the number of units, sums over these."""
    zeros = F.array_repeat(F.lit(0).cast("bigint"), DENSE)
    vectors = F.transform(F.split(text, "\n", -1), _vector)
    dense = F.aggregate(vectors, zeros, lambda a, v: F.zip_with(a, v, lambda x, y: (x + y) % MOD))
    return _named(_picked(text), lambda p: F.struct(dense.alias("dense"), F.size(F.filter(p, lambda x: x < SPARSE * SPARSE_MOD)).cast("bigint").alias("units"), _summed(p).alias("sparse")))


def _combined(vector: Column, text: Column, sign: int) -> Column:
    """The lanes with those of a text added or, with their negatives, taken away."""
    signed = lambda codes: codes if sign > 0 else F.transform(codes, lambda c: c - c % SPARSE_MOD + (SPARSE_MOD - c % SPARSE_MOD) % SPARSE_MOD)
    both = lambda own: F.struct(
        F.zip_with(vector["dense"], own["dense"], lambda a, b: (a + sign * b + MOD) % MOD).alias("dense"), (vector["units"] + sign * own["units"]).alias("units"),
        _summed(F.concat(vector["sparse"], signed(own["sparse"]))).alias("sparse"),
    )
    return _named(lanes(text), both)


def insert(vector: Column, text: Column) -> Column:
    """The lanes after the paragraphs of text have been put in."""
    return _combined(vector, text, 1)


def delete(vector: Column, text: Column) -> Column:
    """The lanes after the paragraphs of text have been taken out."""
    return _combined(vector, text, -1)


def written(vector: Column) -> Column:
    """The lanes as one string of hexadecimal digits: dense ones, the number of units, sparse ones with their places."""
    digits = lambda a, n: F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat_ws(".", digits(vector["dense"], DIGITS), F.lower(F.hex(vector["units"])), digits(vector["sparse"], 7))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the share of lanes used in either that agree, at the level that suits both."""
    most = F.greatest(a["units"], b["units"])
    level = F.when(most <= UNITS, 0)
    for j in range(1, LEVELS - 1):
        level = level.when(most <= UNITS * RATE**j, j)
    at = lambda v, j: F.filter(v["sparse"], lambda c: F.floor(c / (SPARSE_MOD * SPARSE)) == j)
    lanes_of = lambda v: F.transform(v, lambda c: F.floor(c / SPARSE_MOD))
    share = lambda x: F.size(F.array_intersect(x["a"], x["b"])) / F.greatest(F.size(F.array_union(lanes_of(x["a"]), lanes_of(x["b"]))), F.lit(1))
    both = _named(level.otherwise(LEVELS - 1), lambda j: F.struct(at(a, j).alias("a"), at(b, j).alias("b")))
    return F.when(a == b, F.lit(1.0)).otherwise(_named(both, share))


def _bucket(bounds: list[int]) -> Column:
    """How many of the sorted bounds lie below doc_id, in two steps of the square root each."""
    step = max(1, round(len(bounds) ** 0.5))
    every = F.array(*[F.lit(b).cast("bigint") for b in bounds]) if bounds else F.array().cast("array<bigint>")
    coarse = F.array(*[F.lit(b).cast("bigint") for b in bounds[step - 1 :: step]]) if bounds else every
    whole = F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * step
    return F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(
        F.transform(F.array(whole), lambda w: w + F.size(F.filter(F.slice(every, w + 1, F.lit(step)), lambda b: b < F.col("doc_id")))).getItem(0)
    )


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and vector, with next_text and next_vector of the document that follows.

    Rows are dealt into buckets of neighbouring doc_ids. The first row of each bucket is also put,
    as a ghost, behind the last row of the bucket before it, so one shuffle of the texts is all.
    What is broadcast is one doc_id a bucket, MAX_BUCKETS at most.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    count = min(MAX_BUCKETS, n // BUCKET_ROWS)
    quantiles = [i / (count + 1) for i in range(1, count + 1)]
    found = docs.agg(F.percentile_approx("doc_id", quantiles, 100_000).alias("q")).collect()[0]["q"] if quantiles else None
    bucket = _bucket(sorted(set(found or [])))
    heads = docs.select("doc_id", bucket.alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("head"))
    # a few numbers a bucket: the bucket in which each head follows as a ghost
    order = sorted(((r["bucket"], r["head"]) for r in heads.collect()), reverse=True)
    ghosts = [(head, order[i - 1][0]) for i, (_, head) in enumerate(order)]
    follows = docs.sparkSession.createDataFrame(ghosts, "head bigint, ghost int") if ghosts else docs.sparkSession.createDataFrame([], "head bigint, ghost int")
    dealt = (
        docs.withColumn("bucket", bucket).join(F.broadcast(follows), F.col("doc_id").eqNullSafe(F.col("head")), "left")
        .withColumn("at", F.explode(F.when(F.col("ghost").isNull(), F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g")))).otherwise(
            F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("g")), F.struct(F.col("ghost").alias("b"), F.lit(1).alias("g"))))))
        .select("doc_id", "text", F.col("at.b").alias("bucket"), F.col("at.g").alias("g"))
        .repartition("bucket").withColumn("vector", lanes(F.col("text")))
    )
    w = Window.partitionBy("bucket").orderBy("g", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumns({"next_text": F.lead("text").over(w), "next_vector": F.lead("vector").over(w)}).filter("g = 0").select("doc_id", "text", "vector", "next_text", "next_vector")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its half edited copy's, and how alike they and the next are."""
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_vector", lanes(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("vector")).alias("fingerprint"), written(F.col("edited_vector")).alias("edited_fingerprint"),
        likeness(F.col("vector"), F.col("edited_vector")).alias("near_edited"), likeness(F.col("vector"), F.col("next_vector")).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))


_WIDE = " || ".join(f"sha256(d || '{i}')" for i in range(4))
_TAKEN = " ".join(f"WHEN u.draw % {RATE ** (j + 1)} <> 0 THEN {j}" for j in range(LEVELS - 1))
_LEVEL = "CASE " + " ".join(f"WHEN greatest({{0}}.units, {{1}}.units) <= {UNITS * RATE**j} THEN {j}" for j in range(LEVELS - 1)) + f" ELSE {LEVELS - 1} END"


def _lanes_sql(text: str) -> str:
    """A struct of dense, units and sparse, as lanes() has them."""
    hashed = f"list_transform(list_filter(string_split_regex({text}, '{ENDS}'), lambda u: u <> ''), lambda u: md5(u))"
    units = f"list_transform(list_transform({hashed}, lambda d: ('0x' || d[1:14])::BIGINT), lambda x: {{lane: x % {SPARSE * SPARSE_MOD} // {SPARSE_MOD}, v: x % {SPARSE_MOD}, draw: x >> {LANE_BITS}}})"
    picked = f"flatten(list_transform({units}, lambda u: list_transform(range(CASE {_TAKEN} ELSE {LEVELS - 1} END + 1), lambda j: {{lane: u.lane + j * {SPARSE}, v: u.v}})))"
    total = f"(list_sum(list_transform(list_filter(p, lambda x: x.lane = l), lambda x: x.v)) % {SPARSE_MOD})::BIGINT"
    sparse = f"list_filter(list_transform(list_sort(list_distinct(list_transform(p, lambda x: x.lane))), lambda l: l * {SPARSE_MOD} + {total}), lambda c: c % {SPARSE_MOD} <> 0)"
    wide = f"list_transform(list_transform(string_split({text}, chr(10)), lambda p: sha256(p)), lambda d: {_WIDE})"
    dense = f"list_transform([{wide}], lambda ws: list_transform(range({DENSE}), lambda i: (list_sum(list_transform(ws, lambda w: ('0x' || w[i * {DIGITS} + 1:i * {DIGITS} + {DIGITS}])::BIGINT)) % {MOD})::BIGINT))[1]"
    return f"list_transform([{picked}], lambda p: {{dense: {dense}, units: len(list_filter(p, lambda x: x.lane < {SPARSE}))::BIGINT, sparse: {sparse}}})[1]"


def _written_sql(v: str) -> str:
    digits = lambda a, n: f"array_to_string(list_transform({a}, lambda x: lpad(lower(to_hex(x)), {n}, '0')), '')"
    return f"{digits(f'{v}.dense', DIGITS)} || '.' || lower(to_hex({v}.units)) || '.' || {digits(f'{v}.sparse', 7)}"


def _near_sql(a: str, b: str) -> str:
    level = _LEVEL.format(a, b)
    at = lambda v: f"list_filter({v}.sparse, lambda c: c // {SPARSE_MOD * SPARSE} = {level})"
    places = lambda v: f"list_transform({at(v)}, lambda c: c // {SPARSE_MOD})"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE ELSE len(list_intersect({at(a)}, {at(b)}))::DOUBLE / greatest(len(list_distinct(list_concat({places(a)}, {places(b)}))), 1) END"


ORACLE = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT *, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text FROM d
  WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
), e AS (
  SELECT *, substring(text, 1, length(text) - length(text) // 2) || substring(next_text, 1, length(text) // 2) AS edited FROM n
), v AS (
  SELECT *, {_lanes_sql('text')} AS v, {_lanes_sql('edited')} AS ev, {_lanes_sql('next_text')} AS nv FROM e
)
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(edited) AS edited_sha256, {_written_sql('v')} AS fingerprint,
  {_written_sql('ev')} AS edited_fingerprint, {_near_sql('v', 'ev')} AS near_edited, {_near_sql('v', 'nv')} AS near_next
FROM v
"""
