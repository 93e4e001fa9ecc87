"""Op 12: vectors as short codes, by weighted Lloyd rounds over distinct integer parts.

Each component x becomes the integer floor(256 * x), and a vector PARTS consecutive parts of equal
length. Equal parts of a position are one row with a weight, so a round assigns each distinct part once,
however many vectors have it. Workers sum up weights and integers by entry before a shuffle, so a round
shuffles some rows a task. Codes and errors are at last joined back to the vectors by position and part;
parts that a share of all vectors have are few by that very share, and are broadcast instead. All sums
are of integers and exact, so results do not depend on how rows are dealt.

A codebook starts as the parts of the ENTRIES least ids (rows without an id last). Distances are
squared Euclidean ones, ties go to the lower index; an entry becomes floor(sum / count) of its parts,
by component, and stays where it has none. Codebooks of equal entries, and less than ENTRIES vectors, are allowed.

Left out are vectors that are null or empty, hold nulls or numbers that are not finite, or have
another length than the vector of the least id. A length that PARTS does not divide is filled up with zeros. Integers
are cut to 2 ** 26 either way, so no sum overflows: components beyond 262,144 count as that. Repeated rows come as
often as they are, each with its code; a null label is a label. An empty table gives no rows. Only vec_id,
embedding and label are read, other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table, unused

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Largest integer of a component.
MOST = 1 << 26
#: A part or label is broadcast to the rows that have it where at least one row in so many does.
SHARE = 1000
#: Distinct parts compared with a codebook at a time.
BLOCK = 4096


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))).cast("int"))


def is_whole(vector: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(finite(x.cast("double")), F.lit(False)))


def kept(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """vec_id, label, whole (integers of a vector, filled up) and copies, a row for equal rows; and the length of a part."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("v")).filter(is_whole(F.col("v")))
    first = rows.select(F.col("vec_id"), F.size("v").alias("n"), "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").select("n").take(1)
    size = first[0]["n"] if first else parts
    width = -(-size // parts)
    whole = F.concat(integers(F.col("v")), F.array_repeat(F.lit(0), parts * width - size))
    rows = rows.filter(F.size("v") == size).select("vec_id", "label", whole.alias("whole"))
    return rows.groupBy("vec_id", "label", "whole").agg(F.count(F.lit(1)).alias("copies")), width


def exploded(rows: DataFrame, width: int, parts: int, *columns: str) -> DataFrame:
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.slice("whole", i * width + 1, width))
    return rows.select(*columns, F.posexplode(cut).alias("position", "part"))


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Position, row numbers and parts of some rows (position, part, ...) of one position."""
    position = batch.column(0).to_numpy(zero_copy_only=False)
    part = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    for p in np.unique(position).tolist():
        own = np.flatnonzero(position == p)
        for at in range(0, len(own), BLOCK):
            yield p, own[at : at + BLOCK], part[own[at : at + BLOCK]]


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lowest of several, and the squared distance to it."""
    distance = np.zeros((len(part), len(book)), np.int64)
    for k in range(part.shape[1]):
        difference = part[:, k, None] - book[:, k]
        distance += difference * difference
    index = distance.argmin(axis=1)
    return index, distance[np.arange(len(part)), index]


def _summed(books: np.ndarray):
    """Rows (position, entry, count, sums) of a task's distinct parts (position, part, weight)."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sums = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            weight = batch.column(2).to_numpy(zero_copy_only=False)
            for p, own, part in _blocks(batch, width):
                index, _ = nearest(part, books[p])
                np.add.at(count[p], index, weight[own])
                np.add.at(sums[p], index, weight[own, None] * part)
        p, e = np.nonzero(count)
        if len(p):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * width, pa.int32()), pa.array(sums[p, e].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), lists], ["position", "entry", "n", "sums"])

    return run


def train(distinct: DataFrame, books: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (position, entry, component) after some rounds over rows (position, part, weight).

    What comes to the driver is a row an entry: PARTS times ENTRIES.
    """
    width = books.shape[2]
    for _ in range(rounds):
        found = distinct.mapInArrow(_summed(books), "position int, entry int, n bigint, sums array<bigint>")
        totals = found.groupBy("position", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k]) for k in range(width)]).alias("sums"))
        books = books.copy()
        for r in totals.collect():
            books[r["position"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """position, part and weight with code and error."""
    width = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, own, part in _blocks(batch, width):
                code[own], error[own] = nearest(part, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], ["position", "part", "weight", "code", "error"])

    return distinct.mapInArrow(run, "position int, part array<int>, weight bigint, code int, error bigint")


def joined_back(rows: DataFrame, found: DataFrame, keys: list[str], weight: str, total: int, share: int = SHARE) -> DataFrame:
    """Each row with what was found for its keys. Keys that one row in ``share`` has are at most ``share`` a position
    and are broadcast, so no task gets all rows of such a key; the others are joined by key. Nulls are equal."""
    hot = found.filter(F.col(weight) * share > total).drop(weight)
    others = [c for c in found.columns if c not in (*keys, weight)]
    at = unused(rows, "of_hot")
    side = hot.select(*[F.col(k).alias(f"{k}_hot") for k in keys], F.struct(F.lit(1).alias("is_hot"), *others).alias(at))
    same = lambda suffix: [F.col(k).eqNullSafe(F.col(f"{k}{suffix}")) for k in keys]
    rows = rows.join(F.broadcast(side), same("_hot"), "left").drop(*[f"{k}_hot" for k in keys])
    rest = found.filter(F.col(weight) * share <= total).select(*[F.col(k).alias(f"{k}_rest") for k in keys], *others)
    few = rows.filter(F.col(at).isNotNull()).select(*[c for c in rows.columns if c != at], *[F.col(at)[c].alias(c) for c in others])
    many = rows.filter(F.col(at).isNull()).drop(at).join(rest, same("_rest")).drop(*[f"{k}_rest" for k in keys])
    return few.unionByName(many)


def encode_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, codes (one of a codebook by position), error; and the codebooks (position, entry, component)."""
    rows, width = kept(vectors, parts)
    rows = checkpointed(rows)
    seeds = rows.select("vec_id", "whole", "copies").orderBy(F.col("vec_id").asc_nulls_last(), "whole").take(entries)
    first = [r["whole"] for r in seeds for _ in range(min(r["copies"], entries))][:entries]
    books = np.array(first, np.int64).reshape(len(first), parts, width).swapaxes(0, 1)
    distinct = exploded(rows, width, parts, "copies").groupBy("position", "part").agg(F.sum("copies").alias("weight"))
    if not first:
        empty = rows.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("bigint").alias("error"))
        return empty, books
    distinct = checkpointed(distinct)
    books = train(distinct, books, rounds)
    found = checkpointed(coded(distinct, books))
    total = rows.agg(F.sum("copies")).collect()[0][0]
    at = exploded(rows, width, parts, "vec_id", "label", F.xxhash64("whole").alias("mark"), "copies")
    back = joined_back(at, found, ["position", "part"], "weight", total)
    # different vectors of one id are told apart by two hashes; equal rows are one with their number
    code = F.transform(F.array_sort(F.collect_list(F.struct("position", "code"))), lambda c: c["code"])
    whole = back.groupBy("vec_id", "label", "mark", "copies").agg(code.alias("codes"), F.sum("error").alias("error"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))
    return whole.select("vec_id", "label", "codes", "error", each.alias("copy")).drop("copy"), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = encode_vectors(table(spark, sf_dir, "embeddings"))
    rows = checkpointed(rows)
    labels = rows.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n"))
    total = rows.count()
    code = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = joined_back(rows, checkpointed(labels), ["label"], "n", total)
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _assigned_sql(name: str, books: str) -> str:
    """Every part's nearest entry: a row (vec_id, label, p, part, i, err)."""
    return f"""{name} AS (
  SELECT vec_id, label, p, part, best.i AS i, best.err AS err FROM (
    SELECT x.vec_id, x.label, x.p, x.part, min({{err: list_sum(list_transform(list_zip(x.part, b.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, i: b.i}}) AS best
    FROM x JOIN {books} b ON x.p = b.p GROUP BY x.vec_id, x.label, x.p, x.part))"""


def _moved_sql(name: str, assigned: str, books: str) -> str:
    """The entries after a round over the assigned parts."""
    return f"""{name} AS (
  SELECT b.p, b.i, coalesce(m.entry, b.entry) AS entry FROM {books} b LEFT JOIN (
    SELECT p, i, list(v ORDER BY k) AS entry FROM (
      SELECT p, i, k, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS v
      FROM (SELECT p, i, unnest(part) AS c, generate_subscripts(part, 1) AS k FROM {assigned}) GROUP BY p, i, k) GROUP BY p, i) m USING (p, i))"""


ORACLE = f"""
WITH q AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS (
  SELECT vec_id, label, p, v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})] AS part FROM q, range({PARTS}) t(p)
), b0 AS (
  SELECT p, (row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1)::BIGINT AS i, part AS entry FROM x
  WHERE vec_id IN (SELECT vec_id FROM q ORDER BY vec_id LIMIT {ENTRIES})
), {_assigned_sql('a0', 'b0')}, {_moved_sql('b1', 'a0', 'b0')}, {_assigned_sql('a1', 'b1')}, {_moved_sql('b2', 'a1', 'b1')}, {_assigned_sql('a2', 'b2')}
, r AS (
  SELECT vec_id, label, string_agg(lpad(lower(to_hex(i)), 2, '0'), '' ORDER BY p) AS code, sum(err)::BIGINT AS error FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, i)) FROM b2) AS codebooks_sha256
FROM r
"""
