"""Op 5: near copies among embeddings by cross-polytope hashing with multiprobe.

Equal vectors of a label are one class with a count. A class is hashed in TABLES tables: the vector
is rotated by three rounds of random signs and fast Hadamard transforms, and its code is the axis,
with sign, that it comes closest to; k rotations make a code. Besides its own bucket a class looks
into the buckets where one rotation's axis is the second closest. Pairs that meet are verified by
their cosine in double precision. k grows with the logarithm of the number of classes.

A bucket with more classes than BLOCK is split into blocks by a hash; each pair of blocks is a
group of its own, so no task holds a large bucket and no pair is left out. Groups give the counts
of links, each pair counted in the first bucket where it meets only, and edges that span their
connected members; pairs are never written out.

Vectors that are null, empty or zero, or hold a null or non-finite component, rows with a null label
and rows with a null vec_id link with nothing (the component is vec_id; kept is true). Vectors of
unequal length don't link. Repeated rows are copies of each other. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table
from .graph import components

COSINE = 0.93
TABLES = 8
MORE_TABLES = 6
BLOCK = 1000
#: Classes that a bucket has on average, from which the number of rotations a code follows.
AVERAGE = 64
SEED = 11


def rotations(n: int, dim: int, seed: int = SEED) -> np.ndarray:
    """Signs of n random rotations of three rounds each."""
    return np.random.default_rng([seed, dim]).choice([-1.0, 1.0], size=(n, 3, dim))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / math.sqrt(n)


def codes(x: np.ndarray, tables: int, k: int, seed: int = SEED) -> np.ndarray:
    """[row, table, 1 + k] codes: its own, then those with one axis replaced by the second closest."""
    dim = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), dim))
    padded[:, : x.shape[1]] = x
    signs = rotations(tables * k, dim, seed)
    best = np.zeros((len(x), tables, k, 2), np.int64)
    for r in range(tables * k):
        y = padded
        for s in signs[r]:
            y = hadamard(y * s)
        two = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
        size = np.take_along_axis(np.abs(y), two, 1)
        two = np.where((size[:, :1] >= size[:, 1:]), two, two[:, ::-1])
        best[:, r // k, r % k] = 2 * two + (np.take_along_axis(y, two, 1) < 0)
    weight = (2 * dim) ** np.arange(k)
    own = (best[..., 0] * weight).sum(2)
    out = np.repeat(own[:, :, None], 1 + k, axis=2)
    for j in range(k):
        out[:, :, 1 + j] += (best[:, :, j, 1] - best[:, :, j, 0]) * weight[j]
    return out


_BUCKETS = "rep bigint, label bigint, dim int, copies bigint, vector binary, codes binary, bucket int, code bigint, own boolean"


def _bucketed(tables: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "label", "dim", "copies", "vector", "codes", "bucket", "code", "own"]
        for batch in batches:
            rep, label, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            lists = batch.column(3)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                x = np.array(lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), dim)
                for at in range(0, len(rows), 500):
                    some, part = rows[at : at + 500], x[at : at + 500]
                    scaled = part / np.abs(part).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
                    unit = scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))
                    code = codes(unit, tables, k)
                    n, each = len(some), tables * (1 + k)
                    pick = np.repeat(np.arange(n), each)
                    vectors, all_codes = [v.tobytes() for v in unit], [c.tobytes() for c in code]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(rep[some][pick]), pa.array(label[some][pick].astype(np.int64)), pa.array(np.full(n * each, dim, np.int32)), pa.array(copies[some][pick]),
                        pa.array([vectors[i] for i in pick], pa.binary()), pa.array([all_codes[i] for i in pick], pa.binary()),
                        pa.array(np.tile(np.repeat(np.arange(tables, dtype=np.int32), 1 + k), n)), pa.array(code.reshape(-1)), pa.array(np.tile(np.arange(1 + k) == 0, n * tables)),
                    ], names)

    return run


def _first_meeting(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of codes [pair, table, 1 + k]: the first table in which a pair meets, and the least code there."""
    meets = np.concatenate([a[:, :, :1] == b, (b[:, :, :1] == a)[:, :, 1:]], axis=2)
    code = np.concatenate([b, a[:, :, 1:]], axis=2)
    first = meets.any(axis=2).argmax(axis=1)
    pair = np.arange(len(a))
    return first, np.where(meets[pair, first], code[pair, first], np.iinfo(np.int64).max).min(axis=1)


_LINKS = "a bigint, b bigint, links bigint"


def _linked(tables: int, k: int, cosine: float):
    """For sorted rows of groups: (rep, null, links counted here) and spanning edges (a, b, null)."""

    def of(group: list[tuple]) -> pa.RecordBatch | None:
        # (rep, copies, vector, codes, bucket, code, own, side)
        side = np.array([g[7] for g in group])
        if len(group) < 2:
            return None
        rep, copies = np.array([g[0] for g in group]), np.array([g[1] for g in group])
        x = np.frombuffer(b"".join(g[2] for g in group)).reshape(len(group), -1)
        code = np.frombuffer(b"".join(g[3] for g in group), np.int64).reshape(len(group), tables, 1 + k)
        own = np.array([g[6] for g in group])
        near = (x @ x.T >= cosine) & (own[:, None] | own[None, :]) & (rep[:, None] != rep[None, :])
        if side.any():
            near &= side[:, None] != side[None, :]
        i, j = np.nonzero(np.triu(near, 1))
        if not len(i):
            return None
        counts = np.zeros(len(group), np.int64)
        for at in range(0, len(i), 100_000):
            p, q = i[at : at + 100_000], j[at : at + 100_000]
            first, least = _first_meeting(code[p], code[q])
            here = (first == group[0][4]) & (least == group[0][5])
            np.add.at(counts, p[here], copies[q[here]])
            np.add.at(counts, q[here], copies[p[here]])
        component = np.arange(len(group))
        while True:
            lower = np.minimum(component, np.where(near, component[None, :], len(group)).min(axis=1))
            lower = lower[lower]
            if (lower == component).all():
                break
            component = lower
        some, edge = np.flatnonzero(counts), np.flatnonzero(component != np.arange(len(group)))
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([rep[some], rep[edge]]), pa.int64()), pa.array([*[None] * len(some), *rep[component[edge]].tolist()], pa.int64()),
            pa.array([*counts[some].tolist(), *[None] * len(edge)], pa.int64()),
        ], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if row[:6] != key:
                    if (out := of(group)) is not None:
                        yield out
                    key, group = row[:6], []
                rep, copies, vector, code, own, side = row[6:]
                group.append((rep, copies, vector, code, row[2], row[3], own, side))
        if (out := of(group)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE, tables: int = TABLES) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda c: c != 0), F.lit(False))
    hashed = v.withColumn("valid", valid).withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.reverse("embedding"))})
    classes = checkpointed(hashed.filter("valid").groupBy("label", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("embedding").alias("embedding")))
    most = classes.groupBy("label").count().agg(F.max("count")).collect()[0][0] or 0
    dim = classes.agg(F.max(F.size("embedding"))).collect()[0][0] or 1
    k = max(1, math.ceil(math.log(max(1.0, most / AVERAGE)) / math.log(2 << max(1, (dim - 1).bit_length()))))
    tables += MORE_TABLES * (k - 1)

    rows = classes.select("rep", "label", "copies", "embedding").mapInArrow(_bucketed(tables, k), _BUCKETS)
    bucket = ["label", "dim", "bucket", "code"]
    # buckets that are split; a class is in a bucket once, so blocks need only its number
    large = checkpointed(rows.select(*bucket).groupBy(*bucket).count().filter(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count"))
    split = rows.join(F.broadcast(large) if large.count() < 10_000 else large, bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = split.withColumn("mine", block).withColumn("other", other).withColumns({"b1": F.least("mine", "other"), "b2": F.greatest("mine", "other"), "side": F.col("mine") > F.col("other")})
    key = [*bucket, "b1", "b2"]
    dealt = dealt.select(*key, "rep", "copies", "vector", "codes", "own", "side").repartition(*key).sortWithinPartitions(*key, "rep")
    found = checkpointed(dealt.mapInArrow(_linked(tables, k, cosine), _LINKS))

    joined = components(found.filter("b is not null").select("a", "b"))
    links = found.filter("links is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    label = (
        classes.select("label", "h1", "h2", "rep", "copies").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component_id"))
    )
    own = ["label", "h1", "h2"]
    good = hashed.filter("valid").select("vec_id", *own).join(label, own).select("vec_id", F.col("links").cast("bigint").alias("n_links"), "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
    rest = hashed.filter("not valid").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    return good.unionByName(rest)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
), good AS (
  SELECT vec_id, label, list_transform(x, lambda c: c / sqrt(list_sum(list_transform(x, lambda d: d * d)))) AS u FROM v
  WHERE label IS NOT NULL AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.u) = len(b.u)
  WHERE list_dot_product(a.u, b.u) >= {COSINE}
), r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a)
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT v.vec_id, (SELECT count(*) FROM e WHERE e.a = v.vec_id)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN r ON r.x = v.vec_id
"""
