"""Exact nearest neighbours of a set of query vectors among all vectors, in blocks.

Vectors are packed where they lie into blocks of one size and scope; every block of queries meets
every block of vectors of its size and scope once, as a matrix product that leaves the k best of the
block for each query. Those few are then ranked for each query. Queries are broadcast only if they
are known to be few; otherwise blocks are joined by size, scope and a share of the scope: a scope of
many vectors is dealt out over as many shares as it needs, and its queries go to each of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.sources.tables import is_small, small_side

BLOCK = 4096
#: Queries that may be broadcast (their vectors take some MB).
FEW = 10_000
#: Vectors of a scope that one share takes, where queries are many.
SHARE = 1 << 18


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, scope, vector) to blocks of unit vectors of one size and scope; null or zero vectors are left out."""
    for batch in batches:
        out = []
        sizes = batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ids, scopes = (batch.column(i).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
        order = np.lexsort((scopes, sizes))
        order = order[sizes[order] > 0]
        apart = np.flatnonzero((np.diff(sizes[order]) != 0) | (np.diff(scopes[order]) != 0)) + 1
        for group in np.split(order, apart):
            for at in range(0, len(group), BLOCK):
                rows = group[at : at + BLOCK]
                x = np.array(batch.column(2).take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), -1)
                length = np.sqrt((x**2).sum(axis=1))
                good = np.isfinite(length) & (length > 0)
                if good.any():
                    out.append((int(sizes[rows[0]]), int(scopes[rows[0]]), ids[rows[good]].tobytes(), (x[good] / length[good, None]).tobytes()))
        if out:
            dims, of, packed, matrices = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(of, pa.int64()), pa.array(packed, pa.binary()), pa.array(matrices, pa.binary())], ["dim", "scope", "ids", "matrix"])


_BLOCK = "dim int, scope bigint, ids binary, matrix binary"
_HIT = "query_id bigint, id bigint, similarity double"


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("q_ids", "ids", "q_matrix", "matrix")]
            for n in range(batch.num_rows):
                q_ids, ids, q, x = (np.frombuffer(c[n].as_py(), t) for c, t in zip(columns, (np.int64, np.int64, float, float), strict=True))
                q, x = q.reshape(len(q_ids), -1), x.reshape(len(ids), -1)
                for at in range(0, len(q), 512):
                    similarity = q[at : at + 512] @ x.T
                    # the k-th best and all that are as good: ties are settled by id later
                    kth = np.sort(np.partition(similarity, max(0, len(ids) - k), axis=1)[:, max(0, len(ids) - k) :], axis=1)[:, 0]
                    i, j = np.nonzero(similarity >= kth[:, None] - 1e-9)
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[at + i]), pa.array(ids[j]), pa.array(similarity[i, j])], ["query_id", "id", "similarity"])

    return run


def _met(blocks: DataFrame, asked: DataFrame, vectors: DataFrame, scope: Column | None) -> DataFrame:
    """Blocks with the queries' blocks of their size and scope, where neither side is small.

    Shares are counted for scopes of more than SHARE vectors only, so their table has a row for SHARE vectors at most.
    """
    shares = F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")
    if scope is None:
        count = vectors.agg(shares).collect()[0][0]
        counted = lambda rows: rows.withColumn("shares", F.lit(max(1, count)))
    else:
        large = small_side(vectors.groupBy(F.coalesce(scope, F.lit(-(2**63))).alias("scope")).agg(shares).filter("shares > 1"))
        counted = lambda rows: rows.join(large, "scope", "left").fillna(1, ["shares"])
    dealt = counted(blocks).withColumn("share", F.pmod(F.xxhash64("ids"), F.col("shares")).cast("int")).drop("shares")
    each = counted(asked).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    return dealt.join(each, ["dim", "scope", "share"])


def nearest(vectors: DataFrame, queries: DataFrame, k: int, scope: str | None = None) -> DataFrame:
    """query_id, id, similarity and pos (1 to k), by falling cosine and rising id.

    vectors and queries have id and vector; with a scope, a column of both, a query only sees
    vectors whose scope is the same (null is a scope, too). A query finds at most k; one without a
    vector, or with one of zeros or infinite numbers, finds none, and such vectors aren't found.
    """
    mark = F.col(scope).cast("bigint") if scope else F.lit(0).cast("bigint")
    pack = lambda df: df.select(F.col("id").cast("bigint"), mark.alias("scope"), "vector").mapInArrow(_blocks, _BLOCK)
    asked = pack(queries).withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
    if is_small(queries, FEW):
        met = pack(vectors).join(F.broadcast(asked), ["dim", "scope"])
    else:
        met = _met(pack(vectors), asked, vectors, mark if scope else None)
    hits = met.select("q_ids", "ids", "q_matrix", "matrix").mapInArrow(_best(k), _HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)
