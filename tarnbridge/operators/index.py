"""An inverted-file index over vectors: lists around centres, of which a search looks into the nearest few.

The centres are fitted on a bounded sample; every vector is put into the list of its nearest centre.
A search compares a query with the vectors of its nearest lists only, so it can miss neighbours in
others: recall rises with the lists that are probed, and all of them give the exact answer.

Beside it there are product-quantised codes: a vector as a byte a part. A search then compares codes,
and reads the vectors of its last candidates only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.functions.vectors import cosine
from tarnbridge.operators import nearest as N

#: Vectors that the centres are fitted on at most, and rounds of fitting.
SAMPLE = 20_000
ROUNDS = 12
#: Parts of a vector's code, a byte each, and entries of a part's codebook.
PARTS, ENTRIES = 16, 256
#: Tasks that the vectors of a list are coded in.
SALTS = 16
#: Candidates that a task holds before it leaves out those beyond a query's best.
HITS = 1 << 20


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit(vectors: DataFrame, lists: int, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Centres [list, dim] by spherical k-means on the sample that a hash of id picks.

    vectors has id and vector; null, empty and zero vectors, and those of another length than most, aren't used.
    """
    rows = vectors.filter(F.exists("vector", lambda v: v != 0)).select(F.col("vector").cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), "id").alias("h"))
    x = _sampled(vectors, sample, seed)
    if not len(x):
        return np.zeros((1, 1))
    random = np.random.default_rng(seed)
    centres = x[random.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        empty = ~sums.any(axis=1)
        sums[empty] = x[random.choice(len(x), int(empty.sum()))]
        centres = _unit(sums)
    return centres


def _sampled(vectors: DataFrame, sample: int, seed: int) -> np.ndarray:
    """Unit vectors that a hash of id picks, of the most frequent length; so many come to the driver, by Arrow."""
    rows = vectors.filter(F.exists("vector", lambda v: v != 0)).select(F.col("vector").cast("array<double>").alias("v"), F.xxhash64(F.lit(seed), "id").alias("h"))
    picked = rows.orderBy("h").limit(sample).select("v").toArrow().column("v").combine_chunks()
    sizes = picked.value_lengths().to_numpy(zero_copy_only=False)
    if not len(sizes):
        return np.zeros((0, 1))
    usual = np.bincount(sizes).argmax()
    x = np.array(picked.filter(pa.array(sizes == usual)).flatten().to_numpy(zero_copy_only=False), float).reshape(-1, usual)
    return _unit(x[np.isfinite(x).all(axis=1)])


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, sample: int = SAMPLE, seed: int = 1) -> np.ndarray:
    """Codebooks [part, entry, number] of the parts of unit vectors, by k-means on a sample; a part is filled up with zeros."""
    x = _cut(_sampled(vectors, sample, seed), parts)
    random = np.random.default_rng(seed)
    books = np.zeros((parts, min(entries, max(1, len(x))), x.shape[2]))
    for p in range(parts if len(x) else 0):
        own = np.ascontiguousarray(x[:, p])
        book = own[random.choice(len(own), books.shape[1], replace=False)]
        for _ in range(ROUNDS):
            near = _nearest_entry(own, book)
            sums, count = np.zeros_like(book), np.bincount(near, minlength=len(book))
            np.add.at(sums, near, own)
            book = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], own[random.choice(len(own), len(book))])
        books[p] = book
    return books


def _cut(x: np.ndarray, parts: int) -> np.ndarray:
    """Vectors as [row, part, number]."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width)


def _nearest_entry(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * (x @ book.T)).argmin(axis=1)


_CODES = "list int, ids binary, codes binary"


def coded(lists: DataFrame, books: np.ndarray) -> DataFrame:
    """list, ids and codes: blocks of up to BLOCK vectors of a list, each a byte a part; lists as assigned() leaves them.

    A block is a row, so a list of any size goes over several tasks and a search reads codes, not vectors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _cut(_unit(np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)), len(books))
            code = np.stack([_nearest_entry(x[:, p], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)
            of, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(of, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(of[order])) + 1).tolist(), len(of)]
            groups = [order[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(of[g[0]]) for g in groups], pa.int32()), pa.array([ids[g].astype("<i8").tobytes() for g in groups], pa.binary()), pa.array([code[g].tobytes() for g in groups], pa.binary())], ["list", "ids", "codes"]
            )

    spread = lists.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    return spread.repartition("list", "_part").sortWithinPartitions("list", "_part").select("list", "id", "vector").mapInArrow(run, _CODES)


def write_codes(vectors: DataFrame, centres: np.ndarray, books: np.ndarray, path: str) -> None:
    """The index as two tables: codes, and vectors to rank the last candidates by, both with the lists as folders."""
    write(vectors, centres, f"{path}/vectors")
    coded(assigned(vectors, centres), books).write.mode("overwrite").partitionBy("list").parquet(f"{path}/codes")


def search_codes(codes: DataFrame, lists: DataFrame, queries: DataFrame, centres: np.ndarray, books: np.ndarray, k: int, probes: int, candidates: int) -> DataFrame:
    """query_id, id, similarity and pos (1 to k), as search() has them.

    For each query a table of products with all entries of the codebooks gives the approximate cosine of a code
    as a sum of a number a part. The tables are made where a block of queries meets a block of codes, so that
    only the queries' vectors are joined. The best so many candidates of the probed lists are then ranked by their
    vectors, which are looked up by list and id. With as many candidates as vectors, and all lists, the answer is exact.
    """
    asked = assigned(queries, centres, probes).mapInArrow(_query_blocks, _QUERIES)

    def best(hits: list[tuple]) -> list[np.ndarray]:
        """list, query_id, id and about of the best candidates of each query so far."""
        of, query, ids, about = (np.concatenate(x) for x in zip(*hits, strict=True))
        order = np.lexsort((ids, -about, query))
        start = np.flatnonzero(np.diff(query[order], prepend=query[order[:1]] - 1))
        rank = np.arange(len(order)) - np.repeat(start, np.diff(start, append=len(order)))
        return [x[order[rank < candidates]] for x in (of, query, ids, about)]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, count = [], 0
        told = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["list", "query_id", "id", "about"])
        for batch in batches:
            for n in range(batch.num_rows):
                of, ids, codes_, q_ids, matrix = (batch.column(i)[n].as_py() for i in range(5))
                ids, code, q_ids = np.frombuffer(ids, "<i8"), np.frombuffer(codes_, np.uint8).reshape(-1, len(books)), np.frombuffer(q_ids, "<i8")
                tables = np.einsum("rpw,pew->rpe", _cut(_unit(np.frombuffer(matrix, "<f8").reshape(len(q_ids), -1)), len(books)), books).astype("<f4")
                score = np.zeros((len(q_ids), len(ids)), np.float32)
                for p in range(len(books)):
                    score += tables[:, p][:, code[:, p]]
                some = np.argpartition(-score, candidates - 1, axis=1)[:, :candidates] if len(ids) > candidates else np.tile(np.arange(len(ids)), (len(q_ids), 1))
                hits.append((np.full(some.size, of, np.int32), np.repeat(q_ids, some.shape[1]), ids[some].reshape(-1), np.take_along_axis(score, some, axis=1).reshape(-1)))
                count += some.size
                if count > HITS:
                    hits = [best(hits)]
                    count = len(hits[0][0])
                    if count > HITS // 2:
                        yield told(hits[0])
                        hits, count = [], 0
        if count:
            yield told(best(hits))

    met = codes.select("list", "ids", "codes").join(asked, F.col("list") == F.col("q_list")).select("list", "ids", "codes", "q_ids", "q_matrix")
    about = met.mapInArrow(scored, "list int, query_id bigint, id bigint, about float")
    nearest_codes = Window.partitionBy("query_id").orderBy(F.desc("about"), "id")
    few = about.withColumn("n", F.row_number().over(nearest_codes)).filter(F.col("n") <= candidates).select("list", "query_id", "id")
    of_query = queries.select(F.col("id").cast("bigint").alias("query_id"), F.col("vector").alias("q"))
    ranked = few.join(lists.select("list", "id", F.col("vector").alias("v")), ["list", "id"]).join(of_query, "query_id").select("query_id", "id", cosine(F.col("q"), F.col("v")).alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return ranked.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


_QUERIES = "q_list int, q_ids binary, q_matrix binary"


def _query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (list, id, vector) to blocks of one list."""
    for batch in batches:
        of, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = np.array(batch.column(2).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1)
        groups = [np.flatnonzero(of == n) for n in np.unique(of)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([of[g[0]] for g in groups], pa.int32()), pa.array([ids[g].astype("<i8").tobytes() for g in groups], pa.binary()), pa.array([x[g].astype("<f8").tobytes() for g in groups], pa.binary())], ["q_list", "q_ids", "q_matrix"]
        )


def assigned(vectors: DataFrame, centres: np.ndarray, probes: int = 1) -> DataFrame:
    """A row (list, id, vector) for each of the nearest lists of a vector; those without a direction have none.

    The centres go to the executors: as many numbers as lists times dimensions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(sizes == centres.shape[1])
            part = batch.take(pa.array(rows))
            x = np.array(part.column(1).flatten().to_numpy(zero_copy_only=False), float).reshape(len(rows), centres.shape[1])
            good = np.isfinite(x).all(axis=1) & x.any(axis=1)
            part, x = part.filter(pa.array(good)), x[good]
            most = min(probes, len(centres))
            near = np.argpartition(-(x @ centres.T), most - 1, axis=1)[:, :most] if len(x) else np.zeros((0, most), int)
            out = part.take(pa.array(np.repeat(np.arange(len(x)), most)))
            yield pa.RecordBatch.from_arrays([pa.array(near.reshape(-1).astype(np.int32)), *out.columns], ["list", "id", "vector"])

    return vectors.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInArrow(run, "list int, id bigint, vector array<double>")


def write(vectors: DataFrame, centres: np.ndarray, path: str, files: int = 8) -> None:
    """The index as a table whose folders are the lists, so that a search reads those that it probes; a list's rows are dealt to some files."""
    assigned(vectors, centres).repartition("list", F.pmod(F.xxhash64("id"), F.lit(files))).write.mode("overwrite").partitionBy("list").parquet(path)


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int, probes: int) -> DataFrame:
    """query_id, id, similarity and pos (1 to k): the nearest that the probed lists have, ties by id.

    index has list, id and vector, as assigned() or write() leave it. Each list's vectors are packed
    into blocks, a large list's into several, and joined by list with the queries that probe it.
    """
    def packed(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / N.BLOCK).cast("int").alias("parts"))
        salted = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))  # a row a list
        return salted.repartition("list", "part").sortWithinPartitions("list", "part").select("list", "part", "id", "vector").mapInArrow(_list_blocks, f"list int, {N._BLOCK}")

    asked = packed(assigned(queries, centres, probes))
    asked = asked.withColumnsRenamed({"ids": "q_ids", "matrix": "q_matrix"})
    met = packed(index).join(asked, ["list", "dim", "scope"])
    hits = met.select("q_ids", "ids", "q_matrix", "matrix").mapInArrow(N._best(k), N._HIT)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("similarity", 9)), "id")
    return hits.withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= k)


def _list_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by list and part to blocks of unit vectors, BLOCK rows at most, of one part each."""

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(rows).combine_chunks()
        lists = whole.column("vector").combine_chunks()
        x = _unit(np.array(lists.flatten().to_numpy(zero_copy_only=False), float).reshape(len(whole), -1))
        ids = whole.column("id").to_numpy().astype(np.int64)
        return pa.RecordBatch.from_arrays([
            pa.array([whole.column("list")[0].as_py()], pa.int32()), pa.array([x.shape[1]], pa.int32()), pa.array([0], pa.int64()), pa.array([ids.tobytes()]), pa.array([x.tobytes()]),
        ], ["list", "dim", "scope", "ids", "matrix"])

    held, key, count = [], None, 0
    for batch in batches:
        group = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
        cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if held and (tuple(group[:, a]) != key or count + b - a > N.BLOCK):
                yield block(held)
                held, count = [], 0
            key = tuple(group[:, a])
            held.append(batch.slice(a, b - a))
            count += b - a
    if held:
        yield block(held)
