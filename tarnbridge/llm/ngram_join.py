"""Op 4: exact Jaccard join of word-shingle sets with PartEnum signatures.

Sets are put into size bands whose ends are in the ratio of the threshold, so two similar sets lie
in one band or in bands next to each other, and a set takes part in its own band's instance and in
the next one's. In an instance similar sets differ in at most k shingles. The hashed domain of
shingles is cut into more than k / 2 partitions of three thirds, so similar sets differ in at most
one shingle in some partition and agree on two of its thirds: a set has a signature for each
partition and pair of thirds, the hash of its shingles there.

Thirds empty in both sets would match without saying anything. In a partition where two thirds of
a set have shingles, any pair of thirds says something; a set with more than k / 2 such partitions
shares a signature that is not empty with every similar set. So empty pairs of thirds count only
where both sets lack that: only such sets, a few, have signatures for them. Hence no link is lost,
at any size of set.

Rows with one set of shingles are one class. Classes with a common signature are first linked
along the sorted members of the signature, linked pairs are verified against the whole sets, and
only classes that are not connected yet are then compared with each other, all of them. Of the
pairs that parities can't tell apart the workers give back a spanning forest. Its trees hold all
such pairs; within a tree whole sets are compared, and again a spanning forest of the links comes
back. The classes of a group of copies are thus never expanded into pairs, and rows are as many as
classes in signatures at most, not as pairs.

Empty and null texts, or texts without words, have no shingles and link with nothing. Rows that
repeat a doc_id count as copies where the sets are equal and as documents of their own where they
are not: a class goes by its least doc_id and its set's hash. A row with a null doc_id links with
nothing and has a null component. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.sources.tables import spread

from .common import checkpointed, forget, release, table, unused, written
from .graph import components
from .shingles import WORDS, chunks, mix, shingle_sets

#: Sets link when PERCENT of their union is common to both.
PERCENT = 80
#: Documents a bucket of signatures; signatures held by a task before they are sent.
BUCKET_DOCS = 2000
HELD = 1_000_000
#: Bits of a bucket's number at most: a signature has 64, of which 40 are kept beside it.
MOST_BITS = 24
#: Words of 64 bits in the filters of candidate documents (1 MB, whatever the input).
FILTER_WORDS = 1 << 17
#: Parity words of a set at least.
PARITY = 8
#: Members of a run that a worker holds while the others stream past, and shingles of such members; pairs compared at a time.
BLOCK = 4096
BLOCK_SHINGLES = 1 << 22
PAIRS = 1 << 18
#: Runs of a class, the first by name, that go with it, so that few pairs are told in several runs.
FIRST_RUNS = 32

_U = np.uint64


def bands(largest: int, percent: int = PERCENT) -> np.ndarray:
    """First size of each band: a set of the last size of a band is similar to none two bands on."""
    first = [1]
    while first[-1] <= largest:
        first.append(first[-1] * 100 // percent + 1)
    return np.array([*first, first[-1] * 100 // percent + 1], np.int64)


def instance(first: np.ndarray, band: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """k and the number of partitions of each band's instance.

    Sets a and b with |a & b| >= p |a | b| differ in at most (|a| + |b|) (1 - p) / (1 + p), so they
    differ in at most one shingle in all but k // 2 partitions; some partitions more are spare.
    """
    last = first[band + 1] - 1
    k = 2 * last * (100 - percent) // (100 + percent)
    few = k // 2
    return k, few + 1 + np.where(few > 0, 1 + few * 8 // 100, 0)


def signatures(row: np.ndarray, shingle: np.ndarray, size: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their signatures; row and shingle sorted, size the number of shingles by row."""
    if not len(row):
        return row, shingle
    first = bands(int(size.max()), percent)
    band = np.searchsorted(first, size, side="right") - 1
    rows, values = [], []
    for step in (0, 1):
        own = np.maximum(band + step, 0)
        k, parts = instance(first, own, percent)
        takes = (size > 0) & ((step == 0) | (100 * size >= percent * first[own]))
        some = takes[row]
        r, h = row[some], shingle[some]
        if not len(r):
            continue
        # partitions are ranges of the hash, thirds are ranges of a partition
        third = (((h >> _U(32)) * (3 * parts[r]).astype(np.uint64)) >> _U(32)).astype(np.int64)
        edge = np.ones(len(r), bool)
        edge[1:] = (r[1:] != r[:-1]) | (third[1:] != third[:-1])
        at = np.flatnonzero(edge)
        parts = np.where(takes, parts, 0)
        base = np.cumsum(parts) - parts
        sums, counts = np.zeros((int(parts.sum()), 3), np.uint64), np.zeros((int(parts.sum()), 3), np.int64)
        place = base[r[at]] + third[at] // 3
        sums[place, third[at] % 3] = np.add.reduceat(mix(h ^ _U(0x5851F42D4C957F2D)), at)
        counts[place, third[at] % 3] = np.diff(at, append=len(r))
        who = np.repeat(np.arange(len(size)), parts)
        label = mix(own[who].astype(np.uint64) * _U(1 << 32) + (np.arange(len(who)) - base[who]).astype(np.uint64))
        # partitions in which any two thirds have shingles; a set with few of them tells of empty ones, too
        sound = np.bincount(who[(counts > 0).sum(axis=1) >= 2], minlength=len(size))
        unsure = (sound <= k // 2)[who]
        total, n = sums.sum(axis=1, dtype=np.uint64), counts.sum(axis=1)
        exact = (k == 0)[who]
        for left_out in range(3):
            told = ((n - counts[:, left_out] > 0) | unsure) & ~exact
            rows.append(who[told])
            values.append(mix((total - sums[:, left_out] + mix(label + _U(left_out + 1)))[told]))
        rows.append(who[exact])
        values.append(mix((total + label)[exact]))
    return np.concatenate(rows), np.concatenate(values)


def set_keys(row: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two hashes and the size of each row's set."""
    size = np.bincount(row, minlength=rows)
    keys = [np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)]
    if len(row):
        at = np.flatnonzero(np.diff(row, prepend=-1))
        for key, salt in zip(keys, (0x2545F4914F6CDD1D, 0x9E6C63D0876A9A47), strict=True):
            key[row[at]] = np.add.reduceat(mix(shingle ^ _U(salt)), at)
    return mix(keys[0] + size.astype(np.uint64)), mix(keys[1]), size


def parities(row: np.ndarray, shingle: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity words of each row's set: how many, and all in a row.

    Each bit says whether an odd number of the set's shingles hash to it. A shingle that one of two
    sets has changes one bit, so sets differ in as many shingles at least as bits. There is about
    a bit a shingle, in a power of two of words; halves fold into each other by exclusive or.
    """
    words = np.maximum(PARITY, 1 << np.ceil(np.log2(np.maximum(size, 1) / 64)).clip(0).astype(np.int64))
    base = np.cumsum(words) - words
    odd = np.zeros(int(words.sum()), np.uint64)
    bit = (mix(shingle) >> _U(24)) & (64 * words[row] - 1).astype(np.uint64)
    np.bitwise_xor.at(odd, base[row] + (bit >> _U(6)).astype(np.int64), _U(1) << (bit & _U(63)))
    return words, odd


class Sets:
    """Size and parity words of some sets, one after the other."""

    def __init__(self, n: np.ndarray, words: np.ndarray, at: np.ndarray, odd: np.ndarray):
        self.n, self.words, self.at, self.odd = n, words, at, odd

    @classmethod
    def of(cls, n: np.ndarray, parity: pa.Array) -> Sets:
        ends = np.frombuffer(parity.buffers()[1], np.int32)[parity.offset : parity.offset + len(parity) + 1].astype(np.int64)
        odd = np.frombuffer(parity.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64) if len(parity) else np.zeros(0, np.uint64)
        return cls(n.astype(np.int64), np.diff(ends) // 8, (ends[:-1] - ends[0]) // 8, odd)

    def folded(self, i: np.ndarray, words: int, to: int) -> np.ndarray:
        """The words of sets i, all of which have so many, folded to fewer."""
        return np.bitwise_xor.reduce(self.odd[self.at[i, None] + np.arange(words)].reshape(len(i), -1, to), axis=1)

    def short(self) -> np.ndarray:
        """PARITY words of every set, in columns."""
        out = np.zeros((PARITY, len(self.n)), np.uint64)
        for w in np.unique(self.words).tolist():
            own = np.flatnonzero(self.words == w)
            out[:, own] = self.folded(own, w, PARITY).T
        return out

    def __getitem__(self, some: slice) -> Sets:
        return Sets(self.n[some], self.words[some], self.at[some], self.odd)


def can_be_similar(x: Sets, i: np.ndarray, y: Sets, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the sets i of x and j of y, pair by pair, can be similar by their sizes and parities."""
    a, b = x.n[i], y.n[j]
    out = 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    some = np.flatnonzero(out)
    shape = x.words[i[some]] * 2**32 + y.words[j[some]]
    for kind in np.unique(shape).tolist():
        left, right = divmod(kind, 2**32)
        own = some[shape == kind]
        to = min(left, right)
        differ = np.bitwise_count(x.folded(i[own], left, to) ^ y.folded(j[own], right, to)).sum(axis=1, dtype=np.int64)
        out[own] = (100 + percent) * differ <= (100 - percent) * (a[own] + b[own])
    return out


_PACKED = "bucket bigint, docs binary, items binary"
_DOC = np.dtype([("doc_id", "<i8"), ("node", "<u8"), ("node2", "<u8"), ("n", "<i4"), ("words", "<i4")])


def _packed(bits: int, percent: int):
    """Rows (bucket, binary): the documents' keys, and signatures packed by bucket.

    A bucket holds the signatures with the same leading bits: 40 more bits of each (chance matches
    are verified away) and the place of its node in the list of nodes that follows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        held: list[tuple] = []
        count = nodes = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, count, nodes
            if count:
                node = np.concatenate([x[0] for x in held])
                who = np.concatenate([x[1] + b for x, b in zip(held, np.cumsum([0] + [len(x[0]) for x in held[:-1]]), strict=True)]).astype(np.uint16)
                sig = np.concatenate([x[2] for x in held])
                order = np.argsort(sig, kind="stable")
                sig, who = sig[order], who[order]
                bucket = (sig >> _U(64 - bits)).astype(np.int64)
                rest = (sig << _U(bits)) >> _U(24)
                low, high = (rest & _U(0xFFFFFFFF)).astype("<u4"), (rest >> _U(32)).astype(np.uint8)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                names, blobs = [], []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    used, place = np.unique(who[a:b], return_inverse=True)
                    names.append(int(bucket[a]))
                    blobs.append(np.array([b - a, len(used)], "<u4").tobytes() + low[a:b].tobytes() + high[a:b].tobytes() + place.astype("<u2").tobytes() + node[used].tobytes())
                for i in range(0, len(names), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(names[i : i + 256], pa.int64()), pa.nulls(len(names[i : i + 256]), pa.binary()), pa.array(blobs[i : i + 256], pa.binary())], ["bucket", "docs", "items"])
            held, count, nodes = [], 0, 0

        for batch in batches:
            for at, data, ends in chunks(batch.column(1)):
                row, shingle = shingle_sets(data, ends)
                node, node2, size = set_keys(row, shingle, len(ends))
                docs = np.zeros(len(ends), _DOC)
                docs["words"], odd = parities(row, shingle, size)
                docs["doc_id"], docs["node"], docs["node2"], docs["n"] = batch.column(0).slice(at, len(ends)).to_numpy(zero_copy_only=False), node, node2, size
                turn += 1
                yield pa.RecordBatch.from_arrays([pa.array([int(mix(node[:1] + _U(turn))[0] >> _U(64 - bits))], pa.int64()), pa.array([docs.tobytes()], pa.binary()), pa.array([odd.tobytes()], pa.binary())], ["bucket", "docs", "items"])
                fresh = np.zeros(len(ends), bool)
                for i, key in enumerate(node2.tolist()):  # one row a set and task
                    if size[i] and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                some = fresh[row]
                number = np.cumsum(fresh) - 1
                who, sig = signatures(number[row[some]], shingle[some], size[fresh], percent)
                if nodes + int(fresh.sum()) > 65_000:
                    yield from flush()
                held.append((node[fresh], who, sig))
                count += len(sig)
                nodes += int(fresh.sum())
                if count > HELD:
                    yield from flush()
        yield from flush()
        release()

    return run


_SHARED = "doc_id bigint, node bigint, node2 bigint, n int, run bigint, follows bigint, parity binary"


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets, one after the other: the documents' keys, and the nodes that have a signature in common.

    The nodes of a signature, sorted, are a run. Neighbours in a run are a pair (node, follows).
    Runs of three and more are told in full (run, node), once a bucket where they have the same nodes.
    """
    names = ["doc_id", "node", "node2", "n", "run", "follows", "parity"]
    kinds = {"n": pa.int32(), "parity": pa.binary()}

    def rows(**columns) -> pa.RecordBatch:
        count = len(next(iter(columns.values())))
        kind = lambda x: kinds.get(x, pa.int64())
        as_array = lambda x, v: v if isinstance(v, pa.Array) else pa.array(v, kind(x))
        return pa.RecordBatch.from_arrays([as_array(x, columns[x]) if x in columns else pa.nulls(count, kind(x)) for x in names], names)

    def told(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        sig, node = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        distinct = np.ones(len(sig), bool)
        distinct[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[distinct], node[distinct]
        first = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
        size = np.diff(first, append=len(sig))
        pair = np.flatnonzero(sig[1:] == sig[:-1])
        if not len(pair):
            return
        pairs = np.unique(np.stack([node[pair], node[pair + 1]]), axis=1)
        yield rows(node=pairs[0].view(np.int64), follows=pairs[1].view(np.int64))
        name = mix(np.add.reduceat(mix(node), first) + size.astype(np.uint64))
        _, once = np.unique(name, return_index=True)
        once = once[size[once] > 2]
        if len(once):
            run = np.repeat(name[once], size[once])
            member = np.repeat(first[once] - (np.cumsum(size[once]) - size[once]), size[once]) + np.arange(len(run))
            yield rows(run=run.view(np.int64), node=node[member].view(np.int64))

    bucket, parts = None, []
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(1)[i].is_valid:
                docs = np.frombuffer(batch.column(1)[i].as_buffer(), _DOC)
                signed = lambda x: np.ascontiguousarray(x).view(np.int64)
                offsets = np.concatenate([[0], 8 * np.cumsum(docs["words"])]).astype(np.int32)
                parity = pa.Array.from_buffers(pa.binary(), len(docs), [None, pa.py_buffer(offsets), batch.column(2)[i].as_buffer()])
                yield rows(doc_id=docs["doc_id"], node=signed(docs["node"]), node2=signed(docs["node2"]), n=docs["n"], parity=parity)
            else:
                if batch.column(0)[i].as_py() != bucket:
                    if parts:
                        yield from told(parts)
                    bucket, parts = batch.column(0)[i].as_py(), []
                blob = batch.column(2)[i].as_buffer()
                n, m = np.frombuffer(blob, "<u4", 2).tolist()
                low = np.frombuffer(blob, "<u4", n, 8).astype(np.uint64)
                high = np.frombuffer(blob, np.uint8, n, 8 + 4 * n).astype(np.uint64)
                place = np.frombuffer(blob, "<u2", n, 8 + 5 * n)
                parts.append(((high << _U(32)) | low, np.frombuffer(blob, "<u8", m, 8 + 7 * n)[place]))
    if parts:
        yield from told(parts)
    release()


def _sets(wanted: np.ndarray):
    """Rows (doc_id, text) that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            hit = (wanted[(h >> _U(6)) & _U(FILTER_WORDS - 1)] >> (h & _U(63))) & _U(1)
            yield batch.filter(pa.array(hit.astype(bool)))

    return run


def _filter_of(ids: DataFrame) -> np.ndarray:
    """A bitmap of hashed doc_ids: FILTER_WORDS numbers, however many ids there are."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(FILTER_WORDS, np.uint64)
        for batch in batches:
            h = mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64))
            np.bitwise_or.at(words, ((h >> _U(6)) & _U(FILTER_WORDS - 1)).astype(np.int64), _U(1) << (h & _U(63)))
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], ["at", "word"])

    found = ids.mapInArrow(bits, "at bigint, word bigint").groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
    words = np.zeros(FILTER_WORDS, np.uint64)
    words[found["at"].to_numpy(np.int64)] = found["word"].to_numpy(np.int64).view(np.uint64)
    return words


def _shingle_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, node and sorted shingles; all rows of a doc_id are in one task, each set of it comes once."""
    seen: set = set()
    for batch in batches:
        for at, data, ends in chunks(batch.column(1)):
            row, shingle = shingle_sets(data, ends)
            ids, nodes = batch.column(0).slice(at, len(ends)), set_keys(row, shingle, len(ends))[0].view(np.int64)
            fresh = []
            for key in zip(ids.to_pylist(), nodes.tolist(), strict=True):
                fresh.append(key not in seen)
                seen.add(key)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(ends)))])
            arrays = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(shingle.view(np.int64)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes), arrays], ["doc_id", "node", "shingles"]).filter(pa.array(fresh))


def _key(doc_id: str = "doc_id"):
    """A class: the least doc_id of its rows and the hash of its set."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.col("node").alias("node"))


def _whole_sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, node and shingles of the documents of some doc_ids; texts are read again for these only."""
    texts = docs.mapInArrow(_sets(_filter_of(ids)), "doc_id bigint, text string")
    return texts.join(ids, "doc_id", "left_semi").repartition("doc_id").mapInArrow(_shingle_arrays, "doc_id bigint, node bigint, shingles array<bigint>")


def _verified(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    pairs = checkpointed(pairs)
    ids = pairs.select(F.explode(F.array("a.doc_id", "b.doc_id")).alias("doc_id")).distinct()
    sets = checkpointed(_whole_sets(ids, docs))
    both = pairs.join(sets.select(_key().alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(_key().alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    out = checkpointed(both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b"))
    del pairs, ids, sets, both
    forget(out.sparkSession)
    return out


_PAIR = "a struct<doc_id: bigint, node: bigint>, b struct<doc_id: bigint, node: bigint>"


def _near(percent: int):
    """Of rows (a, b, size and parity of a, of b) the pairs that can be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (Sets.of(batch.column(i).to_numpy(zero_copy_only=False), batch.column(i + 1)) for i in (2, 4))
            i = np.arange(batch.num_rows)
            yield batch.filter(pa.array(can_be_similar(x, i, y, i, percent))).select(["a", "b"])

    return run


class Forest:
    """Which classes are connected by the edges so far."""

    def __init__(self):
        self.above: dict[tuple[int, int], tuple[int, int]] = {}

    def root(self, x: tuple[int, int]) -> tuple[int, int]:
        path = []
        while (up := self.above.get(x, x)) != x:
            path.append(x)
            x = up
        for y in path:
            self.above[y] = x
        return x

    def connects(self, a: tuple[int, int], b: tuple[int, int]) -> bool:
        """Put an edge in; whether it connects what was apart."""
        a, b = self.root(a), self.root(b)
        self.above[max(a, b)] = min(a, b)
        return a != b


class _Members:
    """Keys, components, sets and short parities of some members of a run; their first runs, or their shingles."""

    def __init__(self, key: np.ndarray, component: np.ndarray, in_top: np.ndarray, sets: Sets, short: np.ndarray, more: np.ndarray):
        self.key, self.component, self.in_top, self.sets, self.short, self.more = key, component, in_top, sets, short, more

    def __getitem__(self, some: slice) -> _Members:
        return _Members(self.key[:, some], self.component[:, some], self.in_top[some], self.sets[some], self.short[:, some], self.more[some])

    def __len__(self) -> int:
        return len(self.in_top)

    @classmethod
    def joined(cls, parts: list[_Members]) -> _Members:
        base = np.cumsum([0] + [len(p.sets.odd) for p in parts[:-1]])
        own = [getattr(p.sets, k) for k in ("n", "words") for p in parts]
        n, words, at = np.concatenate(own[: len(parts)]), np.concatenate(own[len(parts) :]), np.concatenate([p.sets.at + b for p, b in zip(parts, base, strict=True)])
        sets = Sets(n, words, at, np.concatenate([p.sets.odd for p in parts]))
        return cls(*(np.concatenate([getattr(p, k) for p in parts], axis=-1) for k in ("key", "component", "in_top")), sets, np.concatenate([p.short for p in parts], axis=1), np.concatenate([p.more for p in parts]))


def _candidates(x: _Members, y: _Members, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places) of a member of x, none of which is in the largest component, and one of y of another component."""
    differ = np.zeros((len(x), len(y)), np.uint16)
    for u, v in zip(x.short, y.short, strict=True):
        differ += np.bitwise_count(u[:, None] ^ v)
    most = (100 - percent) * x.sets.n[:, None] + (100 - percent) * y.sets.n
    i, j = np.nonzero((100 + percent) * differ.astype(np.int32) <= most)
    a, b = x.component[:, i], y.component[:, j]
    after = y.in_top[j] | (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))
    i, j = i[after], j[after]
    near = can_be_similar(x.sets, i, y.sets, j, percent)
    return i[near], j[near]


def _first_met(x: _Members, i: np.ndarray, y: _Members, j: np.ndarray, run: int) -> np.ndarray:
    """Whether no run before this one is known to have both of a pair; in the first that has them it is true."""
    out = np.ones(len(i), bool)
    for at in range(0, len(i), PAIRS // 16):
        some = slice(at, at + PAIRS // 16)
        both = np.sort(np.concatenate([x.more[i[some]], y.more[j[some]]], axis=1), axis=1)
        out[some] = ~((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < run)).any(axis=1)
    return out


def _met(percent: int, more, chosen):
    """Edges (a, b) that connect classes, from rows sorted by run, block and side.

    A block's rows of side 0 are held, those of side 1 stream past them. Of their pairs, by different
    components that can be similar, chosen(forest, run, x, i, y, j) gives those that are meant; a pair
    of components outside the run's largest one counts in one of its two directions. A task tells no
    edge between what its edges connect, so it tells fewer than it has classes.
    """

    def told(found: list[tuple]) -> pa.RecordBatch:
        ends = [[min(e) for e in found], [max(e) for e in found]]
        kinds = pa.struct([("doc_id", pa.int64()), ("node", pa.int64())])
        keys = [pa.array([dict(zip(("doc_id", "node"), k, strict=True)) for k in end], kinds) for end in ends]
        return pa.RecordBatch.from_arrays(keys, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, found, forest = None, [], [], Forest()
        for batch in batches:
            column = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(9)]
            sets = Sets.of(column[8], batch.column(9))
            rows = _Members(np.stack(column[3:5]), np.stack(column[5:7]), column[7].astype(bool), sets, sets.short(), more(batch.column(10)))
            group = np.stack([c.astype(np.int64) for c in column[:3]])
            cuts = [0, *(np.flatnonzero((group[:, 1:] != group[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (group[0, a], group[1, a]) != key:
                    key, held = (group[0, a], group[1, a]), []
                if group[2, a] == 0:
                    held.append(rows[a:b])
                    continue
                held = [_Members.joined(held)] if len(held) > 1 else held
                step = max(1, PAIRS // max(1, len(held[0]))) if held else 1
                for at in range(a, b, step) if held else ():
                    x, y = held[0], rows[at : min(b, at + step)]
                    i, j = _candidates(x, y, percent)
                    found += chosen(forest, key[0], x, i, y, j)
            if len(found) > HELD // 16:
                yield told(found)
                found = []
        if found:
            yield told(found)
        release()

    return run


def _edge(x: _Members, i: int, y: _Members, j: int) -> tuple:
    return tuple(x.key[:, i].tolist()), tuple(y.key[:, j].tolist())


def _apart(percent: int):
    """A spanning forest of the pairs of different components that the parities don't tell apart.

    Each class that is in such a pair is in an edge. Pairs that an earlier run has are left to it.
    """

    def first_runs(lists: pa.Array) -> np.ndarray:
        out = np.full((len(lists), FIRST_RUNS), np.iinfo(np.int64).max)
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        out[np.arange(FIRST_RUNS) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
        return out

    def chosen(forest: Forest, run: int, x: _Members, i: np.ndarray, y: _Members, j: np.ndarray) -> list[tuple]:
        new = _first_met(x, i, y, j, run)
        edges = (_edge(x, p, y, q) for p, q in zip(i[new], j[new], strict=True))
        return [e for e in edges if forest.connects(*e)]

    return _met(percent, first_runs, chosen)


def _linked(percent: int):
    """A spanning forest of the links between different components, by whole sets: edges of components."""

    def shingles(lists: pa.Array) -> np.ndarray:
        out = np.empty(len(lists), object)
        ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))[:-1]
        out[:] = np.split(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), ends)
        return out

    def chosen(forest: Forest, run: int, x: _Members, i: np.ndarray, y: _Members, j: np.ndarray) -> list[tuple]:
        out = []
        for p in np.unique(i).tolist():
            own, name = x.more[p], tuple(x.component[:, p].tolist())
            for q in j[i == p].tolist():
                other = tuple(y.component[:, q].tolist())
                if forest.root(name) == forest.root(other):
                    continue
                others = y.more[q]
                common = int((own[np.minimum(np.searchsorted(own, others), len(own) - 1)] == others).sum())
                if 100 * common >= percent * (len(own) + len(others) - common):
                    forest.connects(name, other)
                    out.append((name, other))
        return out

    return _met(percent, shingles, chosen)


_AT = ("run", "at.block", "at.side", "key.doc_id", "key.node", "component.doc_id", "component.node", "in_top", "n", "parity")


def _dealt(members: DataFrame, more: str, edges) -> DataFrame:
    """Edges of members with run, blocks, key, component, in_top, n, parity and one column more.

    A member outside the run's largest component is held in one block; each member is compared with all blocks.
    """
    place = lambda block, side: F.struct(block.alias("block"), F.lit(side).alias("side"))
    as_right = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: place(b, 1))
    as_left = F.array(place(F.pmod(F.xxhash64("key", "run"), F.col("blocks")).cast("int"), 0))
    dealt = members.withColumn("at", F.explode(F.when(F.col("in_top"), as_right).otherwise(F.concat(as_left, as_right))))
    names = ("run", "block", "side", "doc_id", "node", "c_doc", "c_node", "in_top", "n", "parity")
    dealt = dealt.select(*[F.col(c).alias(n) for c, n in zip(_AT, names, strict=True)], more)
    return dealt.repartition("run", "block").sortWithinPartitions("run", "block", "side").mapInArrow(edges, _PAIR).distinct()


def _compared(runs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between the classes of a run whose components differ and that can be similar.

    classes have node, key, n, parity and component. Within a run only the members outside its
    largest component are compared with all members. They are dealt out in blocks of BLOCK; the
    workers give back edges that connect all pairs that the parities don't tell apart.
    """
    component = runs.join(classes.select("node", "key", "component"), "node")
    sizes = component.groupBy("run", "component").count().groupBy("run").agg(F.sum("count").alias("k"), F.max(F.struct("count", "component")).alias("top"))
    several = sizes.filter(F.col("k") > F.col("top.count")).select("run", F.col("top.component").alias("top"), F.ceil((F.col("k") - F.col("top.count")) / BLOCK).cast("int").alias("blocks"))
    own = runs.join(several, "run")
    first = own.groupBy("node").agg(F.slice(F.sort_array(F.collect_list("run")), 1, FIRST_RUNS).alias("runs"))
    member = own.join(classes.join(first, "node"), "node").withColumn("in_top", F.col("component") == F.col("top"))
    return _dealt(member, "runs", _apart(percent))


def _links_within(edges: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Components (a, b), as edges that connect those whose classes are linked, among classes that edges connect.

    Each class is in one tree of edges, and so is each pair that was not told apart: its whole set goes
    to the blocks of its tree.
    """
    edges = checkpointed(edges)
    trees = components(edges)
    trees = trees.unionAll(trees.select(F.col("component").alias("node"), "component").distinct()).withColumnsRenamed({"node": "key", "component": "tree"})
    inside = checkpointed(classes.drop("node").join(trees, "key").withColumn("run", F.xxhash64("tree")))
    counts = inside.groupBy("run").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sets = _whole_sets(inside.select("key.doc_id").distinct(), docs).select(_key().alias("key"), "shingles")
    member = inside.join(counts, "run").join(sets, "key").withColumn("in_top", F.lit(False))
    return _dealt(member, "shingles", _linked(percent))


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; a row's component is the least
    doc_id that links lead to from its document, itself included."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = _labelled(docs, percent).select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), F.col("component.doc_id").alias("component_id"))
    nameless = docs.filter("doc_id is null").select("doc_id", "text").mapInArrow(_sizes, "doc_id bigint, n_shingles bigint, component_id bigint")
    return rows.unionByName(nameless)


def _labelled(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, node, n and component (the key of its least class) of every row with a doc_id."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    named = docs.filter("doc_id is not null")
    buckets = max(64, named.count() // BUCKET_DOCS)
    bits = min(MOST_BITS, (buckets - 1).bit_length())
    packed = spread(named).mapInArrow(_packed(bits, percent), _PACKED).repartition(F.col("bucket")).sortWithinPartitions("bucket")
    with written(packed.mapInArrow(_shared, _SHARED)) as found:
        forget(found.sparkSession)
        keys = found.filter("doc_id is not null")
        classes = keys.filter("n > 0").groupBy("node", "node2", "n").agg(F.min("doc_id").alias("rep"), F.min("parity").alias("parity"))
        classes = checkpointed(classes.withColumn("key", _key("rep")).drop("rep"))
        pairs = found.filter("follows is not null").select("node", "follows").distinct()
        runs = found.filter("run is not null").select("run", "node").distinct()

        # neighbours in runs
        x, y = classes.select("node", F.col("key").alias("kx"), F.col("n").alias("nx"), F.col("parity").alias("px")), classes.select(F.col("node").alias("follows"), F.col("key").alias("ky"), F.col("n").alias("ny"), F.col("parity").alias("py"))
        near = pairs.join(x, "node").join(y, "follows").filter("kx <> ky")
        near = near.select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), "nx", "px", "ny", "py")
        near = checkpointed(near.mapInArrow(_near(percent), _PAIR).distinct())
        links = _verified(near, named, percent)
        joined = checkpointed(components(links))
        forget(found.sparkSession)

        # classes of a run that aren't connected yet
        whole = classes.join(joined.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        labelled = whole.select("node", "key", "n", "parity", "component")
        apart = _compared(runs, labelled, percent)
        tops = components(_links_within(apart, labelled, named, percent)).withColumnsRenamed({"component": "top", "node": "component"})

        label = whole.join(tops, "component", "left").select("node", "node2", "n", F.coalesce("top", "component").alias("component"))
        rows = keys.select("doc_id", "node", "node2", "n").join(label, ["node", "node2", "n"], "left")
        return checkpointed(rows.select("doc_id", "node", "n", F.coalesce("component", _key()).alias("component")))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, ends in chunks(batch.column(1)):
            n = np.bincount(shingle_sets(data, ends)[0], minlength=len(ends))
            none = pa.nulls(len(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(n, pa.int64()), none], ["doc_id", "n_shingles", "component_id"])


def _nodes(text: Column):
    """The hash of the set of shingles of a text column."""

    @F.arrow_udf("bigint")
    def node(texts: pa.Array) -> pa.Array:
        parts = [set_keys(*shingle_sets(data, ends), len(ends))[0].view(np.int64) for _, data, ends in chunks(texts)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    return node(text)


def first_of_each(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of each component the row whose doc_id is least.

    Of a doc_id with several sets, each set counts for itself; their rows are told apart by hashing again.
    """
    rows = _labelled(docs, percent).select("doc_id", "node", (F.col("component") == _key()).alias("first"))
    node, copy, several = unused(docs, "node"), unused(docs, "copy"), unused(docs, "several")
    each = rows.groupBy("doc_id").agg((F.min("node") != F.max("node")).alias(several), F.max("first").alias("any"))
    # texts are dealt out by doc_id once, for this join and the windows
    kept = docs.filter("doc_id is not null").join(each.filter("any").drop("any"), "doc_id")
    firsts = rows.filter("first").select("doc_id", F.col("node").alias(node)).distinct()
    # the condition keeps the hashing above the join, so only texts of doc_ids with several are hashed again
    mixed = kept.filter(F.col(several)).withColumn(node, _nodes(F.when(F.col(several), F.col("text")))).join(firsts, ["doc_id", node]).drop(node)
    once = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.col("text"))
    first = lambda some: some.withColumn(copy, F.row_number().over(once)).filter(F.col(copy) == 1)
    whole = first(kept.filter(~F.col(several))).unionByName(first(mixed))
    return whole.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [md5(array_to_string(w, ' '))]
    ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: md5(array_to_string(w[i:i + {WORDS - 1}], ' ')))) END AS sh FROM d
), u AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS h FROM s
), few AS (
  SELECT h FROM u GROUP BY h HAVING count(*) > 1
), v AS (
  SELECT * FROM u WHERE h IN (SELECT h FROM few)
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM v a JOIN v b ON a.h = b.h AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {PERCENT} * (a.n + b.n - count(*))
), e AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, e.b FROM reach JOIN e ON reach.y = e.a)
  SELECT x, min(y) AS component_id FROM reach GROUP BY x
)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id FROM s JOIN r ON r.x = s.doc_id
"""
