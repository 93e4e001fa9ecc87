"""Op 1: SentencePiece encoding with sampled segmentations, and lossless decoding.

A text, with a blank put before it, is split where no piece of the vocabulary reaches across. Each
chunk has a lattice of all its pieces; characters that no piece covers become their bytes. Forward
filtering sums the probabilities of all segmentations up to each position, backward sampling draws
the pieces from the end in proportion. The random numbers are hashed from the row key, the chunk's
place and the position, so a row's sample does not depend on partitions or batches.

A piece's probability follows Zipf's law on its rank in the vocabulary, raised to ALPHA; the
vocabulary itself is not trained or changed. Decoding joins the pieces' bytes and takes the first
blank away: it gives back any text exactly. A null text is encoded as null, an empty text as one
blank; a null key is hashed as a key of its own; equal rows get equal samples, so ties change
nothing. Texts of any length are encoded whole, in time that grows with their length; a chunk without
a blank or a place where no piece reaches across is held as one lattice, position by position. Only
doc_id and text are read; other columns may have any name. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.sources.tables import spread

from .common import release, table

#: A SentencePiece model file with byte fallback; on every executor.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 1
#: Lattices kept by a worker, and characters sampled at a time.
KEPT = 100_000
CHARS = 500_000
#: Logarithm of the weight of a character that no piece covers.
UNCOVERED = -20.0

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_models: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit hash of each number."""
    x = x + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Lattices:
    """The lattices of many chunks in flat arrays: a chunk has a node before each character and at its end, a node its incoming edges, an edge its ids."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        rank = {i: n for n, i in enumerate(sorted(plain, key=lambda i: (-model.get_score(i), i)))}
        pieces: dict[str, int] = {}
        self.bytes, self.byte_ids = [b""] * size, [0] * 256
        for i in range(size):
            if model.is_byte(i):
                value = int(model.id_to_piece(i)[3:5], 16)
                self.byte_ids[value], self.bytes[i] = i, bytes([value])
            elif i in rank:
                text = model.id_to_piece(i).replace("▁", " ")
                pieces[text], self.bytes[i] = i, text.encode()
        self.byte_sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.byte_first = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.byte_table = np.frombuffer(b"".join(self.bytes), np.uint8)
        free = not any(re.search(r"[^ ] |\n.|.\n", p, re.S) for p in pieces)
        #: a chunk: blanks and what follows them, or one line end; all of the text if pieces reach further
        self.chunk = re.compile(r"\n| *[^ \n]+| +" if free else r".+", re.S)
        self.scores = np.zeros(size + 1)
        for i, n in rank.items():
            self.scores[i] = -alpha * math.log(n + 3.0)
        #: ids by edge: a piece has itself, a character that is no piece its bytes, from an offset on
        self.ids = np.arange(size, dtype=np.int32)
        self.fallback: dict[int, tuple[int, int]] = {}
        # all beginnings of pieces in an open hash table: the piece's id, or -1 if it is only a beginning
        starts = {p[:k]: -1 for p in pieces for k in range(1, len(p) + 1)} | pieces
        self.bits = max(12, (len(starts) * 6).bit_length())
        self.slots, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        for text, value in starts.items():
            h = np.zeros(1, np.uint64)
            for c in text:
                h = _mix(h + np.uint64(ord(c)))
            at = int(h[0] >> np.uint64(64 - self.bits))
            while self.slots[at]:
                at = (at + 1) & (len(self.slots) - 1)
            self.slots[at], self.values[at] = h[0], value
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.node0, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of a chunk
        self.edge0 = np.zeros(0, np.int64)  # of a node
        self.cum, self.back = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of an edge: probability in 2**-31 so far, position before
        self.first, self.n_ids = np.zeros(0, np.int32), np.zeros(0, np.int8)

    def _found(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is the beginning of a piece, and the id of the piece that it is, or -1."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.slots[at]
        off = np.flatnonzero((there != h) & (there != 0))
        while len(off):
            at[off] = (at[off] + 1) & (len(self.slots) - 1)
            there[off] = self.slots[at[off]]
            off = off[(there[off] != h[off]) & (there[off] != 0)]
        hit = there == h
        return hit, np.where(hit, self.values[at], -1)

    def _bytes_of(self, code: int) -> tuple[int, int]:
        if code not in self.fallback:
            own = [self.byte_ids[b] for b in chr(code).encode("utf-8", "surrogatepass")]
            self.fallback[code] = (len(self.ids), len(own))
            self.ids = np.concatenate([self.ids, np.array(own, np.int32)])
        return self.fallback[code]

    def build(self, chunks: list[str]) -> None:
        """Forward filtering over the lattices of new chunks, position by position."""
        length = np.array([len(c) for c in chunks], np.int64)
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        ends = np.cumsum(length)
        owner = np.repeat(np.arange(len(chunks)), length)
        # every piece that starts at every character
        at, h, k = np.arange(len(code)), np.zeros(len(code), np.uint64), 0
        starts, sizes, firsts, counts, scores = [], [], [], [], []
        while len(at):
            h = _mix(h + code[at + k])
            k += 1
            hit, piece = self._found(h)
            whole = np.flatnonzero(piece >= 0)
            starts.append(at[whole])
            sizes.append(np.full(len(whole), k))
            firsts.append(piece[whole])
            counts.append(np.ones(len(whole), np.int64))
            scores.append(self.scores[piece[whole]])
            if k == 1 and len(none := np.flatnonzero(piece < 0)):
                distinct, which = np.unique(code[none], return_inverse=True)
                own = np.array([self._bytes_of(int(c)) for c in distinct], np.int64)
                starts.append(none)
                sizes.append(np.ones(len(none), np.int64))
                firsts.append(own[which, 0])
                counts.append(own[which, 1])
                scores.append(np.full(len(none), UNCOVERED))
            go = np.flatnonzero(hit & (at + k < ends[owner[at]]))
            at, h = at[go], h[go]
        start, size = np.concatenate(starts), np.concatenate(sizes)
        to = start + size + owner[start]  # a chunk has one node more than characters
        order = np.argsort(to, kind="stable")
        start, size, to = start[order], size[order], to[order]
        score, source = np.concatenate(scores)[order], start + owner[start]
        nodes = len(code) + len(chunks)
        degree = np.bincount(to, minlength=nodes)
        edge0 = np.cumsum(degree) - degree
        node0 = ends - length + np.arange(len(chunks))
        forward, weight = np.zeros(nodes), np.zeros(len(to), np.int64)
        by_length = np.argsort(-length, kind="stable")
        rising = -length[by_length]
        for j in range(1, int(length.max()) + 1):
            node = node0[by_length[: np.searchsorted(rising, -j, side="right")]] + j
            n = degree[node]
            first = np.cumsum(n) - n
            edge = np.repeat(edge0[node] - first, n) + np.arange(int(n.sum()))
            term = forward[source[edge]] + score[edge]
            top = np.maximum.reduceat(term, first)
            part = np.exp(term - np.repeat(top, n))
            total = np.add.reduceat(part, first)
            forward[node] = top + np.log(total)
            weight[edge] = part / np.repeat(total, n) * 2.0**31
        # whole numbers, so that sums do not depend on what else is in the batch
        cum = np.cumsum(weight)
        cum -= np.repeat((cum - weight)[edge0[degree > 0]], degree[degree > 0])
        cum[(edge0 + degree - 1)[degree > 0]] = 2**31
        base, base_edge = len(self.edge0), len(self.cum)
        self.known.update(zip(chunks, range(len(self.node0), len(self.node0) + len(chunks)), strict=True))
        join = lambda a, b: np.concatenate([a, b.astype(a.dtype)])
        self.node0, self.length = join(self.node0, node0 + base), join(self.length, length)
        self.edge0, self.cum = join(self.edge0, edge0 + base_edge), join(self.cum, cum)
        self.back = join(self.back, start - (ends - length)[owner[start]])
        self.first, self.n_ids = join(self.first, np.concatenate(firsts)[order]), join(self.n_ids, np.concatenate(counts)[order])

    def sample(self, texts: list[str], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and how many each text has."""
        find = self.chunk.findall
        chunks: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            chunks += (own := find(" " + text))
            counts[i] = len(own)
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if new and len(self.known) + len(new) > KEPT:
            self.clear()
            new = list(dict.fromkeys(chunks))
        if new:
            self.build(new)
        chunk = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        place = np.arange(len(chunk), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
        seed = _mix(np.repeat(keys, counts) + place.astype(np.uint64) * _B)
        at, node = self.length[chunk], self.node0[chunk]
        who, picked = np.arange(len(chunk)), []
        n_picked = np.zeros(len(chunk), np.int64)
        while len(who):
            draw = (_mix(seed + at.astype(np.uint64) * _C) >> np.uint64(33)).astype(np.int64)
            edge = self.edge0[node + at]
            more = np.flatnonzero(self.cum[edge] <= draw)
            while len(more):
                edge[more] += 1
                more = more[self.cum[edge[more]] <= draw[more]]
            picked.append((who, edge))
            n_picked[who] += 1
            at = self.back[edge].astype(np.int64)
            go = np.flatnonzero(at)
            who, at, node, seed = who[go], at[go], node[go], seed[go]
        end = np.cumsum(n_picked)
        taken = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
        for step, (own, edge) in enumerate(picked):  # the last piece of a chunk was drawn first
            taken[end[own] - 1 - step] = edge
        n_ids = self.n_ids[taken].astype(np.int64)
        sums = np.cumsum(n_ids)
        ids = self.ids[np.repeat(self.first[taken] - (sums - n_ids), n_ids) + np.arange(int(sums[-1]) if len(sums) else 0)]
        upto = np.concatenate([[0], sums])[np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(counts)])]]
        return ids, np.diff(upto)

    def decode(self, ids) -> str:
        """The text of some ids."""
        return b"".join([self.bytes[i] for i in ids]).decode("utf-8", "surrogatepass")[1:]

    def decode_batch(self, ids: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, all at once; null for null."""
        values = ids.flatten().to_numpy(zero_copy_only=False)
        n = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes = self.byte_sizes[values]
        ends = np.cumsum(sizes)
        joined = self.byte_table[np.repeat(self.byte_first[values] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        to = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        blank = to[:-1][n > 0]  # the first blank of each text
        offsets = to - np.concatenate([[0], np.cumsum(n > 0)])
        texts = pa.Array.from_buffers(pa.large_string(), len(ids), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.delete(joined, blank))])
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.large_string()))


def lattices(path: str = MODEL, alpha: float = ALPHA) -> Lattices:
    """The vocabulary and the lattices kept so far, once a process."""
    if (path, alpha) not in _models:
        _models[path, alpha] = Lattices(path, alpha)
    return _models[path, alpha]


def row_keys(ids: pa.Array, seed: int = SEED) -> np.ndarray:
    """A 64-bit random key of each row from its integer id."""
    values = ids.cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False).astype(np.uint64)
    return _mix(_mix(values) + np.uint64(seed))


def encode_batch(keys: np.ndarray, texts: list[str | None], path: str = MODEL, alpha: float = ALPHA) -> pa.Array:
    """list<int32> of sampled ids, a list per text."""
    own, parts, at = lattices(path, alpha), [], 0
    lengths = np.zeros(len(texts), np.int64)
    while at < len(texts):
        to, chars = at, 0
        while to < len(texts) and (to == at or chars + len(texts[to] or "") <= CHARS):
            chars += len(texts[to] or "")
            to += 1
        some = [i for i in range(at, to) if texts[i] is not None]
        if some:
            ids, n = own.sample([texts[i] for i in some], keys[some])
            parts.append(ids)
            lengths[some] = n
        at = to
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    values = pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32())
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([t is None for t in texts], pa.bool_()))


def encode_documents(docs: DataFrame, seed: int = SEED, path: str = MODEL, alpha: float = ALPHA) -> DataFrame:
    """doc_id, ids, n_tokens and whether decoding gives the text back, for every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lattices(path, alpha)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # keeps what is sent back at once small
                part = batch.slice(at, 500)
                ids = encode_batch(row_keys(part.column(0), seed), part.column(1).to_pylist(), path, alpha)
                same = pc.equal(own.decode_batch(ids), part.column(1).cast(pa.large_string())).fill_null(True)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, ids.value_lengths().fill_null(0), same], ["doc_id", "ids", "n_tokens", "lossless"])
        own.clear()  # a worker that serves other tasks next need not keep the lattices
        release()

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(run, "doc_id bigint, ids array<int>, n_tokens int, lossless boolean")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
