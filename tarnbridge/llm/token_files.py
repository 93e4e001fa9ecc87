"""Op 13: token ids of documents as Simple-8b files.

A file is a row of blocks of 64-bit little-endian words. A block has a head, an index of its
documents, and the ids of these documents packed into words:

    head       8 words: MAGIC, words of the whole block, part, block within the part, ids, entries, code words, CRC-32 of all that follows
    index      two words an entry: the document's id, and ids here * 4 + 2 (the id is null) + 1 (the document goes on in the next block)
    code       words of ids
    MAGIC      once more, which the writer puts between rows

A code word has its selector in the upper 4 bits; the others hold so many ids of so many bits each,
the first id lowest. Selector 0 is an escape: the whole next word is one id, for ids of more than 60
bits. Each word takes as many ids as fit. As a selector says how many ids a word has, all words of a
selector decode at once, each to its place by a running sum.

Documents are put in order of doc_id, rows without one last, rows of equal id by their texts; a range
of this order is a part file, so parts in order hold all ids in order. What goes before a block is
the sum of the ids of blocks before it, which the heads alone give. Spark's own writer publishes the
files, so a task that is repeated leaves no trace and any file system that Spark can write will do.

A null or empty text has only the id that ends a document. Long texts go over several blocks. Repeated
rows are written as often as they come. An empty table gives files without blocks and no rows. Only
doc_id and text are read, other columns may have any name.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnbridge.session import shared_folder

from .common import checkpointed, release, table

#: A tokenizer of the tokenizers library; on every executor.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
#: The id put after each document.
END = 0
#: How many ids of how many bits a code word has, by selector from 1.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: First word of a block: eight letters.
MAGIC = b"TBS8BBLK"
#: Ids of a block, but for the last document of it up to twice as many.
BLOCK_IDS = 1 << 16
#: Bytes of a part's texts, about. A file is less than half as large, and read back as a whole.
PART_BYTES = 64 << 20
#: Pieces of text whose ids a worker remembers.
REMEMBERED = 400_000
#: Characters of a piece that isn't remembered.
LONG = 60
#: Marks that end a word of the tokenizer where they follow a letter.
MARKS = frozenset(".,;:!?")
#: Bytes of texts encoded together, the last of them whole; a longer text is taken alone.
TOGETHER = 2 << 20

_U = np.uint64
_HEAD = 8
_LIMITS = np.array([1 << b for b in BITS], np.uint64)
_CLASSES = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.int8)


def packed(ids: np.ndarray) -> np.ndarray:
    """Code words of non-negative ids."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    # least selector by bits of each id; more than any selector has behind the end
    least = np.full(n + COUNTS[0], len(BITS) + 1, np.int8)
    least[:n] = _CLASSES[ids] if int(ids.max()) < len(_CLASSES) else np.searchsorted(_LIMITS, ids, side="right")
    fitting = np.zeros(n, np.int8)  # selectors that fit at each place; where one fits, so do all after it
    most, width = least, 1  # the greatest of so many ids from each place on
    for selector in range(len(COUNTS), 0, -1):
        count = COUNTS[selector - 1]
        while 2 * width <= count:
            most = np.maximum(most[:-width], most[width:])
            width *= 2
        fitting += (np.maximum(most[:n], most[count - width : count - width + n]) < selector).view(np.int8)
    choice = (len(COUNTS) + 1 - fitting) % (len(COUNTS) + 1)
    takes = np.array([1, *COUNTS])[choice].tolist()
    starts, at = [], 0
    while at < n:
        starts.append(at)
        at += takes[at]
    start = np.array(starts)
    chosen = choice[start]
    size = np.where(chosen == 0, 2, 1)
    to = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for selector in np.unique(chosen).tolist():
        own = chosen == selector
        if selector == 0:
            out[to[own] + 1] = ids[start[own]]
            continue
        count, bits = COUNTS[selector - 1], BITS[selector - 1]
        first = start[own]
        word = np.full(len(first), selector << 60, np.uint64)
        for k in range(count):
            word |= ids[first + k] << _U(k * bits)
        out[to[own]] = word
    return out


def unpacked(code: np.ndarray) -> np.ndarray:
    """The ids of code words."""
    selector = (code >> _U(60)).astype(np.int64)
    if (selector == 0).any():  # a word after an escape is no code word; escapes can follow each other
        escaped, at = np.zeros(len(code), bool), 0
        for at in np.flatnonzero(selector == 0).tolist():
            if not escaped[at]:
                escaped[at + 1] = True
        whole = np.flatnonzero(escaped)
        selector[whole] = -1
    else:
        whole = np.zeros(0, np.int64)
    counts = np.array([1, *COUNTS, 0, 0])[selector]  # an escape stands for one id, its word for none
    to = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    out[to[whole - 1]] = code[whole]
    for s in np.unique(selector).tolist():
        if s < 1:
            continue
        own = selector == s
        count, bits = COUNTS[s - 1], BITS[s - 1]
        word, first, mask = code[own], to[own], _U((1 << bits) - 1)
        for k in range(count):
            out[first + k] = (word >> _U(k * bits)) & mask
    return out


class Encoder:
    """Whole texts to ids, as little-endian 32-bit words.

    The tokenizer cuts a text into words before it merges, and none of its words goes over the end of a
    white space between two other characters unless it starts with that blank. So a text's ids are those of
    its pieces cut there, one after the other, and the library encodes a piece once for as long as it is remembered.
    The same holds for a mark behind an ASCII letter.
    """

    _CUT = re.compile(r"(?<=\S)(?= \S)")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}  # what was known before; what is asked for again is known again

    def _encoded(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces. Those without line breaks go to the library as lines of one text."""
        lines = [p for p in pieces if "\n" not in p]
        whole = self.tokenizer.encode_batch_fast(["\n".join(["", *lines, ""])], add_special_tokens=False)[0]
        ids = np.array(whole.ids, "<u4")
        ends = (4 * np.flatnonzero(ids == ids[0])).tolist()
        if len(ends) == len(lines) + 1:
            raw = ids.tobytes()
            found = [raw[a + 4 : z] for a, z in zip(ends, ends[1:], strict=False)]
        else:  # a line break has become part of a longer token
            found = list(map(self._one, lines))
        if len(lines) == len(pieces):
            return found
        of_lines = iter(found)
        return [self._one(p) if "\n" in p else next(of_lines) for p in pieces]

    def _one(self, piece: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([piece], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> list[str]:
        """Makes pieces that aren't known known, and gives those that the library was asked for."""
        known, old = self.known, self.old
        if old:
            again = {p: own for p, own in zip(new, map(old.get, new), strict=True) if own is not None}
            known.update(again)
            new = [p for p in new if p not in again]
        marked = [p for p in new if p[-1:] in MARKS and p[-2:-1].isascii() and p[-2:-1].isalpha()]
        asked = set(new).difference(marked)
        asked.update(p for m in marked for p in (m[:-1], m[-1]) if p not in known)
        known.update(zip(asked, self._encoded(list(asked)), strict=True))
        for p in marked:
            known[p] = known[p[:-1]] + known[p[-1]]
        return [*asked, *marked]

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        """The ids of each text. Arrow cuts the texts, numbers their different pieces and puts the ids together."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(texts, " ", "\0 "), "\n", "\0\n\0"), "\0")
        first = np.asarray(cut.offsets)
        coded = cut.flatten().dictionary_encode()
        pieces, codes = _strings(coded.dictionary), np.asarray(coded.indices)
        del cut
        known = self.known
        ids = list(map(known.get, pieces))
        missing = [i for i, own in enumerate(ids) if own is None]
        # white space beside white space: such texts are cut with more care, their odd pieces are never known
        odd = np.zeros(len(pieces), bool)
        odd[[i for i in missing if not pieces[i] or (pieces[i] != "\n" and _has_odd_ends(pieces[i]))]] = True
        careful = np.asarray(pc.match_substring(texts, "\0"))
        if odd.any():
            careful = careful | (np.diff(np.append(0, np.cumsum(odd[codes]))[first]) > 0)
        with_care = {i: self._CUT.split(texts[i].as_py()) for i in np.flatnonzero(careful).tolist()}
        missing = [i for i in missing if not odd[i]]
        new = {pieces[i] for i in missing}
        new.update(p for cut in with_care.values() for p in cut if p not in known)
        learned = self._learn(list(new)) if new else []
        for i in missing:
            ids[i] = known[pieces[i]]
        whole = pa.array(ids, pa.large_binary()).take(coded.indices)  # odd pieces have none; their texts are left out
        _, ends, data = whole.buffers()
        ends = np.frombuffer(ends, np.int64, len(whole) + 1)[first].tolist()
        raw = memoryview(data or b"")
        out = [bytes(raw[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
        for i, cut in with_care.items():
            out[i] = b"".join(map(known.__getitem__, cut))
        gone = [p for p in learned if len(p) > LONG]
        if with_care:
            gone += [p for p in learned if not p or (p != "\n" and _has_odd_ends(p))]
        for p in gone:
            known.pop(p, None)
        if len(known) > REMEMBERED:
            self.old, self.known = known, {}
        return out


def _strings(values: pa.Array) -> list[str]:
    """The values, none of which has a null character: one string for all is made much faster than a string each."""
    if not len(values):
        return []
    all_of_them = pa.LargeListArray.from_arrays(pa.array([0, len(values)], pa.int64()), values)
    return pc.binary_join(all_of_them, pa.scalar("\0", values.type))[0].as_py().split("\0")


def _has_odd_ends(piece: str) -> bool:
    """White space at an end, but for one blank before the rest."""
    return piece[-1].isspace() or piece[1:2].isspace() or (piece[0] != " " and piece[0].isspace())


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def block(part: int, number: int, ids: np.ndarray, entries: list[tuple[int | None, int, bool]]) -> bytes:
    """The bytes of a block but for the MAGIC after it; entries are (doc_id, ids, goes on)."""
    code = packed(ids)
    index = np.zeros(2 * len(entries), np.int64)
    index[0::2] = [0 if d is None else d for d, _, _ in entries]
    index[1::2] = [4 * n + 2 * (d is None) + more for d, n, more in entries]
    rest = index.astype("<i8").tobytes() + code.astype("<u8").tobytes()
    head = np.array([_HEAD + 2 * len(entries) + len(code) + 1, part, number, len(ids), len(entries), len(code), zlib.crc32(rest)], "<u8")
    return MAGIC + head.tobytes() + rest


def blocks_of(content: bytes) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """part, number, doc ids with their index words, and code of each block of a file; an error where it is damaged."""
    words = np.frombuffer(content, "<u8")
    magic, at = int.from_bytes(MAGIC, "little"), 0
    while at < len(words):
        head = words[at : at + _HEAD]
        size = int(head[1]) if len(head) == _HEAD else 0
        if not size or int(head[0]) != magic or at + size > len(words) or int(words[at + size - 1]) != magic:
            raise ValueError(f"no block of token ids at byte {8 * at}")
        entries, code = int(head[5]), int(head[6])
        body = words[at + _HEAD : at + size - 1]
        if zlib.crc32(body.tobytes()) != int(head[7]) or 2 * entries + code != len(body):
            raise ValueError(f"block of token ids at byte {8 * at} is damaged")
        index = body[: 2 * entries].view(np.int64)
        yield int(head[2]), int(head[3]), index[0::2], index[1::2], body[2 * entries :]
        at += size


def _parts(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text") + F.lit(16))).collect()[0][0] or 0
    return max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))


def _together(batch: pa.RecordBatch) -> Iterator[tuple[list, pa.Array]]:
    """Ids and texts of some rows at a time."""
    size, at = np.cumsum(pc.binary_length(batch.column(1)).to_numpy()), 0
    while at < len(size):
        end = min(len(size), 1 + int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER)))
        yield batch.column(0)[at:end].to_pylist(), batch.column(1)[at:end]
        at = end


def write_tokens(docs: DataFrame, path: str, vocabulary: str = VOCABULARY) -> None:
    """Encodes every document and writes its ids, an END after each document, to files of a new folder."""
    special = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    mark = F.xxhash64("text")  # rows of one id are dealt to several parts
    order = [F.col("doc_id").asc_nulls_last(), mark]
    dealt = special.repartitionByRange(_parts(special), *order).sortWithinPartitions(*order, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encode = encoder(vocabulary).encode
        held: list[bytes] = []
        entries: list[tuple[int | None, int, bool]] = []
        count = 0

        def told() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            return pa.RecordBatch.from_arrays([pa.array([block(part, number, ids, entries)], pa.binary())], ["block"])

        end = END.to_bytes(4, "little")
        for batch in batches:
            for docs_, texts in _together(batch):
                for doc, ids in zip(docs_, encode(texts), strict=True):
                    ids += end
                    for at in range(0, len(ids), 4 * BLOCK_IDS):
                        some = ids[at : at + 4 * BLOCK_IDS]
                        held.append(some)
                        entries.append((doc, len(some) // 4, at + 4 * BLOCK_IDS < len(ids)))
                        count += len(some) // 4
                        if count >= BLOCK_IDS:
                            yield told()
                            number += 1
                            held, entries, count = [], [], 0
        if held:
            yield told()
        release()

    rows = dealt.mapInArrow(run, "block binary")
    # the writer of texts puts a row's bytes as they are, with a separator behind
    rows.select(F.col("block").cast("string").alias("value")).write.option("lineSep", MAGIC.decode()).option("compression", "none").text(path)


_PIECE = "part bigint, block bigint, entry bigint, doc_id bigint, n bigint, more boolean, ids array<bigint>, crc bigint"


def _read(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    """Every entry of every block, with its ids or their CRC-32 as 32-bit words."""
    arrow = [pa.int64()] * 5 + [pa.bool_(), pa.list_(pa.int64()), pa.int64()]
    names = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                for part, number, docs, marks, code in blocks_of(content.as_buffer()):
                    ids = unpacked(code)
                    n = marks >> 2
                    cuts = np.append(0, np.cumsum(n))
                    if cuts[-1] != len(ids):
                        raise ValueError(f"block {number} of part {part} has {len(ids)} ids, not {cuts[-1]}")
                    count = len(docs)
                    lists, sums = pa.nulls(count, arrow[6]), pa.nulls(count, pa.int64())
                    if with_ids:
                        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64)))
                    else:
                        raw = ids.astype("<u4").tobytes()
                        sums = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)], pa.int64())
                    own = pa.array(docs, pa.int64(), mask=(marks & 2) > 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part] * count, pa.int64()), pa.array([number] * count, pa.int64()), pa.array(np.arange(count)), own, pa.array(n), pa.array((marks & 1) > 0), lists, sums], names
                    )
        release()

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, _PIECE)


def _placed(pieces: DataFrame) -> DataFrame:
    """Adds first, the number of ids before each entry, and document, that of the entry its document begins with.

    Running sums within blocks, over the blocks of a part, and over the parts: a row a block and a row a part.
    """
    blocks = pieces.groupBy("part", "block").agg(F.sum("n").alias("n"))
    parts = blocks.groupBy("part").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("part", before(Window.orderBy("part")).alias("of_part"))
    blocks = blocks.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("of_block")).join(parts, "part")
    blocks = blocks.select("part", "block", (F.col("of_part") + F.col("of_block")).alias("of_block"))
    within = before(Window.partitionBy("part", "block").orderBy("entry"))
    return pieces.withColumn("within", within).join(blocks, ["part", "block"]).withColumn("first", F.col("of_block") + F.col("within")).drop("within", "of_block")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in all files), ids: a row for each entry of a block, so a long document has several."""
    return _placed(_read(spark, path, True)).select("doc_id", F.col("first").alias("start"), "ids")


def _crc_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each row's entries (first, n, crc), sorted, the CRC of all their ids."""
    for batch in batches:
        sums = [joined_crc([(int(e["n"]), int(e["crc"])) for e in row]) for row in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums, pa.int64())], [*batch.schema.names[1:], "ids_crc32"])


_POLYNOMIAL = 0xEDB88320


def _times(matrix: list[int], vector: int) -> int:
    out, k = 0, 0
    while vector:
        if vector & 1:
            out ^= matrix[k]
        vector >>= 1
        k += 1
    return out


@cache
def _zeros(power: int) -> tuple[int, ...]:
    """What 2 ** power zero bits do to a CRC, as a matrix over two elements."""
    if power == 0:
        return (_POLYNOMIAL, *(1 << k for k in range(31)))
    half = list(_zeros(power - 1))
    return tuple(_times(half, row) for row in half)


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of 32-bit words from (words, CRC-32) of each stretch of them: a CRC is linear in its bits."""
    total = 0
    for n, crc in parts:
        bits, power = 32 * n, 0
        while bits:
            if bits & 1:
                total = _times(list(_zeros(power)), total)
            bits >>= 1
            power += 1
        total ^= crc
    return total


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files.

    The entries of a document that goes over blocks are brought together by the number of its first id.
    """
    pieces = checkpointed(_read(spark, path, False).drop("ids"))
    placed = _placed(pieces)
    whole = placed.filter("not more and entry > 0").select("doc_id", F.col("first").alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    # an entry that goes on, and the first of a block, may belong to a document of several blocks
    rest = placed.filter("more or entry = 0")
    begins = Window.partitionBy("part").orderBy("block", "entry")
    rest = rest.withColumn("follows", F.lag("more", 1, False).over(begins))
    rest = rest.withColumn("document", F.sum(F.when(F.col("follows"), 0).otherwise(1)).over(begins))
    entry = F.struct("first", "n", "crc")
    grouped = rest.groupBy("part", "document").agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.max("doc_id").alias("doc_id"), F.min("first").alias("start"), F.sum("n").alias("n_tokens"))
    joined = grouped.select("entries", "doc_id", "start", "n_tokens").mapInArrow(_crc_joined, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return whole.unionByName(joined)


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    try:
        write_tokens(table(spark, sf_dir, "documents"), path)
        return checkpointed(token_index(spark, path))
    finally:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
