"""Op 11: all runs (maximal periodic stretches of words) of whole texts.

Documents are worked on in chunks of whole texts. Prefix doubling sorts the suffixes of a chunk,
each document for itself, and leaves the names of all its factors of 1, 2, 4, ... words; from the
suffix array come LCP, the longest previous factor (LPF) of every position with a place where it
occurs before, and the LZ blocks. A run that touches the start of a block is found there by Main's
extensions: for every period that can matter, how far the text agrees with itself a period on,
forward and backward. Every other run lies strictly inside a block and is copied from the block's
earlier occurrence, start by start from buckets, so that all runs are found in n log n steps.

Why these are all: let [i, j] be a run of period p, b the start of a block (or the text's end). If
the block of word j + 1 starts before i, the run is strictly inside it. Else some b is in [i, j + 1].
A block that starts in [i + p, j] reaches j, as what follows occurred p words before.
Where there is one, the first such b has p < |block before| + |block|: compare b - p with b. Else if
some b is in [i, i + p), the last one's block reaches j and has more than p words: compare b with
b + p. Else b = j + 1 and the block before has more than 2p words: compare b - p with b.

A null or empty text, and one of blanks, has no words and no runs. Texts are taken whole, however
long: a text longer than a chunk is a chunk alone. Words are compared exactly, as bytes. Of runs that tie for the greatest
length the first start counts, then the least period; repeated rows are worked on each by itself;
an empty table gives no rows. Only the id and the text are read, other columns may have any name.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.sources.tables import spread

from .common import release, table

#: Words that a run has at least.
LEAST = 12
#: Words of a chunk; a longer text is a chunk of its own.
CHUNK_WORDS = 1 << 17
#: Positions below which a search goes on one by one.
FEW = 48


class Suffixes:
    """Sorted suffixes of several texts, one after the other, with the names of their factors.

    names[k][i] names the factor of 2 ** k words that starts at i, cut at its text's end: equal names
    of two places of a text mean equal whole factors. The last names are all different.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n = len(words)
        ends = np.cumsum(sizes)
        self.end = np.repeat(ends, sizes)
        self.begin = np.repeat(ends - sizes, sizes)
        key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1) + words
        self.array = np.argsort(key, kind="stable")
        key = key[self.array]
        first = np.ones(n, bool)
        first[1:] = key[1:] != key[:-1]
        name = np.empty(n, np.int32)
        name[self.array] = np.flatnonzero(first)[np.cumsum(first) - 1] if n else 0
        self.names = [name]
        # the level of names at which each place of the array parts from the place before it
        self.parted = np.where(first, 0, -1).astype(np.int8)
        while True:
            shared = self.parted < 0
            place = np.flatnonzero(shared | np.append(shared[1:], False))
            if not len(place):
                break
            step = 1 << (len(self.names) - 1)
            at = self.array[place]
            after = at + step
            inside = after < self.end[at]
            follows = np.where(inside, name[np.where(inside, after, 0)].astype(np.int64) + 1, 0)
            key = name[at].astype(np.int64) * (n + 1) + follows
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            self.array[place] = at
            first = np.ones(len(key), bool)
            first[1:] = key[1:] != key[:-1]
            name = name.copy()
            name[at] = place[np.flatnonzero(first)[np.cumsum(first) - 1]]
            fresh = place[first]
            fresh = fresh[self.parted[fresh] < 0]
            self.parted[fresh] = len(self.names)
            self.names.append(name)

    def lcp(self) -> np.ndarray:
        """Common words of each suffix in order with the one before it."""
        out = np.zeros(len(self.array), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            some = np.flatnonzero(self.parted > level)
            ok = self._same(level, self.array[some - 1] + out[some], self.array[some] + out[some], self.end[self.array[some]])
            out[some[ok]] += 1 << level
        return out

    def _same(self, level: int, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        ok = (i < end) & (j < end)
        name = self.names[level]
        return ok & (name[np.where(ok, i, 0)] == name[np.where(ok, j, 0)])

    def forward(self, i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Words that agree from places i and j on, pair by pair."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            out += self._same(level, i + out, j + out, end).astype(np.int64) << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Words that agree right before places i < j, pair by pair."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            step = out + (1 << level)
            ok = i - step >= begin
            name = self.names[level]
            ok &= name[np.where(ok, i - step, 0)] == name[np.where(ok, j - step, 0)]
            out[ok] = step[ok]
        return out


def _nearest_before(sa: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix array: the nearest place to the left whose suffix starts earlier, and their
    common words; none (0 common words) where nothing is in common."""
    to, common = np.arange(len(sa)) - 1, lcp.copy()
    active = np.flatnonzero(common > 0)
    active = active[sa[to[active]] > sa[active]]
    while len(active) >= FEW:  # places jump together over what others have passed
        over = to[active]
        common[active], to[active] = np.minimum(common[active], common[over]), to[over]
        active = active[common[active] > 0]
        active = active[sa[to[active]] > sa[active]]
    for x in active.tolist():
        y, c, own = int(to[x]), int(common[x]), int(sa[x])
        while c and sa[y] > own:
            y, c = int(to[y]), min(c, int(common[y]))
        to[x], common[x] = y, c
    return to, common


def longest_previous(suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """By position: the longest factor that also starts earlier in its text, and where."""
    sa, lcp, n = suffixes.array, suffixes.lcp(), len(suffixes.array)
    left, common = _nearest_before(sa, lcp)
    right, other = _nearest_before(sa[::-1], np.append(lcp[1:], 0)[::-1])
    right, other = (n - 1 - right)[::-1], other[::-1]
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    length[sa] = np.maximum(common, other)
    source[sa] = sa[np.where(common >= other, left, right).clip(0, max(0, n - 1))] if n else 0
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Starts of the LZ blocks: each is the longest previous factor, or a word that is new."""
    starts, at, steps = [], 0, np.maximum(length, 1).tolist()
    while at < len(steps):
        starts.append(at)
        at += steps[at]
    return np.array(starts, np.int64)


def _counted(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row its number and 1 to count."""
    row = np.repeat(first, count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + 1


def all_runs(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (start, end, period) of the runs of several texts, sorted; end is the last word's place in the chunk.

    A run has at least ``least`` words and twice its smallest period.
    """
    none = np.zeros((0, 3), np.int64)
    if not len(words):
        return none
    s = Suffixes(words, sizes)
    length, source = longest_previous(s)
    # the part of a run after its first period occurs a period before
    if length.max() < (least + 1) // 2:
        return none
    starts = blocks(length)
    ends = np.cumsum(sizes[sizes > 0])
    b = np.union1d(starts, ends)
    at_end = np.isin(b, ends)
    home = np.minimum(b, len(words) - 1)
    size = np.diff(b, append=b[-1])
    before = np.append(0, size[:-1])
    new_text = s.begin[home] == b  # the end of one text is the start of the next
    # as the end of a text: periods into its last block; as a start of a block: both ways
    e = np.flatnonzero(at_end)
    i = np.flatnonzero(~new_text & (b < len(words)))
    half = (least + 1) // 2
    right = np.flatnonzero((size > half) & (b < len(words)))
    left = i[before[i] + size[i] > half]
    e = e[before[e] > half]
    r_row, r_period = _counted(right, size[right] - 1)
    l_row, l_period = _counted(left, np.minimum(before[left] + size[left] - 1, b[left] - s.begin[home[left]]))
    e_row, e_period = _counted(e, before[e] - 1)
    x = np.concatenate([b[r_row], b[l_row] - l_period, b[e_row] - e_period])
    p = np.concatenate([r_period, l_period, e_period])
    text = np.concatenate([b[r_row], b[l_row] - 1, b[e_row] - 1])  # a word of the text in question
    begin, end = s.begin[text], s.end[text]
    if least > 4 and len(s.names) > 1:  # two words at least agree right after or right before x
        pair = s.names[1]
        last = len(words) - 1
        ok = (x + p < end) & (pair[np.minimum(x, last)] == pair[np.minimum(x + p, last)])
        ok |= (x - 2 >= begin) & (pair[np.maximum(x - 2, 0)] == pair[np.maximum(x + p - 2, 0)])
        x, p, begin, end = x[ok], p[ok], begin[ok], end[ok]
    back, on = s.backward(x, x + p, begin), s.forward(x, x + p, end)
    ok = back + on + p >= np.maximum(least, 2 * p)
    if not ok.any():
        return none
    first, last, p = (x - back)[ok], (x + p + on - 1)[ok], p[ok]
    order = np.lexsort((p, last, first))
    first, last, p = first[order], last[order], p[order]
    once = np.ones(len(p), bool)  # a multiple of the smallest period has the same ends
    once[1:] = (first[1:] != first[:-1]) | (last[1:] != last[:-1])
    buckets: dict[int, list] = defaultdict(list)
    for i, j, q in zip(first[once].tolist(), last[once].tolist(), p[once].tolist(), strict=True):
        buckets[i].append((j, q))
    _copied(buckets, starts, np.diff(starts, append=len(words)), source, least, s)
    rows = [(i, j, q) for i in sorted(buckets) for j, q in sorted(buckets[i], key=lambda run: run[1])]
    return np.array(rows, np.int64).reshape(-1, 3)


def _copied(buckets: dict[int, list], starts: np.ndarray, size: np.ndarray, source: np.ndarray, least: int, s: Suffixes) -> None:
    """Adds the runs strictly inside blocks: those of the earlier occurrence, from the text's start on."""
    some = np.zeros(len(s.end) + 1, bool)
    some[list(buckets)] = True
    seen = np.cumsum(some)
    has_runs = seen[s.end[starts] - 1] > np.where(s.begin[starts] > 0, seen[s.begin[starts] - 1], 0)
    for h in np.flatnonzero((size >= least + 2) & has_runs).tolist():
        b, n = int(starts[h]), int(size[h])
        src = int(source[b])
        for i in range(src + 1, src + n - least):  # a block may reach into what it copies, so starts come in order
            for j, q in buckets.get(i, ()):
                if j < src + n - 1:
                    buckets[i + b - src].append((j + b - src, q))


def _worked(texts: list[list[bytes]], least: int) -> Iterator[tuple[list, bytes]]:
    """Runs (start, length, period) of each text, given as words, and the words left of it."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(t) for t in texts], np.int64)
    words = np.array([number[w] for t in texts for w in t], np.int64)
    found = all_runs(words, sizes, least)
    offset = np.cumsum(sizes) - sizes
    cuts = np.searchsorted(found[:, 0], np.append(offset, len(words)))
    for k, text in enumerate(texts):
        a, z = cuts[k], cuts[k + 1]
        if a == z:
            yield [], b" ".join(text)
            continue
        start, last, period = (found[a:z] - [offset[k], offset[k], 0]).T
        depth = np.zeros(len(text) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, last + 1, -1)
        runs = np.stack([start, last - start + 1, period], axis=1).tolist()
        yield runs, b" ".join(compress(text, (np.cumsum(depth[:-1]) == 0).tolist()))


RUN = "start bigint, length bigint, period bigint"


def find_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", least: int = LEAST) -> DataFrame:
    """The key of every row, runs (sorted by start, then period) and collapsed: the text without repeats.

    A word is left out where a run contains it after the run's first period.
    """
    kind = docs.select(key).schema[0].dataType
    schema = f"{key} {kind.simpleString()}, runs array<struct<{RUN.replace(' bigint', ': bigint')}>>, collapsed string"
    arrow_runs = pa.list_(pa.struct([(c.split()[0], pa.int64()) for c in RUN.split(", ")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            at = 0
            while at < batch.num_rows:
                part: list[list[bytes]] = []
                count = 0
                while at + len(part) < batch.num_rows and (not part or count < CHUNK_WORDS):
                    value = texts[at + len(part)]
                    words = value.as_py().split() if value.is_valid else []  # bytes split at ASCII blanks
                    if part and count + len(words) > CHUNK_WORDS:
                        break
                    part.append(words)
                    count += len(words)
                runs, left = zip(*_worked(part, least), strict=True)
                of_runs = pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in runs], arrow_runs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), of_runs, pa.array(left, pa.binary()).cast(pa.string())], [key, "runs", "collapsed"])
                at += len(part)
        release()

    return spread(docs.select(key, F.col(text).alias("text"))).mapInArrow(run, schema)


def longest(runs: Column) -> Column:
    """The run with most words; of several the first start, then the least period."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period"))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the text of every tenth hash of the id repeats a part of its words to its end."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    h = F.crc32(F.col("doc_id").cast("string"))

    def repeated(w: Column) -> Column:
        n = F.size(w)
        g = F.floor(h / 10)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.array_join(F.concat(F.slice(w, 1, a), F.transform(F.sequence(a, n - 1), lambda i: w[a + (i - a) % p])), " ")

    text = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_runs(planted(table(spark, sf_dir, "documents")))
    best = longest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return rows.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
