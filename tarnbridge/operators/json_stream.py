"""JSON objects that follow each other in files, in any layout, read in ranges that are split anywhere.

Where an object starts depends on all bytes before: how deep the braces are, whether a string is open,
whether a backslash came last. So a range is first read as a function of the state before it; the functions
of a file's ranges are composed from its start on, a row a range; then each range knows its state and
gives the objects that end in it. Objects over several ranges are put together from their parts.

The function of a range has a row for each of three kinds of state (outside strings, inside one, after
a backslash inside one) and each depth at which the range comes back to depth 0: from there on it is the
same whatever came before, as outside objects all bytes but an opening brace count for nothing. From
greater depths it only changes the depth.

Files are split by Spark at closing braces, as lines are at line breaks, so a file without line breaks is
split like any other. A worker holds some megabytes of a range at a time, whatever its size: the first
reading gives a function for each such part, the second carries the state from part to part.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnbridge.session import shared_folder
from tarnbridge.sources.tables import is_small

#: Kinds of state: outside strings, inside a string, after a backslash inside one.
PLAIN, QUOTED, ESCAPED = 0, 1, 2
#: Braces within each other at most; more are an error, as for the parser of objects.
MOST_DEPTH = 900
#: Ranges whose states are broadcast at most, some hundred bytes each.
FEW_RANGES = 100_000
#: Bytes of a range that a worker holds at a time.
HELD = 1 << 22

_REST = re.compile(rb'[^"\\]*(?:\\.[^"\\]*)*', re.S)
_NEXT = re.compile(rb'[{}"]')


def _string_end(data: bytes, at: int) -> tuple[int, int]:
    """Place after the string that is open at a place, and PLAIN; or the end and the kind there."""
    to = _REST.match(data, at).end()
    if to < len(data) and data[to] == 0x22:
        return to + 1, PLAIN
    return len(data), ESCAPED if to < len(data) else QUOTED  # all that stops before a quotation mark is a last backslash


def _inside(data: bytes, at: int, kind: int, depth: int) -> Iterator[tuple[int, int, int]]:
    """(place after it, depth, kind) at each brace from a state inside an object, and at the end; the caller stops at depth 0."""
    if kind != PLAIN:
        if at == len(data):
            yield at, depth, kind
            return
        at, kind = _string_end(data, at + (kind == ESCAPED))
    while kind == PLAIN:
        m = _NEXT.search(data, at)
        if m is None:
            at = len(data)
            break
        at = m.end()
        if m[0] == b'"':
            at, kind = _string_end(data, at)
        else:
            depth += 1 if m[0] == b"{" else -1
            yield at, depth, PLAIN
    yield at, depth, kind


class Range:
    """A range's bytes, and what it does to a state (depth, kind)."""

    def __init__(self, data: bytes):
        self.data = data
        self._from: dict[int, list] = {}
        self.left = (0, PLAIN)

    def ends(self, at: int, kind: int, depth: int) -> Iterator[tuple[int, int]]:
        """(start or -1, end) of each object that ends in the range; then (start or -1, -1) of one that is left open. Raises where it is too deep.

        When all are read, left is the state (depth, kind) after the range.
        """
        start = -1
        if depth:
            at = yield from self._object(at, kind, depth, start)
        while at >= 0:
            start = self.data.find(b"{", at)
            if start < 0:
                return
            at = yield from self._object(start + 1, PLAIN, 1, start)

    def _object(self, at: int, kind: int, depth: int, start: int) -> Iterator[tuple[int, int]]:
        for to, depth, kind in _inside(self.data, at, kind, depth):  # noqa: B007
            if not depth:
                yield start, to
                return to
            if depth > MOST_DEPTH:
                raise ValueError(f"more than {MOST_DEPTH} braces within each other")
        self.left = (depth, kind)
        yield start, -1
        return -1

    def fresh(self, at: int) -> list:
        """[depth, kind, objects that end, start of the one left open] from depth 0 at a place on; each object is read once."""
        path = []
        result = [0, PLAIN, 0, -1]
        while True:
            start = self.data.find(b"{", at)
            if start < 0:
                break
            if start in self._from:
                result = self._from[start]
                break
            for to, depth, kind in _inside(self.data, start + 1, PLAIN, 1):  # noqa: B007
                if not depth:
                    break
            if depth:
                result = self._from[start] = [depth, kind, 0, start]
                break
            path.append(start)
            at = to
        for start in reversed(path):
            result = self._from[start] = [result[0], result[1], result[2] + 1, result[3]]
        return result

    def function(self) -> list:
        """For each kind: results by depth from 0 (or 1) up to where the range no longer comes to depth 0, and (change of depth, kind) beyond."""
        out = []
        for kind in (PLAIN, QUOTED, ESCAPED):
            by_depth, lowest = [self.fresh(0) if kind == PLAIN else None], 0
            change, last = 0, kind
            for to, change, last in _inside(self.data, 0, kind, 0):
                if change < lowest and len(by_depth) <= MOST_DEPTH:
                    lowest = change
                    depth, left, n, start = self.fresh(to)
                    by_depth.append([depth, left, n + 1, start])
            out.append([by_depth, [change, last]])
        return out


def after(function: list, depth: int, kind: int) -> list:
    """[depth, kind, objects that end, start of the one left open (-1: the one before, or none)] after a range."""
    by_depth, (change, last) = function[kind]
    if depth < len(by_depth):
        return by_depth[depth]
    return [depth + change, last, 0, -1]


def _ranges(lines: DataFrame, begin, schema: str) -> DataFrame:
    """use(bytes, part, whether it is the last part, *other columns) for each part of a range, in order; begin() gives a task its use.

    A range is the rows, in order, that are equal in the columns path and start, which come second and third.
    """
    most = HELD

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rest, held, size, part = None, (), [], 0, 0
        use = begin()

        def told(final: bool) -> Iterator[pa.RecordBatch]:
            yield from use(b"}".join([*held, b""]), part, final, *rest)

        for batch in batches:
            name = lambda i, batch=batch: (batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
            at = 0
            while at < batch.num_rows:
                to = batch.num_rows
                if name(at) != name(to - 1):  # where the first range of the batch ends
                    to = next(i for i in range(at + 1, to) if name(i) != name(at))
                if name(at) != key:
                    if held:
                        yield from told(True)
                    key, held, size, part = name(at), [], 0, 0
                    rest = tuple(batch.column(i)[at].as_py() for i in range(1, batch.num_columns))
                elif size >= most:
                    yield from told(False)
                    held, size, part = [], 0, part + 1
                new = batch.column(0).slice(at, to - at).to_pylist()
                held += new
                size += sum(map(len, new)) + len(new)
                at = to
        if held:
            yield from told(True)

    return lines.mapInArrow(run, schema)


_FUNCTION = "path string, start bigint, part bigint, size bigint, file_size bigint, function string"
_STATE = "path string, start bigint, depth int, kind int, objects bigint, at bigint, size bigint, opened bigint, last boolean, extra boolean"
_PIECE = "path string, pos bigint, part bigint, json binary"


def _rows(schema: str, rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for n, c in zip(names, columns, strict=True)], names)


def _function(data: bytes, part: int, final: bool, path: str, start: int, file_size: int) -> Iterator[pa.RecordBatch]:
    row = (path, start, part, len(data), file_size, json.dumps(Range(data).function()))
    yield _rows(_FUNCTION, [row], {"path": pa.string(), "function": pa.string()})


def _states(rows: pd.DataFrame) -> pd.DataFrame:
    """The state before each range of a file: depth, kind, objects that have ended, bytes, start of the open object."""
    depth, kind, objects, at, opened = 0, PLAIN, 0, 0, -1
    out = []
    for path, start, part, size, function in rows.sort_values(["start", "part"])[["path", "start", "part", "size", "function"]].itertuples(index=False):
        if part == 0:
            out.append([path, start, depth, kind, objects, at, 0, opened, False, False])
        out[-1][6] += size
        depth, kind, n, first = after(json.loads(function), depth, kind)
        objects += n
        opened = at + first if first >= 0 else (opened if depth else -1)
        at += size
    # every piece counts with a brace behind it, which the last one may not have; a byte order mark is no piece
    extra = at - int(rows["file_size"].iloc[0])
    if extra not in (0, 1, -3, -2):
        raise ValueError(f"{out[0][0]} has changed while it was read")
    out[-1][-2:] = [True, extra in (1, -2)]
    return pd.DataFrame(out, columns=[c.split()[0] for c in _STATE.split(", ")])


class _Cut:
    """The objects, or parts of objects, of ranges whose states before them are known."""

    def __call__(self, data: bytes, part: int, final: bool, path: str, start: int, depth: int | None, kind: int, objects: int, at: int, size: int, opened: int, last: bool, extra: bool) -> Iterator[pa.RecordBatch]:
        if part == 0:
            self.depth, self.kind, self.objects, self.at, self.opened, self.read = depth, kind, objects, at, opened, 0
        self.read += len(data)
        if depth is None or (final and size != self.read):
            raise ValueError(f"{path} was not split as before at byte {start}")
        rows = []
        data = data[:-1] if final and extra else data
        own = Range(data)
        for first, end in own.ends(0, self.kind, self.depth):
            whole = first >= 0 and end >= 0
            rows.append((path, self.objects, -1 if whole else self.at, data[max(first, 0) : end if end >= 0 else len(data)]))
            self.objects += end >= 0
            if end < 0:
                self.opened = self.at + first if first >= 0 else self.opened
                if last and final:
                    raise ValueError(f"{path} ends within an object that starts at byte {self.opened}")
        (self.depth, self.kind), self.at = own.left, self.at + len(data)
        if rows:
            yield _rows(_PIECE, rows, {"path": pa.string(), "json": pa.binary()})


def objects(spark: SparkSession, path: str) -> DataFrame:
    """path, pos (from 0 in each file) and json, the text of each object of all files of a path.

    What lies between objects is passed over; null files and empty ones have none. A file that ends within an
    object is an error that names the byte at which the object starts. Files are read twice, and have to
    be split alike: a file that has changed, or other splits, are an error.
    """
    shared_folder(spark)
    meta = F.col("_metadata")
    lines = spark.read.option("lineSep", "}").text(path).select(
        F.col("value").cast("binary").alias("value"), meta["file_path"].alias("path"), meta["file_block_start"].alias("start"), meta["file_size"].alias("file_size")
    )
    functions = _ranges(lines, lambda: _function, _FUNCTION)
    states = functions.groupBy("path").applyInPandas(_states, _STATE).checkpoint()
    columns = [c.split()[0] for c in _STATE.split(", ")][2:]
    if is_small(states, FEW_RANGES):  # the rows of a range stay where they are, in order
        told = lines.drop("file_size").join(F.broadcast(states), ["path", "start"], "left")
    else:
        order = lines.drop("file_size").withColumn("row", F.monotonically_increasing_id())
        told = order.join(states, ["path", "start"], "left").repartition("path", "start").sortWithinPartitions("path", "start", "row")
    pieces = _ranges(told.select("value", "path", "start", *columns), _Cut, _PIECE)
    whole = pieces.filter("part < 0").select("path", "pos", F.col("json").cast("string").alias("json"))
    parts = pieces.filter("part >= 0").groupBy("path", "pos").agg(F.array_sort(F.collect_list(F.struct("part", "json"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["json"]))
    return whole.unionByName(parts.select("path", "pos", joined.cast("string").alias("json")))


def read_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """path, pos and the columns of the schema of each object; one that is no JSON is an error."""
    rows = objects(spark, path).select("path", "pos", F.from_json("json", schema, {"mode": "FAILFAST"}).alias("_o"))
    return rows.select("path", "pos", "_o.*")
