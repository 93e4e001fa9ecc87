"""Op 8: chat formatting in budgeted windows.

A turn is written as ``<|im_start|>role``, a newline, its text and ``<|im_end|>``; control strings
inside roles and texts are escaped with a backslash and can be restored. A conversation becomes
one or more windows of whole turns: prefix sums of turn tokens choose how many new turns fit in
the budget; every later window repeats the system turn and as much of the latest history as the limit
of history and what the first new turn leaves of the budget allow. The loss mask covers the text
of new assistant turns only, so repeated turns are masked and each assistant text is a target once.
A turn is never cut: a window exceeds the budget only where the system turn and one new turn do.

Turns are sorted by turn, then role and text; conversations are streamed one after the other, in
memory bounded by a window. A null role or text counts as empty; a null conv_id is a conversation
of its own; equal rows are turns of their own, ties are equal in all that is read; a very long turn
is held as a whole, once; columns other than conv_id, turn, role and text aren't read and may have
any name; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .token_counts import VOCABULARY, encoding

BUDGET = 2048
HISTORY = 512
START, END = "<|im_start|>", "<|im_end|>\n"

#: Control strings of common chat templates, broken up where they occur in a text.
_CONTROL = re.compile(r"\\|<(?=\||s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\])")
_MARK = re.compile(r"\\(\\?)")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)

WINDOWS = "conv_id bigint, window int, text string, n_turns int, n_repeated int, n_tokens int, loss array<struct<first:int,last:int>>"
_WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()),
    ("n_tokens", pa.int32()), ("loss", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
])


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _MARK.sub(lambda m: m[1], text)


def escape_role(role: str) -> str:
    """A role stays on one line, too."""
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\n]?)", lambda m: {"n": "\n"}.get(m[1], m[1]), role)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted window: role and text as they were."""
    return [(unescape_role(a), unescape(b)) for a, b in _TURN.findall(text)]


class _Conversation:
    """Turns come in one by one; windows go out as soon as they are full."""

    def __init__(self, conv_id: int | None, budget: int, history: int):
        self.conv_id, self.budget, self.history = conv_id, budget, history
        self.system: tuple | None = None
        self.repeated: list[tuple] = []
        self.new: list[tuple] = []
        self.tokens, self.windows, self.turns = 0, 0, 0

    def add(self, role: str, text: str, body: str, head: str, tokens: int) -> Iterator[tuple]:
        turn = (role, head, body, tokens)
        if self.turns == 0 and role == "system":
            self.system = turn
        elif self.new and self.new != [self.system] and self.tokens + tokens > self.budget:
            yield self.flush()
            self.repeat(tokens)
        self.new.append(turn)
        self.tokens += tokens
        self.turns += 1

    def flush(self) -> tuple:
        """The window so far."""
        parts, loss, at = [], [], 0
        for i, (role, head, body, _) in enumerate(self.repeated + self.new):
            at += len(head)
            if role == "assistant" and i >= len(self.repeated):
                loss.append({"first": at, "last": at + len(body)})
            parts += [head, body, END]
            at += len(body) + len(END)
        return self.conv_id, self.windows, "".join(parts), len(self.repeated) + len(self.new), len(self.repeated), self.tokens, loss

    def repeat(self, tokens: int) -> None:
        """The next window starts with the system turn and the history that fits beside a new turn of so many tokens."""
        always = [self.system] if self.system else []
        room = min(self.history, self.budget - tokens - sum(t[3] for t in always))
        latest: list[tuple] = []
        for turn in reversed([t for t in self.repeated + self.new if t is not self.system]):
            room -= turn[3]
            if room < 0:
                break
            latest.append(turn)
        self.repeated = always + latest[::-1]
        self.new, self.tokens, self.windows = [], sum(t[3] for t in self.repeated), self.windows + 1


def format_windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per window, the windows of a conversation in order within one partition."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        own: _Conversation | None = None
        out: list[tuple] = []
        table_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _WINDOWS, strict=True)], schema=_WINDOWS)
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own is None or own.conv_id != conv_id:
                    if own is not None:
                        out.append(own.flush())
                    own = _Conversation(conv_id, budget, history)
                head, body = f"{START}{escape_role(role)}\n", escape(text)
                out += own.add(role, text, body, head, len(encode(head + body + END)))
            if out:
                yield table_of(out)
                out = []
        if own is not None:
            yield table_of([*out, own.flush()])

    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(windows, WINDOWS)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, n_windows bigint"
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say, read from their texts and masks alone.

    Takes windows as format_windows() leaves them: a conversation's in a row, in order.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list | None = None
        table_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
        ended = lambda x: (x[0], x[1], x[2].hexdigest(), x[3], x[4].hexdigest(), x[5], x[6])
        for batch in batches:
            out = []
            for w in batch.to_pylist():
                if own is None or own[0] != w["conv_id"]:
                    if own is not None:
                        out.append(ended(own))
                    own = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(w["text"])[w["n_repeated"] :]:
                    own[1] += 1
                    own[2].update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    target = unescape(w["text"][span["first"] : span["last"]])
                    own[3] += len(target)
                    own[4].update(target.encode())
                own[5] += len(w["text"])
                own[6] += 1
            if out:
                yield table_of(out)
        if own is not None:
            yield table_of([ended(own)])

    return windows.mapInArrow(digest, DIGEST)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_windows(rows.unionByName(more)))
