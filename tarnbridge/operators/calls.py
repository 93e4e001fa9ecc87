"""Calls of a model or service from tasks: several in flight, answers in order, each call tried again for itself.

A worker holds a window of calls at a time, so a slow service does not leave it waiting for one answer
after the other, and no more than the window's inputs and answers are held. What fails for good becomes a row
with an error beside the rows that went well, for a reject table; no other row is lost with it.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Seconds to wait after each failed call; one call for each.
WAITS = (0.2, 0.5, 1.0)
#: Calls in flight of a worker, and rows of a call.
WINDOW, BATCH = 8, 128


def retried(call: Callable[[Any], Any], waits: Sequence[float] = WAITS) -> Callable[[Any], Any]:
    """The same function, called again where it fails, once for each wait; then its last error is raised."""

    def again(x: Any) -> Any:
        for i, wait in enumerate(waits):
            try:
                return call(x)
            except Exception:  # whatever a client raises
                if i + 1 == len(waits):
                    raise
                time.sleep(wait)
        raise ValueError("no call is allowed")

    return again


def in_flight(items: Iterator, call: Callable[[Any], Any], window: int = WINDOW) -> Iterator[tuple[Any, Any, Exception | None]]:
    """(item, answer, error) of each item, in the order of the items, with up to ``window`` calls at a time.

    Items are taken as places become free. The oldest call decides what comes next, so its answer comes first.
    """
    with ThreadPoolExecutor(max_workers=window) as pool:
        waiting: deque[tuple[Any, Future]] = deque()

        def oldest() -> tuple[Any, Any, Exception | None]:
            item, future = waiting.popleft()
            error = future.exception()
            return item, None if error else future.result(), error

        for item in items:
            if len(waiting) == window:
                yield oldest()
            waiting.append((item, pool.submit(call, item)))
        while waiting:
            yield oldest()


def called(rows: DataFrame, key: str, text: str, call: Callable[[list[str]], Sequence], answer: str, batch: int = BATCH, window: int = WINDOW, waits: Sequence[float] = WAITS) -> DataFrame:
    """key, answer and error of every row; ``call`` gets up to ``batch`` texts and gives as many answers.

    answer is the type of an answer. A call that fails for all its tries, or that gives another number of
    answers, is repeated row by row, so only rows that fail by themselves get an error and a null answer. The
    caller keeps the result (a checkpoint or table) before it parts good rows from rejects, or calls are made twice.
    """
    kind = rows.schema[key].dataType.simpleString()

    def answers(texts: list[str]) -> list:
        out = list(call(texts))
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} answers to {len(texts)} texts")
        return out

    ask = retried(answers, waits)

    def each(part: pd.DataFrame) -> pd.DataFrame:
        texts = part["text"].tolist()
        try:
            found, errors = ask(texts), [None] * len(texts)
        except Exception as error:
            if len(texts) == 1:
                found, errors = [None], [f"{type(error).__name__}: {error}"]
            else:
                singles = [each(part.iloc[[i]]) for i in range(len(part))]
                return pd.concat(singles)
        return pd.DataFrame({"key": part["key"].tolist(), "answer": found, "error": errors})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (pdf.iloc[at : at + batch] for pdf in batches for at in range(0, len(pdf), batch))
        for _, found, error in in_flight(parts, each, window):
            if error is not None:
                raise error
            yield found

    out = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, answer {answer}, error string")
    return out.withColumnRenamed("key", key)


def parted(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that have an answer, and the rejects (with their error)."""
    return answers.filter("error is null").drop("error"), answers.filter("error is not null").drop("answer")
