"""A log of what was called, with arguments, results and times."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "tool string, args string, result string, elapsed_ms double"
CLIP = 2000


def _short(value: object) -> str:
    if isinstance(value, DataFrame):
        return f"DataFrame[{', '.join(value.columns)}]"
    text = json.dumps(value, default=str, ensure_ascii=False)
    return text if len(text) <= CLIP else text[:CLIP] + "..."


class Trace:
    """Calls in order; as_table() makes them rows, of the driver's calls only."""

    def __init__(self) -> None:
        self.calls: list[tuple] = []

    def record(self, tool: str, args: object, result: object, elapsed_ms: float) -> None:
        self.calls.append((tool, _short(args), _short(result), float(elapsed_ms)))

    def traced(self, tool: str) -> Callable:
        def wrap(function: Callable) -> Callable:
            @wraps(function)
            def run(*args, **kwargs):
                began = time.perf_counter()
                try:
                    result = function(*args, **kwargs)
                except Exception as error:
                    self.record(tool, [args, kwargs], {"error": repr(error)}, 1000 * (time.perf_counter() - began))
                    raise
                self.record(tool, [args, kwargs], result, 1000 * (time.perf_counter() - began))
                return result

            return run

        return wrap

    def as_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.calls, SCHEMA)
