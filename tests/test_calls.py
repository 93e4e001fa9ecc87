import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbridge.operators import calls, embedding, judging


def test_window_and_order():
    """A slow call holds up what comes after it, not the calls beside it; no more than the window are open."""
    lock, open_, most = threading.Lock(), [0], [0]

    def slow(x):
        with lock:
            open_[0] += 1
            most[0] = max(most[0], open_[0])
        time.sleep(0.2 if x % 5 == 0 else 0.02)
        with lock:
            open_[0] -= 1
        if x == 7:
            raise ValueError("seven")
        return x * x

    begin = time.time()
    out = list(calls.in_flight(iter(range(40)), slow, 8))
    assert time.time() - begin < 8 * 0.2 + 32 * 0.02  # one after the other takes 2.24 s
    assert [x for x, _, _ in out] == list(range(40)) and 1 < most[0] <= 8
    assert [a for _, a, _ in out] == [None if x == 7 else x * x for x in range(40)] and str(out[7][2]) == "seven"


def test_items_are_taken_as_places_become_free():
    taken = []

    def items():
        for i in range(100):
            taken.append(i)
            yield i

    found = calls.in_flight(items(), lambda x: x, 4)
    next(found)
    assert len(taken) <= 5 and list(calls.in_flight(iter(()), lambda x: x)) == []


def test_retries_of_a_call():
    seen = []

    def sometimes(x):
        seen.append(x)
        if len(seen) < 3:
            raise OSError("busy")
        return x

    assert calls.retried(sometimes, (0, 0, 0))(5) == 5 and seen == [5, 5, 5]
    with pytest.raises(OSError):
        calls.retried(lambda x: sometimes(seen.clear()), (0, 0))(1)


def test_rows_that_fail_are_rejects(spark):
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)] + [(50, None)], "id int, t string").coalesce(2)

    def model(texts):
        if any(t is None or t.endswith("3") for t in texts):
            raise RuntimeError("bad text")
        return [len(t) for t in texts]

    good, rejects = calls.parted(calls.called(rows, "id", "t", model, "int", batch=7, window=3, waits=(0,)))
    assert {r["id"]: r["answer"] for r in good.collect()} == {i: len(f"t{i}") for i in range(50) if i % 10 != 3}
    assert {r["id"]: r["error"] for r in rejects.collect()} == {i: "RuntimeError: bad text" for i in (3, 13, 23, 33, 43, 50)}
    short = calls.called(rows, "id", "t", lambda texts: [1], "int", batch=5, waits=(0,))
    assert short.filter("error is null").count() == 51  # answers of a wrong number: row by row
    assert calls.called(rows.limit(0), "id", "t", model, "int").count() == 0


def test_a_second_run_embeds_new_texts_only(spark, tmp_path):
    """Also when the first run had rejects, which are tried again."""
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    rows = spark.createDataFrame([(1, "One text"), (2, "one  TEXT"), (3, "two"), (4, " "), (5, None), (6, "bad")], "id int, t string")

    def embed(good, log=str(log)):
        def run(texts):
            import uuid

            with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(texts))
            if not good and "bad" in texts:
                raise RuntimeError("bad")
            return np.array([[len(t), 1.0] for t in texts])

        return run

    def asked():
        out = sorted(t for f in log.iterdir() for t in f.read_text().split("\n"))
        for f in log.iterdir():
            f.unlink()
        return out

    found, rejects = embedding.embedded_with_store(rows, "id", "t", embed(False), 2, store, waits=(0,))
    assert {r["id"]: r["embedding"] for r in found.collect()} == {1: [8, 1], 2: [8, 1], 3: [3, 1]} and rejects.count() == 1
    assert set(asked()) == {"one text", "two", "bad"}
    more = rows.union(spark.createDataFrame([(7, "three"), (8, "TWO")], "id int, t string"))
    found, rejects = embedding.embedded_with_store(more, "id", "t", embed(True), 2, store, waits=(0,))
    assert {r["id"] for r in found.collect()} == {1, 2, 3, 6, 7, 8} and rejects.count() == 0
    assert asked() == ["bad", "three"]


def test_judging_in_flight(spark):
    rows = spark.createDataFrame([(i, str(i)) for i in range(20)], "id int, q string")
    good, rejects = judging.judged_in_flight(rows, "id", F.col("q"), lambda prompts: ['{"score": 5}' if p != "7" else 1 / 0 for p in prompts], window=4, waits=(0,))
    assert sorted(r["id"] for r in good.filter("score = 5 and valid").collect()) == [i for i in range(20) if i != 7]
    assert [(r["id"], r["error"]) for r in rejects.collect()] == [(7, "ZeroDivisionError: division by zero")]
