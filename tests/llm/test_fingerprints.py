import hashlib
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarnbridge.llm import fingerprints as P

from .conftest import ODD


def plain_lanes(text):
    dense = [0] * P.DENSE
    for p in (text or "").split("\n"):
        own = hashlib.sha256(p.encode()).hexdigest()
        d = "".join(hashlib.sha256(f"{own}{i}".encode()).hexdigest() for i in range(4))
        dense = [(x + int(d[P.DIGITS * i : P.DIGITS * (i + 1)], 16)) % P.MOD for i, x in enumerate(dense)]
    units, sums = [u for u in re.split(P.ENDS, text or "") if u], Counter()
    for u in units:
        x = int(hashlib.md5(u.encode()).hexdigest()[:14], 16)
        draw, level = x >> P.LANE_BITS, 0
        while True:
            sums[level * P.SPARSE + x // P.SPARSE_MOD % P.SPARSE] += x % P.SPARSE_MOD
            level += 1
            if level == P.LEVELS or draw % P.RATE**level:
                break
    sums = {k: v % P.SPARSE_MOD for k, v in sums.items()}
    return dense, len(units), [k * P.SPARSE_MOD + v for k, v in sorted(sums.items()) if v]


def plain_written(lanes):
    dense, units, sparse = lanes
    return ".".join(["".join(f"{x:014x}" for x in dense), f"{units:x}", "".join(f"{x:07x}" for x in sparse)])


def plain(row):
    return list(row["dense"]), row["units"], list(row["sparse"])


def lanes_of(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [plain(r["v"]) for r in rows.select("i", P.lanes(F.coalesce("t", F.lit(""))).alias("v")).orderBy("i").collect()]


def test_lanes_against_plain_python(spark):
    texts = ["a\nb\na", "", None, "one", "\n\n", "One. Two! Three?\nOne. Two... x", "".join(f"Sentence number {i}. " for i in range(5000))]
    assert lanes_of(spark, *texts) == [plain_lanes(t) for t in texts]


def test_homomorphic(spark):
    long = "\n".join(f"line {i}. and {i}" for i in range(300))
    rows = spark.createDataFrame([("x\ny", "z\nx"), (long, "new 1\nline 7. and 7"), ("a\nb", long)], "a string, b string")
    whole = P.lanes(F.concat("b", F.lit("\n"), "a"))
    back = P.delete(P.insert(P.lanes(F.col("a")), F.col("b")), F.col("b"))
    for r in rows.select(P.insert(P.lanes(F.col("a")), F.col("b")).alias("sum"), whole.alias("whole"), back.alias("back"), P.lanes(F.col("a")).alias("own"), P.written(whole).alias("w")).collect():
        assert plain(r["sum"]) == plain(r["whole"]) and plain(r["back"]) == plain(r["own"]) != plain(r["sum"]) and r["w"] == plain_written(plain(r["whole"]))


@pytest.mark.parametrize("sentences", [False, True])
def test_likeness(spark, sentences):
    """Whatever the length, and in one line, too: equal 1, a tenth replaced much, half replaced less, others nearly nothing."""
    texts = []
    for n in (40, 150, 400, 3000):
        parts = [f"part {i}" for i in range(n)]
        half, tenth = (parts[: n - n // k] + [f"new {i}" for i in range(n // k)] for k in (2, 10))
        texts += [(n, "half", parts, half), (n, "tenth", parts, tenth), (n, "other", parts, [f"other {i}" for i in range(n)]), (n, "same", parts, parts)]
    by = ". " if sentences else "\n"
    rows = spark.createDataFrame([(n, k, by.join(a), by.join(b)) for n, k, a, b in texts], "n int, k string, a string, b string")
    found = rows.select("n", "k", P.likeness(P.lanes(F.col("a")), P.lanes(F.col("b"))).alias("x")).collect()
    bounds = {"half": (0.1, 0.62), "tenth": (0.55, 0.99), "other": (0.0, 0.1), "same": (1.0, 1.0)}
    assert all(bounds[r["k"]][0] <= r["x"] <= bounds[r["k"]][1] for r in found), found


def test_order_does_not_matter(spark):
    lines = [f"line {i}. more" for i in range(40)]
    rows = spark.createDataFrame([("\n".join(lines), "\n".join(lines[::-1]))], "a string, b string")
    assert rows.select(P.likeness(P.lanes(F.col("a")), P.lanes(F.col("b")))).collect()[0][0] == 1.0


def test_edges_between_buckets(docs, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    texts = {i: f"text {i}\n" + "word " * (i % 5) for i in range(0, 60, 2)}
    rows = P.fingerprint_documents(docs(list(texts.items()))).collect()
    order = sorted(texts, reverse=True)
    for r in rows:
        own, after = texts[r["doc_id"]], texts[order[(order.index(r["doc_id"]) + 1) % len(order)]]
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and r["n_chars"] == len(own)
        assert r["edited_fingerprint"] == plain_written(plain_lanes(edited))


def test_odd_rows(docs, monkeypatch):
    for size in (1000, 2):
        monkeypatch.setattr(P, "BUCKET_ROWS", size)
        rows = P.fingerprint_documents(docs(ODD)).collect()
        assert len(rows) == len(ODD)
        assert len({r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}) == 1 and len({r["fingerprint"] for r in rows if r["doc_id"] in (1, 2)}) == 1
        assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    one = P.fingerprint_documents(docs([(1, "abc")])).collect()
    assert [(r["edited_sha256"], r["near_next"]) for r in one] == [(hashlib.sha256(b"aba").hexdigest(), 1.0)]
    assert P.fingerprint_documents(docs([])).count() == 0


def test_one_line_has_a_likeness(docs):
    """Half of a text of one line is kept in the edited one, and shows."""
    rows = P.fingerprint_documents(docs([(i, " ".join(f"Sentence {i} {k}." for k in range(20))) for i in range(4)])).collect()
    assert all(0.1 < r["near_edited"] < 0.8 and r["near_next"] < 0.1 for r in rows)
