import hashlib
import math
from collections import Counter

import numpy as np

from tarnbridge.llm import vector_codes as V

SCHEMA = "vec_id bigint, embedding array<float>, label int, code string, weight string"


def plain(rows, parts=V.PARTS, entries=V.ENTRIES, rounds=V.ROUNDS):
    """(vec_id, label, codes, error) of every row and the codebooks, with Python's own integers."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(V.SCALE * x) for x in r[1]]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = -(-len(good[0][1]) // parts)
    cut = []
    for r in good:
        v = [math.floor(V.SCALE * x) for x in r[1]] + [0] * (parts * width - len(r[1]))
        cut.append([tuple(v[p * width : (p + 1) * width]) for p in range(parts)])
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        moved = []
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(p, c[p])[1], []).append(c[p])
            moved.append([[sum(x) // len(members[i]) for x in zip(*members[i], strict=True)] if i in members else e for i, e in enumerate(books[p])])
        books = moved
    best = [[near(p, c[p]) for p in range(parts)] for c in cut]
    return [(r[0], r[2], [i for _, i in b], sum(e for e, _ in b)) for r, b in zip(good, best, strict=True)], books


def check(spark, rows, **kind):
    df, books = V.encode_vectors(spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA), **kind)
    want, want_books = plain(rows, **kind)
    assert Counter(map(repr, ((r["vec_id"], r["label"], r["codes"], r["error"]) for r in df.collect()))) == Counter(map(repr, want))
    assert books.tolist() == want_books
    assert V.books_digest(books) == hashlib.sha256(",".join(str(x) for b in want_books for e in b for x in e).encode()).hexdigest()


def test_against_plain_integers(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, 32)], int(i % 3)) for i in rng.permutation(150)]
    check(spark, rows)


def test_hot_parts_ties_and_repeats(spark):
    rows = [(i, [0.5, -0.5] * 8, None) for i in range(40)] + [(i % 50, [(i % 5) / 7, (i % 3) / 5] * 8, i % 2) for i in range(40, 200)]
    rows += [(7, [0.5, -0.5] * 8, None)] * 3 + [(None, [0.25] * 16, 1)] * 2
    check(spark, rows, entries=4)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None, 1), (2, [], 1), (3, [None] * 20, 1), (4, [nan] * 20, 1), (5, [inf] * 20, None), (6, [0.1] * 20, None), (7, [-0.001] * 20, 2), (8, [0.1] * 16, 2), (9, [0.3, None] * 10, 2)]
    check(spark, rows)  # 20 is no multiple of 16, 8 has another length
    df, books = V.encode_vectors(spark.createDataFrame([(10, [3e38] * 16, 1, "x", "x"), (11, [-3e38] * 16, 1, "x", "x")], SCHEMA))
    assert {r["vec_id"]: r["error"] for r in df.collect()} == {10: 0, 11: 0} and books.shape == (16, 2, 1)
    for rows in ([], [(1, None, 1, "x", "x")]):
        df, _ = V.encode_vectors(spark.createDataFrame(rows, SCHEMA))
        assert df.count() == 0 and df.columns == ["vec_id", "label", "codes", "error"]


def test_query_on_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert V.op12_vector_codes(spark, str(tmp_path)).count() == 0


def test_large_sums_are_exact(spark):
    rows = [(i, [float(200_000 + i % 2)] * 16, 1) for i in range(300)]
    check(spark, rows, entries=1)
