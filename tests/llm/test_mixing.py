import re
from collections import defaultdict

import pytest

from tarnbridge.llm import mixing as M

from .conftest import ODD


def water(sizes):
    """Targets of sources in order, by sharing the excess again until there is none."""
    weights = [M.WEIGHTS[i % 3] for i in range(len(sizes))]
    budget, full, out = M.SHARE * sum(sizes), set(), [0.0] * len(sizes)
    while True:
        open_ = [i for i in range(len(sizes)) if i not in full]
        left = budget - sum(2 * sizes[i] for i in full)
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if total and left * weights[i] / total > 2 * sizes[i]]
        if not over:
            for i in range(len(sizes)):
                out[i] = 2.0 * sizes[i] if i in full else left * weights[i] / total
            return out
        full |= set(over)


@pytest.mark.parametrize("bin_rows", [50_000, 3])
@pytest.mark.parametrize("shape", [{"a": 500, "b": 300, "c": 200}, {"a": 10, "b": 900, "c": 800, "d": 5, None: 300}, {"one": 50}])
def test_targets_and_takings(docs, monkeypatch, shape, bin_rows):
    monkeypatch.setattr(M, "BIN_ROWS", bin_rows)
    rows, i = [], 0
    for source, n in shape.items():
        for _ in range(n):
            rows.append((i, "w " * (i % 13), source))
            i += 1
    out = M.mix_documents(docs(rows)).collect()
    again = M.mix_documents(docs(rows[::-1])).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))
    source = {r[0]: r[2] for r in rows}
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", rows[r["doc_id"]][1])) and r["taken"] in (0, r["size"], 2 * r["size"])
        s = source[r["doc_id"]]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    order = sorted(shape, key=lambda s: (s is None, s or ""))
    assert [target[s] for s in order] == pytest.approx(water([size[s] for s in order]))
    assert all(abs(taken[s] - target[s]) <= 13 for s in order)
    assert sum(taken.values()) <= M.SHARE * sum(size.values()) + 1e-6


def test_stream_is_the_mix_in_order(docs):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(200)]
    d = docs(rows)
    mixed = M.mixed_stream(d)
    assert mixed.columns == d.columns
    got = [r["doc_id"] for r in mixed.collect()]
    table = {r["doc_id"]: r for r in M.mix_documents(d).collect()}
    want = sorted((f, f"a:s{i % 3}", p, i) for i, r in table.items() for p, f in ((1, r["finish_1"]), (2, r["finish_2"])) if r["taken"] >= p * r["size"])
    assert got == [i for *_, i in want]


def test_odd_rows(docs):
    rows = M.mix_documents(docs(ODD)).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert {r["size"] for r in rows if r["doc_id"] in (1, 2, 3)} == {0}
    assert M.mix_documents(docs([])).count() == 0 and M.mixed_stream(docs([])).count() == 0
    assert {r["taken"] for r in M.mix_documents(docs([(1, ""), (2, None)])).collect()} == {0}


def test_stream_has_documents_of_size_zero_once(docs):
    empty = [(1000, None, "s0"), (1001, "", "s1"), (1002, " \n", "s2"), (1003, "", "only empty")]
    d = docs([(i, "w " * (1 + i % 5), f"s{i % 3}") for i in range(200)] + empty)
    got = [r["doc_id"] for r in M.mixed_stream(d).collect()]
    want, total = [], 0
    for r in sorted(M.servings(M.queue(d)).collect(), key=lambda r: (r["finish"], r["skey"], r["serving"], r["k"])):
        total += r["size"]
        if total > r["budget"]:
            break
        if r["serving"] == 1 and not r["size"]:
            want.append(r["doc_id"])
    want.sort()
    assert 1003 in want and sorted(i for i in got if i >= 1000) == want
    assert sorted(r["doc_id"] for r in M.mixed_stream(docs(empty)).collect()) == [1000, 1001, 1002, 1003]


def test_rows_without_an_id_are_spread(docs):
    """Rows that share a doc_id, or have none, are ordered by their texts."""
    d = docs([(None, "w " * (1 + i % 5) + str(i), "s") for i in range(300)] + [(7, "v " * (1 + i % 5) + str(i), "t") for i in range(300)])
    assert M._rows(d, {}).select("k").distinct().count() == 600
    out = M.mix_documents(d).collect()
    assert abs(sum(r["taken"] for r in out) - M.SHARE * sum(r["size"] for r in out)) <= 12


def test_clashing_names(spark):
    rows = [(i, "w " * (i % 4), "s", i, i, "x", "y", "z") for i in range(30)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, _keep_0 int, skey string, k string, `a.b` string")
    got = M.mixed_stream(d)
    assert got.columns == d.columns and set(map(tuple, got.collect())) <= set(rows)
