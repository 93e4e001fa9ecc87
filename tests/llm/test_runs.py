import hashlib
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbridge.llm import runs as R

from .conftest import ODD


def plain_runs(words, least=R.LEAST):
    """(start, length, period) of every run, by every period."""
    found, n = {}, len(words)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            start = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i > start and i + p - start >= max(least, 2 * p):
                found.setdefault((start, i + p - start), p)
            i += 1
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_left(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def with_repeat(words, doc_id):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def fibonacci(n):
    a, b = "0", "01"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


PERIODIC = st.builds(
    lambda head, unit, times, extra, tail: head + unit * times + unit[:extra] + tail,
    st.lists(st.integers(0, 2), max_size=8), st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 8), st.integers(0, 8), st.lists(st.integers(0, 3), max_size=8),
)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(PERIODIC, st.builds(lambda x, y: x + y + x, PERIODIC, PERIODIC), st.lists(st.integers(0, 1), max_size=60)), max_size=4), st.sampled_from([6, 12]))
def test_all_runs_of_several_texts(texts, least):
    sizes = np.array([len(t) for t in texts], np.int64)
    got = R.all_runs(np.array(sum(texts, []), np.int64), sizes, least)
    want, at = [], 0
    for t in texts:
        want += [(s + at, s + at + n - 1, p) for s, n, p in plain_runs(t, least)]
        at += len(t)
    assert list(map(tuple, got.tolist())) == want


def test_texts_of_many_runs():
    for words in (fibonacci(2000), list("ab" * 900 + "c" + "ab" * 900), ["x"] * 3000, list("aab" * 40 + "baa" * 40) * 6):
        ((runs, left),) = R._worked([[w.encode() for w in words]], R.LEAST)
        assert [tuple(r) for r in runs] == plain_runs(words)
        assert left.decode() == plain_left(words, plain_runs(words))


def test_longest_previous_factor():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, n).tolist() for n in (0, 1, 7, 60, 200)]
    words = np.array(sum(texts, []), np.int64)
    length, source = R.longest_previous(R.Suffixes(words, np.array([len(t) for t in texts])))
    at = 0
    for t in texts:
        for i in range(len(t)):
            want = max((next((k for k in range(len(t) - i) if t[i + k] != t[j + k]), len(t) - i) for j in range(i)), default=0)
            assert length[at + i] == want
            if want:
                j = source[at + i] - at
                assert 0 <= j < i and t[j : j + want] == t[i : i + want]
        at += len(t)


def test_long_texts_take_little_more_time_a_word():
    import time

    spent = []
    for n in (40_000, 160_000):
        words = [b"a%d" % (i % 7001) for i in range(n)]
        begin = time.process_time()
        ((runs, left),) = R._worked([words], R.LEAST)
        spent.append(time.process_time() - begin)
        assert runs == [[0, n, 7001]] and len(left.split()) == 7001
    assert spent[1] < 12 * spent[0] + 1


def test_query_against_plain_python(spark, data):
    from tarnbridge.llm.queries import QUERIES

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    rows = QUERIES["op11_runs"](spark, data).collect()
    assert len(rows) == len(texts) and sum(r["n_runs"] > 0 for r in rows) > len(rows) / 20
    for r in rows:
        words = with_repeat(split(texts[r["doc_id"]]), r["doc_id"])
        runs = plain_runs(words)
        s, n, p = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) == (len(runs), s, n, p, 1000 * n // p if p else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(plain_left(words, runs).encode()).hexdigest()


def test_odd_rows(spark, docs):
    rows = docs([*ODD, (10, "a b c " * 9 + "end"), (10, "a b c " * 9 + "end"), (11, "é é x " * 12)])
    got = sorted(((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in R.find_runs(rows).collect()), key=repr)
    want = []
    for r in rows.collect():
        words = split(r["text"])
        runs = plain_runs(words) if len(words) < 1000 else [(0, 30_000, 1)]
        want.append((r["doc_id"], runs, plain_left(words, runs)))
    assert got == sorted(want, key=repr)
    assert R.find_runs(rows.limit(0)).count() == 0
    coded = R.planted(rows).collect()
    assert sorted((str(r["doc_id"]), " ".join(split(r["text"]))) for r in coded) == sorted((str(r["doc_id"]), " ".join(with_repeat(split(r["text"]), r["doc_id"]) if r["doc_id"] is not None else split(r["text"]))) for r in rows.collect())
