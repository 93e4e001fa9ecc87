import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbridge.llm import pieces as P

from .conftest import ODD


def encode(texts, keys=None):
    keys = P.row_keys(pa.array(range(len(texts)) if keys is None else keys))
    return P.encode_batch(keys, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
def test_round_trip(texts):
    ids = encode(texts)
    assert P.lattices().decode_batch(ids).to_pylist() == texts
    assert [None if x is None else P.lattices().decode(x) for x in ids.to_pylist()] == texts


def test_same_sample_in_any_batch():
    texts = [t or "" for _, t in ODD]
    one = encode(texts).to_pylist()
    order = np.random.default_rng(1).permutation(len(texts))
    P.lattices().clear()
    other = encode([texts[i] for i in order], [int(i) for i in order]).to_pylist()
    assert [one[i] for i in order] == other
    assert encode(["hello there friend"] * 40, range(40)).to_pylist() != [encode(["hello there friend"]).to_pylist()[0]] * 40


def test_samples_follow_the_lattice():
    own = P.lattices()
    word = " there"
    weight = {}

    def walk(at, ids, score):
        if at == len(word):
            weight[tuple(ids)] = math.exp(score)
            return
        for to in range(at + 1, len(word) + 1):
            found = [i for i, b in enumerate(own.bytes) if b == word[at:to].encode() and own.scores[i] < 0]
            for i in found:
                walk(to, [*ids, i], score + own.scores[i])

    walk(0, [], 0.0)
    total, n = sum(weight.values()), 20_000
    seen = Counter(map(tuple, encode([word[1:]] * n, range(n)).to_pylist()))
    assert set(seen) <= set(weight)
    for ids, w in weight.items():
        p = w / total
        assert abs(seen[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-4


def test_odd_rows(docs):
    rows = P.encode_documents(docs(ODD)).collect()
    assert len(rows) == len(ODD) and all(r["lossless"] for r in rows)
    assert [r["ids"] is None for r in rows if r["doc_id"] == 1] == [True]
    assert len({tuple(r["ids"]) for r in rows if r["doc_id"] == 4}) == 1
    assert P.encode_documents(docs([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_seed(docs, seed):
    a, b = (P.encode_documents(docs([(1, "some longer words to segment " * 5)]), seed=s).collect()[0]["ids"] for s in (seed, seed + 1))
    assert a != b
