import numpy as np
import pytest

from tarnbridge.llm import embedding_dedup as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, copies string, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)


def brute(rows):
    x = np.array([r[1] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, label = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
    near = (x @ x.T >= E.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    c = ids.copy()
    while True:
        lower = np.minimum(c, np.where(near, c[None, :], 10**9).min(axis=1))
        if (lower == c).all():
            return {int(i): (int(n), int(k), bool(i == k)) for i, n, k in zip(ids, near.sum(axis=1), c)}
        c = lower


@pytest.mark.parametrize("dim, block", [(64, 1000), (64, 20), (24, 1000)])
def test_against_brute_force(spark, monkeypatch, dim, block):
    monkeypatch.setattr(E, "BLOCK", block)
    r = np.random.default_rng(dim + block)
    rows = []
    for group in range(40):
        base = r.normal(size=dim)
        base /= np.linalg.norm(base)
        for spread in r.uniform(0, 0.5, 12):  # from equal to just beyond the limit
            noise = r.normal(size=dim)
            noise -= (noise @ base) * base
            v = base + spread * noise / np.linalg.norm(noise) if spread > 0.05 else base
            rows.append((len(rows), (v * r.uniform(0.1, 9)).tolist() if spread > 0.05 else v.tolist(), group % 3))
    rows += [(len(rows) + i, (np.eye(dim)[0] + 0.02 * r.normal(size=dim)).tolist(), 1) for i in range(60)]
    want = brute(rows)
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in E.near_vectors(frame(spark, rows)).collect()}
    links = sum(n for n, _, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing is linked below the limit
    assert sum(n for n, _, _ in got.values()) >= 0.99 * links
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_recall_at_the_limit():
    r = np.random.default_rng(1)
    a = r.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    z = r.normal(size=a.shape)
    z -= (z * a).sum(axis=1, keepdims=True) * a
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    b = E.COSINE * a + np.sqrt(1 - E.COSINE**2) * z
    for k in (1, 2, 3):
        tables = E.TABLES + E.MORE_TABLES * (k - 1)
        x, y = E.codes(a, tables, k), E.codes(b, tables, k)
        assert np.concatenate([x[:, :, :1] == y, y[:, :, :1] == x], axis=2).any(axis=(1, 2)).mean() > 0.99


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(E.hadamard(x), axis=1), np.linalg.norm(x, axis=1)) and np.allclose(E.hadamard(E.hadamard(x)), x)


def test_odd_rows(spark):
    u, nan = [1.0, 0.0, 0.0], float("nan")
    rows = [(None, u, 1), (1, u, None), (2, None, 1), (3, [], 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, nan, 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("inf"), 0.0, 0.0], 1), (8, [1.0, 0.0], 1),
            (9, u, 1), (9, u, 1), (10, [3e38, 0.0, 0.0], 1), (11, [1e-30, 0.0, 0.0], 1), (12, u, 2)]
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in E.near_vectors(frame(spark, rows)).collect()), key=str)
    alone = [(i, 0, i, True) for i in (None, 1, 2, 3, 4, 5, 6, 7, 8, 12)]
    assert got == sorted([*alone, (9, 3, 9, True), (9, 3, 9, True), (10, 3, 9, False), (11, 3, 9, False)], key=str)
    assert E.near_vectors(frame(spark, [])).count() == 0
