import zlib
from collections import Counter

from tarnbridge.llm import sharding as S

from .conftest import ODD


def test_law(docs):
    rows = S.shard_documents(docs([(i, "t" * (i % 7)) for i in range(4000)])).collect()
    by = Counter(r["shard"] for r in rows)
    assert sorted(by) == list(range(16)) and max(by.values()) < 1.4 * 250 and min(by.values()) > 0.6 * 250
    moved = [r for r in rows if r["shard"] != r["grown_shard"]]
    assert {r["grown_shard"] for r in moved} == {16} and 0.5 < len(moved) / (4000 / 17) < 1.5
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_one_more_shard(docs):
    """Whatever the number of shards, one more takes rows only into itself, as walking the grown tree shows."""
    d = docs([(i, "") for i in range(1500)]).select("doc_id", "text")
    for n in (1, 3, 8, 11, 16):
        regions = S.tree((1.0,) * n)
        grown = S.descend(S.F.col("doc_id").cast("string"), S.with_shard(regions, 1.0))
        rows = S.place(d, weights=(1.0,) * n).withColumn("walked", grown).collect()
        assert all(r["grown_shard"] == r["walked"] and r["grown_shard"] in (r["shard"], n) for r in rows)
        assert 0.6 < sum(r["grown_shard"] == n for r in rows) / (1500 / (n + 1)) < 1.4


def test_only_changed_subtrees_get_rows(docs):
    """Shard 9 (rack 2, region 1) gets heavier: rows move into region 1, into rack 2 and into shard 9, nowhere else."""
    d = docs([(i, "") for i in range(4000)])
    of = lambda w: {r["doc_id"]: r["shard"] for r in S.place(d.select("doc_id"), weights=w).collect()}
    weights = [1.0] * 16
    a = of(weights)
    weights[9] = 4.0
    b = of(weights)
    for i, old in a.items():
        new = b[i]
        assert new == old or new // 8 == 1
        if old // 8 == 1:  # was in the region already
            assert new == old or new // 4 == 2
        if old // 4 == 2:  # was in the rack already
            assert new in (old, 9)
    share = Counter(b.values())
    assert abs(share[9] / 4000 - 4 / 19) < 0.03 and all(abs(share[i] / 4000 - 1 / 19) < 0.02 for i in range(16) if i != 9)


def test_odd_rows(docs):
    rows = S.shard_documents(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    text = dict(ODD)
    for r in rows:
        t = (text[r["doc_id"]] or "").encode()
        assert r["size"] == len(t) + 1 and r["text_crc32"] == zlib.crc32(t) and r["law"] == "key"
    assert len({r["shard"] for r in rows if r["doc_id"] == 4}) == 1
    assert S.shard_documents(docs([])).count() == 0
