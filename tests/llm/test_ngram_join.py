import re

import numpy as np
import pyarrow as pa

from tarnbridge.llm import ngram_join as N
from tarnbridge.llm import graph
from tarnbridge.llm.graph import components
from tarnbridge.llm.shingles import chunks, shingle_sets

from .conftest import ODD


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    label = {i: i for i, _ in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            both = len(a & b)
            if both and 100 * both >= 80 * len(a | b):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def edited(r, words, share):
    w = list(words)
    for _ in range(max(1, int(len(w) * share))):
        w[r.integers(len(w))] = f"e{r.integers(10**6)}"
    return w


def test_against_brute_force(docs):
    r = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(r.choice(vocabulary, 60))
    rows, i = [], 0
    for n in (1, 3, 4, 5, 6, 8, 9, 10, 12, 15, 20, 40, 90, 200, 500, 1500):
        for _ in range(3):
            base = [str(x) for x in r.choice(vocabulary, n)]
            for share in (0.0, 0.004, 0.01, 0.02, 0.03, 0.04, 0.06):
                rows.append((i, " ".join(edited(r, base, share) if share else base)))
                i += 1
            for cut in (1, 2, max(1, n // 6), max(1, n // 4)):  # a copy without its end, or with more
                rows += [(i, " ".join(base[:-cut])), (i + 1, " ".join(base + [f"m{x}" for x in range(cut)]).upper())]
                i += 2
    for _ in range(40):  # a passage that many share doesn't link them
        rows.append((i, " ".join([*r.choice(vocabulary, 80), passage, *r.choice(vocabulary, 80)])))
        i += 1
    rows += [(i + k, passage) for k in range(5)]
    got = sorted(tuple(x) for x in N.similar_documents(docs(rows)).collect())
    assert got == brute(rows)
    assert len({c for _, _, c in got}) < len(rows) - 100


def test_signatures_lose_no_pair():
    r = np.random.default_rng(9)
    for _ in range(1500):
        n = int(np.exp(r.uniform(0, np.log(600)))) + 1
        a = r.integers(1, 2**63, n).astype(np.uint64) * np.uint64(2)
        drop, add = int(r.integers(0, n // 5 + 1)), 0
        while 100 * (n - drop) >= 80 * (n + add + 1):
            add += 1
        b = np.concatenate([a[drop:], r.integers(1, 2**63, add).astype(np.uint64)])
        if 100 * (n - drop) < 80 * (n + add):
            continue
        a, b = np.sort(a), np.sort(b)
        who, sig = N.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_parities_are_a_bound():
    r = np.random.default_rng(2)
    for n in (3, 60, 700, 5000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 3 :], r.integers(0, 2**63, n // 2).astype(np.uint64)]))
        size = np.array([len(a), len(b)])
        words, odd = N.parities(np.repeat([0, 1], size), np.concatenate([a, b]), size)
        sets = N.Sets.of(size, pa.array([odd[: words[0]].tobytes(), odd[words[0] :].tobytes()], pa.binary()))
        to = int(words.min())
        x, y = (sets.folded(np.array([i]), int(words[i]), to) for i in (0, 1))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_similar_sets_pass_the_parities():
    r = np.random.default_rng(3)
    for n in (10, 90, 510, 516, 1030, 3000):  # around the sizes at which the number of words doubles
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        for b in (a[n // 5 :], np.concatenate([a, r.integers(0, 2**63, len(a) // 4).astype(np.uint64)]), r.integers(0, 2**63, n).astype(np.uint64)):
            size = np.array([len(a), len(b)])
            words, odd = N.parities(np.repeat([0, 1], size), np.concatenate([a, b]), size)
            sets = N.Sets.of(size, pa.array(["", odd[: words[0]].tobytes(), odd[words[0] :].tobytes()], pa.binary()).slice(1))
            common = len(np.intersect1d(a, b))
            similar = 100 * common >= 80 * (len(a) + len(b) - common)
            assert N.can_be_similar(sets, np.array([0]), sets, np.array([1]), 80)[0] == similar


def test_shingles_by_chunk():
    texts = [t for _, t in ODD] * 3
    want = [len(shingles(t)) for t in texts]
    for array in (pa.array(texts), pa.array(["pad", *texts, None])[1:-1]):
        got = np.zeros(len(texts), int)
        for at, data, ends in chunks(array):
            row, _ = shingle_sets(data, ends)
            got[at : at + len(ends)] = np.bincount(row, minlength=len(ends))
        assert got.tolist() == want


def test_odd_rows(docs):
    rows = N.similar_documents(docs(ODD)).collect()
    assert len(rows) == len(ODD)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] in (1, 2, 3, 4, 5)) == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 2, 4), (4, 2, 4), (5, 2, 4)]
    assert [(r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is None] == [(2, None)]
    assert N.similar_documents(docs([])).count() == 0
    kept = N.first_of_each(docs(ODD))
    assert kept.columns == docs(ODD).columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["None", "1", "2", "3", "4", "6", "7", "8", "9"])


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5000), (None, 3), (7001, 7000)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 50)} | {7001: 7000}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_id_with_two_texts(docs):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    near = lambda t: t + " more"
    rows = [(5, one), (5, two), (7, near(one)), (9, near(two)), (3, near(two) + " yet")]
    got = sorted(tuple(x) for x in N.similar_documents(docs(rows)).select("doc_id", "component_id").collect())
    assert got == [(3, 3), (5, 3), (5, 5), (7, 5), (9, 3)]
    assert sorted((r["doc_id"], r["text"]) for r in N.first_of_each(docs(rows)).collect()) == [(3, rows[4][1]), (5, one)]


def test_family_of_texts_around_the_limit(docs, monkeypatch):
    """Many texts of one template at a similarity of 0.3 to 0.9, some of them long, in blocks of a few."""
    monkeypatch.setattr(N, "BLOCK", 7)
    r = np.random.default_rng(8)
    rows, doc_id = [], 100
    for words, copies in ((150, 90), (2600, 24)):
        base = [f"w{int(x)}" for x in r.integers(0, 10**6, words)]
        for _ in range(copies):
            text = list(base)
            for at in r.choice(words, int(words * r.uniform(0, 0.09)), replace=False):
                text[at] = f"x{int(r.integers(0, 10**6))}"
            rows.append((doc_id, " ".join(text)))
            doc_id -= 1
    got = sorted(tuple(x) for x in N.similar_documents(docs(rows)).collect())
    assert got == brute(rows)
    assert 10 < len({c for _, _, c in got}) < len(rows) - 20


def test_clashing_names(spark):
    rows = [(1, "a b c d e f", 1, "p"), (2, "a b c d e f", 2, "q"), (3, None, 3, "r")]
    kept = N.first_of_each(spark.createDataFrame(rows, "doc_id bigint, text string, _copy int, node string").withColumnRenamed("_copy", "copy"))
    assert sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]

def test_edges_not_pairs():
    """Texts that the parities can't tell apart, in two runs: as many edges as connect them, not all their pairs."""
    n, runs = 60, [3, 8]
    rows = [(run, 0, side, i, i, i, i, False, 40, b"\0" * 8 * N.PARITY, runs) for run in runs for side in (0, 1) for i in range(n)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.bool_(), pa.int32(), pa.binary(), pa.list_(pa.int64())]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [str(k) for k in range(11)])
    edges = [(r["a"]["doc_id"], r["b"]["doc_id"]) for out in N._apart(80)(iter([batch])) for r in out.to_pylist()]
    assert len(edges) == n - 1 and {x for e in edges for x in e} == set(range(n))
    later = [out for out in N._apart(80)(iter([batch.slice(2 * n)]))]
    assert not later  # a task with the second run only: its pairs are the first run's


def _dealt(df):
    """What the plan deals out by hash, as it was in the end: the columns of each exchange that isn't used again."""
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [c for line in final.splitlines() if "ReusedExchange" not in line for c in re.findall(r"Exchange hashpartitioning\(([^)]*)", line)]


def test_texts_are_dealt_out_once(docs, monkeypatch, spark, tmp_path):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    labels = spark.createDataFrame([(5, 1, (5, 1)), (5, 2, (5, 2)), (7, 1, (5, 1))], "doc_id bigint, node bigint, component struct<doc_id: bigint, node: bigint>")
    labels.write.parquet(f"{tmp_path}/labels")
    docs([(5, one), (5, two), (7, one)]).write.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(N, "checkpointed", lambda df: df)
    monkeypatch.setattr(N, "_labelled", lambda docs, percent: spark.read.parquet(f"{tmp_path}/labels"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dealt = _dealt(N.first_of_each(spark.read.parquet(f"{tmp_path}/docs")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # labels and texts by doc_id, first sets by key; only texts of ids with several sets go on, by key and for their window
    assert len(dealt) == 5, dealt


def test_a_round_of_stars_deals_edges_out_by_nodes_only(spark, tmp_path):
    spark.createDataFrame([(i, i + 1) for i in range(30)], "a bigint, b bigint").write.parquet(f"{tmp_path}/edges")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        dealt = _dealt(graph._round(spark.read.parquet(f"{tmp_path}/edges")))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(dealt) <= 3, dealt
