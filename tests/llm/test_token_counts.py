from tarnbridge.llm import token_counts as T

from .conftest import ODD


def test_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    encode = T.encoding(T.VOCABULARY).encode_ordinary
    n = [len(encode(r["text"])) for r in docs.select("text").collect()]
    sums = T.with_suffix_sums(T.length_histogram(docs))
    rows = sums.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        x = r["n_tokens"]
        assert (r["n_docs"], r["sum_tokens"], r["docs_ge"], r["tokens_ge"]) == (n.count(x), x * n.count(x), sum(v >= x for v in n), sum(v for v in n if v >= x))
        assert r["truncated_total"] == sum(min(v, x) for v in n) and r["docs_le"] == sum(v <= x for v in n) and r["share_le"] == r["docs_le"] / len(n)
    for r in T.totals_at(sums, [0, 7, 100, 10**6]).collect():
        k = r["context_limit"]
        assert (r["docs_over"], r["tokens_kept"], r["tokens_lost"]) == (sum(v > k for v in n), sum(min(v, k) for v in n), sum(max(0, v - k) for v in n))
    assert T.quantile(sums, 0.5).collect()[0][0] == sorted(n)[(len(n) + 1) // 2 - 1]


def test_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 4)
    h = spark.createDataFrame([(x, 1 + x % 3) for x in range(0, 40, 3)], "n_tokens bigint, n_docs bigint")
    n = [x for x in range(0, 40, 3) for _ in range(1 + x % 3)]
    assert all(r["tokens_ge"] == sum(v for v in n if v >= r["n_tokens"]) for r in T.with_suffix_sums(h).collect())


def test_odd_rows(docs):
    rows = T.with_suffix_sums(T.length_histogram(docs(ODD))).collect()
    assert sum(r["n_docs"] for r in rows) == len(ODD) and {r["n_docs"] for r in rows if r["n_tokens"] == 0} == {2}
    assert T.with_suffix_sums(T.length_histogram(docs([]))).count() == 0
