"""The registered queries against their SQL, and the pipeline as a whole."""

from collections import Counter

import pytest

from tarnbridge.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(name, spark, data, duck, same_rows):
    same_rows(queries.QUERIES[name](spark, data), duck.sql(queries.ORACLES[name]))


def test_a_query_for_each_operator():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))


def test_pipeline(spark, data):
    import corpus_pipeline as C
    from tarnbridge.llm.mixing import mix_documents
    from tarnbridge.llm.ngram_join import similar_documents
    from tarnbridge.llm.quality import classify

    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    good = C.quality(spark, docs, data)
    assert good.columns == docs.columns
    kept = {r["doc_id"] for r in good.collect()}
    assert kept == {r["doc_id"] for r in classify(docs, labels).filter("predicted = 1").collect()} and len(kept) < docs.count()
    once = C.near_copies(spark, good, data)
    assert once.columns == docs.columns
    groups = {}
    for r in similar_documents(good).collect():
        groups.setdefault(r["component_id"], []).append(r["doc_id"])
    assert sorted(r["doc_id"] for r in once.collect()) == sorted(groups)
    mixed = C.mixing(spark, once, data)
    assert mixed.columns == docs.columns
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_documents(once).collect() if r["size"]}
    count = {}
    for r in mixed.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert count == {k: v for k, v in taken.items() if v}
    out = C.run(spark, data).collect()
    assert len(out) == sum(count.values()) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) > 0 for r in out)


def test_stages():
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality", "near_copies", "mixing", "encoding"] and C.ORACLE_SQL is None


ODD_NAMES = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, node string, copy string, skey string, size bigint, finish double, _keep_0 string, ids string"


def odd_documents(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties and names that the operators use."""
    good = "plain words of a text that reads well, again and again "
    rows = [(1, good), (1, good), (2, good), (3, None), (4, ""), (5, " \n "), (None, good), (None, None), (6, good * 20_000), (7, "junk " * 60), (8, good + "with an end of its own that is long enough to count"), (9, "x" * 30_000)]
    rest = lambda i: ("en", "s") if i % 3 else (None, None)
    return spark.createDataFrame([(*r, *rest(i), None, None, None, "c", "k", None, None, "z", None) for i, r in enumerate(rows)], ODD_NAMES)


def test_stages_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as C

    docs = odd_documents(spark)
    labels = [(i, int(i != 7), 0, "clash") for i in range(1, 10)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int, text string").write.parquet(str(tmp_path / "labels.parquet"))
    good = C.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns
    count = lambda df: Counter(r["text"] for r in df.collect())
    kept, given = count(good), count(docs)
    assert kept and all(n == given[t] for t, n in kept.items())  # equal texts go together, repeats stay as often as they came
    assert set(given) - set(kept) == {"junk " * 60}
    once = C.near_copies(spark, docs, str(tmp_path))
    assert once.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=repr)
    want = {(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] != 2}
    want.discard((6, next(r["text"] for r in docs.collect() if r["doc_id"] == 6)))  # its set of shingles is near that of 1
    assert {x for x in got if x[0] != 6} == want and len(got) == len(set(got))
    mixed = C.mixing(spark, docs, str(tmp_path))
    assert mixed.columns == docs.columns
    counts = {}
    for r in mixed.collect():
        counts[(r["doc_id"], r["text"])] = counts.get((r["doc_id"], r["text"]), 0) + 1
    assert all(n <= 2 * sum((d["doc_id"], d["text"]) == k for d in docs.collect()) for k, n in counts.items())
    coded = C.encoding(spark, docs, str(tmp_path)).collect()
    assert len(coded) == docs.count() and all(r["lossless"] for r in coded)
    assert {r["doc_id"]: r["n_tokens"] for r in coded}[3] == 0 and all(r["n_tokens"] > 0 for r in coded if r["doc_id"] in (4, 5, 6, 9))


def test_stages_on_empty_tables(spark, tmp_path):
    import corpus_pipeline as C

    docs = odd_documents(spark).limit(0)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in C.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0 and (name == "encoding" or out.columns == docs.columns)
