"""Layouts: joins without a shuffle, lookups that read little, keys without accents or Python workers."""

import uuid

import pytest
from pyspark.sql import functions as F

from tarnbridge.functions import text as X
from tarnbridge.operators import sync
from tarnbridge.sources import layouts


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scanned(df):
    """Rows that come out of the scan."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


@pytest.fixture
def laid(spark, tmp_path):
    names = []

    def write(rows, keys, **more):
        names.append(f"laid_{uuid.uuid4().hex}")
        layouts.write_bucketed(rows, names[-1], str(tmp_path / names[-1]), keys, 4, **more)
        return spark.table(names[-1])

    yield write
    layouts.dropped(spark, *names)


def test_joins_of_buckets_do_not_shuffle(spark, laid):
    owners = laid(spark.range(200).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), ["k"])
    chunks = laid(spark.range(0, 300, 3).select(F.col("id").alias("k"), F.lit("c").alias("kind")), ["k"])
    for how, n in (("left_anti", 133), ("left_semi", 67), ("inner", 67), ("full_outer", 233)):
        out = layouts.joined(owners, chunks, ["k"], how)
        assert "Exchange" not in plan_of(out) and "SortMergeJoin" in plan_of(out)
        assert out.count() == n


def test_upsert_on_three_keys_does_not_shuffle(spark, laid):
    key = ["a", "b", "c"]
    old = laid(spark.createDataFrame([(1, "x", 0, "old", "t0"), (1, "y", 0, "old", "t0"), (2, "x", 1, "old", "t0")], "a int, b string, c int, text string, at string"), key)
    new = laid(spark.createDataFrame([(1, "y", 0, "new"), (3, "x", 0, "new")], "a int, b string, c int, text string"), key)
    out = sync.upsert(old, new, key, stamp={"at": F.lit("t1")})
    assert "Exchange" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [(1, "x", 0, "old", "t0"), (1, "y", 0, "new", "t1"), (2, "x", 1, "old", "t0"), (3, "x", 0, "new", "t1")]


def test_lookups_read_little(spark, laid):
    rows = spark.range(40_000).select(F.concat(F.lit("https://h/"), F.sha2(F.col("id").cast("string"), 256)).alias("url"), F.sha2(F.concat(F.lit("t"), F.col("id")), 256).alias("title"))
    pages = laid(rows, ["url"], bloom={"title": 10_000}, group=256 << 10)
    url, title = rows.filter("url like '%7'").first()
    by_url = pages.filter(F.col("url") == url)
    assert by_url.count() == 1
    assert scanned(pages) == 40_000 and scanned(by_url) <= 11_000  # one bucket of four, and of it not all row groups
    by_title = pages.filter(F.col("title") == title)
    assert by_title.count() == 1 and scanned(by_title) <= 11_000  # other files and row groups are left by their filters
    assert scanned(pages.filter(F.col("title") == "f" * 63 + "g")) == 0


@pytest.mark.parametrize("n", [0, 1])
def test_empty_tables_and_null_keys(spark, laid, n):
    rows = spark.createDataFrame([(None, "a")] * n, "k int, v string")
    a, b = laid(rows, ["k"], bloom={"v": 10}), laid(rows, ["k"])
    assert a.columns == ["k", "v"] and a.count() == n
    assert layouts.joined(a, b, ["k"], "left_anti").count() == n  # a null key equals none


TITLES = ("Transibérica 2023", "TRANSIBERICA", "Trans-Iberica", "trans iberica 1999", "L’Étape du Nord", "letape du nord", "Silk Road", "silk  road!", "Año 2024", "ano", "GB Duro 20", "gb duro", None, "", "2024")


def test_title_keys_are_those_of_the_words_without_a_python_worker(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TITLES)], "i int, title string")
    pairs = lambda key: (a := rows.select("i", key.alias("k"))).join(a.withColumnRenamed("i", "j"), "k").select("i", "j")
    by_key, by_words = pairs(X.title_key(F.col("title"))), pairs(X.title_words(F.col("title")))
    assert sorted(map(tuple, by_key.collect())) == sorted(map(tuple, by_words.collect()))
    assert "ArrowEvalPython" in plan_of(by_words) and "ArrowEvalPython" not in plan_of(by_key)


def test_letters_keys(spark):
    same = lambda a, b: spark.range(1).select(X.letters_key(F.lit(a)) == X.letters_key(F.lit(b))).collect()[0][0]
    assert same("ÉTÉ", "ete") and same("é", "E") and same("Straße", "STRASSE") and not same("a", "b") and not same("a ", "a")
