"""Every registered query gives the rows of its SQL."""

import pytest

from tarnbridge.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(name, spark, data, duck, same_rows):
    same_rows(registry.queries()[name](spark, data), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs_without_sql(name, spark, data):
    assert registry.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_nothing_imports_the_training_data_package():
    from pathlib import Path

    root = Path(registry.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "tarnbridge.llm" not in path.read_text() and "from .llm" not in path.read_text(), path


def test_index_search_recall(spark, data):
    from tarnbridge.plans import retrieval_queries as Q

    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = pairs(Q._hits(spark, data, 10))
    assert len(pairs(Q.index_search(spark, data)) & exact) >= 0.9 * len(exact)


def test_code_search_recall(spark, data):
    from tarnbridge.operators import index
    from tarnbridge.plans import retrieval_queries as Q

    pairs = lambda df: {(r["query_id"], r["chunk_id"]) for r in df.collect()}
    exact = pairs(Q._hits(spark, data, 10))
    assert len(pairs(Q.code_search(spark, data)) & exact) >= 0.9 * len(exact)
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert index.PARTS / (4 * 64) + Q.CANDIDATES / n <= 0.25  # bytes of codes and candidates to those of all vectors


def test_context_pages_against_plain_python(spark, data):
    """Every page is a candidate, with its own text."""
    import re

    from tarnbridge.operators.parsing import parse_article
    from tarnbridge.plans import context_queries as C

    texts = {}
    for r in spark.read.parquet(f"{data}/pages.parquet").collect():
        text = parse_article(r["html"])[2]
        if text.strip():
            url = re.sub(r"[?#].*$", "", r["url"])
            texts[url] = min(texts.get(url, text), text)
    rows = C.context_pages(spark, data).collect()
    assert rows and all(r["text"] == texts[r["page_url"]][:12_000] for r in rows)
    chosen = {r["event"]: r["url"] for r in C.site_candidates(spark, data).filter("place = 1").collect()}
    assert {r["event"] for r in rows} == {e for e, u in chosen.items() if u in texts or any(x.startswith(re.match(r"https?://[^/]+", u)[0]) for x in texts if x.rsplit("/", 1)[-1] in ("rules", "route", "faq"))}
