import json
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnbridge.functions.text import title_words
from tarnbridge.operators import events, index, intent, judging, lexicon, metrics, nearest, parsing, rerank, retrieval, search, sync


def test_nearest_is_exact(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8))
    x[7] = x[3]
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0], 0)]
    v = spark.createDataFrame(rows, "id bigint, vector array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for scope in (None, "label"):
        found = {}
        for row in nearest.nearest(v, v.filter("id % 50 = 0"), 5, scope).collect():
            found.setdefault(row["query_id"], {})[row["pos"]] = row["id"]
        for q in range(0, 300, 50):
            s = [(-round(float(unit[q] @ unit[i]), 9), i) for i in range(300) if scope is None or i % 3 == q % 3]
            assert [found[q][p] for p in range(1, 6)] == [i for _, i in sorted(s)[:5]]


@pytest.mark.parametrize("scope", [None, "label"])
def test_nearest_for_many_queries(spark, scope, monkeypatch):
    """Blocks meet by scope and share: no product of all blocks, the same rows, also of a scope that most vectors have."""
    r = np.random.default_rng(5)
    rows = [(i, v.tolist(), None if i % 50 == 49 else 0 if i % 3 else i % 7) for i, v in enumerate(r.normal(size=(600, 6)))]
    rows += [(900 + i, rows[i][1], 0) for i in range(20)] + [(950, None, 0), (951, [0.0] * 6, 0), (952, [float("nan")] * 6, 0), (953, [None] * 6, 0), (954, [1.0, 2.0], 0)]
    v = spark.createDataFrame(rows, "id bigint, vector array<double>, label int").repartition(6)
    q = v.filter("id % 4 = 0")
    few = nearest.nearest(v, q, 5, scope)
    monkeypatch.setattr(nearest, "FEW", 10)
    monkeypatch.setattr(nearest, "SHARE", 50)
    many = nearest.nearest(v, q, 5, scope)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    plain = lambda df: sorted((x["query_id"], x["pos"], x["id"], round(x["similarity"], 9)) for x in df.collect())
    assert plain(many) == plain(few)
    label, unit = {i: w for i, _, w in rows}, {i: np.array(x) / np.linalg.norm(x) for i, x, _ in rows if x and len(x) == 6 and x[0] and np.isfinite(x[0])}
    found = [(a, i) for a, p, i, _ in plain(many) if p == 1]
    assert len(found) == sum(i % 4 == 0 for i in unit)
    for a, p, i, s in plain(many):
        better = sum(round(float(unit[a] @ u), 9) > s for j, u in unit.items() if scope is None or label[j] == label[a])
        assert better < p and (scope is None or label[a] == label[i])


def test_nearest_of_nothing(spark):
    v = spark.createDataFrame([], "id bigint, vector array<double>, label int")
    assert nearest.nearest(v, v, 3).count() == nearest.nearest(v, v, 3, "label").count() == 0


def _metrics(ids, rel, k):
    top = ids[:k]
    hit = [i for i in top if rel.get(i, 0) > 0]
    n = sum(v > 0 for v in rel.values())
    first = next((p for p, i in enumerate(top, 1) if rel.get(i, 0) > 0), 0)
    ap = sum(sum(rel.get(j, 0) > 0 for j in top[:p]) / p for p, i in enumerate(top, 1) if rel.get(i, 0) > 0)
    dcg = sum((2 ** rel.get(i, 0) - 1) / math.log2(p + 1) for p, i in enumerate(top, 1))
    ideal = sum((2**v - 1) / math.log2(p + 1) for p, v in enumerate(sorted((v for v in rel.values() if v > 0), reverse=True)[:k], 1))
    return (float(bool(hit)), len(set(hit)) / n if n else 0.0, len(set(hit)) / k, 1 / first if first else 0.0, ap / n if n else 0.0, dcg, dcg / ideal if ideal else 0.0)


def test_metrics_against_plain_python(spark):
    lists = {1: [5, 3, 9, 1], 2: [1, 2], 3: [7], 4: [4, 4, 2]}
    rels = {1: {9: 3, 5: 1, 42: 2}, 2: {8: 1}, 4: {4: 2, 2: 0}}
    ranked = spark.createDataFrame([(q, d, p) for q, ids in lists.items() for p, d in enumerate(ids, 1)], "query_id int, doc_id int, pos int")
    relevant = spark.createDataFrame([(q, d, r) for q, x in rels.items() for d, r in x.items()], "query_id int, doc_id int, rel int")
    for row in metrics.metrics(ranked, relevant, [1, 3, 10]).collect():
        assert tuple(row)[2:] == pytest.approx(_metrics(lists[row["query_id"]], rels.get(row["query_id"], {}), row["k"])), row


def test_fallback(spark):
    m = lambda rows: spark.createDataFrame(rows, "query_id int, hitrate double, mrr double")
    out = metrics.safe_fallback(m([(1, 1.0, 0.5), (2, 1.0, 0.5), (3, 0.0, 0.0)]), m([(1, 1.0, 0.5), (2, 1.0, 0.4), (3, 1.0, 1.0)]))
    assert {r["query_id"]: (r["fallback"], r["final_mrr"]) for r in out.collect()} == {1: (False, 0.5), 2: (True, 0.5), 3: (False, 1.0)}


def test_grouping_first_wins_ties(spark):
    hits = spark.createDataFrame([(1, 10, 0.5, 1), (1, 10, 0.5, 2), (1, 11, 0.9, 3), (1, None, 1.0, 4)], "query_id int, owner_id int, score double, pos int")
    assert [(r["owner_id"], r["pos"]) for r in retrieval.best_per_owner(hits).orderBy("first_pos").collect()] == [(10, 1), (11, 3)]
    assert sorted((r["place"], r["owner_id"], r["rn"]) for r in retrieval.grouped(hits, 5, 1).collect()) == [(1, 11, 1), (2, 10, 1)]


def test_rerank_clamps(spark):
    hits = spark.createDataFrame([(1, 0.50, 1, "frame", "full suspension", "28mm", True), (1, 0.48, 2, "Garmin tubeless 11-46", "rigid", "45-50mm", False), (1, 0.48, 3, "", None, None, None)], "query_id int, score double, pos int, text string, frame_type string, tyre_width string, electronic boolean")
    asked = rerank.constraints(F.lit("no suspension, 40-50mm, garmin only, mechanical only, puncture, steep climbs"))
    hit = {c: F.col(c) for c in ("text", "frame_type", "tyre_width", "electronic")} | {"event_key": F.lit(""), "wheel_size": F.lit("")}
    out = {r["pos"]: (round(r["delta"], 6), r["place"]) for r in rerank.rerank(hits, asked, hit).collect()}
    assert out == {1: (-0.05, 3), 2: (0.05, 1), 3: (0.0, 2)}


@pytest.mark.parametrize("width, expected", [("50mm+", (50, None)), ("40mm - 45mm", (40, 45)), ("45-50mm", (45, 50)), (" 35MM", (35, 35)), ("wide", (None, None)), ("", (None, None))])
def test_tyre_range(spark, width, expected):
    low, high = rerank.tyre_range(F.lit(width))
    assert tuple(spark.range(1).select(low, high).collect()[0]) == expected


def test_weights():
    assert rerank.Weights.of({"oversample": 5, "w_event_match": 0.1, "w_has_structured_fields": 0.01}).event_match == 0.1
    with pytest.raises(TypeError):
        rerank.Weights.of({"w_nothing": 1})


ARTICLE = """Bikes of The Race
24 November, 2025
Anna Smith
Age
35
Location:
Spain
Bike
: Steel one
Electronic shifting
Sí
Key items of kit
tent
stove
Bo
Your age:
Location
Cap number
12
Tyre width
50mm+
Age
200"""


def test_parse_riders():
    a, b, c = parsing.parse_riders(ARTICLE)
    assert (a["name"], a["age"], a["location"], a["bike"], a["electronic_shifting"], a["key_items"]) == ("Anna Smith", "35", "Spain", "Steel one", True, "tent\nstove\nBo")
    assert (b["name"], b["age"], b["location"], b["tyre_width"]) == ("Bo", None, "Cap number", "50mm+")
    assert (c["name"], c["age"]) == ("50mm+", None)
    assert parsing.parse_riders(None) == parsing.parse_riders("Age: 35") == []


def test_json_objects(spark):
    text = '{"a": 1}\n\n{"a":\n {"b": "}{\\""}}{"a": 3}'
    assert [json.loads(x)["a"] for x in parsing.json_objects(text)] == [1, {"b": '}{"'}, 3]
    with pytest.raises(ValueError):
        list(parsing.json_objects('{"a": 1'))
    rows = spark.createDataFrame([('{"qid": "q"}\n{"qid":\n"r"}',)], "value string")
    assert [r["qid"] for r in parsing.read_objects(rows, "qid string").orderBy("pos").collect()] == ["q", "r"]


@pytest.mark.parametrize("raw, score, tags, valid", [
    ('<think>{</think>{"score": 9, "tags": ["a", ""]}', 6, ["a"], True), ('{"score_0_to_5": -1, "tags": "x"}', 0, ["x"], True), ('{"score_0_to_6": 4, "tags": ""}', 4, [], True), ("none", None, [], False), (None, None, [], False),
])
def test_verdict(spark, raw, score, tags, valid):
    v = judging.verdict(F.lit(raw).cast("string"))
    assert tuple(spark.range(1).select(v["score"], v["tags"], v["valid"]).collect()[0]) == (score, tags, valid)


def test_tool_calls(spark):
    messages = '[{"tool_name": "a"}, {"name": "b", "tool_calls": [{"function": {"name": "c"}}]}, {"tool": "a"}, {}]'
    call = lambda t: spark.range(1).select(judging.calls_in_messages(F.lit(t))).collect()[0][0]
    assert call(messages) == ["a", "b", "c"] and call('{"name": "x"}') == ["x"]
    assert spark.range(1).select(judging.calls_in_text(F.lit("ran a_b then c"), ["a", "c", "a_b"])).collect()[0][0] == ["c", "a_b"]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, v string, made int")
    new = spark.createDataFrame([(2, "B"), (3, "C")], "id int, v string")
    once = sync.upsert(old, new, ["id"], stamp={"made": F.lit(9)})
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, sync.upsert(once, new, ["id"], stamp={"made": F.lit(9)}).collect())) == [(1, "a", 1), (2, "B", 9), (3, "C", 9)]


def test_merge_and_dedupe(spark):
    old = spark.createDataFrame([("u", 1)], "url string, n int")
    new = spark.createDataFrame([("u", 2), ("v", 4), ("v", 3), (" ", 5), (None, 6)], "url string, n int")
    assert sorted(map(tuple, sync.merge_existing_wins(old, new, "url", F.col("n")).collect())) == [("u", 1), ("v", 3)]
    rows = spark.createDataFrame([(1, "Ann ", 1), (1, "ann", 2), (1, None, 3), (1, " ", 4)], "a int, name string, o int")
    assert sorted(r["o"] for r in sync.unnamed_once(rows, ["a"], "name", F.col("o")).collect()) == [1, 3]


def test_articles_and_riders(spark):
    rows = spark.createDataFrame([("", "T", "u", None, "b"), (None, None, None, "", "c")], "title string, article_title string, url string, body string, text string")
    assert [(r["title"], r["url"], r["body"]) for r in sync.articles(rows).collect()] == [("T", "u", "b")]
    people = spark.createDataFrame([(1, None, "Bo", " 41 "), (2, "Al", None, "x")], "id int, name string, rider_name string, age string")
    out = sync.riders(people, {"name": ["name", "rider_name"], "age": ["age"], "bike": ["bike"]})
    assert sorted(map(tuple, out.select("id", "name", "age", "bike").collect())) == [(1, "Bo", 41, None), (2, "Al", None, None)]


@pytest.mark.parametrize("exact, similar, expected", [(5, 0, "exact_event"), (4, 3, "exact_event"), (2, 0, "exact_plus_similar"), (1, 3, "exact_plus_similar"), (0, 1, "similar_events"), (0, 0, "global")])
def test_scope(spark, exact, similar, expected):
    assert spark.range(1).select(events.scope(F.lit(exact), F.lit(similar))).collect()[0][0] == expected


def test_first_heading_and_article():
    page = "<body><h1>Fir<b>st</b></h1><article><p>a</p><article>b</article><script>x</script></article><h1>Second</h1><article>c</article><main>m</main><main>n</main></body>"
    assert parsing.parse_article(page) == ("First", "a\nb", "m")
    assert parsing.parse_article("<p>x</p>") == ("", "", "x") and parsing.parse_article(None) == ("", "", "")


def test_priority_keeps_rows_and_takes_the_last(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id int, name string")
    by_id = spark.createDataFrame([(1, "old", 1), (1, "new", 2), (2, None, 1), (None, "never", 1)], "key int, truth string, pos int")
    by_name = spark.createDataFrame([("b", "x"), ("b", "y"), ("a", "z")], "key string, truth string")
    out = sync.by_priority(rows, (by_id, "truth", F.col("id")), (by_name, "truth", F.col("name")), fallback=F.lit("none"))
    assert sorted((r["id"], r["truth"], r["found_by"]) for r in out.collect()) == [(1, "new", 1), (2, "y", 2), (3, "none", 0), (4, "none", 0)]


@pytest.mark.parametrize("query, least, most, hint", [
    ("TCR setup, 2.1-2.4\" tyres", 2.1, 2.4, "transcontinental"), ("the GB Duro with 2 - 2.2' rubber", 2.0, 2.2, "gbd"), ("GBDuro or Transcontinental", None, None, "transcontinental"), ("28-32mm", None, None, None),
])
def test_constraints(spark, query, least, most, hint):
    c = rerank.constraints(F.lit(query))
    assert tuple(spark.range(1).select(c["tyre_min_inch"], c["tyre_max_inch"], c["event_hint"]).collect()[0]) == (least, most, hint)


def test_event_rule_applies(spark):
    hits = spark.createDataFrame([(1, 0.5, 1, "gbd-2023"), (1, 0.5, 2, "transcontinental-9")], "query_id int, score double, pos int, event_key string")
    hit = {c: F.lit(None).cast("string") for c in ("text", "frame_type", "tyre_width", "wheel_size")} | {"event_key": F.col("event_key"), "electronic": F.lit(None).cast("boolean")}
    out = rerank.rerank(hits, rerank.constraints(F.lit("what for the tcr")), hit)
    assert {r["pos"]: r["place"] for r in out.collect()} == {1: 2, 2: 1}


@pytest.mark.parametrize("chars", [1_000_000, 13])
def test_lexicon_in_one_and_several_automata(spark, chars):
    """Order of the entries, the longest alias and whole words."""
    texts = spark.createDataFrame([(1, "a mountain bike race"), (2, "mountains of mountain bikes"), (3, "nothing"), (4, ""), (5, None), (6, "ab")], "doc_id int, text string")
    entries = spark.createDataFrame([(0, "m", "mountain"), (1, "b", "mountain bike"), (2, "r", "race"), (3, "a", "ab"), (4, "e", "")], "ord int, key string, alias string")
    assert len(lexicon.automata(entries, chars=chars)) == (1 if chars > 13 else 3)
    got = lambda **k: {r["doc_id"]: r["alias"] for r in lexicon.first_in_lexicon(texts, entries, chars=chars, **k).collect()}
    none = {3: None, 4: None, 5: None, 6: "ab"}
    assert got() == {1: "mountain", 2: "mountain"} | none
    assert got(longest=True) == {1: "mountain bike", 2: "mountain bike"} | none
    assert got(longest=True, whole=True) == {1: "mountain bike", 2: "mountain"} | none
    assert {r["alias"] for r in lexicon.first_in_lexicon(texts, entries.limit(0)).collect()} == {None}


@settings(max_examples=60, deadline=None)
@given(st.text("ab é", max_size=40), st.sets(st.text("abé ", min_size=1, max_size=5), max_size=8), st.booleans())
def test_aliases_of_a_text_against_plain_search(text, aliases, whole):
    import pickle

    names = sorted(aliases)
    got = lexicon._in_text(text, *pickle.loads(lexicon._automaton(names)), whole) if names else {}
    want = {}
    for number, name in enumerate(names):
        at = [i for i in range(len(text)) if text.startswith(name, i)]
        if whole:
            at = [i for i in at if (i == 0 or text[i - 1] == " ") and (i + len(name) == len(text) or text[i + len(name)] == " ")]
        if at:
            want[number] = [at[0], len(at)]
    assert got == want


def test_a_lexicon_of_many_aliases_takes_time_by_length_of_text(spark):
    """20,000 aliases, each text in one pass: four times the text takes about four times as long."""
    import pickle
    import time

    names = sorted({f"event {i} of {i % 7}" for i in range(20_000)})
    automaton = pickle.loads(lexicon._automaton(names))
    spent = []
    for n in (30_000, 120_000):
        text = "a ride and event 77 of 0 then event 5 of 5 more " * (n // 48)
        begin = time.process_time()
        found = lexicon._in_text(text, *automaton, True)
        spent.append(time.process_time() - begin)
        assert {names[k]: v[1] for k, v in found.items()} == {"event 77 of 0": n // 48, "event 5 of 5": n // 48}
    assert spent[1] < 12 * spent[0] + 0.1
    with pytest.raises(ValueError, match="characters"):
        lexicon.automata(spark.createDataFrame([("x" * 20,), ("y" * 20,)], "alias string"), chars=2)


def test_grounding(spark):
    articles = spark.createDataFrame([(1, "Tour Divide 2023"), (2, "Tour Divide 2024"), (3, "Silk Road"), (4, "Nobody's"), (5, " ")], "article_id bigint, title string")
    owners = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12), (2, 13), (3, 20), (5, 9), (4, None)], "article_id bigint, owner_id bigint")
    similar = spark.createDataFrame([("Silk Road", "Tour Divide 2023"), ("Far Away", "Silk Road"), ("Tour Divide 2024", "never used")], "event string, title string")
    queries = spark.createDataFrame([
        (1, "Wheels for the TOUR DIVIDE?", None), (2, "the silk-road, please", "x"), (3, "what to pack", "Tour Divide"), (4, "nobodys race", None), (5, "bags", "Far Away"), (6, "bags", "divide"), (7, None, ""),
        (8, "silk roads", "Unheard Of"),
    ], "query_id int, query string, hint string")
    out = {r["query_id"]: tuple(r)[1:] for r in events.ground(queries, articles, owners, similar).collect()}
    assert out == {
        1: ("Tour Divide 2023", [1, 2], 4, False, [], "exact_event"), 2: ("Silk Road", [3], 1, True, ["Tour Divide 2023"], "exact_plus_similar"), 3: ("Tour Divide", [1, 2], 4, False, [], "exact_event"),
        4: (None, [], 0, False, [], "global"), 5: ("Far Away", [], 0, True, ["Silk Road"], "similar_events"), 6: ("divide", [1, 2], 4, False, [], "exact_event"), 7: (None, [], 0, False, [], "global"),
        8: ("Silk Road", [3], 1, True, ["Tour Divide 2023"], "exact_plus_similar"),
    }


@pytest.mark.parametrize("title, hint, query, bonus", [
    ("Granguanche Road", "granguanche", "a road bike", 0.24), ("Granguanche Trail", "granguanche", "road", 0.0), ("Gravel and Road", None, "gravel", 0.16), ("X Trail", "x", "gravel", 0.04),
    ("X Road", "x", "trail", -0.08), ("X Gravel", "x", "trail", 0.04), ("X Gravel", "x", "road", -0.04), ("Offroad", "x", "road", 0.0), (None, "granguanche", "road", 0.0), ("X Road", "x", "none", 0.0),
])
def test_subtype_bonus(spark, title, hint, query, bonus):
    t, h, q = (title_words(F.lit(x).cast("string")) for x in (title, hint, query))
    assert spark.range(1).select(events.subtype_bonus(t, h, q)).collect()[0][0] == pytest.approx(bonus)


def test_final_rank(spark):
    names = "query_id int, owner_id int, same_event boolean, exact_scope boolean, component_hit boolean, known_event boolean, score double, coverage int, year int, text_length int"
    rows = [
        (1, 1, False, True, True, True, 0.9, 9, 2024, 9), (1, 2, True, False, False, False, 0.1, 0, None, None), (1, 3, False, True, False, True, 0.95, 0, 0, 0), (1, 4, False, True, False, True, 0.95, 1, 0, 0),
        (1, 5, False, True, False, True, 0.95, 1, 2020, 0), (1, 6, False, True, False, False, 0.99, 9, 2024, 9), (1, 7, False, False, True, True, 1.0, 9, 2024, 9), (1, 8, False, True, False, True, 0.95, 1, 2020, 0),
    ]
    owners = spark.createDataFrame(rows, names)
    of = lambda asked: [r["owner_id"] for r in search.final_rank(owners, 7, asked).orderBy("place").collect()]
    assert of(F.lit(False)) == [2, 5, 8, 4, 3, 1, 6]
    assert of(None) == [2, 1, 5, 8, 4, 3, 6]


def test_index_recall_and_exactness(spark, monkeypatch, tmp_path):
    """Recall of the probed lists is at least 0.9, all lists give the exact answer, every row is indexed."""
    monkeypatch.setattr(nearest, "BLOCK", 64)
    r = np.random.default_rng(6)
    x = (r.normal(size=(30, 16))[r.integers(0, 30, 1500)] + 0.4 * r.normal(size=(1500, 16))).tolist()
    v = spark.createDataFrame([*enumerate(x), (9000, None), (9001, [0.0] * 16), (9002, [1.0]), (None, x[0])], "id bigint, vector array<double>").filter("id is not null")
    queries = v.filter("id % 25 = 0")
    exact = {(h["query_id"], h["id"]) for h in nearest.nearest(v, queries, 10).filter("similarity is not null").collect()}
    centres = index.fit(v, 24, sample=600)
    lists = index.assigned(v, centres)
    assert centres.shape == (24, 16) and lists.count() == 1500
    found = lambda rows, probes: {(h["query_id"], h["id"]) for h in index.search(rows, queries, centres, 10, probes).collect()}
    assert len(found(lists, 4) & exact) >= 0.9 * len(exact)
    index.write(v, centres, str(tmp_path / "index"))
    assert found(spark.read.parquet(str(tmp_path / "index")), 24) == exact
    assert index.fit(v.limit(0), 5).shape == (1, 1) and index.search(lists.limit(0), queries, centres, 3, 2).count() == 0


def test_retries():
    from tarnbridge.operators.embedding import with_retries

    calls = []

    def twice(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise OSError("no answer")
        return np.zeros((len(texts), 2))

    assert with_retries(twice, (0.0, 0.0, 0.0))(["a"]).shape == (1, 2) and len(calls) == 3
    with pytest.raises(RuntimeError, match="after 2 calls"):
        calls.clear()
        with_retries(twice, (0.0, 0.0))(["a"])


def test_event_hints(spark):
    from tarnbridge.operators import intent

    f = intent.flags(F.lit("a remote gravel race in the desert mountain"))
    none = F.lit(None).cast("string")
    out = spark.range(1).select(intent.descriptors(f, none, none.cast("int"), none.cast("int"), F.lit(" Badlands ")).alias("d"), *[c.alias(n) for n, c in intent.archetype_details(f).items()]).collect()[0]
    assert out["d"].startswith(f"{intent.FIRST_WORDS}, Badlands, gravel ultra race, arid, heat, remote, mixed dirt roads") and out["adjacent"] == ["gravel_ultra", "mountain_offroad_ultra"]
    assert (out["terrain"], out["environment"], out["format"]) == (["mountainous"], ["desert", "remote"], ["ultra", "self_supported"])


def test_code_search_recall_and_exactness(spark, monkeypatch, tmp_path):
    """Codes of all lists and few vectors find 0.9 of the nearest; with every vector as a candidate the answer is exact."""
    r = np.random.default_rng(7)
    x = (r.normal(size=(40, 24))[r.integers(0, 40, 2000)] + 0.6 * r.normal(size=(2000, 24))).tolist()
    v = spark.createDataFrame([*enumerate(x), (9000, None), (9001, [0.0] * 24), (9002, [1.0])], "id bigint, vector array<double>")
    queries = v.filter("id % 40 = 0 and id < 2000")
    exact = {(h["query_id"], h["id"]) for h in nearest.nearest(v, queries, 10).collect()}
    centres, books = index.fit(v, 8), index.fit_codes(v, parts=8)
    assert books.shape == (8, 256, 3)
    index.write_codes(v, centres, books, str(tmp_path / "index"))
    codes, lists = (spark.read.parquet(str(tmp_path / "index" / n)) for n in ("codes", "vectors"))
    assert sum(len(row["ids"]) // 8 for row in codes.collect()) == 2000 and sum(len(row["codes"]) for row in codes.collect()) == 2000 * 8
    found = lambda probes, most: {(h["query_id"], h["id"]) for h in index.search_codes(codes, lists, queries, centres, books, 10, probes, most).collect()}
    got = found(8, 80)
    read = 8 / (4 * 24) + 80 / 2000  # of the bytes of all vectors as 32-bit numbers
    assert len(got & exact) >= 0.9 * len(exact) and read <= 0.25
    assert found(8, 2000) == exact
    assert len(found(3, 80) & exact) >= 0.6 * len(exact)
    assert index.fit_codes(v.limit(0)).shape[:2] == (16, 1)


def test_links_and_metrics_in_any_spelling(spark):
    page = """<A class=x HREF='/one?a=1'>1</A><a title="a > b" href = /two>2</a><a name="n">3</a><!-- <a href="/no"> --><p data-x='<a href="/no">'>x</p><a href="/three"/>"""
    rows = spark.createDataFrame([(page,), (None,), ("",)], "html string")
    assert [r[0] for r in rows.select(parsing.links_of("html")).collect()] == [["/one?a=1", "/two", "/three"], [], []]
    texts = spark.createDataFrame([("1200 KM and 900 M",), ("20 kmh, 300 mm",), ("45km 1500m",), ("1 km 20 m",)], "t string")
    got = texts.select(intent.metric(F.col("t"), intent.KM).alias("km"), intent.metric(F.col("t"), intent.METRES).alias("m")).collect()
    assert [tuple(r) for r in got] == [(1200, 900), (None, None), (45, 1500), (None, None)]


def test_flags_are_found_once_a_row(spark, data):
    """What is built on flags names them; before, each use searched the text again."""
    from tarnbridge.plans import rule_queries

    for query in (rule_queries.descriptor_query, rule_queries.archetype_details, rule_queries.keyword_flags):
        plan = query(spark, data)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("no services") == 1


def test_setup_patterns_match_only_where_their_plain_part_is():
    import re

    from tarnbridge.plans.rule_queries import PHRASES

    made = ["Enve ses 4.5 WHEELS", "ninth wave x wheel", "29er", "29", "27.5", "conti gp", "Continental GP", "650x47b", "700x40C", "105 RD-R7000 |", "1 x 12", "2x11-40", "50-34/11-34", "apidura bag", "restrap frame bags", "40 mm"]
    for patterns in intent.SETUP.values():
        for p in patterns:
            plain = intent.always_there(p)
            assert plain.strip()
            assert all(plain in t.lower() for t in [*PHRASES, *made] if re.search(p, t, re.I))
    assert intent.always_there(r"\b\d{2}\s?mm\b") == "mm"


def test_a_list_has_its_queries_in_one_row():
    """Codes meet blocks of queries' vectors: before, a row of 16 kB for each query and list."""
    import pyarrow as pa

    from tarnbridge.operators import index

    rows = [(i % 3, i, [1.0 * i, 2.0]) for i in range(12)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["list", "id", "vector"])
    (out,) = index._query_blocks(iter([batch]))
    assert out.column(0).to_pylist() == [0, 1, 2]
    assert [np.frombuffer(b, "<i8").tolist() for b in out.column(1).to_pylist()] == [[0, 3, 6, 9], [1, 4, 7, 10], [2, 5, 8, 11]]
    assert sum(len(b) for b in out.column(2).to_pylist()) == 12 * 2 * 8


def test_delete_cascade_deals_rows_out_by_their_number(spark, monkeypatch):
    monkeypatch.setattr("tarnbridge.sources.tables.DEALT_ROWS", 10)
    parents, children = spark.range(60).withColumnRenamed("id", "p"), spark.range(200).selectExpr("id % 70 AS c", "id")
    left, rows = sync.delete_cascade(parents, children, spark.createDataFrame([(3,), (3,), (9,), (None,)], "p bigint"), "p", "c")
    assert sorted(r["p"] for r in left.collect()) == [i for i in range(60) if i not in (3, 9)]
    assert sorted(r["id"] for r in rows.collect()) == [i for i in range(200) if i % 70 < 60 and i % 70 not in (3, 9)]
    assert rows.rdd.getNumPartitions() == 20
    assert "BroadcastHashJoin" not in rows._jdf.queryExecution().executedPlan().toString()


def test_blocks_come_in_small_batches(spark):
    """Rows of a megabyte, as blocks of vectors are: a worker gets a few at a time."""
    import pyarrow as pa

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS matrix")
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["id"]) for b in batches)
    sizes = [r["id"] for r in rows.mapInArrow(count, "id bigint").collect()]
    assert sum(sizes) == 40 and max(sizes) <= 10
