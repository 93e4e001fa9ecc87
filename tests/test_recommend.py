import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnbridge.operators import embedding, event_names, recommend, synthesis, web_context
from tarnbridge.sources import tables

KNOWN = {"tour of spain": "Tour of Spain", "tos": "Tour of Spain", "big divide": "Big Divide"}


@pytest.mark.parametrize("question, name", [
    ("Which tyres for the TOUR of Spain?", "Tour of Spain"), ("tos setup", "Tour of Spain"), ("I like tossing", "Unknown event"), ("is the big, big divide far", "Big Divide"),
    ("I am doing Long Ridge Trail 300 next week", "Long Ridge Trail 300"), ("what now", "Unknown event"), ("", "Unknown event"), (None, "Unknown event"), ("spain tour", "Tour of Spain"),
])
def test_event_name(question, name):
    assert event_names.event_name(question, KNOWN) == name


@pytest.mark.parametrize("question, name", [
    ("srmr or the ht550?", "Highland Trail 550"), ("bags for GB-Duro", "GB Duro"), ("Recommend 3", "Unknown event"), ("Which bags for Trans Pyrenees & Back official rules?", "Trans Pyrenees & Back"),
    ("riding the coast to Lands End, quickly", "coast to Lands End"), ("doing Odyssey", "Odyssey"), ("set up for the Rally of Tales", "Rally of Tales"), ("Best Lights", "Unknown event"), ("Show 3 riders", "Unknown event"), ("show 3 riders", "3"), ("for abc", "Unknown event"),
])
def test_event_name_of_known_events_and_by_the_words_before(question, name):
    assert event_names.event_name(question, event_names.KNOWN_EVENTS) == name


def test_parts_of_the_event_cascade():
    assert event_names.trimmed(" (for the  Big Loop setup, and more) ") == "the Big Loop" and event_names.trimmed("?!") == ""
    assert list(event_names.spans("Ride La Ruta de los Conquistadores, or AB & C no")) == ["Ride La Ruta de", "Conquistadores", "AB & C no"]
    assert [n for n in ("", "Give Race", "my bike", "Ride", "Abc", "abcd", "4x", "big tour", "a b c d e f g h 9") if event_names.reads_as_event(n)] == ["Ride", "4x", "big tour"]
    assert event_names.score("Tour Divide", event_names.KNOWN_EVENTS) == 18 and event_names.score("Loop 300", {}) == 7 and event_names.event_name("anything", {}) == "Unknown event"


@pytest.mark.parametrize("name, good", [("Big Divide", True), ("what is it", False), ("", False), (None, False), ("unknown event", False), ("a b c d e f g h i", False)])
def test_is_event_name(spark, name, good):
    assert spark.range(1).select(event_names.is_event_name(F.lit(name).cast("string"))).collect()[0][0] is good


def test_embedding(spark):
    rows = spark.createDataFrame([(1, "Tent, quilt"), (2, "tent  QUILT"), (3, "tent, quilt "), (4, " ")], "id bigint, t string")
    some = embedding.to_embed(rows, spark.createDataFrame([(1,)], "id bigint"), "id", "t")
    assert sorted(r["id"] for r in some.collect()) == [2, 3]
    assert sorted(r["id"] for r in embedding.to_embed(rows, rows, "id", "t", "all").collect()) == [1, 2, 3]
    calls = spark.sparkContext.accumulator(0)

    def counted(texts):
        calls.add(len(texts))
        return embedding.hashed_words(16)(texts)

    got = {r["id"]: r["embedding"] for r in embedding.embedded_once(rows.filter("id < 4"), "id", "t", counted, 16).collect()}
    assert got[1] == got[3] and np.isclose(np.linalg.norm(got[2]), 1) and calls.value == 2
    with pytest.raises(Exception, match="blank text"):
        embedding.embedded(rows, "id", "t", embedding.hashed_words(16), 16).collect()
    with pytest.raises(Exception, match="gave"):
        embedding.embedded(rows.filter("id = 1"), "id", "t", embedding.hashed_words(8), 16).collect()


def test_candidates(spark):
    rows = [(1, 1, "https://www.facebook.com/a"), (1, 2, "https://bikepacking.com/b"), (1, 3, "https://site.org/c"), (1, 4, "https://dotwatcher.cc/d"), (2, 1, "https://bikepacking.com/e"), (3, 1, "https://netflix.com/f")]
    got = sorted(map(tuple, web_context.candidates(spark.createDataFrame(rows, "event int, rank int, url string")).select("event", "place", "url", "tracker_url").collect()), key=str)
    assert got == [(1, 1, "https://site.org/c", "https://dotwatcher.cc/d"), (2, 1, "https://bikepacking.com/e", None), (3, None, None, None)]


def test_two_attempts(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, rider int, hit boolean")
    first = hits([(1, i, False) for i in range(3)] + [(2, 1, True)] + [(3, i, i == 0) for i in range(3)] + [(5, i, False) for i in range(3)])
    second = hits([(q, 9, q == 1) for q in range(1, 6)])
    asks = spark.createDataFrame([(1, "tyres"), (2, "full_setup"), (3, "tyres"), (4, "bags"), (5, "full_setup")], "query_id int, component string")
    assert {r["query_id"]: r["attempt"] for r in recommend.two_attempts(first, second, asks).collect()} == {1: 2, 2: 2, 3: 1, 4: 2, 5: 1}


def test_filled_component(spark):
    rows = spark.createDataFrame([(1, 1, " ", ["a bag", "x"]), (1, 2, "Roll", ["y"]), (2, 1, None, ["none", "a TENT bag "]), (3, 1, None, None)], "query_id int, place int, bags string, chunks array<string>")
    got = {r["query_id"]: r["value"] for r in recommend.filled_component(rows, "bags", recommend.CHUNK_WORDS["bags"]).collect()}
    assert got == {1: "Roll", 2: "a TENT bag", 3: None}


def test_intent_queries_and_answer(spark):
    first, second = recommend.intent_queries(F.lit("broad"), F.lit(" q? "), F.col("c"), {"bags": "bags, packs"})
    rows = spark.createDataFrame([("bags",), ("full_setup",)], "c string").select(first, second)
    assert [tuple(r) for r in rows.collect()] == [("broad. Focus: bags, packs", "broad"), ("broad", "broad. Question focus: q?")]
    text = spark.range(1).select(recommend.answer(F.lit("E"), F.lit("s"), {"bike": F.lit("b"), "bags": F.lit(" ")})).collect()[0][0]
    assert text == "Event: E\ns\nbike: b"


def test_questions_repeat_and_are_unique(spark):
    events = spark.createDataFrame([("A", 2024), ("a ", 2024), ("B", 2025)], "event string, year int")
    forms, ends = ["{event} {year}: what?", "For {event}?", "Plan {event} {year}"], ["One.", "Two."]
    make = lambda seed: sorted(r["question"] for r in synthesis.questions(events, forms, ends, 3, seed).collect())
    assert make(1) == make(1) and len(set(make(1))) == 6 and all("{" not in q for q in make(1))


def test_tables(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id bigint, v string")
    assert [r["v"] for r in tables.by_id(rows, "id", "2").collect()] == ["c"] == [r["v"] for r in tables.by_id(rows, "id", 2).collect()]
    assert [r["id"] for r in tables.repeated_keys(rows, "id").collect()] == [1]
    assert tables.missing_tables(spark, ["nothing_of_this_name"]) == ["nothing_of_this_name"]


def test_rank_candidates_and_lists(spark):
    from tarnbridge.operators import search

    hits = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.8, 2), (1, 5, 0.7, 3), (1, 7, 0.6, 4)], "query_id int, owner_id int, score double, pos int")
    ranked = search.rank_candidates(hits, 2)
    assert [(r["place"], r["owner_id"]) for r in ranked.orderBy("place").collect()] == [(1, 5), (2, 6)]
    assert [[c["owner_id"] for c in r["candidates"]] for r in search.candidate_lists(ranked, ["owner_id", "total"]).collect()] == [[5, 6]]


def test_similar_owners_stay_empty_in_an_unknown_scope(spark):
    from tarnbridge.operators import search

    v = spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(8)], "id bigint, vector array<double>, label int")
    q = spark.createDataFrame([(0, [1.0, 0.0], 0), (1, [1.0, 1.0], None), (2, [1.0, 2.0], 77)], "id bigint, vector array<double>, label int")
    rows = search.similar_owners(v, q, F.col("id"), "label", search.Limits(3, 4, 1)).collect()
    assert {r["query_id"] for r in rows} == {0, 1}
    assert [r["scope"] for r in sorted(rows, key=lambda r: r["place"]) if r["query_id"] == 0] == ["exact"] * 3 + ["similar"]
    assert {r["scope"] for r in rows if r["query_id"] == 1} == {"similar"}


def test_chunks(spark):
    from tarnbridge.operators import chunks

    riders = spark.createDataFrame([(1, " Trek ", "steel", True, "tent; quilt"), (2, " ", None, None, None), (3, "Own", None, None, "")], "id int, bike string, frame_material string, electronic_shifting boolean, key_items string")
    got = sorted((r["id"], r["chunk_kind"], r["chunk_ix"], r["chunk_text"]) for r in chunks.rider_chunks(riders, "id").collect())
    assert got == [(1, "bike", 0, "Bike: Trek (frame_material=steel, electronic_shifting=True)"), (1, "key_items", 0, "Key items: tent; quilt"), (3, "bike", 0, "Bike: Own")]


def test_trace(spark):
    from tarnbridge.tracing import Trace

    trace = Trace()
    double = trace.traced("double")(lambda x: 2 * x)
    assert double(2) == 4
    with pytest.raises(TypeError):
        double(None)
    rows = trace.as_table(spark).collect()
    assert [(r["tool"], r["args"]) for r in rows] == [("double", "[[2], {}]"), ("double", "[[null], {}]")] and "error" in rows[1]["result"]


def test_judged(spark):
    from tarnbridge.operators import judging

    rows = spark.createDataFrame([(1, "a"), (2, "bad")], "id int, q string")
    out = judging.judged(rows, F.col("q"), lambda prompts: ['{"score": 5}' if p == "a" else "none" for p in prompts])
    assert {r["id"]: (r["score"], r["valid"]) for r in out.collect()} == {1: (5, True), 2: (None, False)}


def test_resolved_contexts(spark):
    kind = "key string, created_at double, c struct<summary:string,surface:string,route_character:string,climate_notes:string,resupply_notes:string,constraints:array<string>,distance_km:double,total_climbing_m:int>, r array<struct<title:string,snippet:string>>, o string, t string"
    row = lambda key, at, o: (key, at, None, None, o, None)
    cache = spark.createDataFrame([row("a", 95.0, "old"), row("a", 99.0, "new"), row("b", 10.0, "stale"), row("c", 99.0, "")], kind)
    fetched = spark.createDataFrame([row("a", 100.0, "f"), row("b", 100.0, "f"), row("c", 100.0, "f")], kind)
    events = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    got = {r["key"]: (r["o"], r["from_cache"]) for r in web_context.resolved(events, cache, fetched, 100.0, 10.0).collect()}
    assert got == {"a": ("new", True), "b": ("f", False), "c": ("f", False), "d": (None, False)}


def test_eval_queries(spark):
    events = spark.createDataFrame([("A",), ("B",), ("A",)], "event string")
    make = lambda seed: sorted(map(tuple, synthesis.eval_queries(events, {"kit": ["tent", "bivy"], "goal": ["fast", "slow"]}, ["{event}: {kit}, {goal}", "for {event} {goal} {kit}"], 5, seed).collect()))
    assert make(3) == make(3) and len({q for q, _, _ in make(3)}) == 10 and all("{" not in t for _, _, t in make(3))


def test_a_keyed_permutation_takes_each_place_once():
    for size in (1, 2, 3, 12, 100, 1000):
        orders = []
        for key in (0, 5, 2**63 - 1, -7):
            got = synthesis.permuted(np.arange(size), np.full(size, key), size).tolist()
            assert sorted(got) == list(range(size))
            orders.append(tuple(got))
        assert size < 12 or len(set(orders)) == 4


def test_eval_queries_of_an_event_are_distinct(spark):
    pools = {"kit": [f"k{i}" for i in range(7)], "goal": ["fast", "slow", "far"]}
    make = lambda n, seed=1: synthesis.eval_queries(spark.createDataFrame([("A",), ("B",), (None,)], "event string"), pools, ["{event}: {kit}, {goal}", "for {event} {goal} {kit}"], n, seed).collect()
    rows = make(30)
    assert len({(r["event"], r["query"]) for r in rows}) == len(rows) == 60
    assert {r["query"] for r in rows} != {r["query"] for r in make(30, 2)} and sorted(map(tuple, rows)) == sorted(map(tuple, make(30)))
    assert len(make(1000)) == 2 * 42  # no more than there are choices


def test_counters_and_evidence(spark):
    rows = spark.createDataFrame([(1, 2, "x", None), (1, 2, " ", "y"), (2, 0, "z", "z")], "query_id int, cov int, a string, b string")
    out = recommend.counters(rows, ["a", "b"]).collect()[0]
    assert (out["a"], out["b"]) == (2, 2) and out["avg_coverage"] == pytest.approx(4 / 3)
    assert {r["query_id"]: r["enough"] for r in recommend.enough_evidence(rows, "cov").collect()} == {1: True, 2: False}
