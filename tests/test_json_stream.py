import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnbridge.operators import json_stream as J


def step(state, c):
    depth, quoted, escaped = state
    if quoted:
        return depth, not (c == '"' and not escaped), c == "\\" and not escaped
    if c == '"':
        return depth, depth > 0, False
    if c == "{":
        return depth + 1, False, False
    return (depth - (c == "}" and depth > 0), False, False)


@settings(max_examples=600, deadline=None)
@given(st.text('{}"\\a', max_size=16), st.integers(0, 2), st.integers(0, 5))
def test_function_of_a_range_is_what_reading_it_does(text, kind, depth):
    depth = max(depth, int(kind > 0))
    got = J.after(json.loads(json.dumps(J.Range(text.encode()).function())), depth, kind)
    spans = list(J.Range(text.encode()).ends(0, kind, depth))
    state, ended, start = (depth, kind > 0, kind == 2), 0, -1
    for i, c in enumerate(text):
        before, state = state, step(state, c)
        if before[0] and not state[0]:
            ended, start = ended + 1, -1
        elif state[0] and not before[0]:
            start = i
    assert got[:3] == [state[0], state[1] + state[2], ended] and (not state[0] or got[3] == start)
    assert sum(end >= 0 for _, end in spans) == ended and bool(spans and spans[-1][1] < 0) == (state[0] > 0)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text('{}"\\a', max_size=9), max_size=5))
def test_functions_compose(texts):
    depth, kind, ended = 0, 0, 0
    for t in texts:
        depth, kind, n, _ = J.after(J.Range(t.encode()).function(), depth, kind)
        ended += n
    assert [depth, kind, ended] == J.after(J.Range("".join(texts).encode()).function(), 0, 0)[:3]


TEXT = '[ "x" {"a": 1}\n\n,{"a":\n {"b": "}{\\"\\\\"}} {"a": "é🤦🏼 }"}}{"a": [{"x": {}}, "' + "long { text } " * 40 + '"]}\n]'
WANTED = [1, {"b": '}{"\\'}, "é🤦🏼 }", [{"x": {}}, "long { text } " * 40]]


@pytest.fixture
def splits(spark):
    """Files are split into so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, v in zip(names, old, strict=True):
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [64, 100, 1 << 20])
@pytest.mark.parametrize("few", [0, 1000])
def test_any_split_gives_the_same_objects(spark, splits, tmp_path, size, few, monkeypatch):
    monkeypatch.setattr(J, "FEW_RANGES", few)
    for i in range(3):
        (tmp_path / f"f{i}.json").write_text(TEXT * (i + 1) + (" " if i else ""), encoding="utf-8")
    (tmp_path / "empty.json").write_text("")
    splits(size)
    rows = J.objects(spark, str(tmp_path)).collect()
    assert len(rows) == 6 * len(WANTED)
    for i in range(3):
        own = sorted((r["pos"], r["json"]) for r in rows if r["path"].endswith(f"f{i}.json"))
        assert [p for p, _ in own] == list(range(4 * (i + 1)))
        assert [json.loads(o)["a"] for _, o in own] == WANTED * (i + 1)


@pytest.mark.parametrize("tail", ['{"a": {"b": 2}', '{"a": "x', '{"a": "x\\', '{"a": "}', "{"])
@pytest.mark.parametrize("size", [64, 1 << 20])
def test_a_partial_tail_is_an_error_with_its_place(spark, splits, tmp_path, tail, size):
    start = TEXT + "\n" + '{"whole": "one"}' * 9 + "\n"
    (tmp_path / "f.json").write_text(start + tail, encoding="utf-8")
    splits(size)
    with pytest.raises(Exception, match=f"starts at byte {len(start.encode())}"):
        J.objects(spark, str(tmp_path)).collect()


def test_read_stream(spark, tmp_path):
    (tmp_path / "f.json").write_text('{"qid": "q"}\n{"qid":\n"r", "n": 3}')
    assert [tuple(r)[1:] for r in J.read_stream(spark, str(tmp_path), "qid string, n int").orderBy("pos").collect()] == [(0, "q", None), (1, "r", 3)]
    (tmp_path / "f.json").write_text('{"qid": q}')
    with pytest.raises(Exception, match="(?i)malformed"):
        J.read_stream(spark, str(tmp_path), "qid string").collect()
    with pytest.raises(ValueError, match="braces"):
        list(J.Range(b"{" * 2000).ends(0, 0, 0))


def test_a_range_in_parts(spark, tmp_path, monkeypatch):
    """A worker holds a few bytes of a range at a time: before, the whole range."""
    from tarnbridge.operators import json_stream

    monkeypatch.setattr(json_stream, "HELD", 50)
    want = [json.dumps({"a": i, "b": {"c": 'x } " { \\ ' * (i % 5)}}) for i in range(3000)]
    (tmp_path / "x.json").write_text(" \n,".join(want))
    got = {r["pos"]: r["json"] for r in json_stream.objects(spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(3000)] == want

    class Longest:
        def __call__(self, data, *rest):
            yield pa.RecordBatch.from_arrays([pa.array([len(data)])], ["n"])

    lines = spark.read.option("lineSep", "}").text(str(tmp_path)).selectExpr("cast(value as binary) value", "'x' path", "0L start")
    sizes = [r["n"] for r in json_stream._ranges(lines, Longest, "n bigint").collect()]
    assert len(sizes) > 1 and max(sizes) < sum(sizes)
