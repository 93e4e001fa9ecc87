import hashlib

import pytest
from pyspark.sql import functions as F

from tarnbridge.functions import hashing as H
from tarnbridge.functions import text as X
from tarnbridge.functions.vectors import cosine


def one(spark, column, **values):
    """The column over one row of values."""
    kinds = {str: "string", float: "double", int: "bigint", bool: "boolean", list: "array<double>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).collect()[0]["x"]




@pytest.mark.parametrize("text, expected", [
    ("Tent, Stove;  tent\n• quilt - mat|MAT", ["Tent", "Stove", "quilt", "mat"]), ("", []), (None, []), ("  \t", []), ("one", ["one"]),
])
def test_phrases(spark, text, expected):
    assert one(spark, X.phrases(F.col("t")), t=text) == expected


def test_packed_keeps_long_items_whole(spark):
    assert one(spark, X.packed(F.split(F.col("t"), "/"), 10), t="aaaa/bbbb/cc/dddddddddddddd/e") == ["aaaa; bbbb", "cc", "dddddddddddddd", "e"]
    assert one(spark, X.packed(F.split(F.col("t"), "/"), 10), t=None) is None
    assert one(spark, X.packed(F.array().cast("array<string>"), 10), t="x") == []


@pytest.mark.parametrize("text, expected", [("abcdefgh", 2), ("abc", 1), ("  ", 0), (None, 0), ("", 0)])
def test_rough_tokens(spark, text, expected):
    assert one(spark, X.rough_tokens(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("Your Age:", "age"), (" Frame type : ", "frame type"), ("your bike", "bike"), ("Age: 35", "age: 35")])
def test_label(spark, text, expected):
    assert one(spark, X.label(F.col("t")), t=text) == expected


@pytest.mark.parametrize("text, expected", [("35 years", "35"), ("0", None), ("121", None), ("about 40", None), (None, None), (" 7", "7")])
def test_age(spark, text, expected):
    assert one(spark, X.age(F.col("t")), t=text) == expected


def test_clean_body(spark):
    body = "\n Results\nFeatures\n\nfirst\n\nlast  \n\nAlso from the site\nmore"
    assert one(spark, X.clean_body(F.col("t")), t=body) == "first\n\nlast"
    assert one(spark, X.clean_body(F.col("t")), t="\n\n") == "" and one(spark, X.clean_body(F.col("t")), t="Results") == ""


@pytest.mark.parametrize("text, expected", [("24 November, 2025", True), ("24 nóvember, 2025", True), ("November 24", False)])
def test_date_line(spark, text, expected):
    assert one(spark, X.is_date_line(F.col("t")), t=text) is expected


def test_titles(spark):
    assert one(spark, X.title_words(F.col("t")), t="Trans-Pyrénées '24 2023: L'Étape ﬁn") == "trans pyrenees 24 letape fin"
    assert one(spark, X.letters_and_digits(F.col("t")), t="Á-b c!") == "ab c"
    a, b = F.col("a"), F.col("b")
    assert one(spark, X.titles_match(a, b), a="tour divide", b="divide tour") and not one(spark, X.titles_match(a, b), a="", b="tour")
    assert one(spark, X.title_exact(a, b), a="the tour divide", b="tour divide") and not one(spark, X.title_exact(a, b), a="detour divide", b="tour divide")
    assert one(spark, X.token_jaccard(a, b), a="a b c", b="b c d") == 0.5 and one(spark, X.token_jaccard(a, b), a="", b="b") == 0.0


def test_redacted(spark):
    log = "plan\nGET https://x.y/z\nsee https://a.b\nlong enough remark with an address https://a.b/c in it\n\n\n\nend"
    assert one(spark, X.redacted(F.col("t")), t=log) == "plan\nlong enough remark with an address [url removed] in it\n\nend"


def test_json_inside(spark):
    assert one(spark, X.json_inside(X.without_thoughts(F.col("t"))), t='<think>{"a": 0}</think> so {"a": {"b": 1}} done') == '{"a": {"b": 1}}'


def test_clean_title(spark):
    assert [one(spark, X.clean_title(F.col("t")), t=t) for t in ("Bikes of Badlands 2023", "The BIKES OF bikes of x ", "", "bikesof")] == ["Badlands 2023", "The   x", "", "bikesof"]


def test_masked(spark):
    assert one(spark, X.masked_dsn(F.col("t")), t="postgresql://me:secret@host/db") == "postgresql://me:***@host/db"
    assert one(spark, X.clipped(F.col("t"), 3), t="abcd") == "abc..." and one(spark, X.clipped(F.col("t"), 4), t="abcd") == "abcd"


def test_point_id_is_unsigned(spark):
    ids = [int(one(spark, H.point_id(F.col("t")), t=str(i))) for i in range(12)]
    assert ids == [int.from_bytes(hashlib.blake2b(str(i).encode(), digest_size=8).digest(), "big") for i in range(12)] and max(ids) > 2**63


@pytest.mark.parametrize("a, b, expected", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], 0.0), ([], [], 0.0)])
def test_cosine_guards(spark, a, b, expected):
    assert one(spark, cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(expected)


@pytest.mark.parametrize("r, expected", [((1, 2, 3, 4), False), ((1, 3, 3, 4), True), ((None, None, 3, 4), True), ((5, None, None, 4), False), ((5, None, None, 5), True)])
def test_overlaps(spark, r, expected):
    row = spark.createDataFrame([r], "a int, b int, c int, d int")
    assert row.select(H.overlaps(*map(F.col, "abcd")).alias("x")).collect()[0]["x"] is expected


def test_fresh(spark):
    t = F.col("t")
    assert one(spark, H.fresh(t, 100.0, 10.0), t=90.0) and not one(spark, H.fresh(t, 100.0, 10.0), t=89.0) and one(spark, H.fresh(t, 100.0, 10.0), t=0.0)
