import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, score string, size string, target string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with columns whose names clash."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0, "x", "x", "x", "x") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


#: null id, null text, empty text, blanks only, repeated rows, equal texts, a long text, odd characters
ODD = [
    (None, "no id here at all today"), (1, None), (2, ""), (3, " \t\n "), (4, "same text for both rows here"), (4, "same text for both rows here"), (5, "same text for both rows here"),
    (6, "word " * 30_000), (7, "a▁b  🤦🏼 漢字\r\n\x00\u2028 é"), (8, "x" * 20_000), (9, "one\ntwo\n\nthree"),
]
