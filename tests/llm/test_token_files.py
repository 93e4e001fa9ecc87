import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tarnbridge.llm import token_files as T

from .conftest import ODD

IDS = st.lists(st.one_of(st.integers(0, 1), st.integers(0, 50_256), st.integers(0, 2**30), st.integers(2**59, 2**64 - 1)), max_size=200)


@settings(max_examples=300, deadline=None)
@given(IDS)
def test_codes_come_back(ids):
    code = T.packed(np.array(ids, np.uint64))
    assert T.unpacked(code).tolist() == ids
    at, words = 0, 0  # each word takes as many ids as fit
    while at < len(ids):
        best = next(((n, b) for n, b in zip(T.COUNTS, T.BITS, strict=True) if at + n <= len(ids) and all(x >> b == 0 for x in ids[at : at + n])), None)
        at, words = at + (best[0] if best else 1), words + (1 if best else 2)
    assert len(code) == words


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(T.VOCABULARY)


def as_list(ids):
    return np.frombuffer(ids, "<u4").tolist()


@settings(max_examples=500, deadline=None)
@given(st.lists(st.text(alphabet="ab é \x1c\x85\n\t'12.,!s　​漢<|>\0", max_size=30), max_size=5))
def test_pieces_have_the_ids_of_whole_texts(tokenizer, texts):
    assert list(map(as_list, T.encoder(T.VOCABULARY).encode(texts))) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_pieces_are_forgotten(tokenizer, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 5)
    encoder = T.Encoder(T.VOCABULARY)
    for text in ("some words of a text.", "other words, of a text. " * 3, "x" * 200 + " <|endoftext|> y"):
        assert list(map(as_list, encoder.encode([text]))) == [tokenizer.encode(text, add_special_tokens=False).ids]
        assert len(encoder.known) <= 5 and all(len(p) <= T.LONG for p in encoder.known)


def plain(tokenizer, rows):
    """doc_id, start, n_tokens, ids_crc32 and ids of (doc_id, text) in order."""
    out, start = [], 0
    for doc, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, T.END]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_query_against_whole_texts(spark, data, tokenizer):
    from tarnbridge.llm.queries import QUERIES

    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    got = sorted(tuple(r) for r in QUERIES["op13_token_files"](spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == [r[:4] for r in plain(tokenizer, docs)]


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_odd_rows_and_long_texts_over_blocks(spark, docs, tokenizer, tmp_path, block, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_IDS", block)
    rows = docs([*ODD, (None, "no id here at all today"), (None, None), (-7, "least id, longest text. " * 40)])
    path = str(tmp_path / "tokens")
    T.write_tokens(rows, path)
    index = sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in T.token_index(spark, path).collect()), key=lambda r: r[1])
    assert [r[0] for r in index] == sorted((r["doc_id"] for r in rows.collect() if r["doc_id"] is not None)) + [None] * 3
    want = {r[0]: set() for r in index}
    for r in rows.collect():
        ((_, _, n, crc, ids),) = plain(tokenizer, [(r["doc_id"], r["text"])])
        want[r["doc_id"]].add((n, crc))
    start = 0
    for doc, at, n, crc in index:
        assert at == start and (n, crc) in want[doc]
        start += n
    stream = [i for r in sorted(T.read_tokens(spark, path).collect(), key=lambda r: r["start"]) for i in r["ids"]]
    assert len(stream) == start
    for _, at, n, crc in index:
        assert zlib.crc32(np.array(stream[at : at + n], "<u4").tobytes()) == crc


def test_empty_table(spark, docs, tmp_path):
    path = str(tmp_path / "none")
    T.write_tokens(docs([(1, "x")]).limit(0), path)
    assert T.token_index(spark, path).count() == 0 and T.read_tokens(spark, path).count() == 0


def test_damage_is_an_error():
    whole = T.block(3, 0, np.array([5, 6, 0], np.uint64), [(9, 3, False)]) + T.MAGIC
    assert [(p, k, d.tolist(), T.unpacked(c).tolist()) for p, k, d, _, c in T.blocks_of(whole)] == [(3, 0, [9], [5, 6, 0])]
    for broken in (whole[:-8], whole[:70] + b"x" + whole[71:], b"x" + whole[1:]):
        with pytest.raises(ValueError):
            list(T.blocks_of(broken))


def test_joined_crc():
    data = np.arange(1000, dtype="<u4").tobytes()
    parts = [data[:40], data[40:44], b"", data[44:]]
    assert T.joined_crc([(len(p) // 4, zlib.crc32(p)) for p in parts]) == zlib.crc32(data)
