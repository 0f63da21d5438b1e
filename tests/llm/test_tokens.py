"""BPE and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, tokenfile

TEXTS = ["", None, "Hello world", "a  b\n\n\n c\t\td ", " lead", "tail \n", "don't we'll 1234 x²  ½", "<|endoftext|> in <|endoftext|>text", "naïve “quotes” 日本語 🎉🎉",
         "x" * 3000, "\n", " ", "  ", "a\n b", "a \nb", "a   b", "it's\n\nfine", "the the the " * 50, " x \u0085y"]
SCHEMA = "doc_id long, text string, id string, ids int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_vocabulary())


def expected(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_codec_matches_library(library):
    codec = bpe.codec(bpe.default_vocabulary())
    for text in TEXTS:
        ids = np.frombuffer(codec.encode(text or ""), "<u4").tolist()
        assert ids == expected(library, text), text
        assert codec.decode(codec.encode(text or "")).decode() == library.decode(ids, skip_special_tokens=False) == (text or "")
    assert codec.decode(np.array([codec.first[0xFF], codec.first[0x41]], "<u4").tobytes()).decode() == library.decode([codec.first[0xFF], codec.first[0x41]])


def test_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(bpe.default_vocabulary())
    for text in TEXTS:
        assert np.frombuffer(codec.encode(text or ""), "<u4").tolist() == expected(library, text)


def test_digests(spark, library):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(None, "null id", "x", 1), (1, "again", "x", 1), (1, "again", "x", 1)]
    got = sorted(map(tuple, bpe.encode_digests(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = expected(library, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bpe.encode_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_documents_round_trip(spark):
    rows = [(k, t, "x", 1) for k, t in enumerate(TEXTS)]
    got = {r.doc_id: r.decoded for r in bpe.encode_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: t or "" for k, t in enumerate(TEXTS)}


@pytest.mark.parametrize("slots", [8, 1 << 12])
def test_library_encoder(library, slots):
    """Small tables are emptied again and again; texts are met in several orders."""
    enc = tokenfile.LibraryEncoder(bpe.default_vocabulary(), slots)
    texts = [t or "" for t in TEXTS] + ["plain words here", "plain, words. Here\nNext line\u2028sep", "\u201cquoted\u201d text\u00a0nbsp", "", "tab\there", "end\n", "\nstart", "é\u3000x", "a\x1cb", "A" * 500 + " b"]
    for order in (texts, texts[::-1], texts * 2, [""], ["", ""], [" "]):
        got = enc.encode(order)
        assert [x.tolist() for x in got] == [expected(library, t) for t in order]
    raw = "".join(texts).encode()
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    ids, counts = enc.encode_rows(np.frombuffer(raw, np.uint8), at, 2)
    assert ids.tolist() == [x for t in texts for x in [*expected(library, t), 2]] and counts.sum() == len(ids)
    assert enc.encode([]) == []


def test_token_files(spark, library):
    rows = [(97 - k, t, "x", 1) for k, t in enumerate(TEXTS)] + [(5, "same", "x", 1), (5, "same", "y", 2)]
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.token_files(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    at, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*expected(library, t), 2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert tokenfile.token_files(spark.createDataFrame([], SCHEMA)).collect() == []
    with_null = tokenfile.token_files(spark.createDataFrame([(None, "a", "", 0), (1, None, "", 0)], SCHEMA)).orderBy("start").collect()
    assert [(r.doc_id, r.n_tokens) for r in with_null] == [(None, 2), (1, 1)]


def doubling(length):
    """Two strings of the kind that collide under every polynomial hash modulo a power of two."""
    a, b = "a", "b"
    while len(a) < length:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("length", [64, 1024, 4096])
def test_span_hashes_and_token_files_tell_doubling_strings_apart(library, length):
    from tidemark.llm.base import span_hashes
    a, b = doubling(length)
    raw = np.frombuffer((a + b).encode(), np.uint8)
    h = span_hashes(raw, np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
    assert h[0] != h[1]
    encoder = tokenfile.LibraryEncoder(bpe.default_vocabulary())
    texts = [f"x {a} y", f"x {b} y"]
    assert [t.tolist() for t in encoder.encode(texts)] == [expected(library, t) for t in texts]


def test_span_hashes_depend_on_bytes_only():
    from tidemark.llm.base import LONG_SPAN, span_hashes
    parts = [b"", b"a", b"b", b"a\0", b"12345678", b"123456780", b"x" * (LONG_SPAN + 5), b"x" * LONG_SPAN, "é日本".encode()]
    seen = []
    for lead in (b"", b"#", b"#######"):
        raw = np.frombuffer(lead + b"".join(parts), np.uint8)
        at = len(lead) + np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        seen.append(span_hashes(raw, at[:-1], at[1:]).tolist())
    assert seen[0] == seen[1] == seen[2] and len(set(seen[0])) == len(parts)
