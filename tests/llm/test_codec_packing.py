"""Tokenizing operators against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import bpe, packing

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a" * 500, "=====" * 50, "hello <|endoftext|> world<|endoftext|>", "日本語 テキスト 混在 tab\t\t x\r\n\r\n  y", "naïve Ωmega ΣΑΣ 🙂🙂👍🏽 zero​width \x00\x01", " " * 300 + "x",
    "don't I'LL we've 12345 3.14", " ́á é", "İstanbul ﬁ ①²", " \x1c \x1d\x1e\x85  x", "a\n \nb", "x  y  z\n", "\U00011de0\U00012475a 1\U00016ff4", "ÀÉ×÷ÿß\x7f\x0b\x0cfoo", "<|startoftext|>x",
]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(BYTE)


@pytest.fixture(scope="module")
def byte_tokenizer():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def word_tokenizer():
    return Tokenizer.from_file(WORD)


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_odd_texts(codec, byte_tokenizer, word_tokenizer):
    words = packing.word_tokens(WORD)
    for text, raw in zip(ODD, codec.encode(ODD), strict=True):
        want = byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert ids(raw) == want
        assert codec.decode(raw) == byte_tokenizer.decode(want, skip_special_tokens=False)
        assert ids(words.encode(text)) == word_tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeinorst ABT.,'\n\t!#19éüß日Ω🙂"), max_size=60))
def test_any_text(codec, byte_tokenizer, word_tokenizer, text):
    assert ids(codec.encode([text])[0]) == byte_tokenizer.encode(text, add_special_tokens=False).ids
    assert ids(packing.word_tokens(WORD).encode(text)) == word_tokenizer.encode(text, add_special_tokens=False).ids


def test_one_by_one_and_side_by_side(codec):
    pieces = [p.encode() for p in (" internationalisation", "zzzzyx", "é" * 9, "0123456789" * 4)]
    assert [ids(x) for x in codec.vocabulary.encode_pieces(pieces)] == [codec.vocabulary.encode_one(p) for p in pieces]


def test_small_memory_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER", 3)
    small = bpe.Codec(BYTE)
    texts = ["one two three four", "two three five six", "one two"]
    assert [small.encode([t])[0] for t in texts] == bpe.codec(BYTE).encode(texts)


ROWS = [(1, None, 7), (2, "", 7), (3, "hello world", 7), (3, "hello world", 7), (None, "x", 7), (4, "word " * 5000, 7)]
SCHEMA = "doc_id long, text string, n_tokens int"


def test_codec_rows(spark, byte_tokenizer):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = bpe.encode_decode(df, BYTE, with_ids=True).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    for r in got:
        text = next(t for d, t, _ in ROWS if d == r.doc_id) or ""
        want = byte_tokenizer.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(want), want, text)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), BYTE).count() == 0


def test_packing_rows(spark, word_tokenizer):
    df = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    got = packing.pack(df, WORD, with_ids=True).collect()
    bins = {}
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQUENCE_TOKENS
    long = sorted((r.piece, r.start, r.length) for r in got if r.doc_id == 4)
    n = len(word_tokenizer.encode(ROWS[5][1], add_special_tokens=False).ids) + 1
    assert long == [(k, k * 2048, min(2048, n - k * 2048)) for k in range(-(-n // 2048))]
    assert [(r.length, r.ids) for r in got if r.doc_id in (1, 2)] == [(1, [0])] * 2
    assert packing.pack(df.limit(0), WORD).count() == 0


@given(st.lists(st.integers(1, 100), max_size=200), st.integers(1, 6))
def test_best_fit(sizes, bound):
    """Against a plain list of open bins."""
    bins, plain, made = packing.Bins(100, bound), {}, 0
    for n in sizes:
        got = bins.place(n)
        fits = [(f, k) for k, f in plain.items() if f >= n]
        if n >= 100 or not fits:
            if n < 100 and len(plain) >= bound:
                plain.pop(bins_closed(plain, bins))
            assert got == (made, 0)
            free = 100
            key = made
            made += 1
        else:
            free = min(fits)[0]
            key = got[0]
            assert plain.pop(key) == free and got[1] == 100 - free
        if free > n:
            plain[key] = free - n
    assert bins.open == len(plain) <= bound


def bins_closed(plain, bins):
    """The bin that is no longer open: one of the fullest."""
    still = {k for group in bins.free for k in group}
    gone = [k for k in plain if k not in still]
    low = min(plain.values())
    assert len(gone) == 1 and plain[gone[0]] == low
    return gone[0]
