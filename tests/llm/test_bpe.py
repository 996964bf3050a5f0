"""The encoder against the library itself, and exact round trips."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import bpe

HARD = ["", " ", "\n", "a", "é", "  a  b ", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't we'll 'S", "日本語テキスト", "😀😀 a‍", "a" * 50_000, " " * 30_000 + "x", "ab" * 9000 + "\n" * 5000 + "ž" * 6000, "\x1c\x1d\x85\xa0 a", "\t\r\n\x0b\x0c z"]


@pytest.fixture(scope="module")
def codec():
    return bpe.codec(bpe.default_vocabulary())


@pytest.mark.parametrize("text", HARD)
def test_same_ids_as_library(codec, text):
    want = codec.library.encode(text, add_special_tokens=False).ids
    assert codec.encode(text) == want
    assert codec.decode(want) == text


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text(codec, text):
    assert codec.encode(text) == codec.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_whole(codec, seed):
    r = random.Random(seed)
    parts = ["the", "ing", "tion", "a", "e", "oun", "é", "ñ", "ß", "zz"]
    raw = "".join(r.choice(parts) for _ in range(3000)).encode()
    assert codec.encode_unsplit(raw, leaf=r.choice([1, 7, 64, 1000])) == codec.core._encode_single_piece(raw)


def test_frames(spark):
    rows = [(1, None), (2, ""), (None, "the cat"), (4, "the cat"), (4, "the cat"), (5, "b" * 20_000)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, ids string")
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.decoded for r in got)) == sorted(t or "" for _, t in rows)
    assert len(got) == len(rows)
    assert bpe.encode(docs.limit(0)).count() == 0
    both = bpe.round_trip(docs).select("ids", "decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, bpe.decode(bpe.encode(docs)).select("ids", "decoded").collect()))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids(codec, ids):
    assert codec.decode(ids) == codec.library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("seed", range(12))
def test_halves_equal_whole(codec, seed):
    """Leaves of any size, cut anywhere, in texts with seams, without, and with what a cut could part."""
    r = random.Random(seed)
    parts = ["the", " ing", "  ", "'re", "'", "r", "e", " 's", "\n", "\n\n ", " 12", "3", "é", " ñ", "...", "\t", "\xa0", "x" * 40, "'ll ", "_", " _"]
    text = "".join(r.choice(parts) for _ in range(400))
    want = codec.library.encode(text, add_special_tokens=False).ids
    for leaf in (1, 3, 17, 100, 700):
        assert codec.encode_halves(text, codec.core.encode_ordinary, leaf) == want
        assert codec.encode_halves(text, lambda t: codec.library.encode(t, add_special_tokens=False).ids, leaf) == want


@settings(max_examples=150, deadline=None)
@given(st.text(min_size=1, max_size=60), st.integers(1, 9))
def test_halves_of_any_text(codec, text, leaf):
    if codec.cut is None or not codec.cut.search(text):
        library = lambda t: codec.library.encode(t, add_special_tokens=False).ids
        assert codec.encode_halves(text, library, leaf) == library(text)


def test_long_documents_go_by_halves(codec):
    """All ids of all documents equal the library's, and those of over LEAF characters are encoded by halves."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()]
    before = codec.trees
    for t in texts:
        assert codec.encode(t) == codec.library.encode(t, add_special_tokens=False).ids
    long = sum(len(t) > bpe.LEAF for t in texts)
    assert codec.trees - before == long > 50
