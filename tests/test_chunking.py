"""Splitters on small texts, and that chunks without overlap tile the text."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.operators import chunking as c

DOC = "# A\n\nintro text\n\n## B\n\n" + "word " * 300 + "\n\n## C\n\n```\n# not a heading\n```\n\n### D\n\nend of it\n"


def test_headings():
    found = c.split(DOC, c.Config(size=200, overlap=0, strategy="heading"))
    assert [x.heading_path for x in found][0] == "A"
    assert {x.heading_path for x in found} >= {"A", "A > B", "A > C > D"}
    assert not any("not a heading" in x.heading_path for x in found)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab #\n|-`.1。，", max_size=900), st.sampled_from(["heading", "marker", "recursive"]))
def test_tiles(text, strategy):
    found = c.split(text, c.Config(size=20, overlap=0, strategy=strategy))
    at = 0
    for x in found:
        assert x.start >= at and text[at : x.start].strip() == ""
        at = x.end
    assert text[at:].strip() == ""


def test_oversized_table_repeats_header():
    table = "| a | b |\n| --- | --- |\n" + "".join(f"| {i} | {i * i} |\n" for i in range(200))
    found = c.split(table, c.Config(size=100, overlap=0, strategy="recursive"))
    assert len(found) > 3
    assert all(x.content.startswith("| a | b |\n| --- | --- |\n") and x.tokens <= 110 for x in found)
    assert all(f"| {i} | {i * i} |" in "".join(x.content for x in found) for i in range(200))


def test_quality():
    one = c.Chunk(0, 9000, "x" * 9000)
    assert not c.good([one], c.Config())
    assert not c.good([], c.Config())
    assert c.good([c.Chunk(0, 1200, "x" * 1200)], c.Config())
    assert not c.good([c.Chunk(0, 3, "ab")] * 9 + [c.Chunk(0, 900, "x" * 900)], c.Config())


def test_tables_and_sections():
    text = "# H\n\ncaption\n| a | b |\n|---|---|\n| 1 | 2 |\n\nafter ![i](j.png) end"
    left, tables = c.extract_tables(text)
    assert "<TABLE_0>" in left and tables == [{"table_no": 0, "content": "| a | b |\n|---|---|\n| 1 | 2 |", "caption": "caption", "heading_path": "H"}]
    (s,) = c.split_sections(text)
    assert s["image"] == "![i](j.png)" and s["context_below"] == "end"


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_empty(text):
    assert c.split(text) == []


def test_frame(spark):
    docs = spark.createDataFrame([(1, DOC, "x"), (None, None, "y"), (2, "", "z"), (3, "short", "z"), (3, "short", "z")], "doc_id long, text string, content string")
    got = c.chunk_documents(docs, c.Config(size=100)).collect()
    assert {r.doc_id for r in got} == {1, 3}
    assert sum(r.doc_id == 3 for r in got) == 2


def test_small_sections_join_the_next():
    config = c.Config(size=1000)
    large, little = "word " * 400, "word " * 20
    text, at, chunks = large + little + little + large, 0, []
    for part in (large, little, little, large):
        chunks.append(c.Chunk(at, at + len(part), part))
        at += len(part)
    got = c.merge_small(text, chunks, config)
    assert [x.content for x in got] == [large, little + little + large]  # a small one after a large one isn't joined to it
