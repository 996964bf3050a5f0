"""Archives written and read back."""

import hashlib

import pytest

from quern.llm import warc

LONG = "<p>" + "é" * 200


def test_round_trip(spark, tmp_path):
    rows = [(3, "u3", LONG), (1, "u1", LONG), (2, None, "tiny"), (4, "u4", "tiny"), (5, "a\r\nb", None), (6, "u", ""), (None, "n", LONG), (7, "v", "x" * 3_000_000), (1, "u1", LONG)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    index = warc.write(pages, f"file://{tmp_path}/w")
    got = warc.read(index, 2).collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = h == LONG and i != 1
        want.append((str(i), len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want)
    assert all(bytes(r.payload) == LONG.encode() for r in got if r.page_id == 1)
    some = warc.read(index.filter("page_id = 7")).collect()
    assert [len(r.payload) for r in some] == [3_000_000]


def test_empty(spark):
    index = warc.write(spark.createDataFrame([], "page_id long, url string, html string"))
    assert index.count() == 0 and warc.read(index).count() == 0


def test_ranges():
    assert warc.coalesce([(0, 10), (10, 5), (100, 5), (1000, 2000)], gap=90, most=1000) == [[(0, 10), (10, 5), (100, 5)], [(1000, 2000)]]
    assert warc.coalesce([]) == []


def test_broken_record():
    raw = warc.record(1, "u", b"abc", "d", None)
    assert warc.parse(raw)[""] == b"abc"
    with pytest.raises(ValueError, match="length"):
        warc.parse(raw[:-1])
