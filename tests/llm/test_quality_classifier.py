"""Held-out accuracy, memory, and defined results at the edges."""

import random
import tracemalloc

from quern.llm import quality_classifier as q


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = q.fit(docs, labels)
    rows = q.score(docs, model).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(400)] + [(None, 1), (5, None)], "doc_id long, quality int")
    rows = [(i, ("good words in a row " if i % 2 else "BAD!! NOISE$$ ") * 20, 0.0) for i in range(400)] + [(None, "x", 1.0), (900, None, 1.0), (901, "", 1.0), (901, "", 1.0), (902, "y" * 300_000, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = q.fit(docs, labels)
    got = q.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[901].score == by[900].score and not by[None].held_out
    assert sum(by[i].predicted == i % 2 for i in range(400)) == 400
    bare = q.fit(docs.limit(0), labels.limit(0))
    assert {r.score for r in q.score(docs, bare).collect()} == {0.5}
    assert q.score(docs.limit(0), model).count() == 0


def test_driver_gets_the_model_only(spark):
    """The sample's texts, whose wide characters take four bytes each in Python, stay out of the driver."""
    r = random.Random(2)
    letters = [chr(c) for c in range(0x1F600, 0x1F640)]
    text = lambda some: "".join(r.choices([*some, " "], k=6000))
    rows = [(i, text(letters[:40] if i % 2 else letters[24:])) for i in range(300)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        model = q.fit(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 2_000_000  # before: 4.8 MB of text and more
    assert sum(x.predicted == x.doc_id % 2 for x in q.score(docs, model).collect()) >= 295
