"""The life of a knowledge base: ingest, find, delete, purge."""

from pyspark.sql import functions as F

from quern.plans.knowledge_base import KnowledgeBase


def test_life(spark, tmp_path):
    kb = KnowledgeBase(spark, f"file://{tmp_path}/kb")
    kb.create("k", "first", ["Whales"])
    kb.create("l", "second")
    rows = [("k", 1, "Whales are large animals of the sea."), ("k", 2, "Sparrows are small birds of the town."), ("k", 3, "Whales are large animals of the sea."), ("zz", 4, "Nobody's document, which is lost.")]
    status = {r.doc_id: r.status for r in kb.ingest(spark.createDataFrame(rows, "kb_id string, doc_id long, text string"), "b1").collect()}
    assert status == {"1": "new", "2": "new", "3": "duplicate", "4": "no such knowledge base"}
    assert kb.table("chunks").filter(F.array_contains("keywords", "Whales")).count() == 1
    asked = spark.createDataFrame([(7, "large whales of the sea")], "query_id long, query string")
    first = kb.search(asked).filter("rank = 1").first()
    assert "Whales" in first.content
    kb.delete(spark.createDataFrame([("1",)], "doc_id string"), "d1")
    assert not any("Whales" in r.content for r in kb.search(asked).collect())
    again = kb.ingest(spark.createDataFrame([("k", 9, rows[0][2])], "kb_id string, doc_id long, text string"), "b2").first()
    assert again.status == "new"
    assert "Whales" in kb.search(asked).filter("rank = 1").first().content
    clean = kb.purge(f"file://{tmp_path}/kb2")
    assert {r.doc_id for r in clean.table("documents").collect()} == {"2", "9"}
    kb.delete_kb("k")
    assert kb.search(asked).count() == 0 and [r.kb_id for r in kb.kbs().collect()] == ["l"]
