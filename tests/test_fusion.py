"""Fusion, diversity and context on small rankings; graph steps on small graphs."""

import pytest
from pyspark.sql import functions as F

from quern.operators import enrich, fusion, graph, retrieval

HITS = "query_id int, chunk_id string, score double, rank int, path string"


def test_rrf_golden(spark):
    rows = [(1, "a", 9.0, 1, "vector"), (1, "b", 8.0, 2, "vector"), (1, "b", 5.0, 1, "bm25"), (1, "a", 4.0, 2, "bm25"), (1, "c", 1.0, 3, "other")]
    weights = {"vector": 0.7, "bm25": 0.3}
    got = {r.chunk_id: r for r in fusion.reciprocal_rank_fusion(spark.createDataFrame(rows, HITS), 10, weights, ratio=None).collect()}
    assert got["a"].score == pytest.approx(0.7 / 61 + 0.3 / 62, abs=1e-9) and got["b"].score == pytest.approx(0.7 / 62 + 0.3 / 61, abs=1e-9)
    assert (got["a"].rank, got["b"].rank, got["c"].rank, got["c"].score) == (1, 2, 3, 0.0)
    assert got["a"].paths == ["bm25", "vector"]


def test_rrf_ratio_and_order(spark):
    rows = [(q, f"c{i:02}", 1.0 / (i + 1), i + 1, "bm25") for q in (1, 2) for i in range(10)]
    df = spark.createDataFrame(rows, HITS)
    kept = fusion.reciprocal_rank_fusion(df, 10, ratio=0.95)
    assert {r["count"] for r in kept.groupBy("query_id").count().collect()} <= {3, 4}
    again = fusion.reciprocal_rank_fusion(df.orderBy(F.rand(1)), 10, ratio=0.95)
    assert sorted(map(tuple, kept.drop("paths").collect())) == sorted(map(tuple, again.drop("paths").collect()))


def test_diversity(spark):
    rows = [(1, "a", 1.0, ["x", "y"]), (1, "b", 0.9, ["x", "y"]), (1, "c", 0.5, ["z"]), (1, "d", 0.1, None)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, score double, tokens array<string>")
    got = [r.chunk_id for r in fusion.diversify(df, 4).orderBy("rank").collect()]
    assert got == ["a", "c", "b", "d"] and len(set(got)) == 4
    vectors = df.withColumn("embedding", F.array(F.lit(1.0), F.when(F.col("chunk_id") == "b", 1.0).otherwise(0.0)))
    assert [r.chunk_id for r in fusion.diversify(vectors, 2).orderBy("rank").collect()] == ["a", "b"]


def test_context_prefix(spark):
    rows = [(1, "a", 0.9, "x" * 300), (1, "b", 0.8, "x" * 300), (1, "c", 0.7, "x"), (2, "d", 0.1, "x" * 9000)]
    df = spark.createDataFrame(rows, "query_id int, chunk_id string, score double, content string")
    assert {r.chunk_id for r in fusion.fit_context(df, 150).collect()} == {"a", "d"}


def test_negative_questions(spark):
    e = spark.createDataFrame([(1, "How do whales sing", ["do whales sing"], ["whales sing loud", ""], "Q"), (2, "Whales sing", [], [], "Q")], "chunk_id long, standard string, similar array<string>, negative array<string>, content string")
    q = spark.createDataFrame([(1, "whales sing"), (2, "do whales sing"), (3, " ")], "query_id long, query string")
    got = {(r.query_id, r.chunk_id): round(r.score, 6) for r in retrieval.faq_match(e, q, 5).collect()}
    assert got == {(1, 2): 1.2, (2, 1): 0.96}


def test_tree_search(spark):
    nodes = [("r", 3, [1.0, 0.0], ["x", "y"], []), ("x", 2, [1.0, 0.1], ["m"], []), ("y", 2, [0.0, 1.0], ["m", "n"], []), ("m", 1, [1.0, 0.0], [], [10, 11]), ("n", 1, [0.0, 1.0], [], [12])]
    df = spark.createDataFrame(nodes, "node_id string, layer int, embedding array<double>, children array<string>, chunks array<long>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<double>")
    got = {r.chunk_id: r.path for r in retrieval.tree_search(df, q).collect()}
    assert got == {10: ["r", "x", "m"], 11: ["r", "x", "m"], 12: ["r", "y", "n"]}


def test_components_and_communities(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101)], "source long, target long")
    got = {r.name: r.component for r in graph.connected_components(pairs).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 33
    clique = [("k", f"{g}{i}", f"{g}{j}", 1.0) for g in "ab" for i in range(5) for j in range(i)] + [("k", "a0", "b0", 0.1)]
    found = graph.communities(spark.createDataFrame(clique, "kb string, source string, target string, weight double"), "kb").collect()
    assert {frozenset(r.name for r in found if r.community == c) for c in {r.community for r in found}} == {frozenset(f"{g}{i}" for i in range(5)) for g in "ab"}


def test_candidates_find_all(spark):
    import random

    r = random.Random(8)
    names = ["".join(r.choice("abc ") for _ in range(r.randrange(1, 16))) for _ in range(120)] + ["北京大学", "北京大学校", "上海"]
    df = spark.createDataFrame([("t", n) for n in names], "type string, name string")
    all_pairs = df.alias("x").join(df.alias("y"), F.col("x.name") < F.col("y.name")).select(F.col("x.name").alias("a"), F.col("y.name").alias("b")).distinct()
    from quern.functions.text import names_alike

    want = {tuple(p) for p in all_pairs.filter(names_alike(F.col("a"), F.col("b"))).collect()}
    assert {(p.a, p.b) for p in graph.candidates(df).collect()} == want


def test_alias_that_is_a_name_too(spark):
    e = spark.createDataFrame([("k", "a", "t", ["b"]), ("k", "b", "t", ["c"])], "kb_id string, name string, type string, aliases array<string>")
    rows = spark.createDataFrame([("k", 1, "b"), ("k", 2, "c"), ("k", 3, "a"), ("k", 4, "d"), ("l", 5, "b")], "kb_id string, doc_id long, name string")
    assert {r.doc_id: r.name for r in graph.canonical(rows, e, "name").collect()} == {1: "a", 2: "b", 3: "a", 4: "d", 5: "b"}


def test_layers():
    assert enrich.layers({"a": ("b",), "b": (), "c": ("a",)}) == [["b"], ["a"], ["c"]]
    assert enrich.layers({"a": ("b",), "b": ()}, only={"a"}) == [["a"]]
    with pytest.raises(ValueError, match="depend"):
        enrich.layers({"a": ("b",), "b": ("a",)})
