"""Lexical paths against plain Python, and what of them is shuffled."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quern.operators import fusion, postings, retrieval
from quern.operators.vectors import cosine_top_k
from quern.storage import settle


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def corpus(spark, seed, repeats):
    r = random.Random(seed)
    chunks = [(f"c{i:03}", [r.choice("abcdefghijklm") for _ in range(r.randrange(0, 12))]) for i in range(120)]
    chunks += [(r.choice(chunks)[0], ["a", "b", "b"]) for _ in range(repeats)] + [(None, ["a", "c"])] * (repeats > 0) + chunks[:repeats]
    asked = [(q, [r.choice("abcdefghijklmz") for _ in range(r.randrange(0, 4))]) for q in range(300)]  # several blocks
    return chunks, asked, spark.createDataFrame(chunks, "chunk_id string, tokens array<string>"), spark.createDataFrame(asked, "query_id int, terms array<string>")


def test_bm25_with_repeated_chunks(spark):
    for seed, repeats in ((1, 0), (2, 9)):
        chunks, asked, c, q = corpus(spark, seed, repeats)
        n, mean = len(chunks), sum(len(t) for _, t in chunks) / len(chunks)
        tf = Counter((i, len(t), w) for i, t in chunks for w in t)
        df = Counter(w for _, _, w in tf)
        want = set()
        for query, terms in asked:
            score = Counter()
            for (i, dl, w), f in tf.items():
                if w in terms:
                    score[i] += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / mean))
            order = sorted(score, key=lambda i: (-round(score[i], 6), i is not None, i or ""))
            want |= {(query, i, round(score[i], 6), k + 1) for k, i in enumerate(order[:5])}
        assert {(r.query_id, r.chunk_id, round(r.score, 6), r["rank"]) for r in retrieval.bm25(c, q, 5).collect()} == want


def test_full_text_of_each_row(spark):
    chunks, asked, c, q = corpus(spark, 3, 5)
    want = Counter()
    for query, terms in asked:
        hits = [(-math.floor(sum(w in terms for w in t) / len(t) * 1e6 + 0.5) / 1e6, i is not None, i or "", i) for i, t in chunks if terms and set(terms) <= set(t)]
        want.update((query, h[3], -h[0], k + 1) for k, h in enumerate(sorted(hits)[:5]))
    assert Counter((r.query_id, r.chunk_id, r.score, r["rank"]) for r in retrieval.full_text_match(c, q, 5).collect()) == want


def test_postings_are_not_shuffled(spark):
    _, _, c, q = corpus(spark, 4, 0)
    for hits in (retrieval.bm25(c, q, 5), retrieval.full_text_match(c, q, 5)):
        assert plan(hits).count("Exchange") == 1 and "Generate" not in plan(hits)


def test_only_smallest_ids_are_joined(spark):
    r = random.Random(5)
    chunks = [(i, [r.choice(["alpha", "beta", "alphabet", "bet"]) for _ in range(3)]) for i in range(200)]
    asked = [(1, ["alp", "bet"]), (2, ["zzz"]), (3, ["e"])]
    c, q = spark.createDataFrame(chunks, "chunk_id int, keywords array<string>"), spark.createDataFrame(asked, "query_id int, keywords array<string>")
    hits = retrieval.keyword_match(c, q, 4)
    want = {(a, i) for a, ns in asked for i in [i for i, ws in chunks if any(n in w for n in ns for w in ws)][:4]}
    assert {(r.query_id, r.chunk_id) for r in hits.collect()} == want
    assert plan(hits).count("WindowGroupLimit") >= 6  # of words, of needles and of queries, before and after an exchange
    pages, refs = spark.createDataFrame([(1, "p", 1.0), (1, "q", 1.0), (2, "q", 3.0)], "query_id int, chunk_id string, score double"), spark.createDataFrame([(p, i) for i in range(50) for p in ("pq" if i % 3 else "q")], "page_id string, ref int")
    carried = retrieval.pages_to_refs(pages, refs, 3)
    assert {(r.query_id, r.chunk_id, r.score) for r in carried.collect()} == {(a, i, s) for a, s in ((1, 1.0), (2, 3.0)) for i in range(3)}
    assert plan(carried).count("WindowGroupLimit") >= 4


def test_pool_finds_rows_where_they_lie(spark):
    pool = settle(spark.createDataFrame([(1, 3), (2, 3), (2, 5)], "query_id int, chunk_id int"), "pool")
    rows = spark.range(1000).select(F.col("id").cast("int").alias("chunk_id"), F.lit("x").alias("content"))
    found = fusion.of_pool(rows, pool)
    assert sorted(r.chunk_id for r in found.collect()) == [3, 5]
    assert "BroadcastHashJoin" in plan(found) and "SortMergeJoin" not in plan(found)


def test_one_block_of_queries_is_dealt(spark):
    rows = spark.range(20000).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    pairs = cosine_top_k(rows, rows.filter("chunk_id < 3").withColumnRenamed("chunk_id", "query_id"), 2)
    assert {(r.query_id, r.chunk_id) for r in pairs.filter("rank = 1").collect()} == {(i, i) for i in range(3)}
    assert "share" in plan(pairs)


def test_rounding_is_away_from_zero():
    import numpy as np

    assert postings.rounded(np.array([0.0078125, -0.0078125, 0.0]), 6).tolist() == [0.007813, -0.007813, 0.0]
