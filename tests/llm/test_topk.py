"""Search against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quern.llm import topk


def brute(rows, k, every):
    best = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(64 * x) for x in v]
        best[i] = min(best.get(i, q), q)
    out = []
    for i, q in best.items():
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in best.items() if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("big", [1, 40, 100_000])
def test_search(spark, monkeypatch, big):
    r = random.Random(big)
    hot = [0.5, -0.25, 1.0]
    rows = [(i, hot if i % 3 == 0 else [r.uniform(-big, big) for _ in range(3)]) for i in range(300)]
    rows += [(None, hot), (700, None), (705, []), (710, [1.0, None, 0.0]), (715, [math.nan, 0.0, 0.0]), (720, [math.inf, 0.0, 0.0]), (725, [1.0]), (5, hot), (5, hot), (-5, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(*x, "clash") for x in rows], "vec_id long, embedding array<double>, score string")
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", 50)
    for k in (1, 20, 1000):
        got = sorted(tuple(x) for x in topk.search(df, F.col("vec_id") % 5 == 0, k).collect())
        assert got == brute(rows, k, 5)


def test_small(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") == 0, 5).count() == 0
    assert topk.search(df.limit(0), F.col("vec_id") == 0, 5).count() == 0
