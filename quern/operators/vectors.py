"""Exact cosine search: a set of query vectors, in blocks, against all rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Query vectors, and candidate rows, that one block holds.
BLOCK, ROWS = 512, 2048

#: Keys over which blocks of queries and shares of candidates are dealt at least, if there are so many candidates.
SHARES = 256


def cosine_top_k(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, score, rank.

    vectors: chunk_id, embedding and, optionally, scope; queries: query_id, embedding and, optionally, scope.  With a
    scope on both sides only equal ones meet.  Null embeddings take no part; equal (rounded) scores rank by chunk_id.
    Each candidate row visits each block of queries once, a matrix product scores a batch against a block, and only a
    batch's k best of each query leave it.
    """
    scoped = "scope" in vectors.columns and "scope" in queries.columns
    scope = F.col("scope").cast("string") if scoped else F.lit("")
    q = queries.filter("embedding is not null").select("query_id", F.col("embedding").cast("array<double>").alias("v"), scope.alias("s"))
    n = math.ceil(q.count() / BLOCK)
    id_type, q_type = vectors.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = f"query_id {q_type}, chunk_id {id_type}, score double"
    if not n:
        return queries.sparkSession.createDataFrame([], schema + ", rank int")
    blocks = q.withColumn("block", F.expr(f"pmod(xxhash64(query_id), {n})")).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("query_id", "s", "v"))).alias("qs"))
    rows = vectors.filter("embedding is not null").select("chunk_id", F.col("embedding").cast("array<double>").alias("v"), scope.alias("s"))
    parts = max(1, math.ceil(rows.count() / ROWS))
    packed = rows.groupBy(F.expr(f"pmod(xxhash64(chunk_id), {parts})").alias("part")).agg(F.collect_list(F.struct("chunk_id", "s", "v")).alias("cs"))
    # A few blocks are a few keys, so each is there for several shares of the candidates.
    shares = max(1, min(parts, math.ceil(SHARES / n)))
    pairs = packed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).withColumn("share", F.expr(f"pmod(part, {shares})"))
    pairs = pairs.join(blocks.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long")))), ["block", "share"])

    def score(frames):
        for f in frames:
            for qs, cs in zip(f["qs"], f["cs"], strict=True):
                yield _best(qs, cs, k, digits, scoped)

    best = pairs.select("qs", "cs").mapInPandas(score, schema)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.filter(F.col("rank") <= k)


def _best(qs, cs, k: int, digits: int, scoped: bool) -> pd.DataFrame:
    def unit(rows):
        m = np.array([r["v"] for r in rows], float)
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    s = np.round(unit(qs) @ unit(cs).T, digits) + 0.0
    if scoped:
        s[np.array([r["s"] for r in qs])[:, None] != np.array([r["s"] for r in cs])[None, :]] = -np.inf
    ids = np.array([r["chunk_id"] for r in cs])
    order = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
    rows, cols = np.repeat(np.arange(len(qs)), order.shape[1]), order.ravel()
    value = s[rows, cols]
    keep = np.isfinite(value)
    return pd.DataFrame({"query_id": [qs[i]["query_id"] for i in rows[keep]], "chunk_id": ids[cols[keep]], "score": value[keep]})
