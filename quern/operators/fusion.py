"""Fusion of rankings, reranking, diversity and the context of an answer."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.functions import text

#: Weight of each path; one that isn't listed weighs 0 but still counts as a hit.
WEIGHTS = {"vector": 0.15, "bm25": 0.10, "question": 0.10, "summary": 0.10, "graph": 0.10, "keyword": 0.08, "community": 0.08, "wiki": 0.07, "faq": 0.05, "raptor": 0.05}
RRF_K = 60


def gather(paths: dict[str, DataFrame], enabled: set[str] | None = None) -> DataFrame:
    """All hits with their path; a path that isn't enabled is never planned."""
    chosen = [df.select("query_id", "chunk_id", "score", "rank").withColumn("path", F.lit(name)) for name, df in paths.items() if enabled is None or name in enabled]
    return reduce(DataFrame.unionByName, chosen)


def reciprocal_rank_fusion(hits: DataFrame, top_k: int, weights: dict[str, float] | None = None, k: int = RRF_K, ratio: float | None = 0.3, digits: int = 9) -> DataFrame:
    """query_id, chunk_id, score, paths, rank: sum of weight / (k + rank), a chunk's first rank in a path counting.

    Hits below ratio of a query's best are dropped; ties rank by chunk_id.
    """
    of = WEIGHTS if weights is None else weights
    weight = F.coalesce(F.create_map(*(F.lit(x) for kv in of.items() for x in kv))[F.col("path")], F.lit(0.0)) if of else F.lit(0.0)
    firsts = hits.groupBy("query_id", "chunk_id", "path").agg(F.min("rank").alias("rank"))
    fused = firsts.groupBy("query_id", "chunk_id").agg(F.round(F.sum(weight / (k + F.col("rank"))), digits).alias("score"), F.array_sort(F.collect_set("path")).alias("paths"))
    if ratio is not None:
        top = F.max("score").over(Window.partitionBy("query_id"))
        fused = fused.withColumn("_top", top).filter((F.col("_top") <= 0) | (F.col("score") >= ratio * F.col("_top"))).drop("_top")
    ranked = fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.filter(F.col("rank") <= top_k)


#: Rows of a pool up to which its ids go to all tasks.
SMALL_POOL = 100_000


def of_pool(rows: DataFrame, pool: DataFrame, on: str = "chunk_id") -> DataFrame:
    """The rows that a settled pool names, found where they lie if the pool is small: they may be long, and few are named."""
    ids = pool.select(on).distinct()
    return rows.join(F.broadcast(ids) if pool.count() <= SMALL_POOL else ids, on, "left_semi")


def pool_size(top_k: int) -> int:
    return max(3 * top_k, 50)


def rerank(candidates: DataFrame, scorer: Column, digits: int = 6) -> DataFrame:
    """candidates with their scores replaced, and ranked by them."""
    scored = candidates.withColumn("score", F.round(scorer, digits))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


def overlap_score(query_tokens: Column, tokens: Column) -> Column:
    """Share of the query's distinct tokens that a text has: the scorer used when no model is given."""
    q = F.array_distinct(query_tokens)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens)) / F.size(q)).otherwise(F.lit(0.0))


def diversify(candidates: DataFrame, k: int, balance: float = 0.7, normalise: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """The k most relevant and mutually different of each query (maximal marginal relevance), with their rank.

    candidates: query_id, chunk_id, score, tokens and, optionally, embedding.  Similarity is cosine if every candidate of
    a query has an embedding, else Jaccard of tokens.  Columns named in carry come along.  A query's pool is bounded by the fusion before.
    """
    id_type, q_type = (candidates.schema[c].dataType.simpleString() for c in ("chunk_id", "query_id"))
    has = "embedding" in candidates.columns

    def pick(pool: pd.DataFrame) -> pd.DataFrame:
        pool = pool.sort_values(["score", "chunk_id"], ascending=[False, True]).reset_index(drop=True)
        relevance = pool["score"].to_numpy(float)
        if normalise and len(pool) > 1 and relevance.max() > relevance.min():
            relevance = (relevance - relevance.min()) / (relevance.max() - relevance.min())
        alike = similarities(pool, has)
        chosen = [0] if len(pool) else []
        worst = alike[:, 0].copy() if len(pool) else None
        while len(chosen) < min(k, len(pool)):
            value = balance * relevance - (1 - balance) * worst
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            worst = np.maximum(worst, alike[:, chosen[-1]])
        out = pool.iloc[chosen][["query_id", "chunk_id", "score", *carry]].reset_index(drop=True)
        out["rank"] = np.arange(1, len(out) + 1, dtype="int32")
        return out

    more = "".join(f"{c} {candidates.schema[c].dataType.simpleString()}, " for c in carry)
    return candidates.groupBy("query_id").applyInPandas(pick, f"query_id {q_type}, chunk_id {id_type}, score double, {more}rank int")


def similarities(pool: pd.DataFrame, has_embedding: bool) -> np.ndarray:
    if has_embedding and len(pool) and all(e is not None and len(e) for e in pool["embedding"]) and len({len(e) for e in pool["embedding"]}) == 1:
        m = np.stack([np.asarray(e, float) for e in pool["embedding"]])
        norm = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)
        return m @ m.T
    sets = [set(t) if t is not None else set() for t in pool["tokens"]]
    return np.array([[len(a & b) / len(a | b) if a | b else 0.0 for b in sets] for a in sets])


def path_stats(hits: DataFrame, final: DataFrame) -> DataFrame:
    """query_id, path, n_hits, n_final: what each path found, and how much of it is in the result."""
    found = hits.groupBy("query_id", "path").agg(F.count("*").alias("n_hits"))
    kept = final.select("query_id", F.explode("paths").alias("path")).groupBy("query_id", "path").agg(F.count("*").alias("n_final"))
    return found.join(kept, ["query_id", "path"], "left").withColumn("n_final", F.coalesce("n_final", F.lit(0).cast("long")))


def channel(kind: Column, score: Column, least: float = 0.85) -> Column:
    """Whether a hit answers directly or is context."""
    return F.when((kind == "faq") & (score >= least), F.lit("faq_direct")).otherwise(F.lit("chunk"))


def fit_context(results: DataFrame, max_tokens: int) -> DataFrame:
    """The score-ordered prefix of each query's results whose tokens fit; the first always stays."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    sized = results.withColumn("used_tokens", F.sum(text.count_tokens(F.col("content"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return sized.filter((F.col("used_tokens") <= max_tokens) | (F.col("place") == 1))


def prompt(results: DataFrame) -> DataFrame:
    """query_id, prompt: the results of a query as numbered blocks."""
    blocks = F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), "content").alias("block"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(blocks, lambda b: b["block"]), "\n\n").alias("prompt"))
