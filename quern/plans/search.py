"""A search from queries to context: many queries at once, each step a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import fusion, retrieval
from quern.operators.vectors import cosine_top_k
from quern.storage import settle


@dataclass(frozen=True)
class SearchConfig:
    top_k: int = 10
    path_top_k: int = 20
    enabled_paths: frozenset[str] | None = None
    weights: dict[str, float] = field(default_factory=lambda: dict(fusion.WEIGHTS))
    ratio: float = 0.3
    balance: float = 0.7
    normalise: bool = False
    max_tokens: int = 6144
    use_rerank: bool = True


@dataclass(frozen=True)
class Store:
    """What a search reads.

    chunks: chunk_id, doc_id, content, tokens, kind; vectors: chunk_id, embedding; documents: doc_id, deleted; extra:
    more paths by name, each a function of (queries, k) that gives hits.
    """

    chunks: DataFrame
    documents: DataFrame
    vectors: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def paths(store: Store, queries: DataFrame, config: SearchConfig) -> dict[str, DataFrame]:
    """The enabled paths' hits; a path without data, or without embeddings in the queries, isn't planned."""
    on = lambda name: config.enabled_paths is None or name in config.enabled_paths
    chunks = retrieval.visible(store.chunks, store.documents)
    out = {}
    if on("bm25"):
        out["bm25"] = retrieval.bm25(chunks, queries.withColumn("terms", text.content_tokens(F.col("query"))), config.path_top_k)
    if on("vector") and store.vectors is not None and "embedding" in queries.columns:
        out["vector"] = cosine_top_k(store.vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), queries, config.path_top_k)
    for name, f in store.extra.items():
        if on(name):
            out[name] = f(queries, config.path_top_k)
    return out


def search(store: Store, queries: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """query_id, rank, chunk_id, score, paths, content of the results; queries: query_id, query and, optionally, embedding."""
    c = config or SearchConfig()
    hits = fusion.gather(paths(store, queries, c))
    pool = settle(fusion.reciprocal_rank_fusion(hits, fusion.pool_size(c.top_k), c.weights, ratio=c.ratio), "pool")
    rich = pool.join(fusion.of_pool(store.chunks.select("chunk_id", "content", "tokens"), pool), "chunk_id")
    if c.use_rerank:
        asked = queries.select("query_id", text.content_tokens(F.col("query")).alias("_q"))
        rich = fusion.rerank(rich.join(asked, "query_id"), fusion.overlap_score(F.col("_q"), F.col("tokens"))).drop("_q")
    if store.vectors is not None:
        rich = rich.join(fusion.of_pool(store.vectors.select("chunk_id", "embedding"), pool), "chunk_id", "left")
    return fusion.diversify(rich, c.top_k, c.balance, c.normalise, carry=("paths", "content"))  # a join back would plan the recall twice


def context(results: DataFrame, config: SearchConfig | None = None) -> DataFrame:
    """query_id, prompt: what of the results fits the token budget, best first."""
    return fusion.prompt(fusion.fit_context(results, (config or SearchConfig()).max_tokens))
