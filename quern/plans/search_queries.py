"""Queries over the ranked paths, their fusion and the search as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import fusion, retrieval
from quern.operators.vectors import cosine_top_k
from quern.plans import search
from quern.plans.registry import query
from quern.plans.tables import KB_SQL, kb_documents, table
from quern.sources import faq
from quern.storage import settle


def _chunks(spark, d):
    """Visible documents as chunks with tokens."""
    docs = kb_documents(spark, d)
    return docs.filter("not deleted").select(F.col("doc_id").alias("chunk_id"), "doc_id", "kb_id", F.col("text").alias("content"), text.content_tokens(F.col("text")).alias("tokens"), F.lit("text").alias("kind"))


def _lexical(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), text.content_tokens(F.col("text")).alias("terms"))


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark, d):
    """The query set of searches: every row whose id is divisible by 50."""
    return _vectors(spark, d).filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_BM25 = f"""{KB_SQL}, c AS (SELECT doc_id AS chunk_id, {_TOK.format("text")} AS tokens FROM kb WHERE NOT deleted),
q AS (SELECT item_id AS query_id, list_distinct({_TOK.format("text")}) AS terms FROM benchmark), qt AS (SELECT query_id, unnest(terms) AS term FROM q),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(tokens)) AS mean FROM c),
p AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM c) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM p JOIN f USING (term) JOIN qt USING (term), s GROUP BY query_id, chunk_id),
bm25 AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM b) WHERE rank <= 20)"""


@query("bm25_topk", f"WITH {_BM25} SELECT query_id, chunk_id, score, rank FROM bm25")
def bm25_topk(spark, d):
    return retrieval.bm25(_chunks(spark, d), _lexical(spark, d), 20)


_COS = "list_cosine_similarity([CAST(x AS DOUBLE) for x in {0}], [CAST(x AS DOUBLE) for x in {1}])"


def _vec_sql(queries: str, where: str = "true", on: str = "true", k: int = 10) -> str:
    return f"""v AS (SELECT vec_id AS chunk_id, embedding, label FROM embeddings WHERE {where}), vq AS ({queries}),
vs AS (SELECT query_id, chunk_id, round({_COS.format("vq.embedding", "v.embedding")}, 6) AS score FROM vq JOIN v ON {on}),
vec AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM vs) WHERE rank <= {k})"""


_VQ = "SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0"


@query("vector_topk", f"WITH {_vec_sql(_VQ)} SELECT query_id, chunk_id, score, rank FROM vec")
def vector_topk(spark, d):
    return cosine_top_k(_vectors(spark, d), _vector_queries(spark, d), 10)


@query("vector_topk_filtered", f"WITH {_vec_sql(_VQ, on='vq.label = v.label')} SELECT query_id, chunk_id, score, rank FROM vec")
def vector_topk_filtered(spark, d):
    scoped = lambda df: df.withColumnRenamed("label", "scope")
    return cosine_top_k(scoped(_vectors(spark, d)), scoped(_vector_queries(spark, d)), 10)


@query("question_topk", f"WITH {_vec_sql(_VQ, where='label < 5')} SELECT query_id, chunk_id, score, rank FROM vec")
def question_topk(spark, d):
    """Chunks that have a question vector (labels under 5 stand for them)."""
    return cosine_top_k(_vectors(spark, d).filter("label < 5"), _vector_queries(spark, d), 10)


@query(
    "community_topk",
    f"""WITH g AS (SELECT label, generate_subscripts(any_value(embedding), 1) AS i FROM embeddings GROUP BY label), m AS (SELECT e.label, i, round(avg(CAST(e.embedding[i] AS DOUBLE)), 9) AS x FROM embeddings e JOIN g ON g.label = e.label GROUP BY e.label, i),
c AS (SELECT label AS chunk_id, list(x ORDER BY i) AS embedding FROM m GROUP BY label), vq AS ({_VQ}), s AS (SELECT query_id, chunk_id, round(list_cosine_similarity([CAST(x AS DOUBLE) for x in vq.embedding], c.embedding), 6) AS score FROM vq, c)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s) WHERE rank <= 3""",
)
def community_topk(spark, d):
    """Communities (labels) by the mean of their vectors."""
    parts = _vectors(spark, d).select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "x")))
    means = parts.groupBy("label").agg(F.transform(ordered, lambda p: p["x"]).alias("embedding")).withColumnRenamed("label", "chunk_id")
    return cosine_top_k(means, _vector_queries(spark, d), 3)


@query("fetch_embeddings", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def fetch_embeddings(spark, d):
    wanted = table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id"))
    return table(spark, d, "embeddings").join(wanted, "vec_id", "left_semi").select("vec_id", "label")


@query("visible_chunks", f"WITH {KB_SQL} SELECT doc_id, kb_id FROM kb WHERE NOT deleted")
def visible_chunks(spark, d):
    docs = kb_documents(spark, d)
    return retrieval.visible(docs.select("doc_id", "kb_id"), docs.select("doc_id", "deleted"))


_KEYWORDS = f"""k AS (SELECT conv_id * 100 + turn AS chunk_id, list_distinct({_TOK.format("text")}) AS kw FROM conversations), q AS (SELECT item_id AS query_id, list_sort(list_distinct({_TOK.format("text")}))[1:10] AS qk FROM benchmark),
kx AS (SELECT chunk_id, unnest(kw) AS w FROM k), qx AS (SELECT query_id, unnest(qk) AS n FROM q)"""


@query("keyword_match", f"WITH {_KEYWORDS}, h AS (SELECT DISTINCT query_id, chunk_id, CAST(1.0 AS DOUBLE) AS score FROM kx JOIN qx ON contains(w, n)) SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS rank FROM h) WHERE rank <= 20")
def keyword_match(spark, d):
    turns = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), F.array_distinct(text.content_tokens(F.col("text"))).alias("keywords"))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.slice(text.distinct_tokens(F.col("text")), 1, 10).alias("keywords"))
    return retrieval.keyword_match(turns, asked, 20)


_FTS = f"""{KB_SQL}, c AS (SELECT doc_id AS chunk_id, {_TOK.format("text")} AS tokens FROM kb WHERE NOT deleted), q AS (SELECT item_id AS query_id, list_distinct({_TOK.format("text")}) AS terms FROM benchmark),
f AS (SELECT query_id, chunk_id, round(CAST(len(list_filter(tokens, lambda t: list_contains(terms, t))) AS DOUBLE) / len(tokens), 6) AS score FROM q JOIN c ON len(terms) > 0 AND list_has_all(tokens, terms)),
fts AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f) WHERE rank <= 20)"""


@query("fts_and_match", f"WITH {_FTS} SELECT query_id, chunk_id, score, rank FROM fts")
def fts_and_match(spark, d):
    return retrieval.full_text_match(_chunks(spark, d), _lexical(spark, d), 20)


_BENCH_VEC = "SELECT item_id AS query_id, embedding, label FROM benchmark JOIN embeddings ON vec_id = item_id"


def _bench_vectors(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"))
    return asked.join(_vectors(spark, d).withColumnRenamed("chunk_id", "query_id"), "query_id")


@query(
    "summary_hybrid",
    f"""WITH {_FTS}, {_vec_sql(_BENCH_VEC, k=20)}, h AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, round(0.3 * coalesce(a.score, 0) + 0.7 * coalesce(b.score, 0), 7) AS score FROM fts a FULL JOIN vec b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h) WHERE rank <= 20""",
)
def summary_hybrid(spark, d):
    lexical = retrieval.full_text_match(_chunks(spark, d), _lexical(spark, d), 20)
    return retrieval.hybrid(lexical, cosine_top_k(_vectors(spark, d), _bench_vectors(spark, d), 20), 20)


_WIKI = "SELECT source AS page, list(doc_id) AS refs FROM documents GROUP BY source"


@query(
    "wiki_topk",
    f"WITH {_BM25}, w AS (SELECT source AS page, doc_id FROM documents), ph AS (SELECT query_id, page, max(score) AS score FROM bm25 JOIN w ON w.doc_id = chunk_id GROUP BY ALL), h AS (SELECT query_id, w.doc_id AS chunk_id, max(score) AS score FROM ph JOIN w USING (page) GROUP BY ALL) SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h) WHERE rank <= 20",
)
def wiki_topk(spark, d):
    """A source is a wiki page; a page scores as the best of its documents, and hands its score to all of them."""
    docs = table(spark, d, "documents").select(F.col("source").alias("page"), "doc_id")
    hits = retrieval.bm25(_chunks(spark, d), _lexical(spark, d), 20).join(docs, F.col("chunk_id") == F.col("doc_id"))
    page_hits = hits.groupBy("query_id", F.col("page").alias("chunk_id")).agg(F.max("score").alias("score"))
    return retrieval.pages_to_refs(page_hits, docs.select(F.col("page").alias("page_id"), F.col("doc_id").alias("ref")), 20)


_FAQ = """t AS (SELECT conv_id, turn, role, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations),
e AS (SELECT conv_id * 100 + turn AS chunk_id, conv_id, text AS standard, answer FROM t WHERE role = 'user' AND next_role = 'assistant')"""


def _faq_entries(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, d, "conversations").withColumn("answer", F.lead("text").over(w)).withColumn("next_role", F.lead("role").over(w))
    return t.filter("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("chunk_id"), "conv_id", F.col("text").alias("standard"), "answer")


@query("faq_chunks", f"WITH {_FAQ} SELECT chunk_id, 'Q: ' || standard || chr(10) || 'A: ' || answer AS content FROM e")
def faq_chunks(spark, d):
    return _faq_entries(spark, d).select("chunk_id", faq.content(F.col("standard"), F.array("answer")).alias("content"))


@query(
    "faq_validate",
    f"WITH {_FAQ} SELECT chunk_id, CASE WHEN standard = '' THEN 'no question' WHEN lower(standard) = lower(answer) THEN 'similar repeats the question' END AS problem FROM e",
)
def faq_validate(spark, d):
    wrong = faq.problem(F.col("standard"), F.array("answer"), F.array().cast("array<string>"), F.array("answer"))
    return _faq_entries(spark, d).select("chunk_id", wrong.alias("problem"))


@query(
    "faq_match",
    f"""WITH {_FAQ}, f AS (SELECT chunk_id, lower(standard) AS s, lower(answer) AS n, 'q: ' || lower(standard) || chr(10) || 'a: ' || lower(answer) AS c FROM e), q AS (SELECT chunk_id AS query_id, lower(trim(standard)) AS q FROM e WHERE conv_id % 50 = 0),
h AS (SELECT query_id, chunk_id, CASE WHEN s = q THEN 1.0 ELSE 0.6 END * CAST(1.2 AS DOUBLE) AS score FROM q JOIN f ON q <> '' AND (contains(s, q) OR contains(c, q)) AND NOT (n <> '' AND (contains(n, q) OR contains(q, n))))
SELECT query_id, chunk_id, score, rank FROM (SELECT query_id, chunk_id, CAST(score AS DOUBLE) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM h) WHERE rank <= 10""",
)
def faq_match(spark, d):
    """Questions of every fiftieth conversation against all entries; an answer stands for a negative question."""
    e = _faq_entries(spark, d)
    entries = e.select("chunk_id", "standard", F.array().cast("array<string>").alias("similar"), F.array("answer").alias("negative"), faq.content(F.col("standard"), F.array("answer")).alias("content"))
    return retrieval.faq_match(entries, e.filter("conv_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("standard").alias("query")), 10)


_HITS = f"""{_BM25}, {_vec_sql(_BENCH_VEC, k=20)}, hits AS (SELECT query_id, chunk_id, score, rank, 'bm25' AS path FROM bm25 UNION ALL SELECT query_id, chunk_id, score, rank, 'vector' FROM vec)"""
_RRF = f"""{_HITS}, r AS (SELECT query_id, chunk_id, round(sum(CASE path WHEN 'bm25' THEN 0.10 WHEN 'vector' THEN 0.15 END / CAST(60 + rank AS DOUBLE)), 9) AS score, array_to_string(list_sort(list(DISTINCT path)), ',') AS paths FROM hits GROUP BY ALL),
m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM r), fused AS (SELECT query_id, chunk_id, score, paths, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM m WHERE top <= 0 OR score >= 0.3 * top)"""


def _hits(spark, d):
    return fusion.gather({"bm25": retrieval.bm25(_chunks(spark, d), _lexical(spark, d), 20), "vector": cosine_top_k(_vectors(spark, d), _bench_vectors(spark, d), 20)})


@query("multi_recall", f"WITH {_HITS} SELECT query_id, chunk_id, score, rank, path FROM hits")
def multi_recall(spark, d):
    return _hits(spark, d)


@query("rrf_fusion", f"WITH {_RRF} SELECT query_id, chunk_id, score, paths, rank FROM fused WHERE rank <= 10")
def rrf_fusion(spark, d):
    return fusion.reciprocal_rank_fusion(_hits(spark, d), 10).withColumn("paths", F.array_join("paths", ","))


@query("rrf_pool", f"WITH {_RRF} SELECT query_id, count(*) AS pool FROM fused WHERE rank <= 50 GROUP BY query_id")
def rrf_pool(spark, d):
    return fusion.reciprocal_rank_fusion(_hits(spark, d), fusion.pool_size(10)).groupBy("query_id").agg(F.count("*").alias("pool"))


@query("path_stats", f"WITH {_RRF} SELECT h.query_id, h.path, h.n AS n_hits, count(f.chunk_id) AS n_final FROM (SELECT query_id, path, count(*) AS n FROM hits GROUP BY ALL) h LEFT JOIN (SELECT * FROM fused WHERE rank <= 10) f ON f.query_id = h.query_id AND contains(f.paths, h.path) GROUP BY ALL")
def path_stats(spark, d):
    hits = _hits(spark, d)
    return fusion.path_stats(hits, fusion.reciprocal_rank_fusion(hits, 10))


_RERANK = f"""{_RRF}, qk AS (SELECT item_id AS query_id, list_distinct({_TOK.format("text")}) AS qt FROM benchmark), dk AS (SELECT doc_id AS chunk_id, {_TOK.format("text")} AS tk, text AS content FROM documents),
rr AS (SELECT query_id, chunk_id, content, round(CASE WHEN len(qt) > 0 THEN CAST(len(list_intersect(qt, tk)) AS DOUBLE) / len(qt) ELSE 0 END, 6) AS score FROM fused JOIN qk USING (query_id) JOIN dk USING (chunk_id) WHERE rank <= 50)"""


def _reranked(spark, d):
    pool = settle(fusion.reciprocal_rank_fusion(_hits(spark, d), 50), "pool")
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    rich = pool.join(fusion.of_pool(docs, pool), "chunk_id").withColumn("tokens", text.content_tokens(F.col("content"))).join(_lexical(spark, d).select("query_id", "terms"), "query_id")
    return fusion.rerank(rich, fusion.overlap_score(F.col("terms"), F.col("tokens")))


@query("rerank_overlap", f"WITH {_RERANK} SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM rr")
def rerank_overlap(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", "score", "rank")


@query("topk_truncate", f"WITH {_RERANK} SELECT query_id, chunk_id, rank FROM (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM rr) WHERE rank <= 5")
def topk_truncate(spark, d):
    return _reranked(spark, d).filter("rank <= 5").select("query_id", "chunk_id", "rank")


@query("mmr_rerank")
def mmr_rerank(spark, d):
    return fusion.diversify(_reranked(spark, d).select("query_id", "chunk_id", "score", "tokens"), 10)


@query("faq_direct_split", f"WITH {_RERANK} SELECT query_id, chunk_id, CASE WHEN score >= 0.85 THEN 'faq_direct' ELSE 'chunk' END AS channel FROM rr")
def faq_direct_split(spark, d):
    return _reranked(spark, d).select("query_id", "chunk_id", fusion.channel(F.lit("faq"), F.col("score")).alias("channel"))


_CONTEXT = f"""{_RERANK}, cx AS (SELECT query_id, chunk_id, content, CAST(row_number() OVER w AS INTEGER) AS place, CAST(sum(greatest(1, floor(length(content) / 3.0))) OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_tokens FROM rr WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, chunk_id)),
fit AS (SELECT * FROM cx WHERE used_tokens <= 6144 OR place = 1)"""


@query("truncate_context", f"WITH {_CONTEXT} SELECT query_id, chunk_id, place, used_tokens FROM fit")
def truncate_context(spark, d):
    return fusion.fit_context(_reranked(spark, d), 6144).select("query_id", "chunk_id", "place", "used_tokens")


@query("build_prompt", f"WITH {_CONTEXT} SELECT query_id, string_agg('[' || place || '] ' || content, chr(10) || chr(10) ORDER BY place) AS prompt FROM fit GROUP BY query_id")
def build_prompt(spark, d):
    return fusion.prompt(fusion.fit_context(_reranked(spark, d), 6144))


@query("cosine_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({_COS.format('a.embedding', 'b.embedding')}, 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(spark, d):
    e = table(spark, d, "embeddings")
    other = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return e.join(other, F.col("vec_id") == F.col("a")).select("a", "b", F.round(text.cosine(F.col("embedding"), F.col("eb")), 6).alias("score"))


def _set_pairs(spark, d, f):
    t = table(spark, d, "documents").select("doc_id", text.distinct_tokens(F.col("text")).alias("t"))
    other = t.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("t").alias("tb"))
    return t.join(other, F.col("doc_id") == F.col("a")).select("a", "b", F.round(f(F.col("t"), F.col("tb")), 6).alias("score"))


_SETS = f"t AS (SELECT doc_id, list_distinct({_TOK.format('text')}) AS t FROM documents), p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.t) AS na, len(b.t) AS nb, len(list_intersect(a.t, b.t)) AS n FROM t a JOIN t b ON b.doc_id = a.doc_id + 1)"


@query("jaccard_pairs", f"WITH {_SETS} SELECT a, b, round(CASE WHEN na + nb - n > 0 THEN CAST(n AS DOUBLE) / (na + nb - n) ELSE 0 END, 6) AS score FROM p")
def jaccard_pairs(spark, d):
    return _set_pairs(spark, d, text.jaccard)


@query("dice_pairs", f"WITH {_SETS} SELECT a, b, round(CASE WHEN na + nb > 0 THEN 2 * CAST(n AS DOUBLE) / (na + nb) ELSE 0 END, 6) AS score FROM p")
def dice_pairs(spark, d):
    return _set_pairs(spark, d, text.dice)


@query("search_end_to_end")
def search_end_to_end(spark, d):
    docs = kb_documents(spark, d)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", F.col("text").alias("content"), text.content_tokens(F.col("text")).alias("tokens"), F.lit("text").alias("kind"))
    store = search.Store(chunks, docs.select("doc_id", "deleted"), _vectors(spark, d).drop("label"))
    asked = _lexical(spark, d).drop("terms").join(_bench_vectors(spark, d).drop("label"), "query_id", "left")
    return search.search(store, asked).select("query_id", "rank", "chunk_id", "score", F.array_join("paths", ",").alias("paths"))
