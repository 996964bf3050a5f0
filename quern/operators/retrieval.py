"""Ranked retrieval paths: each takes many queries at once and gives (query_id, chunk_id, score, rank)."""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from quern.functions import text
from quern.operators import postings
from quern.operators.vectors import cosine_top_k
from quern.storage import settle

K1, B = 1.2, 0.75


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query by score, ties to the smaller chunk_id, with rank."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))
    return ranked.filter(F.col("rank") <= k)


def visible(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of documents that aren't deleted: the one place where deletion hides rows."""
    return chunks.join(documents.filter("deleted").select("doc_id"), "doc_id", "left_anti")


def bm25(chunks: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, digits: int = 6) -> DataFrame:
    """Okapi BM25 over chunks (chunk_id, tokens) for queries (query_id, terms).

    A task has the best of its chunks, so no more than k hits of a query leave it.  Rows that share a chunk_id are one
    chunk, and those without one are too: they are few, and their postings are added up by joins.
    """
    rows, terms = postings.asked(queries)
    wanted: dict = {}
    for q, ts in rows:
        wanted.setdefault(q, Counter()).update(ts)
    counts = postings.term_counts(chunks, terms)
    n, mean = counts.agg(F.count("*"), F.avg("dl")).first()
    q_kind, id_kind = queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    if not n or not mean or not terms:
        return queries.sparkSession.createDataFrame([], f"query_id {q_kind.simpleString()}, chunk_id {id_kind.simpleString()}, score double, rank int")
    again = settle(counts.groupBy("chunk_id").count().filter("count > 1 or chunk_id is null").select("chunk_id"), "repeated-chunks")
    several = not again.isEmpty()
    single = counts.filter("chunk_id is not null").join(again, "chunk_id", "left_anti") if several else counts
    found = {r[0]: r[1] for r in single.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # as many as queries' terms
    if several:
        same = F.col("chunk_id").eqNullSafe(F.col("_again"))
        pairs = counts.join(again.withColumnRenamed("chunk_id", "_again"), same, "left_semi").select("chunk_id", "dl", F.explode(F.arrays_zip("terms", "counts")).alias("p"))
        merged = settle(pairs.groupBy(F.col("p.terms").alias("term"), "chunk_id", "dl").agg(F.sum("p.counts").alias("tf")), "repeated-postings")
        for t, c in merged.groupBy("term").count().collect():
            found[t] = found.get(t, 0) + c
    df = np.array([found.get(t, 0) for t in range(len(terms))], float)
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    lengths = float(mean)

    def weigh(ts, tf, dl):
        return idf[ts] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / lengths))

    def score(cells, weights, dl):
        s = cells @ weights
        return np.where(s != 0, postings.rounded(s, digits), np.nan)

    hits = postings.best_chunks(single, list(wanted.items()), k, q_kind, weigh, score)
    if several:
        spark = queries.sparkSession
        idfs = spark.createDataFrame([(t, float(x)) for t, x in enumerate(idf)], "term int, idf double")
        ask = spark.createDataFrame([(q, t, c) for q, ts in wanted.items() for t, c in ts.items()], StructType([StructField("query_id", q_kind), StructField("term", IntegerType()), StructField("times", IntegerType())]))
        w = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(lengths)))
        more = merged.join(idfs, "term").join(ask, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum(w), digits).alias("score"))
        hits = hits.unionByName(more)
    return best(hits, k)


def full_text_match(chunks: DataFrame, queries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Chunks with every term of the query; score: share of the chunk's tokens that are query terms."""
    rows, terms = postings.asked(queries)
    wanted = [(q, dict.fromkeys(ts, 1)) for q, ts in rows if ts]

    def score(cells, weights, dl):
        every = (cells > 0) @ weights == weights.sum(axis=0)
        return np.where(every, postings.rounded(cells @ weights / np.maximum(dl, 1)[:, None], digits), np.nan)

    hits = postings.best_chunks(postings.term_counts(chunks, terms), wanted, k, queries.schema["query_id"].dataType, lambda ts, tf, dl: tf, score)
    return best(hits, k)


def contains_pairs(texts: DataFrame, needles: DataFrame, gram: int = 6) -> DataFrame:
    """(text_id, needle_id) of every text that contains the needle; texts: text_id, text; needles: needle_id, needle.

    Both meet on the needle's first characters (gram at most), as the texts' substrings of that length, and what meets is
    then tested: an equi-join, for short texts such as names and questions.  Empty needles match nothing.
    """
    head = needles.filter("needle <> ''").withColumn("_n", F.least(F.char_length("needle"), F.lit(gram))).withColumn("_g", F.expr("substring(needle, 1, _n)"))
    lengths = [r[0] for r in head.select("_n").distinct().collect()]  # gram values at most
    if not lengths:
        return texts.limit(0).select("text_id").withColumn("needle_id", F.lit(None).cast(needles.schema["needle_id"].dataType))
    grams = F.flatten(F.array(*(F.expr(f"if(char_length(text) >= {n}, transform(sequence(1, char_length(text) - {n} + 1), i -> substring(text, i, {n})), array())") for n in lengths)))
    found = texts.select("text_id", "text", F.explode(F.array_distinct(grams)).alias("_g")).join(head, "_g")
    return found.filter(F.contains("text", "needle")).select("text_id", "needle_id")


def keyword_match(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Chunks of which any stored keyword contains any query keyword, case aside; score 1."""
    stored = chunks.select("chunk_id", F.explode("keywords").alias("w")).select("chunk_id", F.lower("w").alias("w"))
    asked = queries.select("query_id", F.explode("keywords").alias("w")).select("query_id", F.lower("w").alias("w")).distinct()
    pairs = contains_pairs(stored.select(F.col("w").alias("text_id"), F.col("w").alias("text")).distinct(), asked.select(F.col("w").alias("needle_id"), F.col("w").alias("needle")).distinct())
    # All scores are equal, so of a keyword, of a query's keyword and of a query only the k smallest chunks can be wanted.
    of_word = first_ids(stored, "w", k)
    of_needle = first_ids(of_word.join(pairs, F.col("w") == F.col("text_id")).select("chunk_id", "needle_id"), "needle_id", k)
    hits = of_needle.join(asked, F.col("needle_id") == F.col("w")).select("query_id", "chunk_id").distinct()
    return best(hits.withColumn("score", F.lit(1.0)), k)


def first_ids(rows: DataFrame, of: str, k: int, chunk_id: str = "chunk_id") -> DataFrame:
    """The rows of the k smallest ids of each value of a column; tasks drop the others before they are shuffled."""
    return rows.withColumn("_r", F.dense_rank().over(Window.partitionBy(of).orderBy(chunk_id))).filter(F.col("_r") <= k).drop("_r")


def faq_match(entries: DataFrame, queries: DataFrame, k: int, boost: float = 1.2) -> DataFrame:
    """Entries (chunk_id, standard, similar, negative, content) for queries (query_id, query).

    An entry is a candidate if its question, a similar one or its content contains the query; one of whose negatives
    contains the query, or lies in it, is dropped.  Score: 1 equal, 0.8 in a similar question, 0.6 otherwise, times boost.
    """
    low = queries.select("query_id", F.lower(F.trim("query")).alias("q")).filter("q <> ''")
    needles = low.select(F.col("query_id").alias("needle_id"), F.col("q").alias("needle"))
    low_list = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.lower(x))
    e = entries.select("chunk_id", F.lower("standard").alias("standard"), low_list("similar").alias("similar"), low_list("negative").alias("negative"), F.lower("content").alias("content"))
    fields = e.select(F.col("chunk_id").alias("text_id"), F.explode(F.array_distinct(F.concat(F.array("standard", "content"), "similar"))).alias("text")).filter("text is not null")
    pairs = contains_pairs(fields, needles).distinct()
    c = pairs.join(e, F.col("text_id") == F.col("chunk_id")).join(low, F.col("needle_id") == F.col("query_id"))
    q = F.col("q")
    barred = F.exists("negative", lambda x: (x != "") & (F.contains(x, q) | F.contains(q, x)))
    score = F.when(F.col("standard") == q, 1.0).when(F.exists("similar", lambda x: F.contains(x, q)), 0.8).otherwise(0.6) * boost
    return best(c.filter(~barred).select("query_id", "chunk_id", score.alias("score")), k)


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int, lexical_weight: float = 0.3, digits: int = 7) -> DataFrame:
    """Two rankings combined by a full outer join: 0.3 of the lexical score and 0.7 of the vector score."""
    a = lexical.select("query_id", "chunk_id", F.col("score").alias("a"))
    b = semantic.select("query_id", "chunk_id", F.col("score").alias("b"))
    both = a.join(b, ["query_id", "chunk_id"], "full_outer")
    score = F.round(lexical_weight * F.coalesce("a", F.lit(0.0)) + (1 - lexical_weight) * F.coalesce("b", F.lit(0.0)), digits)
    return best(both.select("query_id", "chunk_id", score.alias("score")), k)


def pages_to_chunks(page_hits: DataFrame, pages: DataFrame, k: int) -> DataFrame:
    """Wiki pages' scores carried to the chunks that they refer to, the best page of a chunk counting."""
    return pages_to_refs(page_hits, pages.select(F.col("chunk_id").alias("page_id"), F.explode("chunk_refs").alias("ref")), k)


def pages_to_refs(page_hits: DataFrame, refs: DataFrame, k: int) -> DataFrame:
    """The same of refs (page_id, ref): a page hands one score to all that it refers to, so only its k smallest are wanted."""
    hits = page_hits.join(first_ids(refs, "page_id", k, "ref"), F.col("chunk_id") == F.col("page_id")).groupBy("query_id", F.col("ref").alias("_c")).agg(F.max("score").alias("score"))
    return best(hits.withColumnRenamed("_c", "chunk_id"), k)


def entities_to_chunks(entity_hits: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """Entities' similarities carried to their chunks, the most similar entity of a chunk counting."""
    refs = entities.select("name", F.explode("chunk_ids").alias("chunk_id"))
    return best(entity_hits.join(refs, "name").groupBy("query_id", "chunk_id").agg(F.max("similarity").alias("score")), k)


def tree_search(nodes: DataFrame, queries: DataFrame, trees: int = 2, beam: int = 3, max_depth: int | None = None, digits: int = 6) -> DataFrame:
    """query_id, chunk_id, path, score: beam search down a summary tree.

    nodes: node_id, layer, embedding, children (array of node_id), chunks (array of chunk_id).  The trees best roots of a
    query start; each step keeps the beam best children of a query, each once and under its nearest parent; nodes of
    layer 1 or without children end a path and give their chunks, and so do those at max_depth, if one is given.
    """
    roots = nodes.join(nodes.select(F.explode("children").alias("node_id")).distinct(), "node_id", "left_anti")
    first = cosine_top_k(roots.select(F.col("node_id").alias("chunk_id"), "embedding"), queries, trees, digits)
    frontier = first.select("query_id", F.col("chunk_id").alias("node_id"), "score", F.array("chunk_id").alias("path"))
    slim = nodes.select("node_id", "layer", "children", "embedding")
    done, seen = [], None
    while True:
        at = settle(frontier.join(slim, "node_id"), "tree-frontier")
        leaf = (F.col("layer") <= 1) | (F.coalesce(F.size("children"), F.lit(0)) == 0) | F.lit(len(done) + 1 == max_depth)
        done.append(at.filter(leaf).select("query_id", "node_id", "score", "path"))
        visited = at.select("query_id", "node_id")
        seen = visited if seen is None else seen.unionByName(visited)
        down = at.filter(~leaf).select("query_id", F.col("score").alias("ps"), "path", F.explode("children").alias("node_id"))
        if down.isEmpty():
            break
        one = Window.partitionBy("query_id", "node_id").orderBy(F.desc("ps"), "path")
        once = down.withColumn("_r", F.row_number().over(one)).filter("_r = 1").join(seen, ["query_id", "node_id"], "left_anti")
        q = queries.select("query_id", F.col("embedding").alias("qe"))
        scored = once.join(slim.select("node_id", "embedding"), "node_id").join(q, "query_id").select("query_id", "node_id", F.round(text.cosine(F.col("qe"), F.col("embedding")), digits).alias("score"), "path")
        kept = scored.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))).filter(F.col("_r") <= beam)
        frontier = kept.select("query_id", "node_id", "score", F.array_append("path", F.col("node_id")).alias("path"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    chunks = nodes.select("node_id", F.explode_outer("chunks").alias("chunk_id"))
    return out.join(chunks, "node_id").select("query_id", "chunk_id", "path", "score")


def score_terms(c: Column) -> Column:
    """A query's text as terms."""
    return text.content_tokens(c)
