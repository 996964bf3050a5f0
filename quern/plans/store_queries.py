"""Queries over stored rows: ingestion, status, updates, deletion, enrichment, chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import enrich, ingest
from quern.plans.registry import query
from quern.plans.search_queries import _TOK
from quern.plans.tables import KB_SQL, LINES_SQL, kb_documents, lines, table


@query("exact_dedup", "SELECT doc_id, CASE WHEN doc_id = m THEN 'new' ELSE 'duplicate' END AS status, CASE WHEN doc_id <> m THEN m END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS m FROM documents)")
def exact_dedup(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", F.lit("kb").alias("kb_id"))
    return ingest.deduplicate(docs).select("doc_id", "status", "duplicate_of")


@query(
    "dedup_against_store",
    f"WITH {KB_SQL}, s AS (SELECT sha256(text) AS h, min(doc_id) AS live FROM kb WHERE NOT deleted AND lang = 'en' GROUP BY 1), i AS (SELECT doc_id + 1000000 AS doc_id, sha256(text) AS h FROM kb), f AS (SELECT h, min(doc_id) AS f FROM i GROUP BY h) SELECT i.doc_id, CASE WHEN coalesce(live, f) = i.doc_id THEN 'new' ELSE 'duplicate' END AS status FROM i JOIN f USING (h) LEFT JOIN s USING (h)",
)
def dedup_against_store(spark, d):
    """All documents come in again under new ids; what is stored and live are the English ones."""
    docs = kb_documents(spark, d)
    stored = docs.filter("lang = 'en'").select(F.lit("kb").alias("kb_id"), "doc_id", F.sha2("text", 256).alias("hash"), "deleted")
    incoming = docs.select(F.lit("kb").alias("kb_id"), (F.col("doc_id") + 1000000).alias("doc_id"), "text")
    return ingest.deduplicate(incoming, stored).select("doc_id", "status")


_KBS = "kbs AS (SELECT 'src' || n_nationkey AS kb_id, n_regionkey = 0 AS deleted FROM nation)"


def _kbs(spark, d):
    return table(spark, d, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("kb_id"), (F.col("n_regionkey") == 0).alias("deleted"))


@query("kb_guard", f"WITH {_KBS} SELECT doc_id, source IN (SELECT kb_id FROM kbs WHERE NOT deleted) AS accepted FROM documents")
def kb_guard(spark, d):
    good, bad = ingest.in_known_kb(table(spark, d, "documents").select("doc_id", F.col("source").alias("kb_id")), _kbs(spark, d))
    return good.select("doc_id", F.lit(True).alias("accepted")).unionByName(bad.select("doc_id", F.lit(False).alias("accepted")))


@query("kb_list", f"WITH {_KBS} SELECT kb_id FROM kbs WHERE NOT deleted")
def kb_list(spark, d):
    return _kbs(spark, d).filter("not deleted").select("kb_id")


@query("logical_delete", f"WITH {KB_SQL}, {_KBS} SELECT doc_id, deleted OR kb_id IN (SELECT kb_id FROM kbs WHERE deleted) AS deleted FROM kb")
def logical_delete(spark, d):
    """A deleted knowledge base takes its documents with it."""
    return ingest.mark_deleted(kb_documents(spark, d), _kbs(spark, d).filter("deleted"), "kb_id").select("doc_id", "deleted")


@query("purge_document", "SELECT 'documents' AS name, count(*) AS left_rows FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def purge_document(spark, d):
    gone = table(spark, d, "labels").filter("quality = 0")
    tables = {"documents": table(spark, d, "documents"), "embeddings": table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "labels": table(spark, d, "labels")}
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("left_rows")) for name, t in ingest.purge(tables, gone).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("latest_status", "SELECT user_id, ts, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_type DESC) AS r FROM (SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS ts, event_type FROM events)) WHERE r = 1")
def latest_status(spark, d):
    log = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), "event_type")
    return ingest.latest(log, "user_id", "ts", "event_type")


@query("stale_checkpoints", "SELECT user_id, CAST(epoch_us(max(ts)) AS BIGINT) AS ts FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 300 SECOND")
def stale_checkpoints(spark, d):
    log = table(spark, d, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    found = ingest.stale(log, "user_id", "ts", F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return found.select("user_id", F.unix_micros("ts").alias("ts"))


@query("update_by_key", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'good' ELSE CASE WHEN l.quality = 0 THEN 'bad' END END, d.lang) AS lang FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_by_key(spark, d):
    new = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("lang"))
    return ingest.update_by_key(table(spark, d, "documents").select("doc_id", "lang"), new, "doc_id", "lang")


@query("upsert_stats", "SELECT coalesce(a.k, b.k) AS nation, coalesce(b.n, a.n) AS n, CAST(coalesce(a.v, 0) + CASE WHEN b.k IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version FROM (SELECT c_nationkey AS k, count(*) AS n, 1 AS v FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def upsert_stats(spark, d):
    old = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n")).withColumn("version", F.lit(1))
    new = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"))
    return ingest.upsert(old, new, "nation")


@query("checkpoint_json", """SELECT doc_id, '{"lang":"' || lang || '","status":"done","step":"' || (doc_id % 7) || '"}' AS merged, '{"lang":"' || lang || '"}' AS trimmed FROM documents""")
def checkpoint_json(spark, d):
    old = F.to_json(F.struct("lang", F.lit("running").alias("status")))
    new = F.to_json(F.struct(F.lit("done").alias("status"), (F.col("doc_id") % 7).cast("string").alias("step")))
    docs = table(spark, d, "documents")
    return docs.select("doc_id", ingest.merge_checkpoint(old, new).alias("merged"), ingest.without_checkpoint(ingest.merge_checkpoint(old, new), "status", "step").alias("trimmed"))


@query("chunks_by_line", f"WITH {KB_SQL}, {LINES_SQL} SELECT doc_id, seq_num, content FROM ch")
def chunks_by_line(spark, d):
    return lines(kb_documents(spark, d)).select("doc_id", "seq_num", "content")


@query("chunk_counts", f"WITH {KB_SQL}, {LINES_SQL} SELECT doc_id, count(*) AS n_chunks FROM ch GROUP BY doc_id")
def chunk_counts(spark, d):
    return lines(kb_documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


_TOKENS = "CAST(greatest(1, floor(length(content) / 3.0)) AS BIGINT)"


@query(
    "parent_chunks",
    f"WITH {KB_SQL}, {LINES_SQL}, p AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY seq_num) - 1) / 2) AS INTEGER) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM ch) SELECT doc_id, CAST(n + p AS INTEGER) AS seq_num, string_agg(content, chr(10) || chr(10) ORDER BY seq_num) AS content, CAST(sum({_TOKENS}) AS BIGINT) AS tokens, CAST(count(*) AS INTEGER) AS children FROM p GROUP BY doc_id, n, p",
)
def parent_chunks(spark, d):
    chunks = lines(kb_documents(spark, d)).withColumn("tokens", text.count_tokens(F.col("content")))
    return ingest.parent_chunks(chunks)


@query("chunk_quality", f"WITH {KB_SQL}, {LINES_SQL}, t AS (SELECT doc_id, {_TOKENS} AS n, seq_num = max(seq_num) OVER (PARTITION BY doc_id) AS is_last FROM ch), g AS (SELECT doc_id, count(*) AS c, max(n) AS m, sum(n) AS s, count(*) FILTER (n < 5 AND NOT is_last) AS tiny FROM t GROUP BY doc_id) SELECT doc_id, NOT (c = 1 AND s > 1024) AND NOT (tiny > c * 0.25 AND tiny > 2) AND NOT (m < 128 AND s > 512) AND m <= 1024 AS passes FROM g")
def chunk_quality(spark, d):
    from quern.operators.chunking import quality

    chunks = lines(kb_documents(spark, d)).withColumn("tokens", text.count_tokens(F.col("content")))
    return quality(chunks, 512)


@query("chunk_no_split", "SELECT doc_id, CAST(0 AS INTEGER) AS seq_num, text AS content, CAST(greatest(1, floor(length(text) / 3.0)) AS BIGINT) AS tokens FROM documents")
def chunk_no_split(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lit(0).alias("seq_num"), F.col("text").alias("content"), text.count_tokens(F.col("text")).alias("tokens"))


_C = f"c AS (SELECT doc_id AS chunk_id, {_TOK.format('text')} AS tokens FROM documents)"


@query(
    "tfidf_keywords",
    f"WITH {_C}, t AS (SELECT chunk_id, keyword, count(*) AS tf FROM (SELECT chunk_id, unnest(tokens) AS keyword FROM c) WHERE length(keyword) > 1 GROUP BY ALL), f AS (SELECT keyword, count(*) AS df FROM t GROUP BY keyword), s AS (SELECT chunk_id, keyword, round(tf * ln(CAST((SELECT count(*) FROM c) AS DOUBLE) / df), 6) AS score FROM t JOIN f USING (keyword)) SELECT chunk_id, keyword, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, keyword) AS INTEGER) AS rank FROM s) WHERE rank <= 5",
)
def tfidf_keywords(spark, d):
    return enrich.tfidf_keywords(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), text.content_tokens(F.col("text")).alias("tokens")))


@query("tag_match", "SELECT doc_id, array_to_string([t for t in ['The', 'und', 'que', 'zzz'] if contains(lower(text), lower(t))], ',') AS tags FROM documents")
def tag_match(spark, d):
    tags = F.array(*map(F.lit, ("The", "und", "que", "zzz")))
    return table(spark, d, "documents").select("doc_id", F.array_join(enrich.matching_tags(F.col("text"), tags), ",").alias("tags"))


@query("keyword_merge", "SELECT doc_id, CASE lang WHEN 'en' THEN 'en,' || source ELSE lang || ',' || source || ',en' END AS keywords FROM documents")
def keyword_merge(spark, d):
    merged = enrich.merge_keywords(F.array("lang"), F.array("source", "lang"), F.array(F.lit("en")))
    return table(spark, d, "documents").select("doc_id", F.array_join(merged, ",").alias("keywords"))


@query("lead_summary")
def lead_summary(spark, d):
    return table(spark, d, "documents").select("doc_id", enrich.lead_summary(F.col("text")).alias("summary"))


_PAGES = "p AS (SELECT lower(n_name) AS raw, n_nationkey AS k, n_name FROM nation), s AS (SELECT k, n_name, coalesce(nullif(trim(regexp_replace(raw, '[^a-z0-9]+', '_', 'g'), '_'), ''), 'untitled') AS slug FROM p)"


def _wiki(spark, d):
    n = table(spark, d, "nation")
    other = n.select((F.col("n_nationkey") - 1).alias("k"), F.col("n_name").alias("next"))
    joined = n.join(other, F.col("n_nationkey") == F.col("k"), "left")
    body = F.concat(F.lit("see [["), F.coalesce("next", F.lit("nowhere")), F.lit("|x]] and [["), "n_name", F.lit("]]"))
    return joined.select(text.to_slug(F.col("n_name")).alias("slug"), body.alias("content"))


@query("wiki_links", f"WITH {_PAGES} SELECT a.slug AS source, b.slug AS target FROM s a JOIN s b ON b.k = a.k + 1")
def wiki_links(spark, d):
    return enrich.wiki_links(_wiki(spark, d))


@query("wiki_backlinks", f"WITH {_PAGES} SELECT b.slug, a.slug AS in_links FROM s a JOIN s b ON b.k = a.k + 1")
def wiki_backlinks(spark, d):
    return enrich.backlinks(enrich.wiki_links(_wiki(spark, d))).select("slug", F.array_join("in_links", ",").alias("in_links"))


@query("compose_full_text", f"WITH {KB_SQL}, {LINES_SQL} SELECT doc_id, sha256(string_agg(content, chr(10) ORDER BY seq_num)) AS hash FROM ch GROUP BY doc_id")
def compose_full_text(spark, d):
    return enrich.full_text(lines(kb_documents(spark, d))).select("doc_id", F.sha2("content", 256).alias("hash"))


@query("wiki_citation_rule", "SELECT item_id AS term_id, doc_id AS chunk_id FROM benchmark b JOIN documents d ON contains(lower(d.text), lower(b.text)) WHERE regexp_matches(b.text, '[A-Za-z]')")
def wiki_citation_rule(spark, d):
    chunks = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return enrich.citations(table(spark, d, "benchmark").filter(F.col("text").rlike("[A-Za-z]")).select(F.col("item_id").alias("term_id"), F.col("text").alias("term")), chunks)


@query("image_content_compose", "SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE '[OCR]' || chr(10) || lang || chr(10) || chr(10) END || '[Caption]' || chr(10) || source AS content FROM documents")
def image_content_compose(spark, d):
    ocr = F.when(F.col("lang") == "en", F.lit("  ")).otherwise(F.col("lang"))
    return table(spark, d, "documents").select("doc_id", enrich.compose_image(ocr, F.col("source")).alias("content"))


@query("embed_chunks")
def embed_chunks(spark, d):
    return enrich.hashed_vectors(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), text.content_tokens(F.col("text")).alias("tokens")))


@query(
    "centroid_assign",
    """WITH c AS (SELECT label AS cluster, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label), s AS (SELECT e.vec_id AS chunk_id, c.cluster, round(list_cosine_similarity([CAST(x AS DOUBLE) for x in e.embedding], [CAST(x AS DOUBLE) for x in c.embedding]), 9) AS s FROM embeddings e, c)
SELECT chunk_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY s DESC, cluster) AS r FROM s) WHERE r = 1""",
)
def centroid_assign(spark, d):
    e = table(spark, d, "embeddings")
    centroids = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).withColumnRenamed("label", "cluster")
    return enrich.assign_centroids(e.withColumnRenamed("vec_id", "chunk_id"), centroids)


@query("topo_layers", "SELECT * FROM (VALUES ('graph_extract', 0), ('keyword_extract', 0), ('question_gen', 0), ('raptor', 0), ('summarizer', 0), ('wiki', 0), ('disambiguation', 1), ('community', 2)) t(module, layer)")
def topo_layers(spark, d):
    return spark.createDataFrame([(m, i) for i, layer in enumerate(enrich.layers()) for m in layer], "module string, layer int")


def _tree(spark, d, method="gmm"):
    return enrich.summary_tree(table(spark, d, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_id"), "embedding"), method=method)


@query("raptor_build")
def raptor_build(spark, d):
    return _tree(spark, d).select("doc_id", "node_id", "layer", F.size("children").alias("n_children"), F.size("chunks").alias("n_chunks"))


@query("raptor_build_ahc")
def raptor_build_ahc(spark, d):
    return _tree(spark, d, "ahc").select("doc_id", "node_id", "layer", F.size("children").alias("n_children"), F.size("chunks").alias("n_chunks"))


@query("raptor_traverse")
def raptor_traverse(spark, d):
    from quern.operators.retrieval import tree_search
    from quern.storage import settle

    asked = table(spark, d, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    found = tree_search(settle(_tree(spark, d), "tree"), asked)
    return found.select("query_id", "chunk_id", F.array_join("path", ">").alias("path"), "score")
