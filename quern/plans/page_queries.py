"""Queries over pages, boxes and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import pages, retrieval
from quern.plans.registry import query
from quern.plans.search_queries import _FAQ, _faq_entries
from quern.plans.tables import table


@query(
    "merge_table_pages",
    r"""WITH p AS (SELECT source, doc_id, text, [x for x in string_split(text, chr(10)) if trim(x) <> ''] AS f FROM documents),
m AS (SELECT *, coalesce(regexp_matches(f[1], '^\s*\|.*\|\s*$'), false) AS starts, coalesce(regexp_matches(f[-1], '^\s*\|.*\|\s*$'), false) AS ends FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 2 THEN text ELSE text || chr(10) || '| a |' END AS text, CASE WHEN doc_id % 3 = 2 THEN f ELSE list_append(f, '| a |') END AS f FROM (SELECT source, doc_id, CASE WHEN doc_id % 3 = 0 THEN '| b |' || chr(10) || text ELSE text END AS text, CASE WHEN doc_id % 3 = 0 THEN list_prepend('| b |', f) ELSE f END AS f FROM p))),
r AS (SELECT *, sum(CASE WHEN starts AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id) AS run FROM (SELECT *, lag(ends) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM m))
SELECT source, min(doc_id) AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM r GROUP BY source, run""",
)
def merge_table_pages(spark, d):
    """Documents of a source stand for its pages; some get a table row at an end."""
    third = F.col("doc_id") % 3
    t = F.when(third == 0, F.concat(F.lit("| b |\n"), "text")).otherwise(F.col("text"))
    docs = table(spark, d, "documents").select("source", "doc_id", F.when(third == 2, F.col("text")).otherwise(F.concat(t, F.lit("\n| a |"))).alias("text"))
    return pages.merge_table_pages(docs, "source", "doc_id")


@query(
    "strip_chart_debris",
    r"""WITH t AS (SELECT doc_id, string_split('7' || chr(10) || text || chr(10) || '0.5' || chr(10) || chr(10) || '10' || chr(10) || '56-layer', chr(10)) AS x FROM documents),
l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS n FROM t),
k AS (SELECT doc_id, n, regexp_matches(line, '(?i)^\s*(?:[-+]?\d+(?:\.\d+)?(?:e[-+]?\d+)?%?|\d+-layer|iter\.\s*\(1e\d\)|(?:training |test )?error\s*\(%\))\s*$') OR (regexp_matches(line, '^[\d\s.()-]+$') AND length(regexp_replace(line, '^\s+|\s+$', '', 'g')) <= 24 AND length(regexp_replace(line, '\D', '', 'g')) >= 3) AS debris, trim(line) = '' AS blank FROM l),
i AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id, debris OR blank ORDER BY n) AS island FROM k),
r AS (SELECT doc_id, island, min(CASE WHEN debris THEN n END) AS first, max(n) AS last FROM i WHERE debris OR blank GROUP BY ALL)
SELECT i.doc_id, count(*) AS n_lines FROM i LEFT JOIN r ON i.doc_id = r.doc_id AND i.island = r.island AND (debris OR blank) WHERE NOT coalesce(n >= first AND last - first >= 2, false) GROUP BY i.doc_id""",
)
def strip_chart_debris(spark, d):
    """All documents, to which a chart of four lines and one lone number are added."""
    broken = F.concat(F.lit("7\n"), "text", F.lit("\n0.5\n\n10\n56-layer"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(broken, "\n")).alias("line_no", "line"))
    return pages.strip_chart_debris(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(
    "reading_columns",
    """WITH b AS (SELECT l_orderkey AS page_id, l_partkey % 100 AS x0, l_partkey % 100 + l_quantity AS x1 FROM lineitem), g AS (SELECT *, max(x1) OVER (PARTITION BY page_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM b),
c AS (SELECT page_id, sum(CASE WHEN x0 - before > 12 THEN 1 ELSE 0 END) AS gaps FROM g GROUP BY page_id) SELECT page_id, CAST(gaps + 1 AS BIGINT) AS n_columns FROM c""",
)
def reading_columns(spark, d):
    boxes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), (F.col("l_partkey") % 100).alias("x0"), (F.col("l_partkey") % 100 + F.col("l_quantity")).alias("x1"))
    return pages.reading_columns(boxes).groupBy("page_id").agg((F.max("column_no") + 1).alias("n_columns"))


@query("point_in_box", "SELECT l_orderkey AS page_id, l_linenumber AS n FROM lineitem p WHERE NOT EXISTS (SELECT 1 FROM orders b WHERE b.o_orderkey = p.l_orderkey AND p.l_quantity BETWEEN 10 AND 30 AND p.l_partkey BETWEEN b.o_custkey - 50 AND b.o_custkey + 50)")
def point_in_box(spark, d):
    points = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("x"), F.col("l_partkey").alias("y"))
    boxes = table(spark, d, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit(10).alias("x0"), F.lit(30).alias("x1"), (F.col("o_custkey") - 50).alias("y0"), (F.col("o_custkey") + 50).alias("y1"))
    return pages.outside_boxes(points, boxes).select("page_id", "n")


@query("chart_bbox", "SELECT l_orderkey AS page_id, min(l_partkey) AS x0, max(l_partkey) AS x1, min(l_suppkey) AS y0, max(l_suppkey) AS y1 FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3")
def chart_bbox(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page_id"))
    return g.agg(F.min("l_partkey").alias("x0"), F.max("l_partkey").alias("x1"), F.min("l_suppkey").alias("y0"), F.max("l_suppkey").alias("y1"), F.count("*").alias("c")).filter("c >= 3").drop("c")


@query("model_lookup", "SELECT p_name AS model, CASE WHEN p_name = 'cold widget' THEN 768 WHEN p_name LIKE 'cold wi%' THEN 1536 WHEN p_name LIKE 'cold %' THEN 3072 ELSE 6144 END AS max_tokens FROM (SELECT DISTINCT p_name FROM part)")
def model_lookup(spark, d):
    patterns = spark.createDataFrame([("cold *", 4096), ("cold wi*", 2048), ("cold widget", 1024)], "pattern string, context int")
    return pages.model_limits(table(spark, d, "part").select(F.col("p_name").alias("model")).distinct(), patterns)


@query("faq_candidates", f"WITH {_FAQ}, q AS (SELECT chunk_id AS query_id, lower(trim(standard)) AS q FROM e WHERE conv_id % 50 = 0) SELECT query_id, chunk_id FROM q JOIN e ON q <> '' AND contains(lower(standard), q)")
def faq_candidates(spark, d):
    e = _faq_entries(spark, d)
    texts = e.select(F.col("chunk_id").alias("text_id"), F.lower("standard").alias("text"))
    asked = e.filter("conv_id % 50 = 0").select(F.col("chunk_id").alias("needle_id"), F.lower(F.trim("standard")).alias("needle"))
    return retrieval.contains_pairs(texts, asked).select(F.col("needle_id").alias("query_id"), F.col("text_id").alias("chunk_id"))


@query("keyword_search_one", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'old')")
def keyword_search_one(spark, d):
    return table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lit("old"))).select("p_partkey")


@query("url_whitelist", "SELECT page_id, regexp_matches(url, '^(https?)://(?:[^/?#@]*@)?(?:[^/:?#]*\\.)?example\\.org(?:[/:?#]|$)') AS listed FROM pages")
def url_whitelist(spark, d):
    """With every host barred but those listed."""
    listed = text.url_problem(F.regexp_replace("url", r"^(https?)://([^/:?#]*\.)?example\.org", "$1://$2example.org.internal"), ("*.example.org.internal",))
    host = F.regexp_extract("url", r"^https?://(?:[^/?#@]*@)?([^/:?#]*)", 1)
    return table(spark, d, "pages").select("page_id", (listed.isNull() & host.rlike(r"(?:^|\.)example\.org$")).alias("listed"))


@query("document_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, count(*) AS changes FROM events GROUP BY user_id")
def document_status(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.count("*").alias("changes"))


@query("backfill_vectors", "SELECT doc_id, vec_id IS NULL AS missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def backfill_vectors(spark, d):
    """Documents without a vector get a hashed one; those with one keep it."""
    from quern.operators import enrich

    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), text.content_tokens(F.concat("text", F.lit(" x"))).alias("tokens"))
    have = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    made = enrich.hashed_vectors(docs.join(have, "chunk_id", "left_anti"))
    kept = have.join(docs.select("chunk_id"), "chunk_id", "left_semi")
    both = kept.withColumn("missing", F.lit(False)).unionByName(made.withColumn("missing", F.lit(True)))
    return both.filter("size(embedding) > 0").select(F.col("chunk_id").alias("doc_id"), "missing")
