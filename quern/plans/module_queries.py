"""Queries over what enrichment modules keep: merges, communities, trees, tags, figures and icons."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import enrich, graph, pages, seams
from quern.plans.registry import query
from quern.plans.tables import table


@query("merge_history", "SELECT p_brand AS kb_id, p_name AS entity_name, min(p_type) AS resolved_id, min(p_type) AS merged_into, 1.0::DOUBLE AS merge_confidence, 'disambiguation_merger' AS origin FROM part GROUP BY p_brand, p_name, p_type")
def merge_history(spark, d):
    """A type of a brand is a canonical name, its parts' names are the aliases."""
    merged = table(spark, d, "part").groupBy(F.col("p_brand").alias("kb_id"), F.col("p_type").alias("canonical")).agg(F.collect_set("p_name").alias("aliases"))
    return graph.merge_history(merged)


@query("community_listing", "SELECT c_mktsegment AS kb_id, c_custkey AS community, c_name AS title, CAST(c_nationkey AS VARCHAR) AS summary, n AS communities FROM (SELECT *, count(*) OVER (PARTITION BY c_mktsegment) AS n, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 5")
def community_listing(spark, d):
    reports = table(spark, d, "customer").select(F.col("c_mktsegment").alias("kb_id"), F.col("c_custkey").alias("community"), F.col("c_name").alias("title"), F.col("c_nationkey").cast("string").alias("summary"))
    return graph.list_communities(reports)


@query("community_unchanged", "SELECT n_name AS kb_id, n_nationkey % 2 = 0 AND n_nationkey IN (SELECT s_nationkey FROM supplier) AS skip FROM nation")
def community_unchanged(spark, d):
    """Nations with an even key have the saved hash; suppliers stand for reports."""
    n = table(spark, d, "nation")
    saved = n.select(F.col("n_name").alias("kb_id"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise("old").alias("hash"))
    reports = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("kb_id"))
    return graph.unchanged(n.select(F.col("n_name").alias("kb_id"), F.col("n_name").alias("hash")), saved, reports)


@query("further_tags", "SELECT doc_id, CASE WHEN len(t) >= 1 THEN '' ELSE array_to_string([x for x in ['web', 'the end', 'que', 'und so'] if NOT list_contains(t, x) AND contains(lower(text), string_split(x, ' ')[1])][1:3], ',') END AS tags FROM (SELECT doc_id, text, [x for x in ['web', 'the end', 'que', 'und so'] if contains(lower(text), x)] AS t FROM documents)")
def further_tags(spark, d):
    """More tags for documents that contain none of them whole."""
    tags = F.array(*map(F.lit, ("web", "the end", "que", "und so")))
    docs = table(spark, d, "documents").withColumn("taken", enrich.matching_tags(F.col("text"), tags))
    return docs.select("doc_id", F.array_join(enrich.further_tags(F.col("text"), F.col("taken"), tags, enough=1), ",").alias("tags"))


@query("tree_skip", "SELECT page_id, regexp_matches(url, '[02468]$') AS skip FROM pages")
def tree_skip(spark, d):
    """Addresses that end in an even digit stand for PDFs read as tables."""
    even = F.col("url").rlike("[02468]$")
    return table(spark, d, "pages").select("page_id", enrich.skips_tree(F.when(even, F.lit(".PDF")).otherwise(F.lit("html")), F.lit("table")).alias("skip"))


@query("tree_ids")
def tree_ids(spark, d):
    return enrich.tree_ids(table(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "chunk_id")


@query("table_position", "SELECT doc_id, instr(text || '<TABLE_1>', '<TABLE_1>') - 1 AS place FROM documents")
def table_position(spark, d):
    return table(spark, d, "documents").select("doc_id", text.table_position(F.concat("text", F.lit("<TABLE_1>")), 1).cast("long").alias("place"))


@query("icon_images", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_partkey < 512 ELSE l_suppkey * 10 < 64 AND l_quantity < 64 END AS icon FROM lineitem")
def icon_images(spark, d):
    """A third of the images can't be decoded."""
    known = F.col("l_partkey") % 3 != 0
    icon = pages.is_icon(F.when(known, F.col("l_suppkey") * 10), F.when(known, F.col("l_quantity")), F.col("l_partkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", icon.alias("icon"))


@query("figure_lines", "SELECT doc_id, CAST(len(string_split(text, chr(10))) + 2 AS BIGINT) AS n_lines FROM documents WHERE text IS NOT NULL")
def figure_lines(spark, d):
    """Documents, to which a blank line, two labels of a figure and its caption are added: the labels go."""
    broken = F.concat("text", F.lit("\n\nInput layer\n0 1 2 3\nFigure 1 A model"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(broken, "\n")).alias("line_no", "line"))
    return pages.without_figure_lines(lines).groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query("model_rerank", "SELECT item_id, coalesce(length(text[1:768]), 0)::DOUBLE AS score FROM benchmark")
def model_rerank(spark, d):
    """A stand-in for a model scores by the length of what it is given."""
    asked = table(spark, d, "benchmark").select("item_id", F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("text").alias("content"))
    return seams.rerank_scores(asked, lambda q, texts: {"results": [{"index": i, "score": len(t)} for i, t in reversed(list(enumerate(texts)))]}).select("item_id", "score")
