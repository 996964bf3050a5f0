"""Queries over the entity graph; order lines stand for mentions of parts and suppliers in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import graph
from quern.plans.registry import query
from quern.plans.tables import table


def _instances(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("kb_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("name"),
        F.col("l_linestatus").alias("description"),
        F.col("l_quantity").alias("weight"),
        F.array(F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_ids"),
    )


def _relations(spark, d):
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("kb_id"),
        F.col("l_orderkey").alias("doc_id"),
        F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("source"),
        F.concat(F.lit("supp"), F.col("l_suppkey").cast("string")).alias("target"),
        F.col("l_linestatus").alias("type"),
        F.col("l_quantity").alias("weight"),
        F.lit("ships").alias("description"),
    )


def _entities(spark, d):
    """Parts with their own number and, as an alias, that number plus a million."""
    p = table(spark, d, "part")
    kbs = F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R")))
    return p.select(kbs.alias("kb_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("type"), F.array(F.concat(F.lit("part"), (F.col("p_partkey") + 1000000).cast("string"))).alias("aliases"))


_I = "i AS (SELECT l_returnflag AS kb_id, l_orderkey AS doc_id, 'part' || l_partkey AS name, l_linestatus AS description, l_quantity AS weight, l_orderkey * 10 + l_linenumber AS chunk FROM lineitem)"
_R = "r AS (SELECT l_returnflag AS kb_id, l_orderkey AS doc_id, 'part' || l_partkey AS source, 'supp' || l_suppkey AS target, l_linestatus AS type, l_quantity AS weight FROM lineitem)"


@query("graph_doc_merge", f"WITH {_I} SELECT kb_id, doc_id, name, string_agg(DISTINCT description, '<SEP>' ORDER BY description) AS description, sum(weight) AS weight, array_to_string(list_sort(list(DISTINCT chunk)), ',') AS chunks FROM i GROUP BY kb_id, doc_id, name")
def graph_doc_merge(spark, d):
    merged = graph.merge_instances(_instances(spark, d))
    return merged.select("kb_id", "doc_id", "name", "description", "weight", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunks"))


@query("graph_relation_merge", f"WITH {_R} SELECT kb_id, doc_id, source, target, type, sum(weight) AS weight FROM r GROUP BY ALL")
def graph_relation_merge(spark, d):
    return graph.merge_relations(_relations(spark, d)).drop("description")


@query(
    "graph_upsert",
    f"WITH {_I}, n AS (SELECT kb_id, doc_id, name, weight FROM i UNION ALL SELECT 'A', o_orderkey, 'part' || (o_custkey % 100 + 1), 1.0 FROM orders) SELECT kb_id, name, count(DISTINCT doc_id) AS docs, sum(weight) AS weight FROM n GROUP BY kb_id, name",
)
def graph_upsert(spark, d):
    """Orders mention parts by alias: their instances join those of the parts."""
    base = (_entities(spark, d), _instances(spark, d), _relations(spark, d))
    fresh = table(spark, d, "orders").select(
        F.lit("A").alias("kb_id"),
        F.col("o_orderkey").alias("doc_id"),
        F.concat(F.lit("part"), (F.col("o_custkey") % 100 + 1000001).cast("string")).alias("name"),
        F.lit("order").alias("type"),
        F.lit("o").alias("description"),
        F.lit(1.0).alias("weight"),
        F.array(F.col("o_orderkey")).alias("chunk_ids"),
    )
    _, instances, _ = graph.upsert(base, fresh, _relations(spark, d).limit(0))
    return instances.groupBy("kb_id", "name").agg(F.countDistinct("doc_id").alias("docs"), F.sum("weight").alias("weight"))


_MERGED = "CASE WHEN CAST(substr(name, 5) AS BIGINT) % 2 = 0 THEN 'part' || (CAST(substr(name, 5) AS BIGINT) - 1) ELSE name END"


@query("alias_merge", f"WITH {_I} SELECT kb_id, {_MERGED} AS name, count(DISTINCT doc_id) AS docs, sum(weight) AS weight FROM i GROUP BY ALL")
def alias_merge(spark, d):
    """Every even part folds into the odd one before it."""
    parts = table(spark, d, "part").filter("p_partkey % 2 = 0")
    name = lambda n: F.concat(F.lit("part"), n.cast("string"))
    merges = parts.select(F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("kb_id"), name(F.col("p_partkey")).alias("alias"), name(F.col("p_partkey") - 1).alias("canonical"))
    _, instances, _ = graph.merge_aliases((_entities(spark, d), _instances(spark, d), _relations(spark, d)), merges)
    return instances.groupBy("kb_id", "name").agg(F.countDistinct("doc_id").alias("docs"), F.sum("weight").alias("weight"))


@query("graph_stats", f"WITH {_I}, {_R} SELECT i.kb_id, (SELECT count(*) FROM part) AS entities, i.n AS instances, r.n AS relations, i.docs AS documents FROM (SELECT kb_id, count(*) AS n, count(DISTINCT doc_id) AS docs FROM i GROUP BY kb_id) i JOIN (SELECT kb_id, count(*) AS n FROM r GROUP BY kb_id) r USING (kb_id)")
def graph_stats(spark, d):
    return graph.stats((_entities(spark, d), _instances(spark, d), _relations(spark, d)))


@query(
    "entity_search",
    f"""WITH {_I}, e AS (SELECT unnest(['A', 'N', 'R']) AS kb_id, 'part' || p_partkey AS name, 'part' || (p_partkey + 1000000) AS alias FROM part), q AS (SELECT n_nationkey AS query_id, 'N' AS kb_id, 'part' || (n_nationkey + 1) AS asked FROM nation UNION ALL SELECT n_nationkey, 'N', 'part' || (n_nationkey + 1000050) FROM nation),
x AS (SELECT query_id, name, max(CASE WHEN name = asked THEN 1.0 ELSE 0.5 END) AS similarity FROM q JOIN e ON q.kb_id = e.kb_id AND asked IN (name, alias) GROUP BY ALL),
z AS (SELECT DISTINCT query_id, name, 0.5 AS similarity FROM q JOIN e ON q.kb_id = e.kb_id AND contains(name, asked) WHERE (query_id, name) NOT IN (SELECT query_id, name FROM x)),
u AS (SELECT *, 0 AS tier FROM x UNION ALL SELECT *, 1 FROM z), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, similarity DESC, name) AS r FROM u)
SELECT query_id, k.name, CAST(similarity AS DOUBLE) AS similarity, CAST(len(c.chunks) AS INTEGER) AS n_chunks FROM k JOIN (SELECT name, list(DISTINCT chunk) AS chunks FROM i WHERE kb_id = 'N' GROUP BY name) c USING (name) WHERE r <= 5""",
)
def entity_search(spark, d):
    name = lambda n: F.concat(F.lit("part"), n.cast("string"))
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.lit("N").alias("kb_id"), F.array(name(F.col("n_nationkey") + 1), name(F.col("n_nationkey") + 1000050)).alias("names"))
    found = graph.search_entities(_entities(spark, d), _instances(spark, d), asked, 5)
    return found.filter("chunk_ids is not null").select("query_id", "name", "similarity", F.size("chunk_ids").alias("n_chunks"))


@query(
    "graph_topk",
    f"""WITH {_I}, q AS (SELECT n_nationkey AS query_id, 'part' || (n_nationkey + 1) AS name FROM nation), h AS (SELECT query_id, chunk AS chunk_id, CAST(1.0 AS DOUBLE) AS score FROM q JOIN (SELECT DISTINCT name, chunk FROM i WHERE kb_id = 'N') USING (name))
SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS rank FROM h) WHERE rank <= 10""",
)
def graph_topk(spark, d):
    from quern.operators import retrieval

    i = _instances(spark, d).filter("kb_id = 'N'")
    hits = table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("part"), (F.col("n_nationkey") + 1).cast("string")).alias("name"), F.lit(1.0).alias("similarity"))
    chunks = i.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("chunk_ids"))).alias("chunk_ids"))
    return retrieval.entities_to_chunks(hits, chunks, 10)


@query("expand_neighbors", f"WITH {_R}, b AS (SELECT source, target, weight FROM r UNION ALL SELECT target, source, weight FROM r), n AS (SELECT source AS name, target AS neighbour, sum(weight) AS weight FROM b WHERE source IN (SELECT 'supp' || s_suppkey FROM supplier) GROUP BY ALL) SELECT name, neighbour, weight FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY weight DESC, neighbour) AS k FROM n) WHERE k <= 200")
def expand_neighbors(spark, d):
    names = table(spark, d, "supplier").select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("name"))
    return graph.neighbours(_relations(spark, d), names)


@query("kb_graph", f"WITH {_R} SELECT source, target, type, sum(weight) AS weight FROM r GROUP BY ALL")
def kb_graph(spark, d):
    return _relations(spark, d).groupBy("source", "target", "type").agg(F.sum("weight").alias("weight"))


@query("community_edges", f"WITH {_R} SELECT least(source, target) AS source, greatest(source, target) AS target, max(weight) AS weight FROM r WHERE source IN (SELECT 'part' || p_partkey FROM part WHERE p_size < 25) GROUP BY ALL")
def community_edges(spark, d):
    parts = table(spark, d, "part").filter("p_size < 25").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("name"))
    return graph.edges(_relations(spark, d), parts.unionByName(suppliers))


@query("graph_delete_document", f"WITH {_I}, k AS (SELECT * FROM i WHERE doc_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) SELECT kb_id, count(DISTINCT name) AS entities, count(*) AS instances FROM k GROUP BY kb_id")
def graph_delete_document(spark, d):
    gone = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("doc_id"))
    e, i, _ = graph.delete_document((_entities(spark, d), _instances(spark, d), _relations(spark, d)), gone)
    return e.groupBy("kb_id").agg(F.count("*").alias("entities")).join(i.groupBy("kb_id").agg(F.count("*").alias("instances")), "kb_id")


@query(
    "graph_hash",
    f"""WITH {_R}, x AS (SELECT unnest(['A', 'N', 'R']) AS kb_id, 'e|part' || p_partkey AS x FROM part UNION SELECT kb_id, 'r|' || least(source, target) || '|' || greatest(source, target) || '|' || type FROM r),
h AS (SELECT kb_id, sha256(x) AS h FROM x), p AS (SELECT kb_id, h[1:4] AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY ALL) SELECT kb_id, sha256(string_agg(p || h, '' ORDER BY p))[1:16] AS hash FROM p GROUP BY kb_id""",
)
def graph_hash(spark, d):
    return graph.graph_hash(_entities(spark, d), _relations(spark, d))


@query(
    "connected_components",
    """WITH RECURSIVE e AS (SELECT c_custkey AS a, min(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment) AS b FROM customer), x AS (SELECT a, b FROM e WHERE a <> b)
SELECT a AS name, b AS component FROM x UNION SELECT b, b FROM x""",
)
def connected_components(spark, d):
    """Customers of one nation and segment, chained each to the next: a component is as long as the group."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("c_custkey")
    pairs = table(spark, d, "customer").select(F.col("c_custkey").alias("source"), F.lead("c_custkey").over(w).alias("target")).filter("target is not null")
    return graph.connected_components(pairs)


@query("communities")
def communities(spark, d):
    return graph.communities(graph.edges(_relations(spark, d)).withColumn("kb_id", F.lit("all")), "kb_id")


@query("community_relations", f"WITH {_R} SELECT source, target, p_brand AS community, sum(weight) AS weight FROM r JOIN part ON source = 'part' || p_partkey JOIN supplier ON target = 'supp' || s_suppkey WHERE p_brand = 'Brand#' || (s_nationkey % 5 + 1) || (s_suppkey % 5 + 1) GROUP BY ALL")
def community_relations(spark, d):
    parts = table(spark, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_brand").alias("community"))
    brand = F.concat(F.lit("Brand#"), (F.col("s_nationkey") % 5 + 1).cast("string"), (F.col("s_suppkey") % 5 + 1).cast("string"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supp"), F.col("s_suppkey").cast("string")).alias("name"), brand.alias("community"))
    inside = graph.inside_communities(_relations(spark, d), parts.unionByName(suppliers))
    return inside.groupBy("source", "target", "community").agg(F.sum("weight").alias("weight"))


@query("disambig_candidates", "WITH n AS (SELECT DISTINCT p_type AS type, p_name AS name FROM part) SELECT a.type, a.name AS a, b.name AS b FROM n a JOIN n b ON a.type = b.type AND a.name < b.name AND levenshtein(lower(a.name), lower(b.name)) <= 3")
def disambig_candidates(spark, d):
    return graph.candidates(table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name")))


@query("entity_similarity", "SELECT s_suppkey, levenshtein(lower(s_name), lower('Supplier#000000' || s_nationkey)) <= 3 AS alike FROM supplier")
def entity_similarity(spark, d):
    other = F.concat(F.lit("Supplier#000000"), F.col("s_nationkey").cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", text.names_alike(F.col("s_name"), other).alias("alike"))


@query("disambig_resolve")
def disambig_resolve(spark, d):
    names = table(spark, d, "part").select(F.col("p_type").alias("type"), F.col("p_name").alias("name"))
    return graph.resolve(graph.candidates(names))
