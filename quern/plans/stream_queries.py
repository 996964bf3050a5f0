"""Queries over files and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.plans.registry import query
from quern.plans.tables import table
from quern.sources import files
from quern.storage import new_dir
from quern.streaming import ingest_stream, stored


@query("stream_ingest", "SELECT source AS kb_id, min(doc_id) AS doc_id FROM documents GROUP BY source, sha256(text)")
def stream_ingest(spark, d):
    """All documents through the stream, into a table in the shared folder."""
    docs = table(spark, d, "documents")
    root = new_dir(spark, "stream")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 64).parquet(f"{d}/documents.parquet*")
    rows = stream.select(F.col("source").alias("kb_id"), "doc_id", "text")
    ingest_stream(rows, f"{root}/store", f"{root}/checkpoint").awaitTermination()
    return stored(spark, f"{root}/store").select("kb_id", "doc_id")


@query("pages_markdown")
def pages_markdown(spark, d):
    pages = table(spark, d, "pages")
    parsed = files.parse_files(pages.select(F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.encode("html", "UTF-8").alias("content")))
    return parsed.select("path", "content", F.element_at("metadata", "title").alias("title"), "error")


@query("parser_routing", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'parse_markdown' WHEN page_id % 3 = 1 THEN 'parse_docx' END AS parser FROM pages")
def parser_routing(spark, d):
    name = F.concat(F.lit("dir/x."), F.element_at(F.array(F.lit("MD"), F.lit("docx"), F.lit("zzz")), (F.col("page_id") % 3 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", files.routing(name).alias("parser"))


@query("image_markdown", "SELECT page_id, '![p' || page_id || '.png](images/p' || page_id || '.png)' AS content FROM pages")
def image_markdown(spark, d):
    name = F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".png"))
    parsed = files.parse_files(table(spark, d, "pages").select(name.alias("path"), F.encode("url", "UTF-8").alias("content")))
    return parsed.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("page_id"), "content")
