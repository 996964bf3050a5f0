"""Queries that index documents: chunking and the pipeline from text to stored chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import clean, text
from quern.operators import chunking
from quern.plans.registry import query
from quern.plans.tables import table


def _chunks(spark, d, strategy):
    return chunking.chunk_documents(table(spark, d, "documents"), chunking.Config(strategy=strategy))


@query("chunk_auto")
def chunk_auto(spark, d):
    return _chunks(spark, d, "auto")


@query("chunk_heading")
def chunk_heading(spark, d):
    return _chunks(spark, d, "heading")


@query("chunk_marker")
def chunk_marker(spark, d):
    return _chunks(spark, d, "marker")


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return _chunks(spark, d, "recursive")


@query("extract_tables")
def extract_tables(spark, d):
    """Each document with a table and an image set before it."""
    return chunking.tables_of(_decorated(spark, d))


@query("split_sections")
def split_sections(spark, d):
    return chunking.sections_of(_decorated(spark, d))


def _decorated(spark, d):
    extra = F.concat(F.lit("# T\nrows:\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n![x](y.png)\n"), "text")
    return table(spark, d, "documents").select("doc_id", extra.alias("text"))


def index_documents(docs, config=None):
    """Chunks with tokens of documents (doc_id, kb_id, text): cleaned, split, passages of under ten characters dropped."""
    cleaned = clean.with_clean_document(docs.select("doc_id", "kb_id", "text"), "text")
    chunks = chunking.chunk_documents(cleaned, config)
    long = F.filter(F.array(clean.clean_passage(F.col("content"))), lambda p: F.char_length(p) >= 10)
    passed = chunks.withColumn("content", F.explode(long))  # a filter would clean each passage once more
    tokens = text.distinct_tokens(F.col("content"))
    return passed.withColumn("content_tokens", tokens).withColumn("chunk_id", F.sha2(F.concat_ws("|", "doc_id", "seq_num", "content"), 256))


@query("index_documents")
def indexed(spark, d):
    docs = table(spark, d, "documents").withColumnRenamed("source", "kb_id")
    return index_documents(docs).select("doc_id", "seq_num", "chunk_id", "token_count", F.size("content_tokens").alias("n_tokens"))
