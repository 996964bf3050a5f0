"""How the driver's tables stand for those of a knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def kb_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, kb_id, text, lang, deleted: a source is a knowledge base, toxic documents are the deleted ones."""
    gone = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("deleted"))
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "kb_id")
    return docs.join(gone, "doc_id", "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)))


#: The same as SQL, for oracles to build on.
KB_SQL = "kb AS (SELECT d.doc_id, d.source AS kb_id, d.text, d.lang, d.n_chars, coalesce(g.deleted, false) AS deleted FROM documents d LEFT JOIN (SELECT doc_id, bool_or(toxic = 1) AS deleted FROM labels GROUP BY doc_id) g USING (doc_id))"


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, kb_id, seq_num, content: the non-blank lines of each document as its chunks."""
    split = docs.select("doc_id", "kb_id", F.posexplode(F.split("text", "\n")).alias("seq_num", "content"))
    return split.filter(F.col("content").rlike(r"[^\s]"))


LINES_SQL = "ch AS (SELECT doc_id, kb_id, CAST(i - 1 AS INTEGER) AS seq_num, parts[i] AS content FROM (SELECT doc_id, kb_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, kb_id, string_split(text, chr(10)) AS parts FROM kb)) WHERE regexp_matches(parts[i], '\\S'))"
