"""A knowledge base on a shared folder: create, ingest, enrich, search, delete, purge.

Tables are parquet folders, one partition a batch, so an ingestion never rewrites what is there and one that is run again
replaces its own partition.  Deletion is a table of its own that every read takes into account; purging rewrites.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import chunking, enrich, ingest
from quern.plans import search
from quern.plans.index_queries import index_documents
from quern.session import ship
from quern.sources import faq, files

TABLES = {
    "kbs": "kb_id string, name string, tags array<string>",
    "documents": "kb_id string, doc_id string, hash string, text string, source_label string",
    "chunks": "kb_id string, doc_id string, seq_num int, content string, heading_path string, token_count int, chunk_id string, tokens array<string>, keywords array<string>, kind string",
    "vectors": "chunk_id string, doc_id string, embedding array<double>",
    "deleted": "doc_id string, kb_id string",
}


class KnowledgeBase:
    def __init__(self, spark: SparkSession, root: str, embedder=None):
        self.spark, self.root, self.embedder = ship(spark), root.rstrip("/"), embedder

    def table(self, name: str) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).option("recursiveFileLookup", True).parquet(f"{self.root}/{name}")

    def _append(self, name: str, rows: DataFrame, batch: str) -> None:
        columns = [c.split()[0] for c in TABLES[name].split(", ")]
        rows.select(*columns).write.mode("overwrite").parquet(f"{self.root}/{name}/batch={batch}")

    def create(self, kb_id: str, name: str, tags: list[str] | None = None) -> None:
        self._append("kbs", self.spark.createDataFrame([(kb_id, name, tags or [])], TABLES["kbs"]), kb_id)

    def kbs(self) -> DataFrame:
        gone = self.table("deleted").filter("doc_id is null").select("kb_id")
        return self.table("kbs").join(gone, "kb_id", "left_anti")

    def documents(self) -> DataFrame:
        """Documents with the flag deleted, their own or their knowledge base's."""
        gone = self.table("deleted")
        docs = ingest.mark_deleted(self.table("documents").withColumn("deleted", F.lit(False)), gone.filter("doc_id is not null"), "doc_id")
        return ingest.mark_deleted(docs, gone.filter("doc_id is null"), "kb_id")

    def ingest(self, rows: DataFrame, batch: str, config: chunking.Config | None = None) -> DataFrame:
        """Rows (kb_id, doc_id, text): known knowledge bases only, each text once; gives every row's status."""
        good, bad = ingest.in_known_kb(rows.withColumn("doc_id", F.col("doc_id").cast("string")), self.kbs().withColumn("deleted", F.lit(False)))
        judged = ingest.deduplicate(good, self.documents())
        self._append("documents", judged.filter("status = 'new'").withColumn("source_label", F.lit(batch)), batch)
        new = self.spark.read.schema(TABLES["documents"]).parquet(f"{self.root}/documents/batch={batch}")
        tags = self.table("kbs").select("kb_id", "tags")
        chunks = index_documents(new, config).join(new.select("doc_id", "kb_id"), "doc_id").withColumn("tokens", text.content_tokens(F.col("content")))
        tagged = chunks.join(tags, "kb_id", "left").withColumn("keywords", enrich.merge_keywords(enrich.matching_tags(F.col("content"), F.coalesce("tags", F.array().cast("array<string>")))))
        self._append("chunks", tagged.withColumn("kind", F.lit("text")), batch)
        self.embed(batch)
        return judged.select("kb_id", "doc_id", "status", "duplicate_of").unionByName(bad.select("kb_id", "doc_id", F.lit("no such knowledge base").alias("status"), F.lit(None).cast("string").alias("duplicate_of")))

    def ingest_files(self, kb_id: str, path: str, batch: str, config: chunking.Config | None = None) -> DataFrame:
        parsed = files.read_files(self.spark, path).filter("error is null")
        rows = parsed.select(F.lit(kb_id).alias("kb_id"), F.sha2(F.concat_ws("|", F.lit(kb_id), "path"), 256).alias("doc_id"), F.col("content").alias("text"))
        return self.ingest(rows, batch, config)

    def ingest_faq(self, kb_id: str, entries: DataFrame, batch: str, replace: bool = False) -> None:
        """One chunk an entry without a problem; replace deletes the question-and-answer documents that are there."""
        if replace:
            old = self.table("chunks").filter((F.col("kb_id") == kb_id) & (F.col("kind") == "faq")).select("doc_id").distinct()
            self.delete(old, f"faq-{batch}")
        good = entries.filter("problem is null").withColumn("content", faq.content(F.col("standard_question"), F.col("answers")))
        rows = good.select(F.lit(kb_id).alias("kb_id"), F.sha2(F.concat_ws("|", F.lit(batch), "standard_question"), 256).alias("doc_id"), "content")
        docs = rows.select("kb_id", "doc_id", F.sha2("content", 256).alias("hash"), F.col("content").alias("text"), F.lit("faq").alias("source_label"))
        self._append("documents", docs, batch)
        chunks = rows.withColumn("seq_num", F.lit(0)).withColumn("heading_path", F.lit("")).withColumn("token_count", text.count_tokens(F.col("content")).cast("int"))
        self._append("chunks", chunks.withColumn("chunk_id", F.col("doc_id")).withColumn("tokens", text.content_tokens(F.col("content"))).withColumn("keywords", F.array().cast("array<string>")).withColumn("kind", F.lit("faq")), batch)
        self.embed(batch)

    def embed(self, batch: str) -> None:
        """Vectors of a batch's chunks, made again from the stored chunks."""
        chunks = self.spark.read.schema(TABLES["chunks"]).parquet(f"{self.root}/chunks/batch={batch}")
        made = enrich.embed(chunks.select("chunk_id", "content"), self.embedder).select("chunk_id", "embedding") if self.embedder else enrich.hashed_vectors(chunks.select("chunk_id", "tokens"))
        self._append("vectors", made.join(chunks.select("chunk_id", "doc_id"), "chunk_id"), batch)

    def search(self, queries: DataFrame, config: search.SearchConfig | None = None) -> DataFrame:
        """Results of queries (query_id, query and, optionally, embedding), over all live documents."""
        store = search.Store(self.table("chunks"), self.documents().select("doc_id", "deleted"), self.table("vectors").select("chunk_id", "embedding"))
        if "embedding" not in queries.columns and not self.embedder:
            tokens = queries.select(F.col("query_id").alias("chunk_id"), text.content_tokens(F.col("query")).alias("tokens"))
            queries = queries.join(enrich.hashed_vectors(tokens).withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
        return search.search(store, queries, config)

    def delete(self, documents: DataFrame, batch: str) -> None:
        self._append("deleted", documents.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("kb_id")), batch)

    def delete_kb(self, kb_id: str) -> None:
        self._append("deleted", self.spark.createDataFrame([(None, kb_id)], TABLES["deleted"]), f"kb-{kb_id}")

    def purge(self, to: str) -> KnowledgeBase:
        """A copy at another folder without the rows of deleted documents."""
        gone = self.documents().filter("deleted").select("doc_id")
        out = KnowledgeBase(self.spark, to, self.embedder)
        kept = ingest.purge({name: self.table(name) for name in ("documents", "chunks", "vectors")}, gone)
        for name, rows in {**kept, "kbs": self.kbs()}.items():
            out._append(name, rows, "purged")
        return out
