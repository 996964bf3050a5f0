"""Structured Streaming counterparts of the batch plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators import ingest


def ingest_stream(source: DataFrame, store: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows (kb_id, doc_id, text) of a stream into the table at store, each text once a knowledge base.

    Duplicates are found against what is stored and live, so a text comes in again after its document was deleted; there
    is no state that outlives a batch.  A batch that is run again replaces its own partition.
    """
    spark = source.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        held = stored(spark, store)
        if held is not None:
            held = held.filter(F.col("batch") != number)
        new = ingest.deduplicate(batch, held).filter("status = 'new'")
        rows = new.select("kb_id", "doc_id", "hash", "text", F.lit(False).alias("deleted"))
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")

    trigger = {"availableNow": True} if once else {"processingTime": "30 seconds"}
    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    """The table that ingest_stream writes, or None before its first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema("kb_id string, doc_id long, hash string, text string, deleted boolean, batch int").parquet(store)
