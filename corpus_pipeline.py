"""A corpus pipeline of five stages over documents; each works on all rows that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import shared
from quern.session import ship

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the rules or the likelihood ratio reject."""
    from quern.llm import quality_rules

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.verdicts(docs, labels, keep=COLUMNS).filter("kept").select(*COLUMNS)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the compression classifier takes for bad ones."""
    from quern.llm import quality_classifier

    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality_classifier.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)  # all labelled rows, as the rules before have taken bad ones
    return quality_classifier.score(docs, model, keep=COLUMNS).filter("predicted = 1").select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of smallest id of each class of near copies."""
    from quern.llm import minhash

    ship(spark)
    found = shared.settle(minhash.classes(docs), "classes")
    kept = found.filter("is_representative").select(F.col("doc_id").alias("_id"), F.col("text_md5").alias("_md5")).distinct()
    text = F.coalesce(F.col("text"), F.lit(""))
    left = docs.select(*COLUMNS).join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.md5(text) == F.col("_md5")), "left_semi")
    repeated = found.groupBy("doc_id", "text_md5").count().filter("count > 1")
    return left if repeated.isEmpty() else left.dropDuplicates(["doc_id", "text"])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat, cut or drop documents so that each source has its target of words."""
    from quern.llm import mixing

    ship(spark)
    return mixing.mixed_texts(docs, keep=COLUMNS).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of what they decode to."""
    from quern.llm import bpe
    from quern.llm.queries import bpe_digests

    ship(spark)
    return bpe_digests(bpe.round_trip(docs))


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("minhash_near_dedup", near_dedup_stage),
    ("source_mixing", mixing_stage),
    ("bpe_round_trip", bpe_stage),
]

#: SQL cannot express the compression classifier, the sampled signatures or the merges; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = shared.settle(docs, name)
    return docs
