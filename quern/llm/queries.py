"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.session import ship


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import token_counts

    return token_counts.count_tokens(_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > 512)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import bpe

    return bpe_digests(bpe.round_trip(_table(spark, sf_dir, "documents")))


def bpe_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import quality_rules

    found = quality_rules.verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import mixing

    return mixing.plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import minhash

    return minhash.classes(_table(spark, sf_dir, "documents"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import topk

    return topk.search(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


OP4_SQL = """
WITH v AS (SELECT vec_id, [floor(64 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import quality_classifier

    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import warc

    read = warc.read(warc.write(_table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import lm_scoring

    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quern.llm import html_extraction

    return html_extraction.extract(_table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM r
"""

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_round_trip": op2_bpe_round_trip,
    "op3_near_dedup": op3_near_dedup,
    "op4_exact_topk": op4_exact_topk,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_warc": op7_warc,
    "op8_html_extraction": op8_html_extraction,
    "op9_quality_rules": op9_quality_rules,
    "op10_source_mixing": op10_source_mixing,
}
ORACLES: dict[str, str] = {"op4_exact_topk": OP4_SQL, "op7_warc": OP7_SQL}
