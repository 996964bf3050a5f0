"""Ingestion into a knowledge base and the life of its rows: duplicates, status, updates, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def deduplicate(incoming: DataFrame, stored: DataFrame | None = None, text: str = "text") -> DataFrame:
    """incoming (kb_id, doc_id, text, ...) with hash, status ('new' or 'duplicate') and duplicate_of.

    A row repeats the first one of its (kb_id, hash): one of stored that isn't deleted, or the smallest doc_id that came in.
    Only ids and hashes meet, not texts.
    """
    hashed = incoming.withColumn("hash", F.sha2(text, 256))
    first = hashed.groupBy("kb_id", "hash").agg(F.min("doc_id").alias("_first"))
    if stored is not None:
        live = stored.filter("not deleted").groupBy("kb_id", "hash").agg(F.min("doc_id").alias("_live"))
        first = first.join(live, ["kb_id", "hash"], "left").withColumn("_first", F.coalesce("_live", "_first")).drop("_live")
    of = hashed.join(first, ["kb_id", "hash"]).withColumn("duplicate_of", F.when(F.col("doc_id") != F.col("_first"), F.col("_first")))
    return of.withColumn("status", F.when(F.col("duplicate_of").isNull(), "new").otherwise("duplicate")).drop("_first")


def in_known_kb(rows: DataFrame, kbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows whose knowledge base exists and isn't deleted, and the others."""
    live = kbs.filter("not deleted").select("kb_id").distinct()
    return rows.join(live, "kb_id", "left_semi"), rows.join(live, "kb_id", "left_anti")


def mark_deleted(rows: DataFrame, gone: DataFrame, on: str) -> DataFrame:
    """rows flagged as deleted where on is among gone; flags already set stay."""
    flags = gone.select(on).distinct().withColumn("_gone", F.lit(True))
    return rows.join(flags, on, "left").withColumn("deleted", F.coalesce("deleted", F.lit(False)) | F.coalesce("_gone", F.lit(False))).drop("_gone")


def purge(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """Every table without rows of the documents gone."""
    return {name: t.join(gone.select("doc_id").distinct(), "doc_id", "left_anti") for name, t in tables.items()}


def latest(log: DataFrame, key: str, at: str, *values: str) -> DataFrame:
    """The last row of each key in an append-only log, without a sort of the log."""
    last = F.max_by(F.struct(*values), F.struct(at, *values))
    return log.groupBy(key).agg(F.max(at).alias(at), last.alias("_v")).select(key, at, *(F.col(f"_v.{v}").alias(v) for v in values))


def stale(log: DataFrame, key: str, at: str, now: Column, seconds: int = 300) -> DataFrame:
    """Keys whose last entry is older than that many seconds."""
    return log.groupBy(key).agg(F.max(at).alias(at)).filter(F.col(at) < now - F.make_interval(secs=F.lit(seconds)))


def update_by_key(rows: DataFrame, new: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with columns replaced where new has a value for the key."""
    fresh = new.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(fresh, key, "left")
    return out.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of either side by key, the new ones winning; version counts what a key has seen."""
    values = [c for c in rows.columns if c not in (key, "version")]
    fresh = new.select(key, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_new"))
    both = rows.join(fresh, key, "full_outer")
    version = F.coalesce("version", F.lit(0)) + F.coalesce(F.col("_new").cast("int"), F.lit(0))
    return both.select(key, *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values), version.alias("version"))


def merge_checkpoint(stored: Column, new: Column) -> Column:
    """A JSON object of strings with the new one's entries over it."""
    parse = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))
    fresh = parse(new)
    kept = F.map_filter(parse(stored), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.map_concat(kept, fresh)))))


def without_checkpoint(stored: Column, *names: str) -> Column:
    return F.to_json(F.map_filter(F.from_json(stored, "map<string,string>"), lambda k, v: ~k.isin(*names)))


def parent_chunks(chunks: DataFrame) -> DataFrame:
    """doc_id, seq_num, content, tokens, children: a parent for each two consecutive chunks of a document."""
    w = Window.partitionBy("doc_id").orderBy("seq_num")
    paired = chunks.withColumn("_p", F.floor((F.row_number().over(w) - 1) / 2).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("seq_num", "content")))
    joined = paired.groupBy("doc_id", "_p").agg(parts.alias("parts"), F.sum("tokens").alias("tokens"))
    n = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("_n"))
    out = joined.join(n, "doc_id")
    return out.select("doc_id", (F.col("_n") + F.col("_p")).alias("seq_num"), F.array_join(F.transform("parts", lambda p: p["content"]), "\n\n").alias("content"), "tokens", F.size("parts").alias("children"))
