"""Mixing sources to target weights by apportionment of equal-token blocks.

Each source has a target of words.  The words of all targets make a number of blocks of BLOCK_WORDS words, apportioned
among sources by highest quotients (w / (2k + 1)); a source's blocks are apportioned the same way among its shards (a
hash of the id deals about SHARD_DOCS documents to each, so a source that holds most rows is many shards).  In a shard,
documents lie end to end in seeded order; its quota takes every block quota // blocks times, and quota % blocks of them,
chosen by a seeded permutation, once more.  What a document gives follows from the blocks it touches, so the mix is
arithmetic on positions, and the same on every run.  Rows without an id are dealt by their text.

What reaches the driver is one row a source.

Defined results: a null text has size 0; rows that share an id lie by size and text; a null source is a source of its own, last in order; repeated rows are rows of
their own and take positions next to each other; empty sources have target 0; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import shared

BLOCK_WORDS, SHARD_DOCS, SEED = 32, 4096, 20240229
#: Weights of sources in order, repeating; what is shared, and the most of a source, as parts of sizes.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
#: Sources whose table of targets may be broadcast.
FEW_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"


def sainte_lague(weights: list[float], seats: int, caps: list[int]) -> list[int]:
    """Seats by highest quotients weight / (2 * held + 1), ties to the earlier; none over its cap."""
    seats = min(seats, sum(c for w, c in zip(weights, caps, strict=True) if w > 0))
    total = sum(weights)
    held = [min(c, math.floor(w * seats / total + 0.5)) if total > 0 else 0 for w, c in zip(weights, caps, strict=True)]
    n = sum(held)
    if n > seats:
        low = [(w / (2 * h - 1), -i) for i, (w, h) in enumerate(zip(weights, held, strict=True)) if h]
        heapq.heapify(low)
        while n > seats:
            i = -heapq.heappop(low)[1]
            held[i] -= 1
            n -= 1
            if held[i]:
                heapq.heappush(low, (weights[i] / (2 * held[i] - 1), -i))
    high = [(-w / (2 * h + 1), i) for i, (w, h, c) in enumerate(zip(weights, held, caps, strict=True)) if w > 0 and h < c]
    heapq.heapify(high)
    while n < seats and high:
        i = heapq.heappop(high)[1]
        held[i] += 1
        n += 1
        if held[i] < caps[i]:
            heapq.heappush(high, (-weights[i] / (2 * held[i] + 1), i))
    return held


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source: share * all by weight, none over most * its size, the excess shared again."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = {i: weights[i % len(weights)] for i in range(len(sizes))}
    while free:
        whole = sum(free.values())
        over = [i for i, w in free.items() if left * w / whole > most * sizes[i]]
        if not over:
            for i, w in free.items():
                out[i] = left * w / whole
            break
        for i in over:
            out[i] = float(most * sizes[i])
            del free[i]
        left -= sum(out[i] for i in over)
    return out


def plan(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """id, size, source_size, target, taken of every row, with the columns keep; _base and _picked tell which blocks."""
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), F.col(text_col).alias("_text"), *(F.col(c).alias(f"_keep_{c}") for c in keep))
    sized = slim.withColumn("_size", F.coalesce(F.regexp_count("_text", F.lit(WORD)), F.lit(0)).cast("long")).withColumn("_tie", F.xxhash64("_text"))
    keyed = sized.withColumn("_key", F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n")))
    if not keep:  # words are counted once; with columns to keep, texts would have to be written, too
        keyed = shared.settle(keyed.drop("_text"), "mixing-sizes")
    found = keyed.groupBy("_source", "_key").agg(F.sum("_size").alias("size"), F.count("*").alias("n")).collect()  # a row a source
    found.sort(key=lambda r: (r["_source"] is None, r["_source"] or ""))
    wanted = targets([r["size"] for r in found])
    blocks = sainte_lague(wanted, round(sum(wanted) / BLOCK_WORDS), [2 * math.ceil(r["size"] / BLOCK_WORDS) for r in found])
    per_source = spark.createDataFrame(
        [(r["_key"], r["size"], t, q, max(1, math.ceil(r["n"] / SHARD_DOCS))) for r, t, q in zip(found, wanted, blocks, strict=True)],
        "_key string, _source_size long, _target double, _quota long, _shards int",
    )
    if len(found) <= FEW_SOURCES:  # else a shuffle, in which no source can be large
        per_source = F.broadcast(per_source)
    dealt = keyed.join(per_source, "_key").withColumn("_shard", F.expr(f"cast(pmod(if(_id is null, xxhash64({seed}, _tie), xxhash64({seed}, _id)), _shards) as int)"))

    def apportion(shards: pd.DataFrame) -> pd.DataFrame:
        shards = shards.sort_values("_shard").reset_index(drop=True)
        n = [math.ceil(w / BLOCK_WORDS) for w in shards["words"]]
        quota = sainte_lague(shards["words"].tolist(), int(shards["_quota"].iloc[0]), [2 * x for x in n])
        step = []
        for s, x in zip(shards["_shard"], n, strict=True):
            a = (seed * 2654435761 + int(s) * 40503) % max(x, 1)
            while math.gcd(a, max(x, 1)) != 1:
                a += 1
            step.append(a)
        return pd.DataFrame({"_key": shards["_key"], "_shard": shards["_shard"], "_blocks": [max(1, x) for x in n], "_seats": quota, "_step": step})

    per_shard = dealt.groupBy("_key", "_shard", "_quota").agg(F.sum("_size").alias("words")).groupBy("_key").applyInPandas(apportion, "_key string, _shard int, _blocks long, _seats long, _step long")
    order = Window.partitionBy("_key", "_shard").orderBy(F.expr(f"xxhash64(_id, {seed})"), "_id", "_size", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = dealt.join(per_shard, ["_key", "_shard"]).withColumn("_start", F.sum("_size").over(order) - F.col("_size"))
    last = f"greatest(_start + _size - 1, _start) div {BLOCK_WORDS}L"
    picked = f"pmod(b * _step + {seed}L, _blocks) < _seats % _blocks"
    inside = f"greatest(0L, least(_start + _size, (b + 1) * {BLOCK_WORDS}L) - greatest(_start, b * {BLOCK_WORDS}L))"
    extra = f"aggregate(sequence(_start div {BLOCK_WORDS}L, {last}), 0L, (t, b) -> t + if({picked}, {inside}, 0L))"
    return (
        placed.withColumn("_base", F.expr("_seats div _blocks"))
        .withColumn("_extra", F.expr(f"if(_size = 0, 0L, {extra})"))
        .select(
            F.col("_id").alias(id_col),
            F.col("_size").alias("size"),
            F.col("_source_size").alias("source_size"),
            F.col("_target").alias("target"),
            (F.col("_base") * F.col("_size") + F.col("_extra")).alias("taken"),
            "_base",
            "_extra",
            "_start",
            "_blocks",
            "_seats",
            "_step",
            *(f"_keep_{c}" for c in keep),
        )
    )


def mixed_texts(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text", n_chars_col: str = "n_chars", seed: int = SEED) -> DataFrame:
    """The mix itself: a document as often as it is taken whole, and once more with the words of its picked blocks."""
    planned = plan(docs, keep=keep, seed=seed).filter("taken > 0")
    text = f"_keep_{text_col}"
    words = f"filter(split({text}, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"
    cut = f"array_join(filter({words}, (w, i) -> pmod(((_start + i) div {BLOCK_WORDS}L) * _step + {seed}L, _blocks) < _seats % _blocks), ' ')"
    texts = F.expr(f"concat(array_repeat({text}, cast(_base as int)), if(_extra = 0, array(), array(if(_extra = size, {text}, {cut}))))")
    out = planned.withColumn("_mixed", F.explode(texts))
    return out.select(*(F.col("_mixed").alias(c) if c == text_col else F.char_length("_mixed").cast(docs.schema[c].dataType).alias(c) if c == n_chars_col else F.col(f"_keep_{c}").alias(c) for c in keep))
