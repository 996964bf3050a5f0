"""Exact top-k search by histogram selection.

Vectors become integers (floor(SCALE * x)) and are packed into blocks of rows.  Candidates' blocks stay where they lie;
in each pass a task scores the HELD blocks that it has read against all query blocks, which it reads one after another
from the shared folder, and adds up, for each query, a histogram of the scores in the interval where its k-th best must
lie; the interval starts as the Cauchy-Schwarz bound and shrinks to one bin of BINS a pass, until a bin is one value.  The
last pass keeps scores above that value, and of those equal to it the smallest ids.  Every score is computed in each pass
and none is guessed, so the result is exact.

Neither scores nor vectors are shuffled, only histograms (one a query block and HELD blocks, added up as they arrive) and
results.  Between passes the query blocks are written with what is known of their intervals.  A vector that many rows
share weighs no more than others.

Defined results: rows with a null id, and vectors null, empty or holding null or non-finite components, take no part;
rows that repeat an id count once, with the smallest vector; shorter vectors count as padded with zeros; with fewer than
k others all are returned; equal scores rank by smaller id; scores beyond 64 bits are not defined.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quern.llm import shared

SCALE, BINS = 64, 256
QUERY_ROWS, CANDIDATE_ROWS, HELD = 512, 4096, 8
BLOCK = "block int, ids binary, vectors binary, dim int, norm double"


def _pack(table: pa.Table) -> pa.Table:
    ids = table.column("_id").to_numpy()
    rows = table.column("_vector").to_pylist()
    dim = max(map(len, rows))
    m = np.zeros((len(rows), dim), np.int64)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    order = np.argsort(ids)
    norm = math.sqrt(float((m.astype(float) ** 2).sum(axis=1).max()))
    return pa.table({"block": pa.array([table.column("_block")[0].as_py()], pa.int32()), "ids": [shared.pack(ids[order].astype(np.int64))], "vectors": [shared.pack(m[order])], "dim": pa.array([dim], pa.int32()), "norm": [norm]})


def _blocks(rows: DataFrame, n: int, size: int) -> DataFrame:
    blocks = math.ceil(n / size)
    files = max(math.ceil(blocks / HELD), min(blocks, shared.partitions(rows.sparkSession)))  # as many tasks can read them
    return rows.withColumn("_block", F.expr(f"cast(pmod(xxhash64(_id), {blocks}) as int)")).repartition(files, "_block").groupBy("_block").applyInArrow(_pack, BLOCK)


class Block:
    """A block of candidates, or one of queries with the starts of their intervals and the scores above them."""

    def __init__(self, row: dict):
        self.number, self.norm, self.dim = row["block"], row["norm"], row["dim"]
        self.ids = shared.unpack(row["ids"], np.int64)
        self.vectors = shared.unpack(row["vectors"], np.int64).reshape(-1, self.dim)
        self.low, self.above = shared.unpack(row["state"], np.int64).reshape(2, -1) if row.get("state") else (None, None)
        self.most = max(1, int(np.abs(self.vectors).max()))


def _scores(q: Block, c: Block) -> np.ndarray:
    """The scores of two blocks; -inf or the least integer for a query's own row."""
    dim = max(q.dim, c.dim)
    a, b = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) if m.shape[1] < dim else m for m in (q.vectors, c.vectors))
    bound = q.norm * c.norm
    kind = np.float32 if bound < 1 << 23 and dim * q.most * c.most < 1 << 24 else np.float64 if bound < 1 << 52 else np.int64
    s = a.astype(kind) @ b.astype(kind).T
    at = np.searchsorted(c.ids, q.ids)
    own = (at < len(c.ids)) & (c.ids[np.minimum(at, len(c.ids) - 1)] == q.ids)
    s[np.flatnonzero(own), at[own]] = -np.inf if kind != np.int64 else np.iinfo(np.int64).min
    return s


def _read(files: list[str]) -> Iterator[Block]:
    for name in files:
        store, path = fs.FileSystem.from_uri(name)
        with store.open_input_file(path) as f:
            table = pq.ParquetFile(f)
            for k in range(table.num_row_groups):
                for row in table.read_row_group(k).to_pylist():
                    yield Block(row)


def _meet(batches: Iterator[pa.RecordBatch], files: list[str]) -> Iterator[tuple[Block, list[Block]]]:
    """Each query block with HELD of the task's candidate blocks after another."""
    rows = (Block(row) for b in batches for i in range(b.num_rows) for row in b.slice(i, 1).to_pylist())
    while held := list(itertools.islice(rows, HELD)):
        for q in _read(files):
            yield q, held


def search(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best others of every query row."""
    spark = vectors.sparkSession
    clean = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    usable = vectors.filter(clean).select(F.col(id_col).cast("long").alias("_id"), whole.alias("_vector"), is_query.alias("_query"))
    rows = shared.settle(usable.groupBy("_id").agg(F.min("_vector").alias("_vector"), F.max("_query").alias("_query")), "topk-rows")
    n, n_queries = (rows.count(), rows.filter("_query").count())
    k = min(k, n - 1)
    if k < 1 or not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = shared.settle(_blocks(rows.filter("_query"), n_queries, QUERY_ROWS), "topk-queries")
    others = shared.settle(_blocks(rows, n, CANDIDATE_ROWS), "topk-candidates")
    bound = math.floor(queries.agg(F.max("norm")).first()[0] * others.agg(F.max("norm")).first()[0]) + 1
    span = 2 * bound + 1
    width = (span + BINS - 1) // BINS
    while True:
        state = shared.settle(_refine(others, queries, -bound, width, span, k), "topk-state")
        old, queries = queries, shared.settle(queries.drop("state").join(state, "block"), "topk-queries")
        shared.drop_table(old)
        shared.drop_table(state)
        if width == 1:
            break
        span, width = width, (width + BINS - 1) // BINS
    best = _keep(others, queries, k)
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _refine(others: DataFrame, queries: DataFrame, start: int, width: int, span: int, k: int) -> DataFrame:
    """The next state: the bin (of width) of each query's interval (of span) that holds its k-th best, and scores above."""
    files = queries.inputFiles()

    def histograms(batches):
        for q, held in _meet(batches, files):
            low = np.full(len(q.ids), start) if q.low is None else q.low
            got = np.zeros((len(q.ids), BINS), np.int64)
            for c in held:
                s = _scores(q, c)
                for i in range(0, len(low), 64):
                    x = s[i : i + 64] - low[i : i + 64, None].astype(s.dtype)
                    r, j = np.nonzero((x >= 0) & (x < span))
                    bins = (x[r, j] // width).astype(np.int64)
                    got[i : i + 64] += np.bincount(r * BINS + bins, minlength=len(x) * BINS).reshape(-1, BINS)
            old = shared.pack(np.stack([low, np.zeros_like(low) if q.above is None else q.above]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([q.number], pa.int32()), pa.array([shared.pack_counts(got.ravel())], pa.binary()), pa.array([old], pa.binary())], names=["block", "counts", "old"])

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number, old = None, None, None
        for b in batches:
            for row in b.to_pylist():
                counts = shared.unpack_counts(row["counts"]).reshape(-1, BINS)
                total, number, old = counts if total is None else total + counts, row["block"], row["old"]
        n = len(total)
        low, above = shared.unpack(old, np.int64).reshape(2, n)
        from_top = np.cumsum(total[:, ::-1], axis=1) + above[:, None]
        at = np.argmax(from_top >= k, axis=1)
        over = np.where(at > 0, from_top[np.arange(n), np.maximum(at - 1, 0)], above)
        state = np.stack([low + (BINS - 1 - at) * width, over]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([shared.pack(state)], pa.binary())], names=["block", "state"])

    return others.mapInArrow(histograms, "block int, counts binary, old binary").groupBy("block").applyInArrow(locate, "block int, state binary")


def _keep(others: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Scores above each query's k-th best, and for those equal to it the smallest ids that are needed."""
    files = queries.inputFiles()

    def run(batches):
        for q, held in _meet(batches, files):
            for c in held:
                s = _scores(q, c)
                r, j = np.nonzero(s >= q.low[:, None].astype(s.dtype))
                score = s[r, j].astype(np.int64)
                tie = score == q.low[r]
                nth = np.cumsum(tie) - np.concatenate([[0], np.cumsum(np.bincount(r[tie], minlength=len(q.ids)))])[r]  # candidates lie by id
                use = ~tie | (nth <= (k - q.above)[r])
                yield pa.RecordBatch.from_arrays([pa.array(q.ids[r[use]]), pa.array(c.ids[j[use]]), pa.array(score[use])], names=["query_id", "vec_id", "score"])

    return others.mapInArrow(run, "query_id long, vec_id long, score long")
