"""Counts of queries' terms in chunks, and the best chunks of each query by them.

The terms of all queries are a caller's, so their number isn't the corpus's: the driver has them, and tasks get them.  A
chunk's text is tokenised once and leaves only how often it has each of these terms; a task scores its chunks against
blocks of queries by products of matrices, and only its k best of each query are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quern.storage import settle

#: Queries that one block holds, and cells of a matrix of chunks and terms.
BLOCK, CELLS = 128, 1 << 21


def asked(queries: DataFrame) -> tuple[list[tuple[object, list[int]]], list[str]]:
    """(query_id, its distinct terms' numbers) of each row of queries (query_id, terms), and the terms by number."""
    number: dict[str, int] = {}
    rows = [(r[0], [number.setdefault(t, len(number)) for t in r[1] if t is not None]) for r in queries.select("query_id", F.array_distinct("terms")).collect() if r[1]]
    return rows, list(number)


def term_counts(chunks: DataFrame, terms: list[str]) -> DataFrame:
    """chunk_id, dl, terms, counts of chunks (chunk_id, tokens): the number of tokens, which of terms are there, how often."""

    def count(batches):
        known = pa.array(terms, pa.string())
        for b in batches:
            ids, tokens = b.columns
            at = tokens.offsets.to_numpy()
            values = pc.index_in(tokens.values.slice(at[0], at[-1] - at[0]), known) if len(b) else pa.array([], pa.int32())
            found = np.flatnonzero(values.is_valid().to_numpy(zero_copy_only=False))
            row = np.searchsorted(at - at[0], found, "right") - 1
            cells, counts = np.unique(row * len(terms) + values.fill_null(0).to_numpy(zero_copy_only=False)[found], return_counts=True)
            ends = pa.array(np.searchsorted(cells, np.arange(len(b) + 1) * len(terms)).astype("int32"))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype("int32"))) for x in (cells % len(terms), counts)]
            yield pa.RecordBatch.from_arrays([ids, pc.list_value_length(tokens).cast(pa.int32()), *lists], names=["chunk_id", "dl", "terms", "counts"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return settle(chunks.select("chunk_id", "tokens").mapInArrow(count, f"chunk_id {kind}, dl int, terms array<int>, counts array<int>"), "term-counts")


def best_chunks(counts: DataFrame, queries: list[tuple[object, dict[int, float]]], k: int, kind: DataType, weigh: Callable, score: Callable) -> DataFrame:
    """query_id, chunk_id, score: each task's k best of each query, ties to the smaller chunk_id.

    queries: (query_id, weights by number of term), ids of type kind; weigh (terms, counts, dl of the chunk of each) gives a number for each
    cell of chunks and terms; score (cells, weights of a block's terms and queries, dl) gives the scores, NaN for no hit.
    """
    queries = [(q, w) for q, w in queries if w]
    names = pa.array([q for q, _ in queries], to_arrow_type(kind))

    def run(batches):
        blocks = []
        for i in range(0, len(queries), BLOCK):
            some = [w for _, w in queries[i : i + BLOCK]]
            columns, at = np.unique([t for w in some for t in w], return_inverse=True)
            blocks.append((columns, at, np.repeat(np.arange(len(some)), [len(w) for w in some]), [v for w in some for v in w.values()], len(some)))
        held = _Best(len(queries), k)
        for b in batches:
            ids, dl, terms, found = b.columns
            at = terms.offsets.to_numpy()
            all_terms, all_counts = (x.values.to_numpy()[at[0] : at[-1]] for x in (terms, found))
            at, dl = at - at[0], dl.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
            cells = weigh(all_terms, all_counts, np.repeat(dl, np.diff(at)))
            row = np.repeat(np.arange(len(b)), np.diff(at))
            for number, (columns, term, query, value, n_queries) in enumerate(blocks):
                weights = np.zeros((len(columns), n_queries))
                weights[term, query] = value
                place = np.minimum(np.searchsorted(columns, all_terms), len(columns) - 1)
                here = columns[place] == all_terms
                step = max(1, CELLS // len(columns))
                for a in range(0, len(b), step):
                    n = min(step, len(b) - a)
                    part = slice(at[a], at[a + n])
                    use = here[part]
                    x = np.zeros((n, len(columns)))
                    x[row[part][use] - a, place[part][use]] = cells[part][use]
                    held.add(number * BLOCK, score(x, weights, dl[a : a + n]), ids, a)
        if held.ids is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(held.query)), held.ids, pa.array(held.score)], names=["query_id", "chunk_id", "score"])

    return counts.mapInArrow(run, f"query_id {kind.simpleString()}, chunk_id {counts.schema['chunk_id'].dataType.simpleString()}, score double")


class _Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.query, self.score, self.ids = np.zeros(0, int), np.zeros(0), None

    def add(self, first: int, scores: np.ndarray, ids: pa.Array, offset: int) -> None:
        """scores: a row for each id from offset on, a column for each query from first on."""
        row, q = np.nonzero(scores >= self.least[None, first : first + scores.shape[1]])  # no NaN
        if not len(row):
            return
        new, self.ids = ids.take(pa.array(row + offset)), ids.slice(0, 0) if self.ids is None else self.ids
        every = pa.concat_arrays([self.ids, new])
        query, score = np.concatenate([self.query, q + first]), np.concatenate([self.score, scores[row, q]])
        place = pc.rank(every, tiebreaker="dense").to_numpy()
        order = np.lexsort((place, -score, query))
        query = query[order]
        begins = np.searchsorted(query, query)
        rank = np.arange(len(query)) - begins
        keep = rank < self.k
        self.query, self.score, self.ids = query[keep], score[order][keep], every.take(pa.array(order[keep]))
        full = rank[keep] == self.k - 1
        self.least[self.query[full]] = self.score[full]


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Half away from zero."""
    y = x * 10.0**digits
    return np.copysign(np.floor(np.abs(y) + 0.5), y) / 10.0**digits
