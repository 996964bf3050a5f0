"""Quality classifier by compression: a text compresses better with a dictionary built from texts of its own kind.

fit() draws at most PER_CLASS labelled rows of each class (smallest hash of the id first; of a text of over SAMPLE_BYTES
it takes PIECES runs of PIECE characters, evenly spread over the whole text), builds one zstandard dictionary from half of the good ones and one from half of the bad ones, and calibrates
the normalised size difference on the other halves by logistic regression, weighted to the classes' true frequencies.
The difference is taken against that of a neutral text of the same length, and normalised by length plus STEADY bytes,
so that a short text, which tells little, has a score near the share of good texts.  The sample goes to one task, as
bytes; the driver gets the dictionaries and the coefficients only.
score() compresses every whole text with both, in runs of RUN bytes so that a text's own repetition cannot stand in for
a dictionary.  Labels, language, source and id are never inputs of a score.

Defined results: null and empty texts have the labelled share of good texts as score; rows whose id's CRC-32 modulo 3
is 1 are never learnt from; a null id isn't held out, and has no label; with fewer than LEAST texts of a class every score
is that share (one half without labels).  Repeated rows repeat; only the columns named are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import shared

#: Bounds of the sample that is learnt from, and the fewest texts of a class that make a dictionary.
PER_CLASS, SAMPLE_BYTES, LEAST = 3000, 32768, 20
PIECES, PIECE = 32, 256
DICTIONARY_BYTES, LEVEL, RUN, STEADY = 1 << 17, 3, 512, 200


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    neutral: float
    prior: float


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


class Sizes:
    """Compressed sizes of a text with either dictionary."""

    def __init__(self, model: Model):
        def compressor(raw: bytes):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.good, self.bad = (compressor(x).compress for x in (model.good, model.bad))

    def evidence(self, text: str | bytes | None) -> tuple[float, float]:
        """(size with the bad dictionary - size with the good one, bytes), both per byte plus STEADY."""
        raw = _raw(text)
        runs = [raw[i : i + RUN] for i in range(0, len(raw), RUN)]
        return sum(len(self.bad(r)) - len(self.good(r)) for r in runs) / (len(raw) + STEADY), len(raw) / (len(raw) + STEADY)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    one = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = one.filter(~held_out("doc_id")).select(F.col("doc_id").alias("_id"), "quality")
    share = {r["quality"]: r["count"] for r in usable.groupBy("quality").count().collect()}
    drawn = [usable.filter(F.col("quality") == q).orderBy(F.xxhash64("_id"), "_id").limit(PER_CLASS) for q in (0, 1)]
    wanted = F.broadcast(drawn[0].unionByName(drawn[1]))  # 2 * PER_CLASS rows at most
    spread = f"array_join(transform(sequence(0, {PIECES - 1}), i -> substring(_text, cast(i * (char_length(_text) / {PIECES}) as int) + 1, {PIECE})), '')"
    texts = docs.select(F.col(id_col).alias("_own"), F.col(text_col).alias("_text")).filter("_text is not null")
    texts = texts.withColumn("_text", F.expr(f"if(octet_length(_text) <= {SAMPLE_BYTES}, _text, {spread})"))
    sample = texts.join(wanted, F.col("_own") == F.col("_id")).groupBy("_id", "quality").agg(F.min("_text").alias("_text")).select("_id", "quality", F.col("_text").cast("binary").alias("_text"))
    prior = math.log((share.get(1, 0) + 1) / (share.get(0, 0) + 1))

    def learn(table: pa.Table) -> pa.Table:
        ids, quality = (table.column(c).to_pylist() for c in ("_id", "quality"))
        order = sorted(range(len(ids)), key=lambda i: str(ids[i]))
        found = _learnt({q: [table.column("_text")[i] for i in order if quality[i] == q] for q in (0, 1)}, share, prior)
        shared.trim()
        return pa.table({"good": pa.array([found.good], pa.binary()), "bad": pa.array([found.bad], pa.binary()), "slope": [found.slope], "neutral": [found.neutral]})

    found = sample.groupBy().applyInArrow(learn, "good binary, bad binary, slope double, neutral double").first()  # 2 * PER_CLASS rows at most
    return Model(bytes(found["good"]), bytes(found["bad"]), found["slope"], found["neutral"], prior) if found else Model(b"", b"", 0.0, 0.0, prior)


def _learnt(sample: dict[int, list[pa.Scalar]], share: dict[int, int], prior: float) -> Model:
    """The model of a sample's texts by class, as binary scalars."""
    if min(map(len, sample.values())) < LEAST:
        return Model(b"", b"", 0.0, 0.0, prior)
    good, bad = (_dictionary(t.as_py() for t in sample[q][::2]) for q in (1, 0))
    if not good or not bad:
        return Model(b"", b"", 0.0, 0.0, prior)
    sizes = Sizes(Model(good, bad, 0.0, 0.0, 0.0))
    x = np.array([sizes.evidence(t.as_py()) for q in (0, 1) for t in sample[q][1::2]])
    y = np.repeat([0.0, 1.0], [len(sample[q][1::2]) for q in (0, 1)])
    w = np.where(y == 1, share[1] / max(1, y.sum()), share[0] / max(1, (1 - y).sum()))
    return Model(good, bad, *_logistic(x, y, w / w.mean(), prior), prior)


def _raw(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


def _dictionary(texts: Iterable[str | bytes]) -> bytes:
    runs = [r[i : i + 2 * RUN] for r in map(_raw, texts) for i in range(0, len(r), 2 * RUN)]
    try:
        return zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, runs)) // 8)), runs).as_bytes()
    except zstandard.ZstdError:  # too little text
        return b""


def _logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, offset: float) -> tuple[float, float]:
    """Two coefficients beside a fixed offset, by Newton's steps with a small ridge."""
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    a, beta, ridge = x / scale, np.zeros(2), np.eye(2) * 1e-2
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ beta + offset, -30, 30)))
        step = np.linalg.solve((a * (w * p * (1 - p))[:, None]).T @ a + ridge, a.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, beta / scale))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """id (or the columns keep), held_out, score, predicted."""
    carried = keep or (id_col,)
    slim = docs.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(carried)), F.col(text_col).alias("_text"))

    def run(batches):
        sizes = Sizes(model) if model.good else None
        for b in batches:
            x = np.array([sizes.evidence(t) if sizes else (0.0, 0.0) for t in b.column(len(carried)).to_pylist()], float).reshape(-1, 2)
            z = np.clip(model.slope * x[:, 0] + model.neutral * x[:, 1] + model.prior, -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-z)))], names=[*b.schema.names[:-1], "score"])
        shared.trim()

    kinds = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    scored = slim.mapInArrow(run, f"{kinds}, score double")
    out = scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(carried)), "score")
    return out.select(*carried, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
