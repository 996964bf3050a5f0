"""Token counts of whole texts, without token ids.

Texts are split into pre-tokens, and each block of texts (BLOCK bytes of one task) becomes postings: for a distinct
pre-token, the documents of the block that hold it and how often.  Postings are dealt by a hash of the pre-token, so
each distinct pre-token is encoded once where it lands, and frequency times count is summed per document.  Pre-tokens
that a good part of a block's documents hold are dealt by pre-token and block, so no task gathers a common one.  Blocks
hold a bounded number of bytes and every dealt row belongs to one block and slot, so no row and no group grows with a
word's frequency.

Input must be a scan or a settled table, whose rows come in the same order when a lost task runs again: blocks are named
by their place in it.

Defined results: a null text counts as empty and has 0 bytes and 0 tokens; repeated rows give repeated rows; only the
id and text columns are read, so other columns can have any name.  With a vocabulary that isn't byte-level BPE (or a
sentencepiece model) the whole text is the pre-token.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import bpe, shared

#: UTF-8 bytes of text in one block.
BLOCK = 8 << 20
#: A pre-token in this part of a block's documents counts as common.
COMMON = 1 / 16
#: Pre-tokens whose counts one task remembers, and document sums that it holds back.
REMEMBERED, HELD = 1_000_000, 2_000_000


class Splitter:
    """Pre-tokens of a text and tokens of a pre-token, for one vocabulary file."""

    def __init__(self, path: str):
        self.codec = self.model = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.codec = bpe.codec(path)
        self.find = regex.compile(bpe.PATTERN).findall

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens, and the number of special tokens beside them."""
        if not text:
            return [], 0
        if not self.codec or not self.codec.byte_level:
            return [text], 0
        cut = self.codec.cut
        if cut and cut.search(text):
            parts = cut.split(text)
            return [p for part in parts for p in self._plain(part)], len(parts) - 1
        return self._plain(text), 0

    def _plain(self, text: str) -> list[str]:
        return self.codec.pieces(text) if not text.isascii() and bpe.UNSURE.search(text) else self.find(text)

    def count(self, piece: bytes) -> int:
        if self.model:
            return len(self.model.encode(piece.decode("utf-8")))
        if self.codec.byte_level:
            return len(self.codec.encode_unsplit(piece))
        return len(self.codec.library.encode(piece.decode("utf-8"), add_special_tokens=False).ids)


@lru_cache(maxsize=4)
def splitter(path: str) -> Splitter:
    return Splitter(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK) -> DataFrame:
    """(id, n_bytes long, n_tokens long) of every row."""
    path = vocabulary or bpe.default_vocabulary()
    spark = docs.sparkSession
    slim = docs.select(F.col(id_col), F.col(text_col))
    kind, n = slim.schema[0].dataType.simpleString(), shared.partitions(spark)
    ids_type = f"array<{kind}>"

    def postings(batches):
        schema, part = None, TaskContext.get().partitionId()
        ids, texts, size, k = [], [], 0, 0
        for b in batches:
            if schema is None:
                schema = pa.schema([("slot", pa.int32()), ("block", pa.string()), ("pieces", pa.binary()), ("ids", pa.list_(b.schema.field(0).type)), ("n_bytes", pa.list_(pa.int64())), ("extra", pa.list_(pa.int64()))])
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or "")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield from _block(splitter(path), schema, f"{part}-{k}", ids, texts, 2 * n)
                    ids, texts, size, k = [], [], 0, k + 1
        if ids:
            yield from _block(splitter(path), schema, f"{part}-{k}", ids, texts, 2 * n)

    def sums(batches):
        known: dict[bytes, int] = {}
        held: dict[str, np.ndarray] = {}
        n_held = 0
        split = splitter(path)
        for b in batches:
            passed = b.filter(b.column("ids").is_valid())
            if passed.num_rows:
                yield pa.RecordBatch.from_arrays([passed.column("block"), pa.nulls(passed.num_rows, pa.binary()), *(passed.column(c) for c in ("ids", "n_bytes", "extra"))], names=OUT)
            for block, payload in zip(b.column("block").to_pylist(), b.column("pieces").to_pylist(), strict=True):
                if payload is None:
                    continue
                n_docs, words, df, at, freq = _open(payload)
                if len(known) > REMEMBERED:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = split.count(w)
                each = np.repeat(np.fromiter((known[w] for w in words), np.int64, len(words)), df)
                got = np.bincount(at, weights=each * freq, minlength=n_docs)
                if block in held:
                    held[block] += got
                else:
                    held[block] = got
                    n_held += n_docs
                if n_held > HELD:
                    yield _sums(held, b)
                    held, n_held = {}, 0
            last = b
        if held:
            yield _sums(held, last)

    def per_document(table):
        whole = table.filter(table.column("ids").is_valid())
        total = np.asarray(whole.column("extra").combine_chunks().flatten())[:]
        total = total.astype(np.int64)
        for payload in table.column("sums").to_pylist():
            if payload is not None:
                total += shared.unpack_counts(payload)
        flat = [whole.column(c).combine_chunks().flatten() for c in ("ids", "n_bytes")]
        return pa.table([*flat, pa.array(total)], names=[id_col, "n_bytes", "n_tokens"])

    dealt = slim.mapInArrow(postings, f"slot int, block string, pieces binary, ids {ids_type}, n_bytes array<long>, extra array<long>").repartition(n, "slot")
    summed = dealt.mapInArrow(sums, f"block string, sums binary, ids {ids_type}, n_bytes array<long>, extra array<long>")
    return summed.groupBy("block").applyInArrow(per_document, f"`{id_col}` {kind}, n_bytes long, n_tokens long")


OUT = ["block", "sums", "ids", "n_bytes", "extra"]


def _sums(held: dict, like: pa.RecordBatch) -> pa.RecordBatch:
    kinds = [like.schema.field(c).type for c in ("ids", "n_bytes", "extra")]
    packed = pa.array([shared.pack_counts(np.rint(x).astype(np.int64)) for x in held.values()], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(held), packed, *(pa.nulls(len(held), t) for t in kinds)], names=OUT)


def _block(split: Splitter, schema: pa.Schema, name: str, ids: list, texts: list[str], slots: int):
    """The rows of one block: one with its documents, and one for each slot with the postings that fall to it."""
    words: dict[str, int] = {}
    codes, freq, sizes, extra = [], [], [], []
    for t in texts:
        pieces, special = split.split(t)
        found = Counter(pieces)
        codes += [words.setdefault(w, len(words)) for w in found]
        freq += found.values()
        sizes.append(len(found))
        extra.append(special)
    name = f"{name}-{xxhash.xxh3_64_hexdigest(repr(ids))}"
    n_docs, raw = len(ids), [w.encode("utf-8", "surrogatepass") for w in words]
    codes, freq = np.array(codes, np.int64), np.array(freq, np.int64)
    at = np.repeat(np.arange(n_docs), sizes)
    df = np.bincount(codes, minlength=len(raw))
    seed = xxhash.xxh3_64_intdigest(name)
    common = max(16, COMMON * n_docs)
    slot_of = np.array([(xxhash.xxh3_64_intdigest(w, seed) if d > common else xxhash.xxh3_64_intdigest(w)) % slots for w, d in zip(raw, df.tolist(), strict=True)], np.int64)
    by_slot = np.argsort(slot_of, kind="stable")
    place = np.empty_like(by_slot)
    place[by_slot] = np.arange(len(by_slot))
    order = np.argsort(place[codes] * n_docs + at, kind="stable") if len(codes) else codes
    at, freq, df_sorted = at[order], freq[order], df[by_slot]
    starts = np.concatenate([[0], np.cumsum(df_sorted)])
    edges = np.searchsorted(slot_of[by_slot], np.arange(slots + 1))
    lens = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
    rows = [(seed % slots, name, None, ids, lens, extra)]
    for s in range(slots):
        a, b = int(edges[s]), int(edges[s + 1])
        if a < b:
            p, q = int(starts[a]), int(starts[b])
            rows.append((s, name, _close(n_docs, [raw[i] for i in by_slot[a:b]], df_sorted[a:b], at[p:q], freq[p:q]), None, None, None))
        if len(rows) >= 64:
            yield _batch(rows, schema)
            rows = []
    if rows:
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _close(n_docs: int, words: list[bytes], *arrays: np.ndarray) -> bytes:
    parts = [b"".join(words), *(_narrow(a) for a in (np.array([len(w) for w in words]), *arrays))]
    head = np.array([n_docs, *map(len, parts)], np.uint32).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _open(payload: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n_docs, *sizes = np.frombuffer(raw, np.uint32, 6).tolist()
    parts, pos = [], 24
    for size in sizes:
        parts.append(raw[pos : pos + size])
        pos += size
    lens, df, at, freq = (np.frombuffer(p, f"u{p[0]}", offset=1).astype(np.int64) for p in parts[1:])
    ends = np.cumsum(lens)
    words = [parts[0][e - n : e] for e, n in zip(ends.tolist(), lens.tolist(), strict=True)]
    return n_docs, words, df, at, freq


def _narrow(a: np.ndarray) -> bytes:
    width = next(w for w in (1, 2, 4, 8) if (int(a.max()) if a.size else 0) < 1 << 8 * w)
    return bytes([width]) + a.astype(f"u{width}").tobytes()
