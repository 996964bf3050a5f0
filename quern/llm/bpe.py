"""Byte-pair encoding and decoding with a published vocabulary.

A text of more than LEAF characters is cut in halves down to leaves, wherever that falls; the leaves are encoded side by
side, and each join is mended by re-encoding a window around it.  A window goes from one seam to another: a space or line
end after a character that is neither is where the splitting pattern begins anew, whatever lies further off, so that
tokens never cross it and what lies beyond is the same with any neighbours.  It grows until its first and last token are
those that the two sides already have at these seams.

A pre-token of more than LEAF bytes has no seams.  It is a tree of its own, whose windows go from token to token: a token
sequence is the encoding of a pre-token exactly if every neighbouring pair is, so that agreement is exact there, too.

Defined results: a null text counts as empty and has no tokens; repeated rows give repeated rows; only the id and text
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, lru_cache

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import shared

#: Characters of a text, or bytes of a pre-token, that one call encodes.
LEAF = 4096
#: Where the splitting pattern begins anew.
SEAM = re.compile(r"(?<=[\w!-~])[ \n]")
#: Fixed value: the public pattern of byte-level vocabularies that splits text before merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class could differ between versions of Unicode; texts that have them are split by the library.
UNSURE = re.compile("[^\\u0000-\\u024F\\u2010-\\u2027\\u2030-\\u205E\\u20A0-\\u20BF]")
SPACES = re.compile(rf"\s{{{LEAF}}}")


def has_long_run(text: str) -> bool:
    """Whether the splitting pattern might leave LEAF characters whole."""
    return len(text) >= LEAF and (max(map(len, text.split()), default=0) >= LEAF or bool(SPACES.search(text)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder for one vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec.get("pre_tokenizer") or {}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
        plain = not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in spec.get("added_tokens") or [])
        self.byte_level = plain and model.get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges") and not spec.get("truncation")
        self.core = None
        if self.byte_level:
            of = byte_alphabet()
            ranks = {bytes(of[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            order = [model["vocab"][a + b] for a, b in merges]
            self.byte_level = order == sorted(order)  # ids must rise with the merges to serve as ranks
            self.core = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.trees = 0  # texts encoded by halves
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    @cached_property
    def library(self) -> Tokenizer:
        """The library's own tokenizer, loaded when a text needs it."""
        return Tokenizer.from_file(self.path)

    @cached_property
    def pool(self) -> ThreadPoolExecutor:
        return ThreadPoolExecutor(4)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if not self.byte_level:
            return self.library.encode(text, add_special_tokens=False).ids
        if self.cut is None or not self.cut.search(text):
            return self._ordinary(text)
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += self._ordinary(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + self._ordinary(text[at:])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens, as the library splits."""
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _ordinary(self, text: str) -> list[int]:
        if not text:
            return []
        if has_long_run(text):
            return [i for p in self.pieces(text) for i in self.encode_unsplit(p.encode("utf-8", "surrogatepass"))]
        unsure = not text.isascii() and UNSURE.search(text)
        whole = (lambda t: self.library.encode(t, add_special_tokens=False).ids) if unsure else self.core.encode_ordinary
        return whole(text) if len(text) <= LEAF else self.encode_halves(text, whole)

    def encode_halves(self, text: str, whole, leaf: int = LEAF) -> list[int]:
        """Encode a text by the tree of its halves, with whole() for leaves and windows."""
        self.trees += 1
        edges = [0, len(text)]
        while edges[1] > leaf:
            edges = sorted({*edges, *((a + b) // 2 for a, b in zip(edges, edges[1:], strict=False))})
        spans = list(zip(edges, edges[1:], strict=False))
        nodes = list(zip(self.pool.map(lambda s: whole(text[s[0] : s[1]]), spans), spans, strict=True))
        while len(nodes) > 1:
            rest = nodes[len(nodes) // 2 * 2 :]
            nodes = [*(self._mend(text, whole, *nodes[k], *nodes[k + 1]) for k in range(0, len(nodes) - 1, 2)), *rest]  # short windows
        return nodes[0][0]

    def _mend(self, text: str, whole, left: list[int], one: tuple[int, int], right: list[int], two: tuple[int, int]) -> tuple[list[int], tuple[int, int]]:
        start, at, end, reach = *one, two[1], 32
        while True:
            low, high = max(start, at - reach), min(end, at + reach)
            a = start if low == start else next((m.start() for m in SEAM.finditer(text, low + 1, at)), None)
            b = end if high == end else next((m.start() for m in reversed(list(SEAM.finditer(text, at + 1, high)))), None)
            if a is not None and b is not None:
                i, j = (self._token_at(t, n) for t, n in ((reversed(left), text[a:at]), (right, text[at:b])))
                again = whole(text[a:b])
                if i is not None and j is not None and (a == start or (i and again[0] == left[-i])) and (b == end or (j and again[-1] == right[j - 1])):
                    return left[: len(left) - i] + again + right[j:], (start, end)
                if a == start and b == end:
                    return again, (start, end)
            reach *= 2

    def _token_at(self, ids: Iterable[int], text: str) -> int | None:
        """How many of ids, from their first on, make the bytes of text; None if a token crosses its end."""
        n, k, ids = len(text.encode("utf-8", "surrogatepass")), 0, iter(ids)
        while n > 0:
            n -= len(self.bytes_of[next(ids)])
            k += 1
        return k if n == 0 else None

    def encode_unsplit(self, raw: bytes, leaf: int = LEAF) -> list[int]:
        """Encode one pre-token; over leaf bytes, by the tree of halves."""
        encode = self.core._encode_single_piece
        if len(raw) <= leaf:
            return encode(raw)
        parts = [raw]
        while len(parts[0]) > leaf:
            parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :]) if h]
        done = list(self.pool.map(encode, parts))
        while len(done) > 1:
            rest = done[len(done) // 2 * 2 :]
            done = [*(self._join(done[k], done[k + 1]) for k in range(0, len(done) - 1, 2)), *rest]
        return done[0]

    def _join(self, left: list[int], right: list[int]) -> list[int]:
        k = 4
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            window = b"".join(self.bytes_of[t] for t in left[i:] + right[:j])
            again = self.core._encode_single_piece(window)
            if (i == 0 or again[0] == left[i]) and (j == len(right) or again[-1] == right[j - 1]):
                return left[:i] + again + right[j:]
            k *= 2

    def decode(self, ids) -> str:
        if not self.byte_level:
            return self.library.decode(list(ids), skip_special_tokens=False)
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for b in batches:
            for part in _slices(b):
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    slim = docs.select(F.col(id_col), F.col(text_col))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", to_col: str = "decoded") -> DataFrame:
    """encoded with the text of ids_col as one more column; null ids give an empty text."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            for part in _slices(b):
                texts = [c.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, to_col])

    kinds = ", ".join(f"`{n}` {t}" for n, t in encoded.dtypes)
    return encoded.mapInArrow(run, f"{kinds}, `{to_col}` string")


def round_trip(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded) of every row: encode() and decode() in one worker."""
    path = vocabulary or default_vocabulary()

    def run(batches):
        c = codec(path)
        for b in batches:
            for part in _slices(b):
                ids = [c.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(c.decode, ids), pa.string())], names=[id_col, "ids", "decoded"])
        shared.trim()

    slim = docs.select(F.col(id_col), F.col(text_col))
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def _slices(batch: pa.RecordBatch, rows: int = 200):
    """A batch in short runs, as Python's integers take many times the room of Arrow's."""
    for at in range(0, max(1, batch.num_rows), rows):
        yield batch.slice(at, rows)
