"""Splitting of documents into chunks: by headings, by structural marks or by separators, with tables and code kept whole.

A document is split by one worker, rows by rows of Arrow batches, so chunking needs no shuffle.  Sizes are in tokens of
three characters.  A splitter's chunks are offsets into the text: without overlap they tile it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of the choice of a splitter and of the quality that it must reach.
MIN_HEADINGS, MIN_DENSITY, MIN_MARKS = 3, 0.005, 5
TINY_TOKENS, TINY_SHARE, LEAST_SHARE, MOST_TIMES = 5, 0.25, 0.25, 2
# Separators in the order in which they are tried.
SEPARATORS = ("\n\n", "\n", "。", "；", "，")

HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t#]*$")
FENCE = re.compile(r"^(?:```|~~~)")
TABLE_ROW = re.compile(r"^\s*\|.*\|\s*$")
TABLE_RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")
IMAGE = re.compile(r"!\[[^\]]*\]\([^)]*\)")
PROTECTED = re.compile(r"\$\$.*?\$\$|^```.*?^```[ \t]*$|(?:^[ \t]*\|.*\|[ \t]*\n?)+|!\[[^\]]*\]\([^)]*\)", re.S | re.M)
#: Marks that a document may be cut at, with their rank where several fall on one place.
MARKS = (
    (100, re.compile(r"\f")),
    (90, re.compile(r"^\s*\d+(?:\.\d+)*[.)]?\s+\S", re.M)),
    (85, re.compile(r"^\s*(?:chapter|kapitel|part|teil)\s+\d+|^\s*第[0-9一二三四五六七八九十百]+[章节部]", re.M | re.I)),
    (70, re.compile(r"^(?=.{3,60}$)[A-Z][A-Z0-9 ,:&-]*[A-Z0-9]$", re.M)),
    (60, re.compile(r"^\s*(?:-{3,}|_{3,}|\*{3,})\s*$", re.M)),
    (50, re.compile(r"^\s*(?:Seite|Page|页码)\s*\d+(?:\s*(?:von|of|/)\s*\d+)?\s*$", re.M | re.I)),
    (40, re.compile(r"\n(?:[ \t]*\n){3,}")),
)


@dataclass(frozen=True)
class Chunk:
    start: int
    end: int
    content: str
    heading_path: str = ""

    @property
    def tokens(self) -> int:
        return tokens(self.content)


@dataclass(frozen=True)
class Config:
    size: int = 512
    overlap: int = 80
    strategy: str = "auto"  # auto, heading, marker, recursive, no_split


def tokens(text: str) -> int:
    return max(1, len(text) // 3)


def protected_spans(text: str) -> list[tuple[int, int]]:
    """Formulas, code, tables and images, which aren't cut in."""
    return [m.span() for m in PROTECTED.finditer(text)]


def heading_lines(text: str) -> Iterator[tuple[int, int, str]]:
    """(offset, level, title) of each heading outside code."""
    at, code = 0, False
    for line in text.split("\n"):
        if FENCE.match(line):
            code = not code
        elif not code and (m := HEADING.match(line)):
            yield at, len(m[1]), m[2]
        at += len(line) + 1


def by_headings(text: str, c: Config) -> list[Chunk]:
    """A chunk a section, under the path of its headings; sections well over the size are split on."""
    path: list[tuple[int, str]] = []
    out, start, crumb = [], 0, ""
    marks = [*heading_lines(text), (len(text), 0, "")]
    for at, level, title in marks:
        if at > start and text[start:at].strip():
            out += split_on(text, start, at, c, crumb) if tokens(text[start:at]) > 1.5 * c.size else [Chunk(start, at, text[start:at], crumb)]
        elif at > start and out:
            out[-1] = Chunk(out[-1].start, at, text[out[-1].start : at], out[-1].heading_path)
        if at > start or not out:
            start = at if at > start else start
        path = [*(p for p in path if p[0] < level), (level, title)]
        crumb = " > ".join(p[1] for p in path)
        start = at
    return merge_small(text, out, c)


def by_marks(text: str, c: Config) -> list[Chunk]:
    """Cuts at marks once the size is reached; what lies between two cuts and is too large is split on."""
    places: dict[int, int] = {}
    for rank, pattern in MARKS:
        for m in pattern.finditer(text):
            places[m.start()] = max(rank, places.get(m.start(), 0))
    out, start = [], 0
    for at in [*sorted(p for p in places if p > 0), len(text)]:
        if at == len(text) or tokens(text[start:at]) >= c.size:
            if at > start:
                out += split_on(text, start, at, c, "") if tokens(text[start:at]) > c.size * MOST_TIMES else [Chunk(start, at, text[start:at])]
            start = at
    return out


def by_separators(text: str, c: Config) -> list[Chunk]:
    return split_on(text, 0, len(text), c, "")


def split_on(text: str, start: int, end: int, c: Config, crumb: str) -> list[Chunk]:
    """Pieces no larger than the size where a separator allows, packed together, each with the tail of the one before."""
    spans = [(a + start, b + start) for a, b in protected_spans(text[start:end])]
    pieces = _pieces(text, start, end, c.size, 0, spans)
    packed: list[tuple[int, int]] = []
    for a, b in pieces:
        if packed and tokens(text[packed[-1][0] : b]) <= c.size:
            packed[-1] = (packed[-1][0], b)
        else:
            packed.append((a, b))
    out: list[Chunk] = []
    for a, b in packed:
        if TABLE_ROW.match(text[a:b].split("\n", 1)[0]) and tokens(text[a:b]) > c.size:
            out += _table_parts(text, a, b, c, crumb)
        elif text[a:b].strip():
            tail = overlap_tail(text[out[-1].start : out[-1].end], c.overlap) if out and c.overlap and out[-1].end == a else ""
            out.append(Chunk(a, b, tail + text[a:b], crumb))
    return out


def _pieces(text: str, start: int, end: int, size: int, depth: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if tokens(text[start:end]) <= size or any(a <= start and end <= b for a, b in spans):
        return [(start, end)]
    if depth == len(SEPARATORS):
        cuts = range(start + 3 * size, end, 3 * size)
    else:
        cuts = (m.start() for m in re.finditer(re.escape(SEPARATORS[depth]), text[start:end]))
        cuts = (start + x for x in cuts)
    places = [start]
    for x in cuts:
        inside = next(((a, b) for a, b in spans if a < x < b), None)
        if x > places[-1] and not inside:
            places.append(x)
    for a, b in spans:  # protected parts stand alone
        places += [x for x in (a, b) if start < x < end]
    places = sorted({*places, end})
    out: list[tuple[int, int]] = []
    for a, b in zip(places, places[1:], strict=False):
        out += _pieces(text, a, b, size, depth + 1, spans) if depth < len(SEPARATORS) else [(a, b)]
    return out


def _table_parts(text: str, start: int, end: int, c: Config, crumb: str) -> list[Chunk]:
    """A table over the size in runs of rows, each under the header."""
    rows = text[start:end].splitlines(keepends=True)
    n_head = 2 if len(rows) > 1 and TABLE_RULE.match(rows[1]) else 1
    head, at = "".join(rows[:n_head]), start + sum(map(len, rows[:n_head]))
    out, held, begin = [], "", start
    for row in rows[n_head:]:
        if held and tokens(head + held + row) > c.size:
            out.append(Chunk(begin, at, head + held, crumb))
            held, begin = "", at
        held += row
        at += len(row)
    return [*out, Chunk(begin, end, head + held, crumb)]


def overlap_tail(text: str, overlap: int) -> str:
    """About overlap tokens from the end, from the start of a line."""
    tail = text[-int(overlap * 3 * 1.2) :] if overlap else ""
    if len(tail) == len(text):
        return ""
    cut = tail.find("\n")
    return tail[cut + 1 :] if 0 <= cut < len(tail) - 1 else tail


def merge_small(text: str, chunks: list[Chunk], c: Config) -> list[Chunk]:
    """Neighbours of one heading joined where the first, with what joined it before, is small and both fit."""
    small, out = max(200, c.size // 2), []
    for x in chunks:
        last = out[-1] if out else None
        if last and last.heading_path == x.heading_path and last.tokens < small and last.end == x.start and last.tokens + x.tokens <= c.size:
            out[-1] = Chunk(last.start, x.end, text[last.start : x.end], x.heading_path)
        else:
            out.append(x)
    return out


def good(chunks: list[Chunk], c: Config) -> bool:
    """Whether a splitter's result may stand: cut at all, few tiny ones, neither all too small nor one too large."""
    n = [x.tokens for x in chunks]
    if not n:
        return False
    tiny = sum(x < TINY_TOKENS for x in n[:-1])
    return not (len(n) == 1 and n[0] > 2 * c.size) and not (tiny > TINY_SHARE * len(n) and tiny > 2) and not (max(n) < LEAST_SHARE * c.size and sum(n) > c.size) and max(n) <= MOST_TIMES * c.size


def split(text: str | None, c: Config | None = None) -> list[Chunk]:
    """The chunks of a text by the strategy, or by the first of those that suit it whose result is good."""
    c = c or Config()
    if not text or not text.strip():
        return []
    if c.strategy == "no_split":
        return [Chunk(0, len(text), text)]
    named = {"heading": by_headings, "marker": by_marks, "recursive": by_separators}
    if c.strategy in named:
        return named[c.strategy](text, c)
    n_headings = sum(1 for _ in heading_lines(text))
    n_marks = sum(len(p.findall(text)) for _, p in MARKS[:-1])
    order = [by_headings] if n_headings >= MIN_HEADINGS and n_headings / (text.count("\n") + 1) >= MIN_DENSITY else []
    order += [by_marks] if order or n_marks >= MIN_MARKS else []
    for f in order:
        if good(found := f(text, c), c):
            return found
    return by_separators(text, c)


SCHEMA = "seq_num int, content string, heading_path string, token_count int, start_offset int, end_offset int"


def chunk_documents(docs: DataFrame, config: Config | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, seq_num, content, heading_path, token_count, start_offset, end_offset."""

    def run(frames):
        for f in frames:
            rows = [(i, n, x.content, x.heading_path, x.tokens, x.start, x.end) for i, t in zip(f["_id"], f["_text"], strict=True) for n, x in enumerate(split(t, config))]
            yield pd.DataFrame(rows, columns=["_id", "seq_num", "content", "heading_path", "token_count", "start_offset", "end_offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id {kind}, {SCHEMA}")
    return out.withColumnRenamed("_id", id_col)


def quality(chunks: DataFrame, size: int) -> DataFrame:
    """doc_id, passes: the same judgement over stored chunks (doc_id, seq_num, tokens), natively."""
    ends = chunks.groupBy("doc_id").agg(F.max("seq_num").alias("_last"))
    g = chunks.join(ends, "doc_id").groupBy("doc_id").agg(
        F.count("*").alias("c"), F.max("tokens").alias("m"), F.sum("tokens").alias("s"), F.count_if((F.col("tokens") < TINY_TOKENS) & (F.col("seq_num") != F.col("_last"))).alias("tiny")
    )
    fails = ((F.col("c") == 1) & (F.col("s") > 2 * size)) | ((F.col("tiny") > TINY_SHARE * F.col("c")) & (F.col("tiny") > 2)) | ((F.col("m") < LEAST_SHARE * size) & (F.col("s") > size)) | (F.col("m") > MOST_TIMES * size)
    return g.select("doc_id", (~fails).alias("passes"))


def extract_tables(text: str | None) -> tuple[str, list[dict]]:
    """The text with placeholders for its tables, and the tables with caption and heading path."""
    lines, out, found = (text or "").split("\n"), [], []
    path: list[tuple[int, str]] = []
    i, code = 0, False
    while i < len(lines):
        if FENCE.match(lines[i]):
            code = not code
        if not code and (m := HEADING.match(lines[i])):
            path = [*(p for p in path if p[0] < len(m[1])), (len(m[1]), m[2])]
        if not code and i + 1 < len(lines) and TABLE_ROW.match(lines[i]) and TABLE_RULE.match(lines[i + 1]):
            end = i
            while end < len(lines) and TABLE_ROW.match(lines[end]):
                end += 1
            caption = next((x.strip() for x in reversed(out) if x.strip()), "")
            found.append({"table_no": len(found), "content": "\n".join(lines[i:end]), "caption": caption if not caption.startswith("#") else "", "heading_path": " > ".join(p[1] for p in path)})
            out.append(f"<TABLE_{len(found) - 1}>")
            i = end
            continue
        out.append(lines[i])
        i += 1
    return "\n".join(out), found


def split_sections(text: str | None, around: int = 500) -> list[dict]:
    """Each image with what stands before and after it, from and to the ends of lines."""
    text, out = text or "", []
    for n, m in enumerate(IMAGE.finditer(text)):
        above, below = text[max(0, m.start() - around) : m.start()], text[m.end() : m.end() + around]
        if m.start() > around and "\n" in above:
            above = above[above.index("\n") + 1 :]
        if m.end() + around < len(text) and "\n" in below:
            below = below[: below.rindex("\n")]
        out.append({"image_no": n, "image": m[0], "context_above": above.strip(), "context_below": below.strip()})
    return out


def tables_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, table_no, content, caption, heading_path."""
    return _exploded(docs, id_col, text_col, lambda t: extract_tables(t)[1], "table_no int, content string, caption string, heading_path string")


def sections_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, image_no, image, context_above, context_below."""
    return _exploded(docs, id_col, text_col, split_sections, "image_no int, image string, context_above string, context_below string")


def _exploded(docs: DataFrame, id_col: str, text_col: str, f, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames):
        for frame in frames:
            rows = [(i, *(x[k] for k in names)) for i, t in zip(frame["_id"], frame["_text"], strict=True) for x in f(t)]
            yield pd.DataFrame(rows, columns=["_id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(run, f"_id {kind}, {schema}")
    return out.withColumnRenamed("_id", id_col)
