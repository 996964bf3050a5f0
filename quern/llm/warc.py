"""WARC archives: written with an index, read back through it.

write() stores one record a page, each a gzip member of its own, in one file a task, and returns the index: file,
offset, length, URL, digest and kind of every record.  A payload of MIN_REVISIT bytes or more that several pages share is
stored once, under the smallest page id; the others are revisit records that name it.  read() takes any selection of
index rows, sorts them by file and offset, joins neighbouring byte ranges whose gap is at most GAP into one read (of
at most MOST bytes, unless one record is longer), and parses what it reads.

Files lie in the shared folder, reached through pyarrow's file systems by the folder's URI.  A task that is run again
writes a file of a new name, and only the rows of tasks that succeeded are in the index, so a half-written file is never
read.  Payload text crosses no shuffle but one, to meet the decision on it.

Defined results: a null html is an empty payload; a null page id never counts as the smallest while another exists;
repeated rows of one page id are each a response; a null URL is written as empty and read as null; only the columns
named are read; an empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import shared

MIN_REVISIT = 100
GAP, MOST = 1 << 16, 8 << 20
INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long, refers_to long, payload_bytes long"
DATE = datetime(2024, 1, 1, tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record. A revisit has no block; the length of what it stands for is in a field of its own."""
    head = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Payload-Length", str(len(payload)))]
        payload = b""
    head.append(("Content-Length", str(len(payload))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return f"WARC/1.1\r\n{lines}\r\n".encode("utf-8", "surrogatepass") + payload + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Fields of one record, and its payload under ''."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    n = int(fields["Content-Length"])
    if len(rest) != n + 4:
        raise ValueError("a record's length differs from its header")
    return fields | {"": rest[:n]}


def _number(urn: str) -> int | None:
    text = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def write(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all pages as archives in folder (a new shared one, if none is given); the index, settled."""
    spark = pages.sparkSession
    root = folder or shared.new_dir(spark, "warc")
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    digests = slim.filter(F.octet_length("html") >= MIN_REVISIT).select("page_id", F.sha2("html", 256).alias("digest"))
    first = digests.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("digest", "first")
    again = digests.join(first, "digest").filter("page_id is null or page_id > first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "first").distinct()
    hashed = slim.withColumn("digest", F.sha2("html", 256))
    decided = hashed.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("d")), "left").select("page_id", "url", "html", "digest", F.col("first").alias("refers_to"))

    def run(batches):
        target = out = None
        offset = 0
        name = f"{root}/part-{uuid.uuid4().hex}.warc.gz"
        try:
            for b in batches:
                rows = []
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None:
                        target, path = fs.FileSystem.from_uri(name)
                        target.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        out = target.open_output_stream(path, compression=None)
                    payload = html.encode("utf-8", "surrogatepass")
                    member = gzip.compress(record(page_id, url, payload, digest, refers_to), 4, mtime=0)
                    out.write(member)
                    rows.append((name, offset, len(member), url, digest, "response" if refers_to is None else "revisit", page_id, refers_to, len(payload)))
                    offset += len(member)
                if rows:
                    yield _frame(rows)
        finally:
            if out is not None:
                out.close()

    return shared.settle(decided.mapInArrow(run, INDEX), "warc-index")


_SCHEMA = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64())])


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) in runs that one read each covers."""
    runs: list[list[tuple[int, int]]] = []
    for offset, length in ranges:
        if runs and offset - sum(runs[-1][-1]) <= gap and offset + length - runs[-1][0][0] <= most:
            runs[-1].append((offset, length))
        else:
            runs.append([(offset, length)])
    return runs


def read(index: DataFrame, parts: int | None = None) -> DataFrame:
    """page_id, url, record_type, refers_to, payload, payload_digest, payload_bytes of the selected records."""
    chosen = index.select("file", "offset", "length")
    parts = parts or shared.partitions(index.sparkSession)
    dealt = chosen.repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")

    def run(frames):
        store, path, handle, name = None, None, None, None
        for f in frames:
            for file, group in f.groupby("file", sort=False):
                if file != name:
                    if handle:
                        handle.close()
                    store, path = fs.FileSystem.from_uri(file)
                    handle, name = store.open_input_file(path), file
                for ranges in coalesce(list(zip(group["offset"], group["length"], strict=True))):
                    start, end = int(ranges[0][0]), int(sum(ranges[-1]))
                    block = handle.read_at(end - start, start)
                    rows = []
                    for offset, length in ranges:
                        x = parse(gzip.decompress(block[offset - start : offset - start + length]))
                        revisit = x["WARC-Type"] == "revisit"
                        stated = x["WARC-Payload-Digest"].removeprefix("sha256:")
                        if not revisit and hashlib.sha256(x[""]).hexdigest() != stated:
                            raise ValueError(f"a payload in {file} at {offset} differs from its digest")
                        rows.append((_number(x["WARC-Record-ID"]), x["WARC-Target-URI"] or None, x["WARC-Type"], _number(x["WARC-Refers-To"]) if revisit else None, None if revisit else x[""], stated, int(x["X-Payload-Length"]) if revisit else len(x[""])))
                    out = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "refers_to", "payload", "payload_digest", "payload_bytes"])
                    yield out.astype({"page_id": "Int64", "refers_to": "Int64"})
        if handle:
            handle.close()

    return dealt.mapInPandas(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string, payload_bytes long")
