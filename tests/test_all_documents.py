"""Queries over all documents, on a few that have what the test data lacks: against brute force and their SQL."""

import re

import duckdb
import pytest

import __spark_entry__
from quern.operators.pages import DEBRIS, TICKS

TEXTS = [None, "", " ", "\n", "a\n\nb", "\n\n5\n6", "5\n\n7%\n\nx\n3\n4\ny", "x\n\n\n", "1\n2\n3", "title\n\n3\n-layer", "0 1 2 3\n(4) 5.0 6\n 10 20 \nx", "1 2\n1234 5678 9012 3456 7890\n1 2\n7", "Error (%)\n0.1\n1e-3\nend", ". a", "a. ", ". . a", "a. . b. c", ". ", "a.b", "a. . "]


def debris(line):
    t = line.strip()
    return bool(re.match(DEBRIS, t) or (re.match(TICKS, t) and len(t) <= 24 and len(re.findall(r"\d", t)) >= 3))


def kept_lines(text):
    lines = ["7", *text.split("\n"), "0.5", "", "10", "56-layer"]
    out, i = 0, 0
    while i < len(lines):
        j = i
        while j < len(lines) and (debris(lines[j]) or (j > i and not lines[j].strip(" "))):
            j += 1
        out += 1 if j == i else (j - i if j - i < 3 else 0)
        i = max(j, i + 1)
    return out


def parts(text):
    if text is None:
        return None
    return len([p for p in [("" if i == 0 else ". ") + s for i, s in enumerate(text.split(". "))] if p])


@pytest.mark.parametrize("name", ["strip_chart_debris", "split_keep_separator"])
def test_all_documents(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()}
    if name == "split_keep_separator":
        assert got == {(i, parts(t)) for i, t in enumerate(TEXTS)}
    else:
        assert got == {(i, kept_lines(t)) for i, t in enumerate(TEXTS) if t is not None and kept_lines(t)}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.sql(__spark_entry__.oracle_sql()[name]).fetchall()) == got
