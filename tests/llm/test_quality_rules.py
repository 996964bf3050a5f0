"""Verdicts against a plain version, and held-out quality."""

import random

from quern.llm import quality_rules
from tests.llm import brute


def docs():
    r = random.Random(5)
    w = ["the", "cat", "of", "and", "sat", "on", "é", "mat,"]
    line = lambda n: " ".join(r.choice(w) for _ in range(n))
    rows = [(i, line(r.randrange(60))) for i in range(60)]
    rows += [(100 + i, " ".join(x + r.choice(["***", "###", "|"]) for x in line(40).split())) for i in range(12)]
    block = line(9)
    rows += [(200, f"{block}\n{block}\n \n{line(20)}\n{block}"), (201, "a " * 500), (202, block * 3), (None, line(40)), (203, None), (204, ""), (205, " \t\n\x0b\x0c\r"), (1, rows[1][1]), (1, rows[1][1]), (206, "x " + "y" * 50_000), (207, line(5000))]
    return rows


def test_verdicts(spark):
    rows = docs()
    labels = [(i, 1, 0) for i in range(0, 40)] + [(3, 0, 0), (500, 1, 1), (None, 1, 0), (41, None, None)] + [(i, 0, 0) for i in range(100, 106)]
    trusted = {i for i, q, _ in labels if q == 1 and i is not None}
    want = brute.quality_verdicts(rows, trusted)
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_words string, bucket int")
    got = quality_rules.verdicts(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    key = lambda x: tuple(map(str, x))
    assert sorted((key((r.doc_id, *(r[f] for f in fields))) for r in got.collect())) == sorted(key((rows[k][0], *v)) for k, v in want.items())
    filtered = quality_rules.verdicts(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), keep=("doc_id", "text", "bucket")).filter("kept")
    assert filtered.count() == sum(v[-1] for v in want.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.verdicts(df, labels).count() == 0
    one = spark.createDataFrame([(1, "word " * 30)], "doc_id long, text string")
    assert [r.llr for r in quality_rules.verdicts(one, labels).collect()] == [0.0]


def test_held_out(spark):
    """Documents whose labels were kept from the target are told apart all the same."""
    d = "/root/testdata/sf0.01"
    data, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_rules.verdicts(data, labels.filter("doc_id % 2 = 0")).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("n_words >= 20 and 100 * n_repeat_words <= 30 * n_words").collect()
    good, bad = ([r.kept for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.5 * len(bad)
