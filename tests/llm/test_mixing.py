"""The mix against a plain version."""

import random

import pytest

from quern.llm import mixing
from tests.llm import brute


def rows():
    r = random.Random(2)
    out = [(i, r.choice(["a", "a", "a", "b", "c", "é", None]), " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(200)))) for i in range(150)]
    return [*out, (None, "a", "null id here"), (None, "a", "null id here"), (None, "a", None), (None, "a", "another without id"), (7, "a", "same id other text"), (7, "a", "same id text other"), (7, "a", "shorter"), (500, "b", None), (501, "zero", ""), (502, "c", "x " * 9000), (0, out[0][1], out[0][2])]


@pytest.mark.parametrize("docs_a_shard", [20, 4096])
def test_mix(spark, monkeypatch, docs_a_shard):
    monkeypatch.setattr(mixing, "SHARD_DOCS", docs_a_shard)
    docs = rows()
    df = spark.createDataFrame([(*r, "clash", len(r[2] or "")) for r in docs], "doc_id long, source string, text string, size string, n_chars long")
    want = brute.mixed(docs)
    got = mixing.plan(df.repartition(5)).select("doc_id", "size", "source_size", "target", "taken").collect()
    key = lambda x: (str(x[0]), x[1], x[2], round(x[3], 6), x[4])
    assert sorted(map(key, got)) == sorted(map(key, want))
    assert all(x[4] <= 2 * x[1] for x in got)
    texts = mixing.mixed_texts(df, keep=("doc_id", "text", "n_chars")).collect()
    assert sorted((str(t.doc_id), t.text) for t in texts) == sorted((str(i), t) for i, *_, ts in want for t in ts)
    assert all(t.n_chars == len(t.text) for t in texts)


def test_near_target(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.plan(docs, keep=("source",)).groupBy("_keep_source").agg({"taken": "sum", "target": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 3 * mixing.BLOCK_WORDS for r in got)


def test_edges(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string")
    assert mixing.plan(df).count() == len(rows())
    assert mixing.plan(df.limit(0)).count() == 0


def test_targets():
    t = mixing.targets([100, 100, 100])
    assert t == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]
    assert sum(mixing.targets([1000, 5, 5, 5])) == pytest.approx(1.5 * 1015)


def test_highest_quotients():
    assert mixing.sainte_lague([53, 24, 23], 7, [9, 9, 9]) == [3, 2, 2]
    assert mixing.sainte_lague([10, 10], 5, [1, 9]) == [1, 4]
    assert mixing.sainte_lague([0, 0], 5, [3, 3]) == [0, 0]
    r = random.Random(1)
    for _ in range(100):
        w = [r.randrange(0, 50) for _ in range(5)]
        n, held = r.randrange(40), [0] * 5
        for _ in range(n if any(w) else 0):
            held[max(range(5), key=lambda i: (w[i] / (2 * held[i] + 1), -i))] += 1
        assert mixing.sainte_lague(w, n, [99] * 5) == held
