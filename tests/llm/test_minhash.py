"""Classes against all pairs, with crowds of variants, and the samples' agreement."""

import random

import numpy as np
import pytest

from quern.llm import minhash as m
from tests.llm import brute


def corpus():
    r = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [r.choice(words) for _ in range(n)]

    def changed(t, share):
        return [r.choice(words) if r.random() < share else w for w in t]

    out = [" ".join(text(r.randrange(5, 200))) for _ in range(80)]
    base = text(150)
    out += [" ".join(changed(base, r.random() * 0.08)) for _ in range(120)]
    passage = text(70)
    out += [" ".join(text(40) + passage + text(40)) for _ in range(60)]
    small = text(90)
    out += [" ".join(changed(small, 0.01)) for _ in range(6)] + out[:10]
    return [*enumerate(out), (None, out[0]), (None, "only null"), (900, None), (901, ""), (902, " "), (903, "a b"), (904, "a b"), (905, "a b c"), (3, out[3]), (906, "w1 w2 " * 20_000)]


@pytest.mark.parametrize("big", [4, 32])
def test_classes(spark, monkeypatch, big):
    monkeypatch.setattr(m, "BIG", big)
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "clash") for i, t in rows], "doc_id long, text string, class_id int, node string").repartition(3)
    got = m.classes(df).collect()
    want = brute.near_classes(rows)
    assert sorted((str(r.doc_id), str(r.class_id)) for r in got) == sorted((str(i), str(c)) for (i, _), c in zip(rows, want, strict=True))
    assert all(r.is_representative == (r.doc_id == r.class_id) for r in got if r.doc_id is not None)


def test_edges(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.classes(df).count() == 0
    one = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id) for r in m.classes(one).collect()) == [(1, 1), (2, 2)]


def test_samples_estimate_similarity():
    rng = np.random.default_rng(1)
    x = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
    w = rng.uniform(0.5, 3, len(x))
    agreements, truth = [], []
    for k in range(40):
        a, b = (slice(None, 1500), slice(100 + 10 * k, None))
        s = [(x[a], w[a]), (x[b], w[b] * rng.uniform(0.7, 1.3, len(x[b])))]
        sig = m.signatures(s)
        agreements.append((sig[0] == sig[1]).mean())
        truth.append(m.similarity(*s))
    assert abs(np.mean(agreements) - np.mean(truth)) < 0.03


@pytest.mark.parametrize("block", [16, 1024])
def test_family_in_a_crowd(spark, monkeypatch, block):
    """Many texts of one template, unlike each other; among them a family that drifts from copy to copy, and pairs of groups."""
    monkeypatch.setattr(m, "BLOCK", block, raising=False)
    r = random.Random(9)
    word = lambda: f"w{r.randrange(5000)}"
    template = [word() for _ in range(150)]
    rows = [" ".join(template + [word() for _ in range(35)]) for _ in range(90)]
    tail = [word() for _ in range(60)]
    for _ in range(90):
        tail[r.randrange(60)] = word()
        rows.append(" ".join(template + tail))
    for _ in range(20):  # two groups of near copies whose tails begin alike: joined by few pairs, all within the crowd
        alike = [word() for _ in range(4)]
        for _ in range(2):
            own = [word() for _ in range(12)]
            rows += [" ".join(template + alike + own + [word()]) for _ in range(6)]
    rows = list(enumerate(rows))
    r.shuffle(rows)
    got = m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute.near_classes(rows)
    assert {x.doc_id: x.class_id for x in got} == {i: c for (i, _), c in zip(rows, want, strict=True)}
    assert 1 < len(set(want)) < len(rows)


def test_similarities():
    r = random.Random(2)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(1, 60))) for _ in range(60)] + ["a b " * 300, "a b " * 250]
    idf = np.random.default_rng(3).uniform(0.5, 1, m.DF_BUCKETS)
    sets = [m.weights(t, idf) for t in texts]
    want = np.array([[m.similarity(a, b) for b in sets] for a in sets[:30]])
    assert np.abs(m.similarities(texts[:30], texts, idf) - want).max() < 1e-12
