"""Enrichment steps on small tables."""

import numpy as np

from quern.operators import enrich


def test_citations_find_all_substrings(spark):
    terms = [None, "", "cat", "cold widget", "ld wid", "a b c", "...", "42", "Of The sea", "é-x", "the old man and", "widgets,", " "]
    texts = [None, "", "Category", "cold widgets, 1420", "Cold Widget", "a b cd", "aa b c", "wait...", "of the seaside; of the", "CAFÉ-X", "the older man and", "bathe old man andes"]
    t = spark.createDataFrame(list(enumerate(terms)), "term_id long, term string")
    c = spark.createDataFrame([(i, x, x.lower().split() if x else []) for i, x in enumerate(texts)], "chunk_id long, content string, tokens array<string>")
    want = sorted((i, j) for i, a in enumerate(terms) if a for j, b in enumerate(texts) if b and a.lower() in b.lower())
    assert sorted(map(tuple, enrich.citations(t, c).collect())) == want


def test_mixture_of_more_than_twelve():
    rng = np.random.default_rng(5)
    centres = rng.uniform(-20, 20, (20, 6))
    x = np.concatenate([c + rng.normal(0, 0.3, (40, 6)) for c in centres])
    found = enrich.clusters(x, "gmm")
    assert sorted(map(sorted, found)) == [list(range(40 * i, 40 * i + 40)) for i in range(20)]
    assert len(enrich.clusters(x, "gmm", most=5)) == 5


def test_ward_is_bounded_and_refined():
    x = 30 * np.repeat(np.eye(80), 2, axis=0) + np.random.default_rng(1).normal(0, 0.01, (160, 80))
    found = enrich.clusters(x, "ahc")
    assert len(found) == 64 and sorted(i for f in found for i in f) == list(range(160))
    assert len(enrich.clusters(x, "ahc", most=5)) == 5
    line = np.array([[0.0], [1.0], [2.0], [3.9], [9.0], [9.1], [6.5]])
    assert enrich.nearest_centroids(line, [[0, 1, 2, 3, 6], [4, 5]]) == [[0, 1, 2, 3], [4, 5, 6]]
    assert enrich.nearest_centroids(line, [[0, 1], [2, 3, 4, 5, 6]], 0) == [[0, 1], [2, 3, 4, 5, 6]]
    for v in np.random.default_rng(2).normal(0, 1, (5, 40, 3)):
        found = enrich.clusters(v, "ahc")
        assert sorted(i for f in found for i in f) == list(range(40))


def merged_naively(x, most):
    """Ward's merges by all pairs' costs at each step."""
    live, steps, costs = {i: (v, 1, [i]) for i, v in enumerate(x)}, [], []
    while len(live) > 1:
        pairs = [(((live[i][0] - live[j][0]) ** 2).sum() * (live[i][1] * live[j][1] / (live[i][1] + live[j][1])), i, j) for i in live for j in live if i < j]
        cost, i, j = min(pairs)
        steps.append(sorted(sorted(v[2]) for v in live.values()))
        costs.append(cost)
        (a, n, p), (b, m, q) = live[i], live.pop(j)
        live[i] = ((a * n + b * m) / (n + m), n + m, p + q)
    return steps[max(int(np.diff(np.sqrt(costs)).argmax()) + 1, len(x) - most)]


def test_ward_grows_with_the_square():
    import time

    rng = np.random.default_rng(7)
    for k in range(12):
        x = rng.normal(0, 1, (30, 9)) if k % 3 == 0 else rng.integers(0, 3, (30, 1 + k)).astype(float) if k % 3 == 1 else rng.normal(0, 1, (6, 5))[rng.integers(0, 6, 30)]
        assert enrich.ward(x, 5) == merged_naively(x, 5)
    began = time.thread_time()
    assert sum(map(len, enrich.ward(rng.normal(0, 1, (3000, 16))))) == 3000
    assert time.thread_time() - began < 60


def test_mixtures_keep_one_fit():
    import tracemalloc

    x = np.random.default_rng(3).normal(0, 1, (1500, 8))
    tracemalloc.start()
    enrich.clusters(x, "gmm")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * 1500 * 64 * 8  # so many arrays of shares
