"""Scores against a dictionary of counts, what the weights are learnt from, and that the model is a distribution."""

import math
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quern.llm import lm_scoring as lm
from quern.llm import shared


def words(t):
    return [*"".join(c.lower() if c.isascii() else c for c in (t or "")).encode().split(), b"\n"]


def rest(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def counted(texts, order):
    """Counts of sequences of each length; texts begin after order - 1 times None."""
    out = [Counter() for _ in range(order)]
    for t in texts:
        w = [*[None] * (order - 1), *words(t)]
        for i in range(order - 1, len(w)):
            for k in range(order):
                out[k][tuple(w[i - k : i + 1])] += 1
    for k in range(1, order):
        out[k - 1][(None,) * k] = len(texts)
    return out


def kinds(counts, whole, hot):
    """The class of how many words follow a history; 0 if its words are hot by the whole counts."""
    following = Counter(s[:-1] for c in counts[1:] for s, n in c.items() if n and s[-1] is not None)
    return lambda h: 0 if all(whole[0][w,] > hot for w in h) else 1 + min(int(math.log2(following[h])), lm.FOLLOWING - 2)


def chances(h, w, counts, base, blend, kind):
    """P(w | h) for h of 0, 1, ... words."""
    p = [(counts[0][w,] + 0.1) / base]
    for k in range(1, len(counts)):
        n = counts[k - 1][h[len(h) - k :]]
        x = blend[k][min(int(math.log2(n)), lm.POWERS - 1)][kind(h[len(h) - k :])] if n else 0
        p.append(x * counts[k][*h[len(h) - k :], w] / n + (1 - x) * p[-1] if n else p[-1])
    return p


def brute(rows, order, hot=10**9):
    train = [t for i, t in rows if rest(i) != 0]
    counts = counted(train, order)
    n, v = sum(len(words(t)) for t in train), len({w for t in train for w in words(t)})
    base = n + 0.1 * (v + 1)
    fold = counted([t for i, t in rows if rest(i) not in (0, lm.TUNING)], order)
    for c in (counts, fold):
        c[0][None,] = len(train) if c is counts else sum(rest(i) not in (0, lm.TUNING) for i, _ in rows)
    kind, fold_kind = kinds(counts, counts, hot), kinds(fold, counts, hot)
    blend = np.full((order, lm.POWERS, lm.FOLLOWING), 0.5)
    for k in range(1, order):
        cells = defaultdict(lambda: [0, 0])
        for i, t in rows:
            if rest(i) == lm.TUNING:
                w = [*[None] * (order - 1), *words(t)]
                for at in range(order - 1, len(w)):
                    own = tuple(w[at - k : at])
                    c = fold[k - 1][own]
                    if c and fold_kind(own):
                        cell = cells[int(math.log2(c)), fold_kind(own)]
                        cell[0] += fold[k][*own, w[at]] > 0
                        cell[1] += 1
        for cell, (seen, told) in cells.items():
            blend[k][cell] = (seen + 0.5) / (told + 1)
        blend[k, :, 0] = blend[k][max(cells, default=(0, 0))]
    out = []
    for i, t in rows:
        w = [*[None] * (order - 1), *words(t)]
        p = [chances(tuple(w[at - order + 1 : at]), w[at], counts, base, blend, kind) for at in range(order - 1, len(w))]
        known = sum(counts[0][x,] > 0 for x in words(t))
        out.append((str(i), rest(i) == 0, len(p), known, n, round(sum(math.log10(x[0]) for x in p), 6), round(sum(math.log10(x[-1]) for x in p), 6)))
    return sorted(out), counts, base, blend, kind


def some_rows(seed=3):
    r = random.Random(seed)
    phrases = ["the cat sat", "The cat on mat\n", "é É on", "a b a b a", "sat on the mat"]
    rows = [(i, " ".join(r.choice([*phrases, "the", "cat", "x%d" % r.randrange(9)]) for _ in range(r.randrange(12)))) for i in range(120)]
    return [*rows, (None, None), (161, ""), (161, ""), (162, "x" * 9000 + " y"), (163, " \t\n"), (164, "a b " * 700)]


def rounded(found):
    return sorted((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6), round(g.score, 6)) for g in found)


@pytest.mark.parametrize(("order", "size", "slot", "hot"), [(3, 1, 700, 10**9), (3, 300, 1 << 20, 90), (3, 1 << 20, 400, 90), (1, 1 << 20, 1 << 20, 90), (4, 3000, 700, 10**9)])
def test_scores(spark, order, size, slot, hot):
    docs = spark.createDataFrame([(*x, "clash") for x in some_rows()], "doc_id long, text string, block string").repartition(3)
    got = lm.score(docs, order=order, block_bytes=size, slot_tokens=slot, hot=hot).collect()
    assert rounded(got) == brute(some_rows(), order, hot)[0]


@pytest.mark.parametrize(("order", "size", "slot", "crowd"), [(3, 300, 400, 90), (3, 1 << 20, 150, 20), (2, 3000, 1 << 20, 0), (4, 3000, 150, 5)])
def test_crowds_score_as_others(spark, order, size, slot, crowd):
    """Histories that are dealt singly, those of starts among them, have the weights that they have in one slot."""
    docs = spark.createDataFrame(some_rows(), "doc_id long, text string").repartition(3)
    got = lm.score(docs, order=order, block_bytes=size, slot_tokens=slot, crowd=crowd).collect()
    assert rounded(got) == brute(some_rows(), order)[0]


def test_no_switch_by_size(spark):
    """The query's scores of a corpus in which one word occurs over 500,000 times are the model's."""
    r = random.Random(7)
    rows = [(i, "a " * 6000 + " ".join(r.choice(["a", "b", "c", "x%d" % r.randrange(40)]) for _ in range(200))) for i in range(100)]
    assert sum(t.split().count("a") for i, t in rows if rest(i) != 0) > 500_000
    got = sorted(lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda g: str(g.doc_id))
    assert [g.score for g in got] == pytest.approx([x[-1] for x in brute(rows, 3)[0]], rel=1e-7)


def test_distribution():
    """For any history, the chances of all words, the end and one unknown word add up to one."""
    rows = some_rows()
    _, counts, base, blend, kind = brute(rows, 3, 90)
    vocabulary = [w for (w,) in counts[0] if w is not None and counts[0][w,]]
    for h in [(None, None), (None, b"the"), (b"the", b"cat"), (b"a", b"b"), (b"no", b"the"), (b"no", b"such")]:
        assert sum(chances(h, w, counts, base, blend, kind)[-1] for w in [*vocabulary, b"unknown"]) == pytest.approx(1)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 100])
def test_walk_in_pieces_and_by_single_steps(piece):
    """A walk in pieces gives what one state carried over each whole text gives."""
    r = np.random.default_rng(5)
    lengths = np.array([1, 9, 40, 2, 17])
    starts = np.cumsum(lengths) - lengths
    tokens = r.integers(10, 16, lengths.sum()).astype(np.uint64) << np.uint64(40)
    tokens[starts + lengths - 1] = lm.END
    names, numbers = np.unique(tokens, return_inverse=True)
    seen = [lm.Sequences(names, numbers, starts, k, np.empty(0, np.uint64)) for k in (1, 2, 3)]
    learn = np.repeat([1.0, 1, 0, 1, 0], lengths)
    blend = np.zeros((3, lm.POWERS, lm.FOLLOWING))
    blend[1:] = r.random((2, lm.POWERS, lm.FOLLOWING))
    types = [r.integers(1, 9, len(lm.groups(s.keys))) for s in seen]
    a = lm.Automaton(seen, [s.counts(learn) for s in seen], types, starts, 3, (0.1, 40.0), blend)
    assert len(a.fail_to) > 1 + len(seen[0].keys) and (a.level[a.to] == 2).any()  # there are states of two words
    want = []
    for s, n in zip(starts, lengths):
        state, total = np.array([a.start]), 0.0
        for at in range(s, s + n):
            state, weight = a.step(state, np.array([at]))
            total += weight[0]
        want.append(total)
    assert a.walk(starts, lengths, piece) == pytest.approx(want)


def peak_bytes(f):
    tracemalloc.start()
    try:
        f()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_memory_of_a_block():
    """Two workers walk blocks of some 1.4 million tokens beside an executor's JVM; before, a block took over 200 bytes a token."""
    r = np.random.default_rng(3)
    lengths = np.full(2000, 500)
    starts = np.cumsum(lengths) - lengths
    names, numbers = np.unique((r.pareto(0.4, lengths.sum()) * 50).clip(0, 3e5).astype(np.uint64) + np.uint64(1 << 30), return_inverse=True)
    names = lm._mix(names)
    blend = np.full((3, lm.POWERS, lm.FOLLOWING), 0.4)

    def build():
        seen = [lm.Sequences(names, numbers, starts, k, np.empty(0, np.uint64)) for k in (1, 2, 3)]
        counts, types = [s.counts(np.ones(len(numbers))) for s in seen], [np.ones(len(lm.groups(s.keys)), np.int64) for s in seen]
        lm.Automaton(seen, counts, types, starts, 2000, (0.1, 1e6), blend)

    assert peak_bytes(build) < 160 * len(numbers)


def test_memory_of_a_slot():
    """Two slots are added up beside an executor's JVM; before, one took over 60 bytes a key."""
    r = np.random.default_rng(4)
    pool = np.sort(r.integers(0, 1 << 63, 1_200_000, np.uint64) >> np.uint64(1) << np.uint64(1))
    rows = []
    for b in range(40):
        keys = np.unique(r.choice(pool, 40_000))
        rows.append((0, str(b), shared.pack_sorted(keys), shared.pack_counts(np.ones(len(keys), np.int64)), shared.pack_counts(np.zeros(len(keys), np.int64))))
    table = pa.table({c: pa.array(x, t) for c, x, t in zip(("slot", "block", "keys", "counts", "tuned"), zip(*rows), (pa.int32(), pa.string(), pa.binary(), pa.binary(), pa.binary()))})
    assert peak_bytes(lambda: lm._answer(table, 3, 500_000, True)) < 50 * 1_600_000


def test_repeated_documents_score_higher(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=60))) for i in range(300)]
    rows += [(1000 + i, t) for i, t in rows[:40]]
    got = {g.doc_id: g.score / g.n_tokens for g in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if rest(g.doc_id) != 0}
    twice = [x for i, x in got.items() if i < 40 and rest(i + 1000) != 0]
    once = [x for i, x in got.items() if 40 <= i < 1000]
    assert np.mean([x > np.quantile(once, 0.95) for x in twice]) > 0.9


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
