"""Plain versions of the operators, one row at a time."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import xxhash

from quern.llm import minhash as m
from quern.llm import mixing, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def xx(value, seed=42):
    """Spark's xxhash64 of a string, or of a small number."""
    raw = value.encode() if isinstance(value, str) else int(value).to_bytes(4, "little", signed=True)
    return xxhash.xxh64_intdigest(raw, seed)


def xx_long(value, seed=42):
    return xxhash.xxh64_intdigest((int(value) % (1 << 64)).to_bytes(8, "little"), seed)


def grams(text):
    codes = [signed(xx(w)) % 65536 - 32768 for w in WORD.findall(text or "")]
    return [c % quality_rules.BUCKETS for c in codes] + [signed(xx(b, xx(a))) % quality_rules.BUCKETS for a, b in zip(codes, codes[1:])]


def quality_verdicts(docs, trusted):
    """{row number: (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)} of (doc_id, text) rows."""
    raw, target = Counter(), Counter()
    for i, t in docs:
        raw.update(grams(t))
        if i in trusted:
            target.update(grams(t))
    a, n_raw, n_target = quality_rules.ALPHA, sum(raw.values()), sum(target.values())
    weight = {b: round(quality_rules.UNIT * (math.log(target[b] + a) - math.log(raw[b] * n_target / n_raw + a))) if n_target else 0 for b in raw}
    out = {}
    for k, (_, t) in enumerate(docs):
        t = t or ""
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        g = grams(t)
        llr = sum(weight[b] for b in g) / (quality_rules.UNIT * len(g)) if g else 0.0
        out[k] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, not failed and llr >= quality_rules.THRESHOLD)
    return out


def near_classes(docs):
    """The class id of each (doc_id, text) row, by all pairs."""
    df = np.zeros(m.DF_BUCKETS, np.int64)
    for _, t in docs:
        df += np.bincount(m._bucket(m.shingles(t)[0]), minlength=m.DF_BUCKETS)
    idf = m.idf_of(df)
    texts = sorted({t or "" for _, t in docs})
    sets = [m.weights(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and m.similarity(sets[i], sets[j]) >= m.SIMILARITY - 1e-9:
                parent[root(i)] = root(j)
    of = {t: root(i) for i, t in enumerate(texts)}
    names = {}
    for i, t in docs:
        r = of[t or ""]
        names[r] = min((x for x in (names.get(r), i) if x is not None), default=None)
    return [names[of[t or ""]] for _, t in docs]


def mixed(docs, seed=mixing.SEED):
    """[(doc_id, size, source_size, target, taken, texts)] of (doc_id, source, text) rows."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size(t) for _, x, t in docs if x == s) for s in sources]
    want = mixing.targets(sizes)
    step = mixing.BLOCK_WORDS
    quota = mixing.sainte_lague(want, round(sum(want) / step), [2 * math.ceil(n / step) for n in sizes])
    out = []
    for s, n, target, q in zip(sources, sizes, want, quota):
        rows = [r for r in docs if r[1] == s]
        n_shards = max(1, math.ceil(len(rows) / mixing.SHARD_DOCS))
        tie = lambda t: signed(xx(t)) if t is not None else 42
        place = lambda r: signed(xx_long(r[0] if r[0] is not None else tie(r[2]) % (1 << 64), xx(seed))) % n_shards  # noqa: B023, E731
        shards = [[r for r in rows if place(r) == k] for k in range(n_shards)]
        words = [sum(size(t) for *_, t in x) for x in shards]
        used = [k for k in range(n_shards) if shards[k]]
        seats = mixing.sainte_lague([words[k] for k in used], q, [2 * math.ceil(words[k] / step) for k in used])
        for k, seat in zip(used, seats):
            blocks = max(1, math.ceil(words[k] / step))
            a = (seed * 2654435761 + k * 40503) % max(math.ceil(words[k] / step), 1)
            while math.gcd(a, blocks) != 1:
                a += 1
            order = lambda r: (signed(xx(seed, xx_long(r[0]) if r[0] is not None else 42)), r[0] if r[0] is not None else -1, size(r[2]), tie(r[2]))  # noqa: B023, E731
            start = 0
            for i, _, t in sorted(shards[k], key=order):
                w = WORD.findall(t or "")
                base, rest = divmod(seat, blocks)
                picked = [x for j, x in enumerate(w) if ((start + j) // step * a + seed) % blocks < rest]
                texts = [t] * base * bool(w) + ([t if len(picked) == len(w) else " ".join(picked)] if picked else [])
                out.append((i, len(w), n, target, base * len(w) + len(picked), texts))
                start += len(w)
    return out


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()
